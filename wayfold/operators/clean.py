"""Cleaning: copies, quality flags, validity. The thresholds are parameters of ours where nothing prescribes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.functions.core import cases, names_where
from wayfold.schema import ACTIVITY_MAX_SPEED, MAX_ACCELERATION, MAX_ACCEPTABLE_GAP, MAX_ACCURACY, MAX_SPEED, MIN_UPDATE_INTERVAL


def activity_max(activity: Column) -> Column:
    return cases(*[(activity == a, F.lit(v)) for a, v in ACTIVITY_MAX_SPEED.items()], other=F.lit(50.0))


def without_copies(events: DataFrame) -> DataFrame:
    """One event for each user, trip, time and place: the first to arrive."""
    same = Window.partitionBy("user_id", "trip_id", "timestamp_unix", "lat", "lon").orderBy("arrival_seq", "copy_no", "event_id")
    return events.withColumn("_nth", F.row_number().over(same)).filter("_nth = 1").drop("_nth")


def arrival_flags(events: DataFrame) -> DataFrame:
    """events with the flags that need the order of arrival: the clock went back; the time is that of the event before."""
    order = Window.partitionBy("user_id", "trip_id").orderBy("arrival_seq", "copy_no", "event_id")
    gap = F.col("timestamp_unix") - F.lag("timestamp_unix").over(order)
    return events.withColumns({"out_of_order": F.coalesce(gap < 0, F.lit(False)), "same_time": F.coalesce(F.abs(gap) <= 0.001, F.lit(False))})


def quality_flags(points: DataFrame, *, max_speed: float = MAX_SPEED, max_acceleration: float = MAX_ACCELERATION, max_accuracy: float = MAX_ACCURACY, drift_metres: float = 10.0) -> DataFrame:
    """points (with features) with quality_flags (array), has_issues and is_valid. Only coordinates make a point invalid."""
    v, acc, dt, moving = F.col("speed"), F.col("coords_accuracy"), F.col("time_delta"), F.col("is_moving") == 1
    bad = ~geo.is_valid_coordinate(F.col("lat"), F.col("lon")) | geo.is_null_island(F.col("lat"), F.col("lon"))
    has = set(points.columns)
    flags = names_where(
        invalid_coordinates=bad,
        unrealistic_speed=v > max_speed,
        unrealistic_acceleration=F.abs("acceleration") > max_acceleration,
        teleportation=F.col("calc_speed") > max_speed,
        low_gps_accuracy=acc > max_accuracy,
        gps_drift=~moving & (F.col("distance") > F.greatest(F.coalesce(acc, F.lit(0.0)), F.lit(drift_metres))),
        duplicate_timestamp=F.col("same_time") if "same_time" in has else F.abs(dt) <= 0.001,
        timestamp_out_of_order=F.col("out_of_order") if "out_of_order" in has else dt < 0,
        large_time_gap=dt > MAX_ACCEPTABLE_GAP,
        rapid_updates=dt < MIN_UPDATE_INTERVAL,
        speed_activity_mismatch=v > 1.5 * activity_max(F.col("activity")),
        movement_stillness_conflict=(F.col("activity") == "still") & moving,
        missing_speed=v.isNull(),
        missing_accuracy=acc.isNull(),
    )
    return points.withColumn("quality_flags", flags).withColumns({"has_issues": F.size("quality_flags") > 0, "is_valid": ~bad})
