"""Trip aggregates of points with features and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["user_id", "trip_id"]


def activity_shares(points: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: the share of each activity."""
    counts = points.groupBy(*keys, "activity").agg(F.count("*").alias("n"))
    return counts.select(*keys, "activity", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("share"))


def primary_activity(points: DataFrame, keys: list[str], order: str = "rn") -> DataFrame:
    """The most frequent activity; of equals the one that appears first."""
    counts = points.groupBy(*keys, "activity").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by("activity", F.struct("n", -F.col("first"))).alias("primary_activity"))


def trip_features(points: DataFrame) -> DataFrame:
    """One row per trip. total_stop_duration adds up running durations; stop_time_seconds is the time spent in stops."""
    order = Window.partitionBy(*KEYS).orderBy("timestamp_unix", "point_index", "event_id")
    p = points.withColumn("_stopped", F.lag("is_stop").over(order))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = p.groupBy(*KEYS).agg(
        (F.max("timestamp_unix") - F.min("timestamp_unix")).alias("duration"), F.avg("update_rate").alias("mean_update_rate"), zero(F.sum("distance")).alias("total_distance"), F.avg("speed").alias("mean_speed"),
        F.max("speed").alias("max_speed"), F.count_if("is_stop").alias("num_stops"), zero(F.sum("stop_duration")).alias("total_stop_duration"),
        zero(F.sum(F.when(F.col("is_stop") & F.col("_stopped"), F.col("time_delta")))).alias("stop_time_seconds"), F.count_if("has_gap").alias("num_gaps"), zero(F.sum("gap_duration")).alias("total_gap"), F.count("*").alias("n"),
    )
    return out.join(primary_activity(points, KEYS), KEYS)


def trip_summary(points: DataFrame) -> DataFrame:
    out = points.groupBy(*KEYS).agg(
        F.min("timestamp_unix").alias("start_time"), F.max("timestamp_unix").alias("end_time"), (F.max("timestamp_unix") - F.min("timestamp_unix")).alias("duration"), F.coalesce(F.sum("distance"), F.lit(0.0)).alias("distance"),
        F.min_by("lat", "rn").alias("start_lat"), F.min_by("lon", "rn").alias("start_lon"), F.max_by("lat", "rn").alias("end_lat"), F.max_by("lon", "rn").alias("end_lon"),
        F.count("*").alias("points"), F.count_if("is_valid").alias("valid_points"), F.avg("confidence").alias("mean_confidence"),
    )
    return out.join(primary_activity(points, KEYS), KEYS)
