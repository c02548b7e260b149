"""What is known of each user, in one row: header, metrics, ends of histograms, shares of activities and hours.

Points are read once by user and once by activity and hour; the separate
operators (baseline, anomaly, profile) give the same in long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.stats import describe
from wayfold.operators.anomaly import hbos_ends
from wayfold.operators.baseline import METRICS
from wayfold.operators.profile import hour_of
from wayfold.schema import MATURE_POINTS, MATURE_TRIPS

KEYS = ["user_id", "trip_id"]
KEPT = "confidence >= 0.5"


def with_trips(points: DataFrame) -> DataFrame:
    """points with first_of_trip (a trip's first point of enough confidence) and, there only, the trip_duration of trips with two such points.

    The windows go by the keys and the order of the features, so that they share their shuffle and sort.
    """
    order = Window.partitionBy(*KEYS).orderBy("timestamp_unix", "point_index", "event_id")
    trip, upto = (order.rowsBetween(Window.unboundedPreceding, end) for end in (Window.unboundedFollowing, 0))
    kept = F.coalesce(F.expr(KEPT), F.lit(False))
    at = F.when(kept, F.col("timestamp_unix"))
    out = points.withColumns({"first_of_trip": kept & (F.count_if(kept).over(upto) == 1), "_n": F.count_if(kept).over(trip), "_span": F.max(at).over(trip) - F.min(at).over(trip)})
    return out.withColumn("trip_duration", F.when(F.col("first_of_trip") & (F.col("_n") >= 2), F.col("_span"))).drop("_n", "_span")


def metrics_by_user(points: DataFrame) -> DataFrame:
    """points (with_trips) by user: header, a struct per metric (null without a point of enough confidence) and the ends of histograms."""
    kept = F.expr(KEPT)
    at, stop = F.when(kept, F.col("timestamp_unix")), F.when(kept & F.col("is_stop") & (F.col("stop_duration") > 0), F.col("stop_duration"))
    values = {"speed": F.when(kept, F.col("speed")), "update_rate": F.when(kept, F.col("update_rate")), "stop_duration": stop, "trip_duration": F.col("trip_duration")}
    out = points.groupBy("user_id").agg(
        F.count_if(F.col("first_of_trip") & F.col("trip_id").isNotNull()).alias("trips"), F.count_if(kept).alias("points"), ((F.max(at) - F.min(at)) / 86400).alias("days"),
        F.median(F.when(kept, F.col("confidence"))).alias("typical_confidence"), *[F.struct(*describe(values[m])).alias(m) for m in METRICS], F.struct(*hbos_ends()).alias("ends"),
    )
    return out.withColumns({m: F.when(F.col("points") > 0, F.col(m)) for m in METRICS})


def habits(points: DataFrame) -> DataFrame:
    """(user_id, shares, hours): the shares of activities, as structs, and of the 24 hours, as an array, among points of enough confidence."""
    counts = points.filter(KEPT).groupBy("user_id", "activity", hour_of(F.col("timestamp_unix")).alias("hour")).agg(F.count("*").alias("n"))
    lists = counts.groupBy("user_id").agg(F.sum("n").alias("total"), F.collect_list(F.struct("activity", "hour", "n")).alias("c"))  # 24 an activity at most

    def share(own) -> Column:
        return F.aggregate(F.filter("c", own), F.lit(0).cast("long"), lambda t, x: t + x["n"]) / F.col("total")

    names = F.array_distinct(F.transform("c", lambda x: x["activity"]))
    shares = F.transform(names, lambda a: F.struct(a.alias("activity"), share(lambda x: x["activity"].eqNullSafe(a)).alias("share")))
    return lists.select("user_id", shares.alias("shares"), F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: share(lambda x: x["hour"] == h)).alias("hours"))


def users(points: DataFrame, *, mature_trips: int = MATURE_TRIPS, mature_points: int = MATURE_POINTS) -> DataFrame:
    """One row per user of points (with_trips)."""
    out = metrics_by_user(points).withColumn("is_mature", (F.col("trips") >= mature_trips) & (F.col("points") >= mature_points))
    return out.join(habits(points), "user_id", "left")
