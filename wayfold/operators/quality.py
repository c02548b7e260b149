"""Data quality reports of scored points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.schema import MATURE_POINTS, MATURE_TRIPS


def ingestion_counters(events: DataFrame) -> DataFrame:
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return events.agg(F.count("*").alias("total_rows"), F.count_if(ok).alias("successful_rows"), F.count_if(~ok).alias("failed_rows"))


def report(points: DataFrame) -> DataFrame:
    """One row per trip and one per user (trip_id null), in one pass."""
    c = F.col("confidence")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = points.rollup("user_id", "trip_id").agg(
        F.grouping_id().alias("_level"), F.count("*").alias("total_points"), F.count_if("is_valid").alias("valid_points"), F.count_if("has_issues").alias("flagged_points"), zero(F.avg(c)).alias("mean_confidence"),
        zero(F.stddev_pop(c)).alias("std_confidence"), zero(F.min(c)).alias("min_confidence"), zero(F.max(c)).alias("max_confidence"), F.count_if(c >= 0.75).alias("high_confidence"),
        F.count_if((c >= 0.5) & (c < 0.75)).alias("medium_confidence"), F.count_if(c < 0.5).alias("low_confidence"), F.avg(F.when(F.col("is_valid"), 1.0).otherwise(0.0)).alias("validity_rate"),
    )
    return out.filter("_level < 3").drop("_level")


def flag_breakdown(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["user_id"]
    return points.select(*keys, F.explode("quality_flags").alias("flag")).groupBy(*keys, "flag").agg(F.count("*").alias("n"))


def confidence_distribution(points: DataFrame) -> DataFrame:
    c = F.col("confidence")
    bands = {"high": c >= 0.75, "medium": (c >= 0.5) & (c < 0.75), "low": c < 0.5}
    return points.groupBy("user_id").agg(*[F.count_if(x).alias(f"{n}_count") for n, x in bands.items()], *[F.round(F.count_if(x) / F.count("*"), 4).alias(f"{n}_share") for n, x in bands.items()])


def user_summary(points: DataFrame, *, mature_trips: int = MATURE_TRIPS, mature_points: int = MATURE_POINTS) -> DataFrame:
    kept = F.col("confidence") >= 0.5
    n, total = F.count("*"), F.sum(F.round(F.col("confidence") * 10000).cast("long"))  # confidences have four decimals: their sum is exact
    mean = F.floor((200 * total + n) / (2.0 * n)) / 1e6  # six decimals, halves upward
    mature = (F.countDistinct(F.when(kept, F.col("trip_id"))) >= mature_trips) & (F.count_if(kept) >= mature_points)
    return points.groupBy("user_id").agg(F.countDistinct("trip_id").alias("trips"), n.alias("events"), mean.alias("mean_confidence"), mature.alias("is_mature"))
