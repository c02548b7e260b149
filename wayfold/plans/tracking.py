"""The chain from tracks to scored points, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.operators import clean, confidence, features
from wayfold.sources import tracks as source


def scored(events: DataFrame) -> DataFrame:
    """Events with features, quality flags and confidence: one shuffle on (user_id, trip_id)."""
    return confidence.score(clean.quality_flags(features.features(source.normalize(events))))


def scored_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(source.tracks(spark, sf_dir))


def intelligence(points: DataFrame) -> DataFrame:
    """The public record of a point."""
    return points.select(
        "user_id", "trip_id", "point_index", "event_id", "timestamp_unix", "lat", "lon", F.col("speed").alias("speed_ms"), "activity", "confidence", "confidence_level",
        F.col("has_issues").alias("has_quality_issues"), F.size("quality_flags").alias("quality_issue_count"),
    )


def page(points: DataFrame, *, trip_id: int | None = None, min_confidence: float = 0.0, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a user's points in order, with the number of all that match. Pass one user's points."""
    found = points if trip_id is None else points.filter(F.col("trip_id") == trip_id)
    found = found.filter(F.col("confidence") >= min_confidence)
    order = ["trip_id", "timestamp_unix", "point_index", "event_id"]
    here = found.orderBy(order).offset(offset).limit(limit).withColumn("total", F.lit(found.count()).cast("long"))
    return here.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(order)) + offset)
