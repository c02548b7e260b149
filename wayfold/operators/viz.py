"""Tables behind timelines, heat maps and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.core import between, cases, names_where

KEY = ["user_id", "trip_id", "point_index", "event_id"]


def fast_timeline(points: DataFrame) -> DataFrame:
    """From confidence alone: risk = 1 - confidence."""
    c = F.col("confidence")
    text = cases((c >= 0.75, "reliable"), (c >= 0.5, "acceptable"), (c >= 0.25, "doubtful"), other="unreliable")
    return points.select(*KEY, "timestamp_unix", (1 - c).alias("risk"), (c < 0.5).alias("anomalous"), (c < 0.25).alias("spoofed"), F.when(c < 0.5, (0.5 - c) * 2).otherwise(0.0).alias("spoof_likelihood"), ((c >= 0.5) & (F.size("quality_flags") == 0)).alias("trusted"), text.alias("explanation"))


def full_timeline(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """A session's risk spread over its points by their confidence."""
    s = sessions.select("user_id", "trip_id", "session_risk", (F.col("spoofing") >= 0.5).alias("spoofed"))
    c = F.col("confidence")
    out = points.join(s, ["user_id", "trip_id"]).withColumn("risk", between(F.col("session_risk") * (1 + 0.2 * (1 - c)), 0.0, 1.0))
    return out.select(*KEY, "timestamp_unix", "risk", "spoofed", ((c >= 0.5) & (F.col("risk") < 0.5) & ~F.col("spoofed")).alias("trusted"), (c < 0.7).alias("shows_anomalies"))


def timeline(rows: DataFrame, user_id: int, *, trip_id: int | None = None, trusted_only: bool = False, limit: int = 100) -> DataFrame:
    found = rows.filter(F.col("user_id") == user_id)
    found = found if trip_id is None else found.filter(F.col("trip_id") == trip_id)
    found = found.filter("trusted") if trusted_only else found
    return found.orderBy("timestamp_unix", "trip_id", "point_index", "event_id").limit(limit)


def metrics(rows: DataFrame, *, since: float | None = None) -> DataFrame:
    """Per user: counts and rates of a timeline, from a time on if given."""
    found = rows if since is None else rows.filter(F.col("timestamp_unix") >= since)
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    return found.groupBy("user_id").agg(F.count("*").alias("points"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"), share("trusted").alias("trust_rate"), share("anomalous").alias("anomaly_rate"), share("spoofed").alias("spoof_rate"))


def heat(points: DataFrame, kind: str = "risk") -> DataFrame:
    """Points with weight and category; an unknown kind weighs 0.5."""
    c = F.col("confidence")
    weight = {"risk": 1 - c, "anomaly": F.when(c < 0.5, 1.0).otherwise(0.1), "spoofing": F.when(c < 0.5, (0.5 - c) * 2).otherwise(0.0)}.get(kind, F.lit(0.5))
    out = points.select(*KEY, "lat", "lon", weight.alias("weight"))
    return out.withColumn("category", cases((F.col("weight") >= 0.7, "high"), (F.col("weight") >= 0.4, "medium"), other="low"))


def bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("user_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))])


def health_status(risk: Column) -> Column:
    return cases((risk < 0.15, "excellent"), (risk < 0.3, "good"), (risk < 0.5, "fair"), (risk < 0.7, "poor"), other="critical")


def dashboard(rows: DataFrame) -> DataFrame:
    m = metrics(rows)
    concerns = names_where(high_risk=F.col("mean_risk") >= 0.5, many_anomalies=F.col("anomaly_rate") > 0.2, spoofing=F.col("spoof_rate") > 0.05, low_trust=F.col("trust_rate") < 0.5)
    return m.select("user_id", ((1 - F.col("mean_risk")) * 100).alias("health"), health_status(F.col("mean_risk")).alias("status"), F.array_join(concerns, ",").alias("concerns"))


def explain_point() -> Column:
    """The first three of what there is to say about a located point."""
    parts = F.array_compact(F.array(
        F.when(F.col("risk") >= 0.5, F.concat(F.lit("risk is "), F.col("risk_level"))), F.when(F.col("confidence") < 0.5, F.lit("position is uncertain")), F.when(F.col("is_anomalous"), F.lit("behaviour is unusual")),
        F.when(F.col("requires_attention"), F.lit("position may be forged")), F.when(F.col("deviation") > 0.5, F.lit("differs from habits")),
    ))
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 3), ". ")).otherwise("nothing unusual")
