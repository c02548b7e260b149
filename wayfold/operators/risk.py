"""Risk of points and sessions from confidence, anomalies, spoofing and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.core import between, cases, names_where

KEYS = ["user_id", "trip_id"]


def level(risk: Column) -> Column:
    return cases((risk < 0.1, "minimal"), (risk < 0.25, "low"), (risk < 0.45, "moderate"), (risk < 0.65, "elevated"), (risk < 0.85, "high"), other="critical")


def baseline_deviation(points: DataFrame, users: DataFrame) -> DataFrame:
    """points with deviation: 0 unless the user's baseline is mature; the mean of what applies of speed, a rare activity, a rare hour.

    users: (user_id, is_mature, speed, shares, hours), a row per user.
    """
    b = users.select("user_id", F.coalesce("is_mature", F.lit(False)).alias("_mature"), F.col("speed.mean").alias("_m"), F.col("speed.std").alias("_s"), F.col("shares").alias("_shares"), F.col("hours").alias("_hours"))
    hour = F.pmod(F.floor(F.col("timestamp_unix") / 3600), F.lit(24)).cast("int")
    out = points.withColumn("hour", hour).join(b, "user_id", "left")
    share = F.get(F.transform(F.filter("_shares", lambda x: x["activity"] == F.col("activity")), lambda x: x["share"]), F.lit(0))
    parts = F.array_compact(F.array(
        F.when((F.col("_s") > 0) & F.col("speed").isNotNull(), F.least(F.lit(1.0), F.abs(F.col("speed") - F.col("_m")) / F.col("_s") / 3)), F.when(share < 0.1, F.lit(0.5)), F.when(F.get("_hours", F.col("hour")) < 0.05, F.lit(0.3))
    ))
    mean = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda t, x: t + x) / F.size(parts)).otherwise(0.0)
    return out.withColumn("deviation", F.when(F.col("_mature"), mean).otherwise(0.0)).drop("_mature", "_m", "_s", "_shares", "_hours")


def locations(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """Scored points (anomaly_score, deviation) with risk, level, reasons and trust; a session's spoofing counts for all its points."""
    s = sessions.select(*KEYS, "spoofing", "tampering", "integrity", "requires_attention")
    out = points.join(s, KEYS, "left").fillna({"spoofing": 0.0, "tampering": 0.0, "integrity": 1.0, "requires_attention": False})
    risk = 0.3 * (1 - F.col("confidence")) + 0.3 * F.col("anomaly_score") + 0.25 * F.greatest("spoofing", "tampering") + 0.15 * F.col("deviation")
    out = out.withColumn("risk", between(risk, 0.0, 1.0)).withColumn("risk_level", level(F.col("risk")))
    reasons = names_where(anomalous=F.col("is_anomalous"), deviation_from_baseline=F.col("deviation") > 0.5, spoofing_suspected=F.col("requires_attention"))
    low = F.when(F.col("confidence") < 0.5, F.concat(F.lit("low_confidence_"), F.col("confidence_level")))
    out = out.withColumn("reasons", F.array_sort(F.array_distinct(F.array_compact(F.concat(reasons, F.array(low))))))
    trusted = (F.col("risk") < 0.5) & (F.col("confidence") >= 0.5) & ~F.col("is_anomalous") & ~F.col("requires_attention")
    return out.withColumn("is_trusted", trusted)


def session_risk(located: DataFrame) -> DataFrame:
    """One row per session: risk, level, reasons, counts, trust, validity."""
    r = F.col("risk")
    high = F.avg(F.when(r >= 0.7, 1.0).otherwise(0.0))
    s = located.groupBy(*KEYS).agg(
        high.alias("high_share"), F.max(r).alias("max_risk"), F.avg(r).alias("avg_risk"), F.max("spoofing").alias("spoofing"), F.max("tampering").alias("tampering"), F.min("integrity").alias("integrity"),
        F.count("*").alias("points"), F.count_if("is_anomalous").alias("anomalies"), F.avg(F.when(F.col("is_trusted"), 1.0).otherwise(0.0)).alias("trust_rate"), F.avg("confidence").alias("mean_confidence"),
    )
    risk = 0.25 * F.least(F.lit(1.0), 2 * F.col("high_share")) + 0.2 * F.col("max_risk") + 0.2 * F.col("avg_risk") + 0.2 * F.col("spoofing") + 0.15 * (1 - F.col("integrity"))
    s = s.withColumn("session_risk", between(risk, 0.0, 1.0))
    reasons = names_where(
        high_risk_points=F.col("high_share") > 0.1, extreme_point_risk=F.col("max_risk") >= 0.8, elevated_average_risk=F.col("avg_risk") > 0.5, spoofing_suspected=(F.col("spoofing") >= 0.5) | (F.col("tampering") >= 0.5), poor_integrity=F.col("integrity") < 0.8
    )
    advice = names_where(
        review_session=F.col("session_risk") >= 0.7, verify_location=F.col("spoofing") >= 0.5, check_device=F.col("tampering") >= 0.5, look_into_anomalies=F.col("anomalies") / F.col("points") > 0.2
    )
    return s.withColumns({
        "session_level": level(F.col("session_risk")), "session_reasons": reasons, "recommendations": F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("no_action"))),
        "is_valid": (F.col("session_risk") < 0.7) & (F.col("spoofing") < 0.5) & (F.col("trust_rate") >= 0.5),
    })


def flagged_points(located: DataFrame, *, shown: int = 10) -> DataFrame:
    """A session's points of highest risk, at most `shown`, and of those the ones from 0.5."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc(F.round("risk", 9)), "timestamp_unix", "point_index", "event_id")
    return located.withColumn("nth", F.row_number().over(order)).filter((F.col("nth") <= shown) & (F.col("risk") >= 0.5))


def user_risk(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("session_risk") >= 0.7).alias("high_risk_sessions"), F.avg("session_risk").alias("mean_risk"))


def process_summary(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id").agg(
        F.count("*").alias("sessions"), F.sum("points").alias("points"), F.count_if(F.col("anomalies") > 0).alias("sessions_with_anomalies"), F.count_if(F.col("session_level").isin("high", "critical")).alias("high_risk_sessions"), F.count_if("is_valid").alias("valid_sessions")
    )


def session_page(sessions: DataFrame, user_id: int, *, min_trust: float = 0.0, trusted_only: bool = False, limit: int = 20, offset: int = 0) -> DataFrame:
    found = sessions.filter((F.col("user_id") == user_id) & (F.col("trust_rate") >= min_trust))
    found = found.filter("is_valid") if trusted_only else found
    order = Window.partitionBy("user_id").orderBy("trip_id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth").between(offset + 1, offset + limit))
