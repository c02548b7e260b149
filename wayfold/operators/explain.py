"""Explanations in words: what a score is made of, largest part first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def percent(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 1), F.lit("%"))


def factors(**parts: Column) -> Column:
    """Array of (factor, contribution), the largest contribution first."""
    rows = F.array(*[F.struct((-c).alias("order"), F.lit(n).alias("factor"), c.alias("contribution")) for n, c in parts.items()])
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["factor"].alias("factor"), r["contribution"].alias("contribution")))


def narrative(risk: Column, level: Column, reasons: Column) -> Column:
    lead = F.concat(F.lit("Risk is "), level, F.lit(" ("), percent(risk), F.lit(")"))
    told = F.array_join(F.transform(F.slice(reasons, 1, 5), title), ", ")
    return F.when(F.size(reasons) > 0, F.concat(lead, F.lit(": "), told, F.lit("."))).otherwise(F.concat(lead, F.lit(": nothing stands out.")))


def sessions(scored: DataFrame) -> DataFrame:
    parts = factors(
        high_risk_share=0.25 * F.least(F.lit(1.0), 2 * F.col("high_share")), largest_risk=0.2 * F.col("max_risk"), average_risk=0.2 * F.col("avg_risk"), spoofing=0.2 * F.col("spoofing"), integrity=0.15 * (1 - F.col("integrity"))
    )
    return scored.select("user_id", "trip_id", "session_risk", narrative(F.col("session_risk"), F.col("session_level"), F.col("session_reasons")).alias("explanation"), F.to_json(parts).alias("factors"))


def points(located: DataFrame) -> DataFrame:
    parts = factors(uncertain_position=0.3 * (1 - F.col("confidence")), anomaly=0.3 * F.col("anomaly_score"), spoofing=0.25 * F.greatest("spoofing", "tampering"), unlike_baseline=0.15 * F.col("deviation"))
    return located.select("user_id", "trip_id", "point_index", "event_id", narrative(F.col("risk"), F.col("risk_level"), F.col("reasons")).alias("explanation"), F.to_json(parts).alias("factors"))
