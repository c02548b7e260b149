"""Confidence of a point: six components, penalties for quality flags, and what explains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.core import cases
from wayfold.operators.clean import activity_max
from wayfold.schema import CONFIDENCE_WEIGHTS, FLAG_PENALTIES, MAX_ACCELERATION, MAX_PENALTY, MAX_SPEED


def gps_score(acc: Column) -> Column:
    return cases((acc.isNull(), 0.3), (acc <= 5, 1.0), (acc <= 10, 0.9), (acc <= 25, 0.7), (acc <= 50, 0.5), (acc <= 100, 0.3), other=0.1)


def speed_score(v: Column, activity: Column, diff: Column, calc: Column, max_speed: float = MAX_SPEED) -> Column:
    ratio = F.when(calc > 1, F.abs(diff) / calc)
    return F.least(
        F.lit(1.0), cases((v > max_speed, 0.1), (v > 0.8 * max_speed, 0.5)), F.when(v > 1.5 * activity_max(activity), 0.6), F.when(v.isNull(), 0.7), cases((ratio > 0.5, 0.5), (ratio > 0.25, 0.7))
    )


def acceleration_score(a: Column, most: float = MAX_ACCELERATION) -> Column:
    a = F.abs(a)
    return cases((a.isNull(), 0.8), (a > most, 0.2), (a > 10, 0.4), (a > 5, 0.7), (a > 3, 0.85), other=1.0)


def temporal_score(dt: Column) -> Column:
    return cases((dt.isNull(), 0.8), (dt > 300, 0.2), (dt > 60, 0.4), (dt > 30, 0.6), (dt < 0.5, 0.6), (dt <= 5, 1.0), (dt <= 15, 0.9), other=0.8)


def activity_score(activity: Column, confidence: Column, moving: Column, v: Column, calc: Column) -> Column:
    v, calc = F.coalesce(v, F.lit(0.0)), F.coalesce(calc, F.lit(0.0))
    still = activity == "still"
    base = cases(
        (still & moving & (v > 1), 0.5), (still & (calc > 2), 0.6), (activity.isin("running", "walking", "in_vehicle") & ~moving & (v < 0.5) & (calc < 0.5), 0.6), other=1.0
    )
    return base * (0.5 + 0.5 * confidence / 100.0)


def continuity_score(flags: Column, turn: Column, calc: Column) -> Column:
    sharp = (F.abs(turn) > 150) & (calc > 5)
    return cases((F.array_contains(flags, "teleportation"), 0.1), (F.array_contains(flags, "gps_drift"), 0.5), (sharp, 0.7), other=1.0)


def penalty(flags: Column) -> Column:
    total = F.lit(0.0)
    for flag, amount in FLAG_PENALTIES.items():
        total = total + F.when(F.array_contains(flags, flag), amount).otherwise(0.0)
    return F.least(F.lit(MAX_PENALTY), total)


def level(score: Column) -> Column:
    return cases((score >= 0.9, "excellent"), (score >= 0.75, "good"), (score >= 0.5, "moderate"), (score >= 0.25, "low"), other="unreliable")


def reasons() -> Column:
    """What lowered the components, in their order."""
    acc, v, calc, diff, a, dt, moving, activity = (F.col(c) for c in ("coords_accuracy", "speed", "calc_speed", "speed_diff", "acceleration", "time_delta", "is_moving", "activity"))
    moving, a = moving == 1, F.abs(a)
    v0, c0 = F.coalesce(v, F.lit(0.0)), F.coalesce(calc, F.lit(0.0))
    parts = [
        cases((acc.isNull(), "no_gps_accuracy"), ((acc > 25) & (acc <= 50), "moderate_gps_accuracy"), ((acc > 50) & (acc <= 100), "poor_gps_accuracy"), (acc > 100, "very_poor_gps_accuracy")),
        cases((v > 100, "impossible_speed"), (v > 80, "very_high_speed")),
        F.when(v > 1.5 * activity_max(activity), "speed_activity_mismatch"),
        F.when((calc > 1) & (F.abs(diff) / F.when(calc > 0, calc) > 0.5), "large_speed_discrepancy"),
        cases((a > 15, "impossible_acceleration"), (a > 10, "emergency_acceleration")),
        cases((dt > 30, F.concat(F.lit("time_gap_"), dt.cast("bigint"), F.lit("s"))), (dt < 0.5, "rapid_update")),
        cases(
            ((activity == "still") & moving & (v0 > 1), "still_but_moving"), ((activity == "still") & (c0 > 2), "still_but_displaced"),
            (activity.isin("running", "walking", "in_vehicle") & ~moving & (v0 < 0.5) & (c0 < 0.5), "active_but_stationary"),
        ),
        cases((F.array_contains("quality_flags", "teleportation"), "teleportation_detected"), (F.array_contains("quality_flags", "gps_drift"), "gps_drift_detected")),
        F.when(~F.array_contains("quality_flags", "teleportation") & (F.abs("bearing_change") > 150) & (calc > 5), "sharp_direction_change"),
    ]
    return F.array_compact(F.array(*parts))


def score(points: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """points (features, quality_flags) with s_<component>, penalty, confidence (4 decimals), confidence_level and confidence_flags."""
    w = CONFIDENCE_WEIGHTS | (weights or {})
    moving = F.col("is_moving") == 1
    out = points.withColumns({
        "s_gps": gps_score(F.col("coords_accuracy")),
        "s_speed": speed_score(F.col("speed"), F.col("activity"), F.col("speed_diff"), F.col("calc_speed")),
        "s_acceleration": acceleration_score(F.col("acceleration")),
        "s_temporal": temporal_score(F.col("time_delta")),
        "s_activity": activity_score(F.col("activity"), F.col("activity_confidence"), moving, F.col("speed"), F.col("calc_speed")),
        "s_continuity": continuity_score(F.col("quality_flags"), F.col("bearing_change"), F.col("calc_speed")),
        "penalty": penalty(F.col("quality_flags")),
        "confidence_flags": reasons(),
    })
    total = F.lit(0.0)
    for name, weight in w.items():
        total = total + weight * F.col(f"s_{name}")
    out = out.withColumn("confidence", F.round(F.greatest(F.lit(0.0), total - F.col("penalty")) + 1e-9, 4))  # halves go up, whatever the sum's last bit
    return out.withColumn("confidence_level", level(F.col("confidence")))


def trip_statistics(points: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col("confidence")
    share = lambda x: F.avg(F.when(x, 1.0).otherwise(0.0))
    return points.groupBy(*keys).agg(
        F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_pop(c).alias("std"), share(c >= 0.75).alias("high_share"), share(c < 0.5).alias("low_share"), F.count("*").alias("n")
    )
