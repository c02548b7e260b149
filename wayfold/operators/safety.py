"""Crashes, falls and batteries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.core import cases

GRAVITY = 9.81


def with_g(readings: DataFrame) -> DataFrame:
    return readings.withColumn("g", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) / GRAVITY)


def crashes(readings: DataFrame) -> DataFrame:
    """One row per detection of readings (detection_id, seq, x, y, z, at, speed_kmh)."""
    order = Window.partitionBy("detection_id").orderBy("seq")
    r = with_g(readings).withColumn("dg", F.abs(F.col("g") - F.lag("g").over(order)))
    peak = r.groupBy("detection_id").agg(F.max("g").alias("peak"), F.min_by("seq", F.struct(-F.col("g"), "seq")).alias("peak_seq"), F.max("dg").alias("max_change"), F.max("speed_kmh").alias("speed_kmh"), F.min(F.when(F.col("g") >= 4, F.col("at"))).alias("a"), F.max(F.when(F.col("g") >= 4, F.col("at"))).alias("b"), F.count_if(F.col("g") >= 4).alias("hits"))
    after = r.join(peak.select("detection_id", "peak_seq"), "detection_id").filter("seq > peak_seq").groupBy("detection_id").agg(F.avg("g").alias("after"))
    p = peak.join(after, "detection_id", "left")
    bump = F.coalesce((F.col("speed_kmh") < 10) & (F.col("peak") < 8), F.lit(False))
    moving = F.coalesce(F.abs(F.col("after") - 1) > 0.3, F.lit(True))
    crash = (F.col("peak") >= 4) & ~bump
    g = F.col("peak")
    severity = F.when(crash, cases((g < 8, "minor"), (g < 15, "moderate"), (g < 25, "severe"), other="critical")).otherwise("none")
    conf = F.least(F.lit(1.0), 0.5 + (g - 4) / 20 + F.when(F.col("speed_kmh") > 30, 0.15).otherwise(0.0) + F.when(F.col("max_change") > 5, 0.1).otherwise(0.0) + F.when(~moving, 0.1).otherwise(0.0))
    return p.select("detection_id", "peak", crash.alias("is_crash"), severity.alias("severity"), moving.alias("moving_after"), F.when(F.col("hits") >= 2, (F.col("b") - F.col("a")) * 1000).otherwise(0.0).alias("impact_ms"), F.when(crash, conf).otherwise(0.0).alias("crash_confidence"), severity.isin("moderate", "severe", "critical").alias("alert"))


def falls(readings: DataFrame) -> DataFrame:
    """One row per detection of readings (..., user_age): free fall, then an impact within four readings.

    The partner of a free-fall reading is found by looking ahead four rows, without a join.
    """
    order = Window.partitionBy("detection_id").orderBy("seq")
    r = with_g(readings)
    ahead = F.coalesce(*[F.when(F.lead("g", i).over(order) >= 3, F.struct(F.lead("g", i).over(order).alias("g"), F.lead("seq", i).over(order).alias("seq"))) for i in range(1, 5)])
    r = r.withColumn("hit", F.when(F.col("g") < 0.4, ahead)).withColumn("free", F.col("g") < 0.4)
    s = r.groupBy("detection_id").agg(F.max("hit.g").alias("impact"), F.min_by("hit.seq", F.when(F.col("hit").isNotNull(), F.struct(-F.col("hit.g"), "seq"))).alias("hit_seq"), F.min(F.when(F.col("free"), F.col("at"))).alias("a"), F.max(F.when(F.col("free"), F.col("at"))).alias("b"), F.max("at").alias("last"), F.max("user_age").alias("age"))
    later = r.join(s.select("detection_id", "hit_seq"), "detection_id").filter("seq > hit_seq").groupBy("detection_id").agg(F.avg("g").alias("after"), F.max("at").alias("end"), F.min("at").alias("begin"))
    p = s.join(later, "detection_id", "left")
    still = F.coalesce(F.abs(F.col("after") - 1) < 0.3, F.lit(False))
    seconds = F.when(still, F.col("end") - F.col("begin")).otherwise(0.0)
    i = F.col("impact")
    base = cases((i.isNull(), "none"), ((i >= 10) & still, "critical"), ((i >= 8) | (seconds > 10), "severe"), (i >= 5, "moderate"), other="minor")
    old = F.coalesce(F.col("age") > 65, F.lit(False))
    severity = cases((old & (base == "minor"), "moderate"), (old & (base == "moderate"), "severe"), other=base)
    conf = F.least(F.lit(1.0), 0.5 + F.when(i >= 5, 0.2).otherwise(0.0) + F.when(still, 0.2).otherwise(0.0) + F.when(old, 0.1).otherwise(0.0))
    return p.select("detection_id", i.isNotNull().alias("is_fall"), F.coalesce(i, F.lit(0.0)).alias("impact"), F.coalesce(F.col("b") - F.col("a"), F.lit(0.0)).alias("free_fall_seconds"), still.alias("stationary_after"), severity.alias("severity"), F.when(i.isNotNull(), conf).otherwise(0.0).alias("fall_confidence"))


def batteries(reports: DataFrame) -> DataFrame:
    level = F.col("battery_level")
    status = cases((F.col("is_charging"), "charging"), (level <= 10, "critical"), (level <= 20, "low"), other="healthy")
    return reports.withColumns({
        "status": status, "hours_left": F.when((F.col("drain_rate_per_hour") > 0) & ~F.col("is_charging"), F.round(level / F.col("drain_rate_per_hour") + 1e-9, 1)), "alert": status.isin("critical", "low"),
        "hot": F.coalesce(F.col("battery_temperature") > 45, F.lit(False)),
    })
