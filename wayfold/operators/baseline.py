"""Behavioural baselines of users: learned from points with confidence 0.5 or more, blended, and compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.core import cases
from wayfold.functions.stats import describe
from wayfold.operators.trips import activity_shares
from wayfold.schema import MATURE_POINTS, MATURE_TRIPS

METRICS = ("speed", "update_rate", "stop_duration", "trip_duration")


def trip_durations(points: DataFrame) -> DataFrame:
    kept = points.filter("confidence >= 0.5").groupBy("user_id", "trip_id").agg((F.max("timestamp_unix") - F.min("timestamp_unix")).alias("trip_duration"), F.count("*").alias("n"))
    return kept.filter("n >= 2").drop("n")


def metrics(points: DataFrame) -> DataFrame:
    """Long form: (user_id, metric, mean, median, std, min, max, p5, p25, p75, p95, sample_size). A metric without values has zeros."""
    kept = points.filter("confidence >= 0.5")
    one = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    stop = F.when(F.col("is_stop") & (F.col("stop_duration") > 0), F.col("stop_duration"))
    values = kept.select("user_id", F.inline(F.array(one("speed", F.col("speed")), one("update_rate", F.col("update_rate")), one("stop_duration", stop), one("trip_duration", F.lit(None).cast("double")))))
    values = values.unionByName(trip_durations(points).select("user_id", F.lit("trip_duration").alias("metric"), F.col("trip_duration").alias("value")))
    return values.groupBy("user_id", "metric").agg(*describe(F.col("value")))


def header(points: DataFrame, *, mature_trips: int = MATURE_TRIPS, mature_points: int = MATURE_POINTS) -> DataFrame:
    """(user_id, trips, points, days, typical_confidence, is_mature)."""
    kept = points.filter("confidence >= 0.5").groupBy("user_id").agg(
        F.countDistinct("trip_id").alias("trips"), F.count("*").alias("points"), ((F.max("timestamp_unix") - F.min("timestamp_unix")) / 86400).alias("days"), F.median("confidence").alias("typical_confidence")
    )
    return kept.withColumn("is_mature", (F.col("trips") >= mature_trips) & (F.col("points") >= mature_points))


def activities(points: DataFrame) -> DataFrame:
    return activity_shares(points.filter("confidence >= 0.5"), ["user_id"])


def wide(points: DataFrame, **mature: int) -> DataFrame:
    """One row per user: the header and a struct per metric; small enough to be joined to points by user."""
    parts = ["mean", "median", "std", "min", "max", "p5", "p25", "p75", "p95", "sample_size"]
    m = metrics(points).groupBy("user_id").agg(*[F.first(F.when(F.col("metric") == n, F.struct(*parts)), ignorenulls=True).alias(n) for n in METRICS])
    return header(points, **mature).join(m, "user_id", "left")


def brief(base: DataFrame) -> DataFrame:
    """Wide baselines in brief: how much is known of each user, and the usual speed."""
    return base.select("user_id", "trips", "points", "days", "is_mature", F.col("speed.mean").alias("mean_speed"), F.col("speed.std").alias("std_speed"))


def blend(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metrics (long form) of two periods, weighted by their numbers of values; an approximation where medians and percentiles are concerned."""
    keys = ["user_id", "metric"]
    o, n = (df.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in keys]) for df, side in ((old, "o"), (new, "n")))
    both = o.join(n, keys, "full_outer")
    no, nn = F.coalesce("sample_size_o", F.lit(0)), F.coalesce("sample_size_n", F.lit(0))
    wo = F.when(no + nn > 0, no / (no + nn)).otherwise(1.0)
    def line(c: str) -> Column:
        return cases((nn == 0, F.col(f"{c}_o")), (no == 0, F.col(f"{c}_n")), other=wo * F.col(f"{c}_o") + (1 - wo) * F.col(f"{c}_n"))
    std = cases((nn == 0, F.col("std_o")), (no == 0, F.col("std_n")), other=F.sqrt(wo * F.pow("std_o", 2) + (1 - wo) * F.pow("std_n", 2)))
    least = cases((nn == 0, F.col("min_o")), (no == 0, F.col("min_n")), other=F.least("min_o", "min_n"))
    most = cases((nn == 0, F.col("max_o")), (no == 0, F.col("max_n")), other=F.greatest("max_o", "max_n"))
    return both.select(*keys, *[line(c).alias(c) for c in ("mean", "median", "p5", "p25", "p75", "p95")], std.alias("std"), least.alias("min"), most.alias("max"), (no + nn).alias("sample_size"))


def blend_headers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Trips and points add up (trips in both count twice), days are the longer period."""
    o = old.select("user_id", F.col("trips").alias("to"), F.col("points").alias("po"), F.col("days").alias("do"))
    n = new.select("user_id", F.col("trips").alias("tn"), F.col("points").alias("pn"), F.col("days").alias("dn"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return o.join(n, "user_id", "full_outer").select("user_id", (zero("to") + zero("tn")).alias("trips"), (zero("po") + zero("pn")).alias("points"), F.greatest("do", "dn").alias("days"))


def blend_shares(old: DataFrame, new: DataFrame, weight_old: float) -> DataFrame:
    """Distributions (user_id, activity, share): the union of activities, a missing share is 0."""
    both = old.withColumnRenamed("share", "o").join(new.withColumnRenamed("share", "n"), ["user_id", "activity"], "full_outer")
    return both.select("user_id", "activity", (weight_old * F.coalesce("o", F.lit(0.0)) + (1 - weight_old) * F.coalesce("n", F.lit(0.0))).alias("share"))


def percentile_of(v: Column, m: str) -> Column:
    """Where v lies among the knots of metric struct m: 0 to 100; null without values."""
    knots = [(0.0, "min"), (5.0, "p5"), (25.0, "p25"), (50.0, "median"), (75.0, "p75"), (95.0, "p95"), (100.0, "max")]
    pairs = [(F.col(f"{m}.sample_size") == 0, F.lit(None)), (v < F.col(f"{m}.min"), F.lit(0.0))]
    for (p, low), (q, high) in zip(knots, knots[1:], strict=False):
        a, b = F.col(f"{m}.{low}"), F.col(f"{m}.{high}")
        pairs.append(((v >= a) & (v <= b), F.when(b > a, p + (v - a) / F.when(b > a, b - a) * (q - p)).otherwise((p + q) / 2)))
    return F.when(v.isNotNull(), cases(*pairs, other=F.lit(100.0)))


def analyse_points(points: DataFrame, base: DataFrame, shares: DataFrame) -> DataFrame:
    """points with speed_percentile, speed_ratio, rate_percentile and activity_share (0 if unseen) against their user's baseline."""
    known = shares.select("user_id", "activity", F.col("share").alias("activity_share"))
    out = points.join(base.select("user_id", "speed", "update_rate").withColumnsRenamed({"speed": "b_speed", "update_rate": "b_rate"}), "user_id").join(known, ["user_id", "activity"], "left")
    return out.withColumns({
        "speed_percentile": percentile_of(F.col("speed"), "b_speed"),
        "speed_ratio": F.when(F.col("b_speed.mean") > 0, F.col("speed") / F.col("b_speed.mean")),
        "rate_percentile": percentile_of(F.col("update_rate"), "b_rate"),
        "activity_share": F.coalesce("activity_share", F.lit(0.0)),
    })


def analyse_trips(trips: DataFrame, base: DataFrame) -> DataFrame:
    out = trips.join(base.select("user_id", F.col("speed").alias("b_speed"), F.col("trip_duration").alias("b_trip")), "user_id")
    return out.select("user_id", "trip_id", percentile_of(F.col("duration"), "b_trip").alias("duration_percentile"), percentile_of(F.col("mean_speed"), "b_speed").alias("speed_percentile"))


def activity_deviation(points: DataFrame, shares: DataFrame) -> DataFrame:
    """Long form: a trip's share of each activity minus its user's."""
    own = activity_shares(points, ["user_id", "trip_id"])
    keys = points.select("user_id", "trip_id").distinct()
    usual = keys.join(shares.withColumnRenamed("share", "usual"), "user_id")
    both = own.join(usual, ["user_id", "trip_id", "activity"], "full_outer")
    return both.select("user_id", "trip_id", "activity", (F.coalesce("share", F.lit(0.0)) - F.coalesce("usual", F.lit(0.0))).alias("deviation"))
