"""Statistics as aggregates, windows and column expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wayfold.functions.core import cases


def describe(x: Column) -> list[Column]:
    """mean, median, population std, min, max, percentiles and sample_size; zeros without values."""
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    p = F.percentile(x, F.array(F.lit(0.05), F.lit(0.25), F.lit(0.75), F.lit(0.95)))
    out = [zero(F.avg(x), "mean"), zero(F.median(x), "median"), zero(F.stddev_pop(x), "std"), zero(F.min(x), "min"), zero(F.max(x), "max")]
    return [*out, *[zero(F.get(p, F.lit(i)), n) for i, n in enumerate(("p5", "p25", "p75", "p95"))], F.count(x).alias("sample_size")]


def joined(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of groups, a table with a row for each of few groups; null is a key like others."""
    keyed = groups.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in groups.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return df.join(F.broadcast(keyed), reduce(Column.__and__, same), "left").drop(*[f"_by_{c}" for c in by])


#: Parts into which a sketch tells ranks, and values up to which a group needs none.
SKETCH, SMALL_GROUP = 10_000, 40_000


def large_percentiles(df: DataFrame, x: str, by: list[str], at: list[float]) -> DataFrame:
    """(by, p0, p1, ...): the same of few, large groups, of which no task holds all values.

    A sketch tells between which two values a percentile lies, at most some
    thousandths of a group; rows below are counted, and only the values between are
    sorted. Where the counts show that a sketch was wrong, the whole group is.
    """
    rows, several = df.filter(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x")), range(len(at))
    asked = [min(1.0, max(0.0, a + side * 4 / SKETCH)) for a in at for side in (-1, 1)]
    ends = rows.groupBy(*by).agg(F.percentile_approx("_x", asked, F.lit(SKETCH)).alias("_q"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count("*").alias("_n"))
    side = lambda i, k: F.when(F.col("_n") <= SMALL_GROUP, F.col(("_low", "_high")[k])).otherwise(F.get("_q", F.lit(2 * i + k)))
    ends = ends.select(*by, "_low", "_high", "_n", *[side(i, k).alias(f"_{'ab'[k]}{i}") for i in several for k in (0, 1)])
    counts = joined(rows, ends, by).groupBy(*by).agg(*[F.first(c).alias(c) for c in ends.columns if c not in by], *[F.count_if(F.col("_x") < F.col(f"_a{i}")).alias(f"_below{i}") for i in several], *[F.count_if(F.col("_x") <= F.col(f"_b{i}")).alias(f"_upto{i}") for i in several])

    def part(i: int, a: float) -> Column:
        place = a * (F.col("_n") - 1)
        right = (F.col(f"_below{i}") <= F.floor(place)) & (F.ceil(place) < F.col(f"_upto{i}"))
        known = lambda c, other: F.when(right, F.col(f"{c}{i}")).otherwise(other)
        return F.struct(F.lit(i).alias("i"), place.alias("place"), known("_a", F.col("_low")).alias("a"), known("_b", F.col("_high")).alias("b"), known("_below", F.lit(0)).alias("below"))

    parts = counts.select(*by, F.array(*[part(i, a) for i, a in enumerate(at)]).alias("_parts"))
    inside = joined(rows, parts, by).select(*by, "_x", F.explode(F.filter("_parts", lambda p: (F.col("_x") >= p["a"]) & (F.col("_x") <= p["b"]))).alias("_p"))
    inside = inside.groupBy(*by, "_p", "_x").agg(F.count("*").alias("_c"))
    upto = F.col("_p.below") + F.sum("_c").over(Window.partitionBy(*by, "_p.i").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("_p.place")
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_x")))
    found = inside.withColumn("_upto", upto).groupBy(*by, "_p.i", F.col("_p.place").alias("_place")).agg(first(F.floor(place)).alias("_l"), first(F.ceil(place)).alias("_r"))
    between = F.when(F.col("_l") == F.col("_r"), F.col("_l")).otherwise((F.ceil("_place") - F.col("_place")) * F.col("_l") + (F.col("_place") - F.floor("_place")) * F.col("_r"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, between)).alias(f"p{i}") for i in several])


def described(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by, what `describe` gives) of few, large groups."""
    names = ("p5", "p25", "median", "p75", "p95")
    p = large_percentiles(df, x, by, [0.05, 0.25, 0.5, 0.75, 0.95]).select(*by, *[F.col(f"p{i}").alias(n) for i, n in enumerate(names)])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    v = F.col(x)
    sums = df.groupBy(*by).agg(zero(F.avg(v)).alias("mean"), zero(F.stddev_pop(v)).alias("std"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max"), F.count(v).alias("sample_size"))
    return joined(sums, p, by).select(*by, "mean", zero("median").alias("median"), "std", "min", "max", *[zero(n).alias(n) for n in ("p5", "p25", "p75", "p95")], "sample_size")


def percentiles(x: Column, at: list[float]) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(x, F.array(*[F.lit(a) for a in at]))


def rolling_mean(x: Column, k: int, by: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order)
    return F.when(F.row_number().over(w) >= k, F.avg(x).over(w.rowsBetween(1 - k, 0)))


def rolling_std(x: Column, k: int, by: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order)
    return F.when(F.row_number().over(w) >= k, F.stddev_pop(x).over(w.rowsBetween(1 - k, 0)))


def outlier_iqr(df: DataFrame, x: str, by: list[str], factor: float = 1.5) -> DataFrame:
    """df with `outlier`; bounds come from a row for each of few, large groups, joined back."""
    q = large_percentiles(df, x, by, [0.25, 0.75]).select(*by, F.col("p0").alias("_low"), F.col("p1").alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    return joined(df, q, by).withColumn("outlier", (F.col(x) < low - factor * (high - low)) | (F.col(x) > high + factor * (high - low))).drop("_low", "_high")


def outlier_z(df: DataFrame, x: str, by: list[str], most: float = 3.0) -> DataFrame:
    s = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return joined(df, s, by).withColumn("outlier", F.coalesce(F.when(F.col("_s") > 0, F.abs((F.col(x) - F.col("_m")) / F.col("_s")) > most), F.lit(False))).drop("_m", "_s")


def outlier_mad(df: DataFrame, x: str, by: list[str], most: float = 3.5) -> DataFrame:
    mid = joined(df, large_percentiles(df, x, by, [0.5]).withColumnRenamed("p0", "_med"), by)
    far = mid.select(*by, F.abs(F.col(x) - F.col("_med")).alias("_far"))
    mid = joined(mid, large_percentiles(far, "_far", by, [0.5]).withColumnRenamed("p0", "_mad"), by)
    return mid.withColumn("outlier", F.coalesce(F.when(F.col("_mad") > 0, F.abs(0.6745 * (F.col(x) - F.col("_med")) / F.col("_mad")) > most), F.lit(False))).drop("_med", "_mad")


def histogram(df: DataFrame, x: str, by: list[str], bins: int = 20) -> DataFrame:
    """(by, bin from 1, low, high, n): equal widths between min and max, the last bin closed; a single value has bins around it."""
    ends = df.groupBy(*by).agg(F.min(x).alias("a"), F.max(x).alias("b"))
    ends = ends.select(*by, F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("a") - 0.5).alias("a"), F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("b") + 0.5).alias("b"))
    found = df.filter(F.col(x).isNotNull()).join(ends, by).withColumn("bin", F.least(F.floor((F.col(x) - F.col("a")) / (F.col("b") - F.col("a")) * bins).cast("int") + 1, F.lit(bins)))
    counts = found.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("b") - F.col("a")) / bins
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("a") + (F.col("bin") - 1) * width).alias("low"), (F.col("a") + F.col("bin") * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def shape(x: Column) -> list[Column]:
    """Population skewness and excess kurtosis, null below 8 values."""
    enough = F.count(x) >= 8
    return [F.when(enough, F.skewness(x)).alias("skewness"), F.when(enough, F.kurtosis(x)).alias("kurtosis"), F.count(x).alias("n")]


def normality_p(skew: Column, kurt: Column, n: Column) -> Column:
    """p of D'Agostino and Pearson's test from population skewness and excess kurtosis (n >= 20 makes it sensible)."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2.0 / (w2 - 1))
    z1 = delta * F.asinh(y / alpha)
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - mean) / F.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1 + 4.0 / (root * root)))
    term = (1 - 2.0 / a) / (1 + x * F.sqrt(2.0 / (a - 4)))
    z2 = ((1 - 2.0 / (9 * a)) - F.signum(term) * F.pow(F.abs(term), 1.0 / 3)) / F.sqrt(2.0 / (9 * a))
    return F.exp(-(z1 * z1 + z2 * z2) / 2)  # chi-square with two degrees


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of Pearson's r with n pairs."""
    return pd.Series([None if k < 3 or r_ is None or r_ != r_ else 0.0 if abs(r_) >= 1 else beta_cdf((k - 2) / 2, 0.5, 1 - r_ * r_) for r_, k in zip(r, n, strict=True)], dtype=float)


def correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, r, n) over pairs without nulls; null below 3 pairs."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.filter(both).groupBy(*by).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    return out.withColumn("r", F.when(F.col("n") >= 3, F.col("r")))


def shapiro_p(values: np.ndarray) -> float:
    """p of the Shapiro-Wilk test for 6 to 5000 values that aren't all equal.

    Royston's approximation (Applied Statistics 44, 1995, algorithm AS R94): up to 11 values the
    logarithm of 1 - W is taken from a bound of its own first. All coefficients are fixed values.
    """
    from statistics import NormalDist

    x = np.sort(values)
    n, normal = len(x), NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, norm = 1 / np.sqrt(n), float(m @ m)
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / np.sqrt(norm)], u)
    prior = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / np.sqrt(norm)], u)
    phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prior**2)
    a = m / np.sqrt(phi)
    a[[0, 1, -2, -1]] = -last, -prior, prior, last
    w = float((a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean())))
    if w >= 1:
        return 1.0
    found, log_n = np.log(1 - w), np.log(n)
    if n <= 11:
        bound = -2.273 + 0.459 * n
        if found >= bound:
            return 0.0
        found = -np.log(bound - found)
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), np.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n), np.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return 1 - normal.cdf((found - mean) / sd)


def normality(df: DataFrame, x: str, by: str) -> DataFrame:
    """(by, n, p) of groups with 8 values or more: Shapiro-Wilk up to 5000 values, else D'Agostino and Pearson. Groups of up to 5000 values are gathered, larger ones only summed."""
    sums = df.filter(F.col(x).isNotNull()).groupBy(by).agg(*shape(F.col(x)))
    large = sums.filter("n > 5000").select(by, "n", normality_p(F.col("skewness"), F.col("kurtosis"), F.col("n")).alias("p"))
    kind = df.schema[by].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g[x].to_numpy(float)
        p = None if np.ptp(v) == 0 else shapiro_p(v)
        return pd.DataFrame({by: [g[by].iloc[0]], "n": [len(v)], "p": [p]})

    small = df.filter(F.col(x).isNotNull()).join(sums.filter("n between 8 and 5000").select(by), by).select(by, x).groupBy(by).applyInPandas(run, f"{by} {kind}, n long, p double")
    return small.unionByName(large)


def ema(values: Column, alpha: float = 0.3) -> Column:
    """Exponential moving average of an array: an array of the same length, starting with the first value.

    A value's weight shrinks by 1 - alpha with each that follows, so an average
    is made of the last values only, as many as weigh more than 1e-18 of the
    whole: the same in doubles, and linear in the array's length. Null values
    make all averages null that they weigh in.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies above 0 and at most at 1")
    reach = 1 if alpha == 1 else math.ceil(math.log(1e-18) / math.log(1 - alpha)) + 1

    def at(_: Column, i: Column) -> Column:
        first = F.greatest(i - reach, F.lit(0))
        return F.aggregate(F.slice(values, first + 2, i - first), F.get(values, first).cast("double"), lambda last, v: alpha * v + (1 - alpha) * last)

    return F.transform(values, at)


BUCKETS = ["0.00-0.25", "0.25-0.50", "0.50-0.75", "0.75-0.90", "0.90-1.00"]


def confidence_bucket(c: Column) -> Column:
    return cases((c < 0.25, BUCKETS[0]), (c < 0.5, BUCKETS[1]), (c < 0.75, BUCKETS[2]), (c < 0.9, BUCKETS[3]), other=BUCKETS[4])


def confidence_buckets(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, bucket, n) with empty buckets."""
    grid = df.select(*by).distinct().withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in BUCKETS])))
    counts = df.groupBy(*by, confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))
    return grid.join(counts, [*by, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


