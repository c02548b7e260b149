"""Time as column expressions and windows. All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.core import cases

FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy/MM/dd HH:mm:ss")


def parse_timestamp(text: Column) -> Column:
    """The first format that fits, then what Spark reads by itself; null for what nobody can read."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS], F.try_to_timestamp(text))


def from_number(x: Column) -> Column:
    """Epoch seconds; what is beyond the year 9999 as seconds is milliseconds."""
    return F.when(F.abs(x) < 253402300800, F.timestamp_micros((x * 1_000_000).cast("bigint"))).otherwise(F.timestamp_micros((x * 1000).cast("bigint")))


def unix(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def delta(t1: Column, t2: Column) -> Column:
    return unix(t2) - unix(t1)


def is_valid_delta(seconds: Column) -> Column:
    return seconds.between(0.5, 300)


def format_duration(seconds: Column) -> Column:
    """`1h 2m 3s`, with a minus sign if negative; minutes from the first minute on, hours likewise."""
    s = F.floor(F.abs(seconds)).cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint")
    text = F.concat_ws(" ", F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))), F.when((m > 0) | (h > 0), F.concat(m.cast("string"), F.lit("m"))), F.concat((s % 60).cast("string"), F.lit("s")))
    return F.when(seconds < 0, F.concat(F.lit("-"), text)).otherwise(text)


def time_window(centre: Column, minutes: float) -> dict[str, Column]:
    half = F.make_interval(secs=F.lit(minutes * 30.0))
    return {"window_start": centre - half, "window_end": centre + half}


def _ordered(by: list[str], t: str, tie: list[str]) -> object:
    return Window.partitionBy(*by).orderBy(t, *tie)


def with_deltas(df: DataFrame, t: str, by: list[str], tie: list[str]) -> DataFrame:
    w = _ordered(by, t, tie)
    return df.withColumns({"i": F.row_number().over(w) - 1, "dt": F.col(t) - F.lag(t).over(w)})


def gaps(df: DataFrame, t: str, by: list[str], tie: list[str], *, least: float = 30.0) -> DataFrame:
    """(by, before, after, seconds) of gaps of at least `least`."""
    return with_deltas(df, t, by, tie).filter(F.col("dt") >= least).select(*by, (F.col("i") - 1).alias("before"), F.col("i").alias("after"), F.col("dt").alias("seconds"))


def monotonic(df: DataFrame, t: str, by: list[str], order: list[str]) -> DataFrame:
    """Whether times never fall, and whether they always rise, in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("dt", F.col(t) - F.lag(t).over(w))
    return d.groupBy(*by).agg(F.coalesce(F.bool_and(F.col("dt") >= 0), F.lit(True)).alias("monotonic"), F.coalesce(F.bool_and(F.col("dt") > 0), F.lit(True)).alias("strict"))


def same_time_runs(df: DataFrame, t: str, by: list[str], tie: list[str], *, within: float = 0.001) -> DataFrame:
    """(by, first, n) of runs of two or more rows each within the tolerance of the one before."""
    d = with_deltas(df, t, by, tie)
    d = d.withColumn("run", F.sum(F.when(F.coalesce(F.abs("dt") <= within, F.lit(False)), 0).otherwise(1)).over(_ordered(by, t, tie).rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "run").agg(F.min("i").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("run")


def update_frequency(df: DataFrame, t: str, by: list[str]) -> DataFrame:
    span = F.max(t) - F.min(t)
    return df.groupBy(*by).agg(F.when((F.count("*") > 1) & (span > 0), (F.count("*") - 1) / span).alias("frequency"))


def segments(df: DataFrame, t: str, by: list[str], tie: list[str], *, least: float = 30.0) -> DataFrame:
    """(by, start, stop): half-open ranges of places between gaps."""
    d = with_deltas(df, t, by, tie)
    d = d.withColumn("seg", F.sum(F.when(F.col("dt") >= least, 1).otherwise(0)).over(_ordered(by, t, tie).rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "seg").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).drop("seg")


def rush(hour: Column) -> Column:
    return cases((hour.isin(7, 8, 9), "morning"), (hour.isin(17, 18, 19), "evening"), other="none")
