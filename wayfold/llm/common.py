"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from wayfold.sources.staging import discard, staged

__all__ = ["WORD", "bounded_batches", "discard", "materialize", "numbered_columns", "partitions", "table"]

#: White space of the corpus contracts: blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, tag: str, *, release: bool = False) -> DataFrame:
    """df as a staged table: lineage cut, and the rows where a lost executor can't take them.

    release: have Spark drop the shuffle files of what is done with. It does so
    when the driver collects garbage, which may otherwise be long after.
    """
    out = staged(df, tag)
    if release:
        spark = df.sparkSession
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ... on the way through an operator, and those names by the columns' own: they clash with nothing, and hold no dots."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, mb: int = 1) -> None:
    """Arrow batches of at most about `mb` MB, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)
