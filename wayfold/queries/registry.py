"""Where query modules put their pairs of a Spark query and its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def halves(c: Column, digits: int) -> Column:
    """Rounded like the SQL's round: halves of the product with a power of ten go away from zero; F.round takes halves of the shortest decimal form."""
    return F.round(c * 10.0**digits) / 10.0**digits


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, and `-0.0` made 0.0. A nudge sends halves up, whatever the last bit of a sum."""
    return df.select([(halves(F.col(f"`{f.name}`") + F.lit(nudge), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def load() -> None:
    from wayfold.queries import analysis, library, profiles, risks, streams, tracking  # noqa: F401
