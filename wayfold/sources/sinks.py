"""Results as JSON, a row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame, columns: list[str] | None = None, *, keys: list[str] | None = None) -> DataFrame:
    """keys and `body`: the row's columns as a JSON object, nulls included."""
    body = F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"})
    return rows.select(*(keys or []), body.alias("body"))
