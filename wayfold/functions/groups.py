"""Python work by groups where most groups are small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, parts: int | None = None) -> DataFrame:
    """run(rows, starts) over batches of whole groups of equal keys, many to a batch; starts: where each group begins.

    One call serves all groups of a batch, so that a group costs what its rows
    cost, and no worker call of its own. A group that goes on in the next batch waits for it.
    parts: so many tasks, for work that is much for its bytes; else Spark merges small ones.
    """

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            if not len(part):
                continue
            starts = _starts(part, keys)
            if held and not _same(held[-1], part, keys):
                whole = pd.concat(held, ignore_index=True)
                yield run(whole, _starts(whole, keys))
                held = []
            last = int(starts[-1])
            if last and held:  # the group that waited ends in this batch
                whole = pd.concat([*held, part.iloc[:last]], ignore_index=True)
                yield run(whole, _starts(whole, keys))
                held = []
            elif last:
                whole = part.iloc[:last].reset_index(drop=True)
                yield run(whole, starts[:-1])
            held.append(part.iloc[last:])
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield run(whole, _starts(whole, keys))

    return df.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys).mapInPandas(batches, schema)


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the keys differ from the row before; nulls are equal."""
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for k in keys:
        codes = pd.factorize(rows[k])[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _same(before: pd.DataFrame, after: pd.DataFrame, keys: list[str]) -> bool:
    a, b = before[keys].iloc[-1], after[keys].iloc[0]
    return all((pd.isna(x) and pd.isna(y)) or x == y for x, y in zip(a, b, strict=True))
