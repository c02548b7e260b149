"""Sharding by sampled splitters.

Records are ordered by a 64-bit hash of their text, then by id. A sample of the
keys, weighted by size (and by rows alike, so that neither makes a range large),
gives quantile boundaries; the records are dealt to the ranges between them,
ranges that turn out overfull (a text with very many copies) are subdivided at
sampled ids, and exact prefix sums inside and across ranges turn the order into
shards of nearly equal bytes and gapless slots.

Equal texts share a shard, whatever ranges they are in, unless their group is
larger than `whole_groups` of a shard and than two of the largest records; only
such a group is cut where a boundary falls, and group_cut tells so.

Nothing but the bounded sample and one row per range reaches the driver. The
number of ranges grows with the records up to a bound set by the sample.

Cases: a null text has size 1 and checksum 0, and null texts form one group;
null ids come first within their text; repeated rows get slots of their own,
and however many they are (null ids too) they are spread over ranges; very long
texts count by their size; an empty table gives an empty result; input columns
beside id and text are neither needed nor returned, whatever their names.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, partitions

#: Keys drawn for each range, most keys drawn in all, and records in a range as
#: long as the sample bound allows.
SAMPLE_PER_RANGE, SAMPLE_BOUND, RECORDS_PER_RANGE = 24, 400_000, 256
LEAST = -(1 << 63)


def quantile_bounds(keys: list, weights: list, pieces: int) -> list:
    """Up to pieces - 1 distinct keys that cut the sorted, weighted keys into even parts."""
    if pieces < 2 or not keys:
        return []
    upto = np.cumsum(np.asarray(weights, dtype=float))
    at = np.searchsorted(upto, upto[-1] * np.arange(1, pieces) / pieces)
    return sorted({keys[min(i, len(keys) - 1)] for i in at} - {keys[0]})


class Splitters:
    """Sorted boundaries on (key, id, nth): even ones on the key, finer ones inside overfull ranges."""

    def __init__(self, bounds: list[int]):
        self.bounds = np.asarray(bounds, dtype=np.int64)
        self.finer: dict[int, list[tuple[int, int, int]]] = {}
        self.first = np.arange(len(bounds) + 1)

    def subdivide(self, finer: dict[int, list[tuple[int, int, int]]]) -> None:
        self.finer = {r: b for r, b in finer.items() if b}
        extra = np.zeros(len(self.bounds) + 1, dtype=np.int64)
        for r, b in self.finer.items():
            extra[r] = len(b)
        self.first = np.arange(len(extra)) + np.cumsum(extra) - extra

    def locate(self, keys: np.ndarray, ids: np.ndarray, nths: np.ndarray) -> np.ndarray:
        coarse = np.searchsorted(self.bounds, keys, side="right")
        out = self.first[coarse]
        for i in np.flatnonzero(np.isin(coarse, list(self.finer))) if self.finer else ():
            out[i] += bisect.bisect_right(self.finer[int(coarse[i])], (int(keys[i]), int(ids[i]), int(nths[i])))
        return out


def with_range(rows: DataFrame, splitters: Splitters) -> DataFrame:
    """rows (with longs _key, _id and _nth) and their _range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_range=splitters.locate(*(b[c].to_numpy(np.int64) for c in ("_key", "_id", "_nth"))))

    return rows.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _range long")


def split_ranges(rows: DataFrame, n: int, total: int, *, seed: int = 7) -> Splitters:
    """Splitters for n rows with _key, _id, _nth and _size, of `total` size in all. A row's weight is its mean share of bytes and rows."""
    ranges = max(1, min(SAMPLE_BOUND // SAMPLE_PER_RANGE, -(-n // RECORDS_PER_RANGE)))
    weight = (F.col("_size") / F.lit(total) + F.lit(1 / n)) / 2
    rate = ranges * SAMPLE_PER_RANGE
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_key", "_id", "_nth"), 11) / F.lit(float(1 << 53))
    drawn = rows.filter(chance < weight * rate).select("_key", "_id", "_nth", F.greatest(F.lit(1.0), weight * rate).alias("w")).collect()
    drawn = sorted((r["_key"], r["_id"], r["_nth"], r["w"]) for r in drawn)
    splitters = Splitters(quantile_bounds([d[0] for d in drawn], [d[3] for d in drawn], ranges))
    full = with_range(rows, splitters).groupBy("_range").agg(F.sum(weight).alias("weight")).filter(F.col("weight") > 2 / ranges).collect()
    if full:
        at = np.searchsorted(splitters.bounds, np.asarray([d[0] for d in drawn], dtype=np.int64), side="right")
        finer = {}
        for r in full:
            own = [drawn[i] for i in np.flatnonzero(at == r["_range"])]
            finer[r["_range"]] = quantile_bounds([d[:3] for d in own], [d[3] for d in own], math.ceil(r["weight"] * ranges))
        splitters.subdivide(finer)
    return splitters


def shard_by_bytes(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", whole_groups: float = 1 / 32) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (null: `bytes` keeps no such promise), and whether its group of equal texts may be cut."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    keyed = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
            F.xxhash64(text).alias("_key"),
        ).withColumns({"_id": F.coalesce("id", F.lit(LEAST)), "_nth": F.monotonically_increasing_id()}),
        "shard-keys",
    )
    n, total, largest = keyed.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    splitters = split_ranges(keyed, n, total) if n else Splitters([])
    limit = max(int(total / shards * whole_groups), 2 * largest)
    ranged = with_range(keyed, splitters).repartition(partitions(spark), "_range")
    order = Window.partitionBy("_range").orderBy("_key", "_id", "_nth")
    group = Window.partitionBy("_range", "_key")
    placed = ranged.withColumns({"upto": F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"), "nth": F.row_number().over(order)})
    placed = materialize(placed.withColumns({"group_at": F.min("upto").over(group), "group_size": F.sum("_size").over(group)}), "shard-places")
    sums = sorted((r["_range"], r["s"], r["c"]) for r in placed.groupBy("_range").agg(F.sum("_size").alias("s"), F.count("*").alias("c")).collect())
    before, at, row = [], 0, 0
    for r, s, c in sums:
        before.append((r, at, row))
        at, row = at + s, row + c
    offsets = F.broadcast(spark.createDataFrame(before, "_range long, bytes_before long, rows_before long"))  # one row per range: bounded by the sample
    placed = placed.join(offsets, "_range").withColumns({"upto": F.col("bytes_before") + F.col("upto"), "group_at": F.col("bytes_before") + F.col("group_at")})
    # groups that a boundary cuts, at most one for each: where they begin and their size over all ranges
    split = spark.createDataFrame([(k,) for k in sorted({b[0] for own in splitters.finer.values() for b in own})], "_key long")
    over_all = placed.join(F.broadcast(split), "_key").groupBy("_key").agg(F.min("group_at").alias("whole_at"), F.sum("_size").alias("whole_size"))
    placed = placed.join(F.broadcast(over_all), "_key", "left").withColumns({"group_at": F.coalesce("whole_at", "group_at"), "group_size": F.coalesce("whole_size", "group_size")})
    cut = F.col("group_size") > limit
    middle = F.when(cut, F.col("upto") + F.col("_size") / 2).otherwise(F.col("group_at") + F.col("group_size") / 2)
    shard = F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")
    dealt = materialize(placed.select("id", F.col("_size").alias("size"), "crc", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("row"), cut.alias("group_cut")), "shard-rows")
    starts = {r["shard"]: r["s"] for r in dealt.groupBy("shard").agg(F.min("row").alias("s")).collect()}
    first = F.lit(0).cast("long")
    for shard, start in sorted(starts.items()):
        first = F.when(F.col("shard") == shard, F.lit(start)).otherwise(first)
    return dealt.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("row") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_cut",
    )
