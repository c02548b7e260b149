"""Exact top-k search by distributed histogram selection.

Queries go in blocks of bounded size. For a block every candidate is scored
against all its queries in matrix products, and each query's scores are counted
into equal bins over the range in which its k-th best score must lie. The bin
with the k-th best becomes the next range, until a bin is one score wide: then
the k-th score is known exactly, one last pass keeps the scores that reach it,
and ties go to the smaller id. Scores are computed again in each pass and never
stored. A task reports only the bins that hold its own k best, and in the last
pass only its own k best rows of each query: no other can be among the k best of
all. So what leaves a task doesn't grow with its rows or with ties.

Components are floor(scale * x) as integers. Products are exact: in doubles
while all sums stay below 2**53, in 64-bit integers below 2**62, else in Python
integers, cut to -2**62 .. 2**62.

Cases: vectors that are null or hold null, NaN or infinite components, and rows
with a null id, take no part; a shorter vector counts as padded with zeros, an
empty one scores 0 with all; rows that share an id are never each other's
candidates, repeated query rows are answered once, and repeated candidates are
candidates each; fewer than k candidates give all; an empty table gives an
empty result; columns beside id and vector don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Queries in a block, bins of a histogram, scores that a task holds at once.
BLOCK, BINS, CELLS = 1024, 2048, 1 << 20
LIMIT = 1 << 62


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): the integer vectors that take part."""
    values = F.col(vec_col).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.transform(values, lambda x: F.floor(x * scale))).alias("v"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scores(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products, a row per candidate."""
    most = candidates.shape[1] * max(1, _largest(candidates)) * max(1, _largest(queries))
    if most < 1 << 53:
        return (candidates.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    if most < LIMIT:
        return candidates @ queries.T
    exact = candidates.astype(object) @ queries.T.astype(object)
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max())) if x.size else 0


class Block:
    """A block of queries with, for each, the range from low, below high, of its k-th best score and how many scores lie above it."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray], norm: float, k: int):
        self.ids, self.k = np.array(ids, dtype=np.int64), k
        self.width = max([0, *map(len, vectors)])
        self.queries = matrix(vectors, self.width)
        reach = np.minimum(np.linalg.norm(self.queries.astype(float), axis=1) * norm * (1 + 1e-9) + 2, float(LIMIT))
        self.low = [-int(r) - 1 for r in reach]
        self.step = [(2 * int(r) + 3 + BINS) // BINS for r in reach]
        self.high = [low + BINS * step for low, step in zip(self.low, self.step, strict=True)]
        self.above = [0] * len(ids)
        self.open = [True] * len(ids)
        self.least = [-LIMIT - 1] * len(ids)  # scores to keep; all, unless there are more than k

    def narrow(self, counts: dict[int, list[tuple[int, int]]]) -> bool:
        """Take in the counts of the bins by query; whether a query is still open."""
        for q, found in counts.items():
            if not self.open[q]:
                continue
            for bin_, n in sorted(found, reverse=True):
                if self.above[q] + n >= self.k:
                    low = self.low[q] + bin_ * self.step[q]
                    if self.step[q] == 1:
                        self.least[q], self.open[q] = low, False
                    else:
                        self.low[q], self.high[q], self.step[q] = low, min(self.high[q], low + self.step[q]), -(-self.step[q] // BINS)
                    break
                self.above[q] += n
            else:
                self.open[q] = False
        for q in range(len(self.ids)):
            if q not in counts:
                self.open[q] = False
        return any(self.open)


def _scored(batches: Iterator[pd.DataFrame], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and scores of candidates, and where a candidate shares a query's id."""
    rows = max(1, CELLS // max(1, len(block.ids)))
    for b in batches:
        for i in range(0, len(b), rows):
            part = b.iloc[i : i + rows]
            vectors = [np.asarray(v, dtype=np.int64) for v in part["v"]]
            width = max([block.width, *map(len, vectors)])
            queries = np.pad(block.queries, ((0, 0), (0, width - block.width)))
            ids = part["id"].to_numpy(np.int64)
            yield ids, scores(matrix(vectors, width), queries), ids[:, None] == block.ids[None, :]


def histogram(rows: DataFrame, block: Block) -> dict[int, list[tuple[int, int]]]:
    """Counts of the bins that can hold the k-th best score, by query."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = held.value
        n = len(block.ids)
        low, high, step = (np.array([min(x, (1 << 63) - 1) for x in side], dtype=np.int64) for side in (block.low, block.high, block.step))
        counts = np.zeros(n * BINS, dtype=np.int64)
        first = np.arange(n) * BINS
        for _, s, own in _scored(batches, block):
            bins = (s - low) // step
            inside = (s >= low) & (s < high) & ~own & np.array(block.open)
            counts += np.bincount((np.clip(bins, 0, BINS - 1) + first)[inside], minlength=n * BINS)
        counts = counts.reshape(n, BINS)
        later = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, bin_ = np.nonzero((counts > 0) & (later < block.k))
        yield pd.DataFrame({"q": q.astype(np.int32), "bin": bin_.astype(np.int32), "n": counts[q, bin_]})

    out: dict[int, list[tuple[int, int]]] = {}
    for r in rows.mapInPandas(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["q"], []).append((r["bin"], r["n"]))
    held.unpersist()
    return out


def best_rows(rows: DataFrame, block: Block) -> DataFrame:
    """(query_id, vec_id, score) of every task's own k best among the scores that reach the k-th best of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        least = np.array(block.least, dtype=object)
        least = np.array([max(-LIMIT, x) for x in least], dtype=np.int64)
        for ids, s, own in _scored(batches, block):
            row, q = np.nonzero((s >= least) & ~own)
            order = np.lexsort((ids[row], -s[row, q], q))
            row, q = row[order], q[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            for r, c in zip(row[nth < block.k].tolist(), q[nth < block.k].tolist(), strict=True):
                kept[c].append((-int(s[r, c]), int(ids[r])))
            for c in set(q.tolist()):
                if len(kept[c]) > 2 * block.k:
                    kept[c] = sorted(kept[c])[: block.k]
        found = [(int(block.ids[c]), i, -s) for c, own in enumerate(kept) for s, i in sorted(own)[: block.k]]
        yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return rows.mapInPandas(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """Per query its k best candidates: query_id, rank (from 1), vec_id, score.

    is_query: a condition on the column `id` of the rows that take part.
    """
    spark = vectors.sparkSession
    rows = materialize(quantized(vectors, id_col, vec_col, scale), "vectors")
    norm = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))))).first()[0] or 0.0
    asked = materialize(rows.filter(is_query).distinct(), "queries")
    done: DataFrame | None = None
    after = None
    while True:
        order = F.struct("id", "v")
        page = asked if after is None else asked.filter((F.col("id") > after[0]) | ((F.col("id") == after[0]) & (F.col("v") > F.array(*[F.lit(x).cast("long") for x in after[1]]).cast("array<bigint>"))))
        found = page.orderBy(order).limit(BLOCK).collect()
        if not found:
            break
        block = Block([r["id"] for r in found], [np.array(r["v"], dtype=np.int64) for r in found], norm, k)
        while block.narrow(histogram(rows, block)):
            pass
        best = best_rows(rows, block)
        if len(found) < BLOCK and done is None:
            done = best
            break
        best = materialize(best, "best")
        done = best if done is None else done.union(best)
        after = (found[-1]["id"], found[-1]["v"])
        if len(found) < BLOCK:
            break
    if done is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return done.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
