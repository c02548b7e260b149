"""Centroid clustering with Hamerly's bounds, in exact integers.

Every vector keeps, in a staged table, its cluster, an upper bound of the
distance to that centroid and one lower bound of the distance to all others.
When the centroids have moved, the upper bound grows by its own centroid's
drift and the lower one shrinks by the largest drift of the others. A vector
whose upper bound stays below the lower one, or below half the way from its
centroid to the next, keeps its cluster unseen. Of the rest the distance to
their own centroid is measured; who is still ambiguous gets a full scan of all
centroids in exact integers, which decides, and bounds anew.

Vectors are shuffled in no round. A task reports the sums of only those vectors
that changed their cluster, a row for each cluster and component, and these are
added to running sums: what reaches the driver has clusters x components rows.

Cases: vectors that are null, of another length, or hold null, NaN or infinite
components take no part; rows with a null id do, but are no first centroids
while there are others; repeated rows count as often as they occur, and may
become equal first centroids, of which the smaller number wins all; with fewer
vectors than centroids there are fewer; an empty table gives an empty result;
columns beside id and vector don't matter. Where squared distances could pass
64 bits (of 64 components one above 2**27 after scaling), the query fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Bounds are widened by this share, far above what doubles round.
MARGIN = 1e-9


def most(width: int) -> int:
    """The largest component for which squared distances fit 64 bits."""
    return int((2**62 / max(1, width)) ** 0.5 / 2)


def quantized(vectors: DataFrame, id_col: str, vec_col: str, *, scale: int, width: int) -> DataFrame:
    """(id, x): floor(scale * component) of the vectors that take part."""
    values = F.col(vec_col).cast("array<double>")
    fine = (F.size(values) == width) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(values, lambda v: F.when(F.abs(v) * scale <= most(width), F.floor(v * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))))
    return vectors.filter(fine).select(F.col(id_col).alias("id"), whole.alias("x"))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per vector."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:  # all sums are whole numbers that doubles hold
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def own_squared(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(axis=1)


class Round:
    """A round's centroids and what their moves do to the bounds."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids, k = centroids, len(centroids)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1)) * (1 + MARGIN)
        self.drift, self.others = moved, np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])
        apart = np.sqrt(squared(centroids, centroids).astype(float)) * (1 - MARGIN)
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1, initial=np.inf) / 2

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster and bounds after the move, and which vectors were scanned in full; cluster -1: not assigned yet."""
        cluster, upper, lower = cluster.copy(), upper + self.drift[cluster], lower - self.others[cluster]
        near = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero((cluster < 0) | (upper >= near))
        seen = open_[cluster[open_] >= 0]
        upper[seen] = np.sqrt(own_squared(x[seen], self.centroids, cluster[seen])) * (1 + MARGIN)
        open_ = open_[(cluster[open_] < 0) | (upper[open_] >= near[open_])]
        if len(open_):
            d = squared(x[open_], self.centroids)
            best = d.argmin(axis=1)  # the first of equals
            cluster[open_], upper[open_] = best, np.sqrt(d[np.arange(len(d)), best]) * (1 + MARGIN)
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max
            lower[open_] = np.sqrt(d.min(axis=1)) * (1 - MARGIN)
        scanned = np.zeros(len(x), dtype=np.int32)
        scanned[open_] = 1
        return cluster, upper, lower, scanned


def stacked(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("x")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The state after a round: `was` is the cluster before."""
    turn, names = Round(centroids, before), state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            was = b.column("cluster").to_numpy()
            cluster, upper, lower, scanned = turn.assign(stacked(b), was, b.column("upper").to_numpy(), b.column("lower").to_numpy())
            scans = b.column("scans").to_numpy() + scanned
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scans, pa.int32())], names=names)

    return state.mapInArrow(run, state.schema)


def moves(state: DataFrame, k: int, width: int) -> dict[int, list[int]]:
    """What the last round adds to each cluster: sums by component, and at last the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x = np.hstack([stacked(b), np.ones((b.num_rows, 1), dtype=np.int64)])
                np.add.at(total, b.column("cluster").to_numpy(), x)
                was = b.column("was").to_numpy()
                np.subtract.at(total, was[was >= 0], x[was >= 0])
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.int32()), pa.array(total[c, at])], names=["cluster", "at", "n"])

    parts = state.filter("cluster <> was").select("x", "cluster", "was").mapInArrow(run, "cluster int, at int, n long")
    out = {c: [0] * (width + 1) for c in range(k)}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect():
        out[r["cluster"]][r["at"]] = int(r["n"])
    return out


def cluster_vectors(vectors: DataFrame, *, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, width: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance, scans) of every vector that takes part, staged, and the centroids.

    The first centroids are the k vectors with the smallest sha256 of
    `seed:id`; distance is squared; scans counts a vector's full scans.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = quantized(vectors, id_col, vec_col, scale=scale, width=width)
    start = {"cluster": F.lit(-1), "was": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.lit(0.0), "scans": F.lit(0)}
    state = materialize(rows.select("id", "x", *[v.alias(c) for c, v in start.items()]), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.select("x", order.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    if not first:
        return state.select("id", "cluster", F.lit(0).cast("long").alias("distance"), "scans"), []
    centroids = np.array([r["x"] for r in first], dtype=np.int64)
    sums = {c: [0] * (width + 1) for c in range(len(first))}
    before = None
    for _ in range(rounds):
        state, old = materialize(assigned(state, centroids, before), "assigned"), state
        discard(old)
        sums = {c: [a + b for a, b in zip(sums[c], own, strict=True)] for c, own in moves(state, len(first), width).items()}
        before, centroids = centroids, np.array([[v // s[-1] for v in s[:-1]] if s[-1] else centroids[c].tolist() for c, s in sums.items()], dtype=np.int64)
    last = assigned(state, centroids, before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster = b.column("cluster")
                yield pa.RecordBatch.from_arrays([b.column("id"), cluster, pa.array(own_squared(stacked(b), centroids, cluster.to_numpy())), b.column("scans")], names=["id", "cluster", "distance", "scans"])

    out = materialize(last.mapInArrow(run, f"id {kind}, cluster int, distance long, scans int"), "clusters")
    discard(state)
    return out, centroids.tolist()


def with_inertia(clusters: DataFrame, centroids: list[list[int]], id_col: str = "vec_id") -> DataFrame:
    """A row per vector with its cluster's and the whole inertia and a checksum of its final centroid."""
    own = {r["cluster"]: r["n"] for r in clusters.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row per centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, n, sum(own.values()), digest[c]) for c, n in sorted(own.items())]
    known = clusters.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.withColumnRenamed("id", id_col).join(F.broadcast(known), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")


def centroid_sql(k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, width: int = 64) -> str:
    """The same clustering by brute force in DuckDB, over the table embeddings."""
    parts = [
        f"v as (select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) e, sha256('{seed}:' || vec_id) h from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as (select row_number() over (order by h nulls last, e) - 1 c, e from (select h, e from v order by h nulls last, e limit {k}))",
    ]
    near = lambda i: f"a{i} as (select vec_id, e, b.c, b.d from (select vec_id, e, (select min(struct_pack(d := cast(list_sum(list_transform(range(1, {width + 1}), lambda i: (v.e[i] - k.e[i]) * (v.e[i] - k.e[i]))) as bigint), c := k.c)) from c{i} k) b from v))"
    for i in range(rounds):
        parts += [
            near(i),
            f"s{i} as (select c, i, cast(sum(e[i]) as bigint) s, count(*) n from a{i} cross join range(1, {width + 1}) r(i) group by c, i)",
            f"m{i} as (select c, list((s - ((s % n) + n) % n) // n order by i) e from s{i} group by c)",
            f"c{i + 1} as (select c{i}.c, coalesce(m{i}.e, c{i}.e) e from c{i} left join m{i} using (c))",
        ]
    # each round is read by several later ones: computed once
    names = [p.split(" as (", 1) for p in [*parts, near(rounds)]]
    ctes = ", ".join(f"{n} as materialized ({rest}" for n, rest in names)
    return f"with {ctes} select vec_id, cast(a.c as integer) \"cluster\", d distance, cast(sum(d) over (partition by a.c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(c{rounds}.e, ',')) centroid_sha256 from a{rounds} a join c{rounds} using (c)"
