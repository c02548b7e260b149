"""Isolation forests, one per user, each tree grown on a bounded sample of its own.

A user of up to trees * sample points comes whole to a task, many users to a
batch: all their trees are grown there level by level, points are scored at
once, and no forest travels. A larger user's trees are grown in one task from
about `sample` rows a tree and scored against the points in a second pass, so no
task needs all points of such a user. Scaling and the threshold cover all points.
What a node draws is a hash of its tree and place, whatever is grown beside it.
"""

from __future__ import annotations

import math
import pickle
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.groups import map_groups
from wayfold.operators.anomaly import feature_vector
from wayfold.sources.staging import staged

FEATURES = 7  # of feature_vector
POINTS_PER_PART = 20_000
#: Rows of all trees that are grown at once.
ROWS_AT_ONCE = 400_000
U64 = np.uint64


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def tree_keys(user: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """What the draws of each user's trees come from: a row per user."""
    own = mixed(np.asarray(user, dtype=np.int64).view(U64) + U64(seed))
    return mixed(own[:, None] + np.arange(1, trees + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Forest(NamedTuple):
    """All nodes of some trees. A node's right child follows its left one; at leaves the feature is -1 and length tells the path's."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray


def grow_all(x: np.ndarray, rows: np.ndarray, at: np.ndarray, keys: np.ndarray, limit: np.ndarray) -> tuple[Forest, np.ndarray]:
    """Trees, each on the rows of x from its `at` to the next, and the path length of each row's leaf."""
    size, first, tree = np.diff(at), at[:-1], np.arange(len(at) - 1)
    place, slot, lengths = np.ones(len(tree), dtype=U64), np.arange(len(rows)), np.zeros(len(rows))
    paths = np.array([mean_path(k) for k in range(int(size.max(initial=0)) + 1)])
    parts, total, depth = [], len(tree), 0
    while len(size):
        xs, node = x[rows], np.arange(len(size))
        low, high = np.minimum.reduceat(xs, first, axis=0), np.maximum.reduceat(xs, first, axis=0)
        wide = high > low
        count = wide.sum(axis=1)
        u, v = (((mixed(keys[tree] ^ mixed(U64(2) * place + U64(k))) >> U64(11)).astype(float) / (1 << 53)) for k in (0, 1))
        f = (wide.cumsum(axis=1) > (u * count).astype(int)[:, None]).argmax(axis=1)
        cut = low[node, f] + v * (high[node, f] - low[node, f])
        of = np.repeat(node, size)
        left = xs[np.arange(len(rows)), f[of]] < cut[of]
        n_left = np.add.reduceat(left.astype(np.int64), first)
        split = (count > 0) & (depth < limit[tree]) & (n_left > 0) & (n_left < size)
        length, go = depth + paths[size], split[of]
        lengths[slot[~go]] = length[of[~go]]
        nth = np.cumsum(split) - split
        parts.append((np.where(split, f, -1), cut, np.where(split, total + 2 * nth, 0), length))
        total += 2 * int(split.sum())
        # rows go on, in their order, to the left and the right child of their node
        pair = np.column_stack((n_left, size - n_left))[split]
        begin = (np.cumsum(pair) - pair.ravel()).reshape(pair.shape)
        before = np.cumsum(pair, axis=0) - pair
        side, of = (~left[go]).astype(int), nth[of[go]]
        rank = np.where(side == 0, np.cumsum(side == 0), np.cumsum(side)) - 1
        to = (begin - before)[of, side] + rank
        rows, slot, old = np.empty(len(to), dtype=rows.dtype), np.empty(len(to), dtype=slot.dtype), (rows[go], slot[go])
        rows[to], slot[to] = old
        size, first, tree = pair.ravel(), begin.ravel(), np.repeat(tree[split], 2)
        place = (U64(2) * place[split])[:, None] + np.arange(2, dtype=U64)
        place, depth = place.ravel(), depth + 1
    return Forest(np.arange(len(at) - 1), *(np.concatenate(p) for p in zip(*parts, strict=True))), lengths


def path_lengths(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Of each row of x in each tree: a row per tree."""
    at, row = np.repeat(forest.roots, len(x)), np.tile(np.arange(len(x)), len(forest.roots))
    inner = np.flatnonzero(forest.feature[at] >= 0)
    while len(inner):
        here = at[inner]
        at[inner] = forest.left[here] + (x[row[inner], forest.feature[here]] >= forest.cut[here])
        inner = inner[forest.feature[at[inner]] >= 0]
    return forest.length[at].reshape(len(forest.roots), len(x))


def depth_limit(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(2, n))).astype(int)


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> Forest:
    """One tree."""
    return grow_all(x, np.arange(len(x)), np.array([0, len(x)]), rng.integers(1 << 63, size=1, dtype=U64), np.array([limit]))[0]


def depths(forest: Forest, x: np.ndarray) -> np.ndarray:
    return path_lengths(forest, x).mean(axis=0)


def mean_depths(x: np.ndarray, starts: np.ndarray, users: np.ndarray, hashes: np.ndarray, *, trees: int, sample: int, seed: int) -> np.ndarray:
    """Of each point of some users (that begin at starts) its mean path length in its user's trees."""
    ends, out = np.append(starts[1:], len(x)), np.zeros(len(x))
    n, keys = ends - starts, tree_keys(users, trees, seed)
    small = np.flatnonzero(n <= sample)
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(n[small]) * trees // ROWS_AT_ONCE)) + 1):  # each tree takes all points of these
        if len(part):
            k = np.repeat(n[part], trees)
            at = np.concatenate(([0], np.cumsum(k)))
            rows = np.arange(at[-1]) + np.repeat(np.repeat(starts[part], trees) - at[:-1], k)
            _, lengths = grow_all(x, rows, at, keys[part].ravel(), depth_limit(k))
            out += np.bincount(rows, weights=lengths, minlength=len(x)) / trees
    for i in np.flatnonzero(n > sample).tolist():
        mine = x[starts[i] : ends[i]]
        own = hashes[starts[i] : ends[i]].view(U64)
        rows = np.concatenate([np.argpartition(mixed(own ^ key), sample - 1)[:sample] for key in keys[i]])
        forest, _ = grow_all(mine, rows, np.arange(trees + 1) * sample, keys[i], depth_limit(np.full(trees, sample)))
        for lo in range(0, len(mine), max(1, ROWS_AT_ONCE // trees)):
            hi = min(len(mine), lo + max(1, ROWS_AT_ONCE // trees))
            out[starts[i] + lo : starts[i] + hi] = path_lengths(forest, mine[lo:hi]).mean(axis=0)
    return out


def outlierness(mean: np.ndarray, n: int, sample: int) -> np.ndarray:
    return -np.power(2.0, -mean / max(1e-9, mean_path(min(sample, n))))


def scaled(points: DataFrame, least: int) -> DataFrame:
    """(user_id, event_id, x, n): features scaled by mean and deviation over all n points of the user, for users with `least` or more."""
    rows = feature_vector(points).select("user_id", "event_id", "x")
    over = lambda f: F.array(*[f(F.get("x", F.lit(i))) for i in range(FEATURES)])
    scale = rows.groupBy("user_id").agg(F.count("*").alias("n"), over(F.avg).alias("mean"), over(F.stddev_pop).alias("std")).filter(F.col("n") >= least)
    x = F.zip_with(F.zip_with("x", "mean", lambda a, b: a - b), "std", lambda a, b: a / F.when(b > 0, b).otherwise(1.0))
    return rows.join(scale, "user_id").select("user_id", "event_id", x.alias("x"), "n")


def fit(points: DataFrame, *, trees: int = 100, sample: int = 256, seed: int = 42, least: int = 10, rows: DataFrame | None = None) -> DataFrame:
    """(user_id, trees): each tree grown on up to `sample` points of its own.

    Trees draw by themselves from a user of up to trees * sample points; of a
    larger one, each tree's points are drawn by hash before they are dealt.
    rows: the points scaled, where these are known already.
    """
    rows = scaled(points, least) if rows is None else rows
    chance = (sample + 6 * math.sqrt(sample)) / F.col("n")  # six deviations more than needed; the surplus goes by hash order
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, "event_id").alias("hash")))
    drawn = F.filter(drawn, lambda t: F.shiftrightunsigned(t["hash"], 11) / F.lit(float(1 << 53)) < chance)
    every = F.array(F.struct(F.lit(-1).alias("tree"), F.xxhash64(F.lit(seed), "event_id").alias("hash")))
    dealt = rows.select("user_id", "event_id", "x", F.inline(F.when(F.col("n") <= trees * sample, every).otherwise(drawn)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["tree", "hash", "event_id"])
        x, tree, keys = np.stack(g["x"]), g["tree"].to_numpy(), tree_keys(g["user_id"].to_numpy()[:1], trees, seed)[0]
        if tree[0] < 0:
            own, k = g["hash"].to_numpy(np.int64).view(U64), min(sample, len(x))
            parts = [np.argpartition(mixed(own ^ key), k - 1)[:k] for key in keys]
        else:
            parts = [np.flatnonzero(tree == t)[:sample] for t in range(trees)]
        size = np.array([len(p) for p in parts])
        full = np.flatnonzero(size)
        forest, _ = grow_all(x, np.concatenate(parts), np.concatenate(([0], np.cumsum(size[full]))), keys[full], depth_limit(size[full]))
        return pd.DataFrame({"user_id": [g["user_id"].iloc[0]], "trees": [pickle.dumps(forest)]})

    return dealt.groupBy("user_id").applyInPandas(run, "user_id bigint, trees binary")


def score(points: DataFrame, *, contamination: float = 0.05, sample: int = 256, least: int = 10, trees: int = 100, seed: int = 42) -> DataFrame:
    """(event_id, iso_score in [0, 1]); above 0.5 where the forest calls a point an outlier: `contamination` of all points of a user. Scaled points are written once when this is called."""
    rows, whole = staged(scaled(points, least), "scaled"), trees * sample

    def run(g: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        users, ends = g["user_id"].to_numpy()[starts], np.append(starts[1:], len(g))
        mean = mean_depths(np.stack(g["x"]), starts, users, g["hash"].to_numpy(np.int64), trees=trees, sample=sample, seed=seed)
        value = np.empty(len(g))
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            s = outlierness(mean[lo:hi], hi - lo, sample)
            value[lo:hi] = np.clip(0.5 - (s - np.quantile(s, contamination)) / 2, 0.0, 1.0)
        return pd.DataFrame({"event_id": g["event_id"].to_numpy(), "iso_score": value})

    small = rows.filter(F.col("n") <= whole).select("user_id", "event_id", "x", F.xxhash64(F.lit(seed), "event_id").alias("hash"))
    out = map_groups(small, ["user_id"], run, "event_id bigint, iso_score double", 4 * points.sparkSession.sparkContext.defaultParallelism)
    large = rows.filter(F.col("n") > whole)
    return out if large.isEmpty() else out.union(_large_scores(points, large, contamination, sample, trees, seed))


def _large_scores(points: DataFrame, rows: DataFrame, contamination: float, sample: int, trees: int, seed: int) -> DataFrame:
    """The same of users whose points don't come to one task; rows: these, scaled."""
    parts = F.greatest(F.lit(4), F.ceil(F.col("n") / POINTS_PER_PART).cast("int"))  # of a user; the model travels once to each
    rows = rows.withColumn("parts", parts)
    sizes = rows.groupBy("user_id").agg(F.first("n").alias("n"), F.first("parts").alias("parts"))
    model = fit(points, sample=sample, trees=trees, seed=seed, rows=rows).hint("merge").join(sizes, "user_id")  # forests are never broadcast

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"user_id": [], "event_id": [], "s": []}).astype({"user_id": "int64", "event_id": "int64", "s": "float64"})
        m = right.iloc[0]
        forest, x, step = pickle.loads(m["trees"]), np.stack(left["x"]), max(1, ROWS_AT_ONCE // trees)
        mean = np.concatenate([path_lengths(forest, x[lo : lo + step]).mean(axis=0) for lo in range(0, len(x), step)])
        return pd.DataFrame({"user_id": left["user_id"].to_numpy(), "event_id": left["event_id"].to_numpy(), "s": outlierness(mean, int(m["n"]), sample)})

    salted = rows.withColumn("part", F.pmod(F.xxhash64("event_id"), F.col("parts").cast("bigint")))
    spread = model.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<bigint>")))
    found = staged(salted.groupBy("user_id", "part").cogroup(spread.groupBy("user_id", "part")).applyInPandas(run, "user_id bigint, event_id bigint, s double"), "scores")
    offset = found.groupBy("user_id").agg(F.percentile("s", F.lit(contamination)).alias("offset"))
    value = F.lit(0.5) - (F.col("s") - F.col("offset")) / 2
    return found.join(offset, "user_id").select("event_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("iso_score"))
