"""Average-linkage clusters of a user's points, by places that can't touch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.groups import map_groups
from wayfold.sources.staging import staged

DEGREE = 111_000.0
#: Points up to which a place's distances are held as a matrix (8 MB), and cells of a block of distances beyond.
DENSE, BLOCK = 1000, 1 << 22
REGION = 256  # cells to a side


def average_linkage(x: np.ndarray, cut: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers by average linkage, merged while the distance is at most cut; weight: points at each place."""
    n = len(x)
    weight = np.ones(n) if weight is None else weight.astype(float)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    if n == 2:
        return np.array([0, int(np.sqrt(((x[0] - x[1]) ** 2).sum()) > cut)])
    return (by_matrix if n <= DENSE else by_chain)(x, cut, weight)


def by_matrix(x: np.ndarray, cut: float, weight: np.ndarray) -> np.ndarray:
    """The closest pair first, distances kept up to date (Lance-Williams): memory of n * n."""
    n = len(x)
    d = np.sqrt(sum((c[:, None] - c[None, :]) ** 2 for c in x.T))
    np.fill_diagonal(d, np.inf)
    size, label = weight.copy(), np.arange(n)
    near = d.argmin(axis=1)
    best = d[np.arange(n), near]
    while n > 1:
        i = int(best.argmin())
        if best[i] > cut:
            break
        i, j = sorted((i, int(near[i])))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        stale = np.flatnonzero((near == i) | (near == j) | (d[:, i] <= best))
        stale = np.union1d(stale, [i, j])
        near[stale] = d[stale].argmin(axis=1)
        best[stale] = d[stale, near[stale]]
    return np.unique(label, return_inverse=True)[1]


def by_chain(x: np.ndarray, cut: float, weight: np.ndarray) -> np.ndarray:
    """The same clusters (but for ties) along chains of nearest neighbours, with distances summed from the points anew: memory of n.

    Average linkage is reducible: two clusters that are each other's nearest
    merge in any order, and one whose nearest is beyond the cut stays as it is.
    Who is within the cut on average is so with some point; only clusters with
    a point in the box around a cluster, wider by the cut, are measured.
    """
    n = len(x)
    of, size, active = np.arange(n), weight.copy(), np.ones(n, dtype=bool)
    members: list[np.ndarray | None] = [np.array([i]) for i in range(n)]
    box = [x.copy(), x.copy()]  # of a cluster, at its number

    def nearest(i: int, before: int | None) -> tuple[float, int]:
        inside = active & (box[0] <= box[1][i] + cut).all(axis=1) & (box[1] >= box[0][i] - cut).all(axis=1)
        inside[i] = False
        own = np.flatnonzero(inside)
        if not len(own):
            return np.inf, i
        points = np.concatenate([members[c] for c in own])
        total = np.zeros(len(points))
        step = max(1, BLOCK // len(points))
        for s in range(0, len(members[i]), step):
            part = members[i][s : s + step]
            total += weight[part] @ np.sqrt(sum((x[part, a][:, None] - x[points, a][None, :]) ** 2 for a in range(x.shape[1])))
        sums = np.bincount(of[points], weights=total * weight[points], minlength=n)[own]
        d = sums / (size[own] * size[i])
        j = int(d.argmin())
        if before is not None and inside[before] and d[np.searchsorted(own, before)] <= d[j]:
            return float(d[j]), before
        return float(d[j]), int(own[j])

    chain: list[int] = []
    for first in range(n):
        while active[first] or chain:
            if not chain:
                chain.append(first)
            i, before = chain[-1], chain[-2] if len(chain) > 1 else None
            d, j = nearest(i, before)
            if d > cut:
                active[i] = False
                chain.pop()
            elif j == before:
                del chain[-2:]
                i, j = sorted((i, j))
                of[members[j]] = i
                members[i], members[j] = np.concatenate([members[i], members[j]]), None
                size[i], active[j] = size[i] + size[j], False
                box[0][i], box[1][i] = np.minimum(box[0][i], box[0][j]), np.maximum(box[1][i], box[1][j])
            else:
                chain.append(j)
    return np.unique(of, return_inverse=True)[1]


def linked(n: int, links: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component; links: pairs of members."""
    label = np.arange(n)
    a, b = links.reshape(-1, 2).T
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a].copy(), low)
        np.minimum.at(label, label[b].copy(), low)
        while not (label[label] == label).all():
            label = label[label]
        if (label == before).all():
            break
    return label


def touching(cells: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Pairs of rows of one group whose cells differ by at most one in every coordinate. Cells are found by coordinate after coordinate, in sorted codes."""
    n, width = cells.shape
    levels, code = [], np.unique(group, return_inverse=True)[1].astype(np.int64)
    start = code
    for c in cells.T:
        low, span = c.min(), int(c.max() - c.min()) + 3
        keys, code = np.unique(code * span + (c - low + 1), return_inverse=True)
        levels.append((keys, span, low))
    rows = np.zeros(len(levels[-1][0]), dtype=np.int64)
    rows[code] = np.arange(n)  # cells of a group are distinct
    found = [((), start)]
    for i, (keys, span, low) in enumerate(levels):
        further = []
        for offsets, at in found:
            for o in (-1, 0, 1):
                if (*offsets, o) < (0,) * (i + 1):  # the opposite direction finds these
                    continue
                key = at * span + (cells[:, i] + o - low + 1)
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                further.append(((*offsets, o), np.where((at >= 0) & (keys[place] == key), place, -1)))
        found = further
    pairs = [np.column_stack((np.flatnonzero(at >= 0), rows[at[at >= 0]])) for offsets, at in found if any(offsets)]
    return np.concatenate(pairs)


def components(cells: DataFrame) -> DataFrame:
    """(user_id, cell, place): distinct cells (arrays of whole numbers) of a user, those that touch under one place.

    Cells are joined within regions of their first two numbers, a region also
    seeing the cells around it; the parts that such a cell has in several
    regions are one place.
    """
    region = lambda a, b: F.concat_ws("/", *[F.floor((F.get("cell", F.lit(i)) + o) / REGION) for i, o in enumerate((a, b))])
    dealt = cells.withColumn("region", F.explode(F.array_distinct(F.array(*[region(a, b) for a in (0, -1, 1) for b in (0, -1, 1)]))))
    kind = cells.schema["user_id"].dataType.simpleString()

    def join(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(rows)]))
        own = np.array(rows["cell"].tolist(), dtype=np.int64)
        order = np.lexsort((*own.T[::-1], group))  # the smallest cell of a part names it, in whatever order cells come
        rows, own = rows.iloc[order], own[order]
        label = linked(len(rows), touching(own, group))
        names = [f"{r}#{'/'.join(map(str, own[i]))}" for r, i in zip(rows["region"], label, strict=True)]
        return pd.DataFrame({"user_id": rows["user_id"], "cell": rows["cell"], "part": names})

    # a cell's parts, its own region's or another's: the smallest stands for it
    parts = map_groups(dealt, ["user_id", "region"], join, f"user_id {kind}, cell array<bigint>, part string")
    parts = staged(parts.groupBy("user_id", "cell").agg(F.array_sort(F.collect_set("part")).alias("parts")), "parts")  # nine at most

    def merge_parts(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        names, users, wholes = [], [], []
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            own = rows["parts"].iloc[a:b]
            known = sorted({p for parts in own for p in parts})
            at = {p: i for i, p in enumerate(known)}
            label = linked(len(known), np.array([(at[parts[0]], at[p]) for parts in own for p in parts[1:]], dtype=np.int64))
            names += known
            users += [rows["user_id"].iloc[a]] * len(known)
            wholes += [known[i] for i in label]
        return pd.DataFrame({"user_id": users, "part": names, "whole": wholes})

    crossing = parts.filter(F.size("parts") > 1).select("user_id", "parts").distinct()
    whole = map_groups(crossing, ["user_id"], merge_parts, f"user_id {kind}, part string, whole string")
    out = parts.select("user_id", "cell", F.get("parts", F.lit(0)).alias("part")).join(whole, ["user_id", "part"], "left")
    return out.select("user_id", "cell", F.coalesce("whole", "part").alias("place"))


def clustered(rows: DataFrame, columns: list[str], cut_metres: float) -> DataFrame:
    """rows (a user's trips or stops) with `place` and, in it, `cluster`; rows without all columns are in none and left out.

    Average linkage never merges across a gap wider than the cut, so a user's
    points part without loss into places: groups of cells of the cut's size
    that touch. Only a place's distinct points, with their numbers, meet in a
    task. The rows are computed once, into a staged table, when this is called.
    """
    cut = cut_metres / DEGREE
    rows = staged(rows.dropna(subset=columns), "clustered")
    points = rows.groupBy("user_id", *columns).agg(F.count("*").alias("weight"))
    points = points.withColumn("cell", F.array(*[F.floor(F.col(c) / (cut * 1.001)).cast("bigint") for c in columns]))  # the margin: rounding
    points = points.join(components(points.select("user_id", "cell").distinct()), ["user_id", "cell"]).drop("cell")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name in ("user_id", "place", *columns))

    def run(found: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        x, weight = found[columns].to_numpy(float), found["weight"].to_numpy()
        cluster = np.zeros(len(found), dtype=np.int32)
        ends = np.append(starts[1:], len(found))
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            order = a + np.lexsort(x[a:b].T[::-1])
            cluster[order] = average_linkage(x[order], cut, weight[order])
        return found.drop(columns="weight").assign(cluster=cluster)

    found = map_groups(points, ["user_id", "place"], run, f"{kind}, cluster int")
    return rows.join(found, ["user_id", *columns])
