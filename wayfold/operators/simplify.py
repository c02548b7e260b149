"""Ramer-Douglas-Peucker simplification of trips, many trips at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wayfold.functions.groups import map_groups


def distances(p: np.ndarray, a: np.ndarray, b: np.ndarray, correct_axes: bool = False) -> np.ndarray:
    """Metres of points from the line a-b (or each from its own); the same plane as functions.geo.line_distance."""
    north = 0 if correct_axes else 1
    shrink = 111412.84 * np.cos(np.radians((p[:, north] + a[..., north] + b[..., north]) / 3))
    sx, sy = (np.full(len(p), 111132.92), shrink) if north == 0 else (shrink, np.full(len(p), 111132.92))
    dx, dy = (b[..., 0] - a[..., 0]) * sx, (b[..., 1] - a[..., 1]) * sy
    px, py = (p[:, 0] - a[..., 0]) * sx, (p[:, 1] - a[..., 1]) * sy
    length = np.hypot(dx, dy)
    safe = np.where(length > 0, length, 1)
    return np.where(length > 0, np.abs(dy * px - dx * py) / safe, np.hypot(px, py))


def kept_all(points: np.ndarray, starts: np.ndarray, epsilon: float = 10.0, correct_axes: bool = False) -> np.ndarray:
    """Mask of the points that stay, of trips that begin at starts; of equally far points the first splits. All parts that are still to be split are looked at together."""
    keep = np.zeros(len(points), dtype=bool)
    i, j = starts, np.append(starts[1:], len(points)) - 1
    keep[i] = keep[j] = True
    while len(wide := np.flatnonzero(j - i >= 2)):
        i, j = i[wide], j[wide]
        n = j - i - 1
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of)) - first[of] + i[of] + 1
        d = distances(points[at], points[i[of]], points[j[of]], correct_axes)
        far = np.maximum.reduceat(d, first)
        k = np.minimum.reduceat(np.where(d == far[of], at, len(points)), first)
        split = far > epsilon
        i, j, k = i[split], j[split], k[split]
        keep[k] = True
        i, j = np.concatenate((i, k)), np.concatenate((k, j))
    return keep


def kept(points: np.ndarray, epsilon: float = 10.0, correct_axes: bool = False) -> np.ndarray:
    """The same of one trip."""
    return kept_all(points, np.zeros(min(1, len(points)), dtype=np.int64), epsilon, correct_axes)


def simplify(points: DataFrame, *, epsilon: float = 10.0, correct_axes: bool = False) -> DataFrame:
    """The points of each trip that stay. A trip is one task's work, many trips a batch's; users with many trips spread by trip."""
    columns = ["user_id", "trip_id", "point_index", "event_id", "timestamp_unix", "lat", "lon"]

    def run(g: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        trip = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(g))))
        g = g.iloc[np.lexsort((g["event_id"], g["point_index"], g["timestamp_unix"], trip))]
        return g[kept_all(g[["lat", "lon"]].to_numpy(float), starts, epsilon, correct_axes)]

    rows = points.select(*columns)
    return map_groups(rows, ["user_id", "trip_id"], run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
