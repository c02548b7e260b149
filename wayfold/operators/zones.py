"""Which circles hold a point, by an equi-join on grid cells.

A circle lies on the level of the grid whose cells are just as large as its
radius, and is known in the few cells (nine, more towards the poles) that it
may reach. A point asks one cell of each level that its user's circles lie on.
Rows of the grid are bands of latitude; each has as many columns as keep their
width near its height, so that columns close around the globe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.schema import EARTH_RADIUS_M

#: Metres to a side of the finest cells, and metres to a degree of latitude.
FINEST, DEGREE = 64.0, math.radians(1) * EARTH_RADIUS_M
LEVELS = 24
ENDS = {"start": ("start_lat", "start_lon", "start_radius"), "end": ("end_lat", "end_lon", "end_radius")}


def level(radius: Column) -> Column:
    """The level whose cells are as large as the radius, or twice as large at most."""
    return F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(radius, F.lit(FINEST)) / FINEST)))).cast("int")


def _side(at: Column) -> Column:
    return F.pow(F.lit(2.0), at) * (FINEST / DEGREE)


def _columns(row: Column, side: Column) -> Column:
    """How many columns a row has: by its edge nearer to a pole."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(row * side - 90), F.abs((row + 1) * side - 90)))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / side)).cast("bigint")


def _id(at: Column, row: Column, column: Column) -> Column:
    return (at.cast("bigint") * (1 << 22) + row) * (1 << 24) + column


def _row(lat: Column, side: Column) -> Column:
    return F.floor((lat + 90) / side).cast("bigint")


def cell(lat: Column, lon: Column, at: Column) -> Column:
    side = _side(at)
    row = _row(lat, side)
    n = _columns(row, side)
    return _id(at, row, F.pmod(F.floor((lon + 180) / 360 * n).cast("bigint"), n))


def cells_around(lat: Column, lon: Column, radius: Column, at: Column) -> Column:
    """Array of the cells of the level that a circle may reach, each once."""
    side, reach = _side(at), radius * (1.0001 / DEGREE)
    far = F.least(F.lit(90.0), F.abs(lat) + reach)
    # beyond a pole a circle spans all longitudes
    wide = F.when(far >= 89.999999, 180.0).otherwise(F.least(F.lit(180.0), reach / F.cos(F.radians(far))))
    rows = F.sequence(_row(F.greatest(F.lit(-90.0), lat - reach), side), _row(F.least(F.lit(90.0), lat + reach), side))

    def columns(row: Column) -> Column:
        n = _columns(row, side)
        first, last = F.floor((lon - wide + 180) / 360 * n).cast("bigint"), F.floor((lon + wide + 180) / 360 * n).cast("bigint")
        return F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda c: _id(at, row, F.pmod(c, n)))

    return F.flatten(F.transform(rows, columns))


def met(trips: DataFrame, zones: DataFrame, *, key: str = "user_id", ends: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of trips and routes of the same user where both ends lie in the route's circles.

    trips: key and, by end, the columns of its latitude and longitude (default:
    those of the routes' own names). Columns of the result: key, `trip` (a
    struct of all columns), `zone` (likewise), start_distance, end_distance.
    Rows without a coordinate or radius meet nothing.
    """
    ends = ends or {e: c[:2] for e, c in ENDS.items()}
    # flat columns under names of their own on the way through the join, structs again behind it
    z_name, t_name = ({c: f"_{side}{i}" for i, c in enumerate(df.columns)} for side, df in (("z", zones), ("t", trips)))
    z_end, t_end = {e: [z_name[c] for c in cols] for e, cols in ENDS.items()}, {e: [t_name[c] for c in cols] for e, cols in ends.items()}
    flat = lambda df, names, needed: df.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()]).dropna(subset=["_key", *[c for cols in needed.values() for c in cols]])
    z = flat(zones, z_name, z_end).withColumns({f"{e}_level": level(F.col(cols[2])) for e, cols in z_end.items()})
    asked = z.select("_key", *[f"{e}_level" for e in ENDS]).distinct()
    for e, (lat, lon, radius) in z_end.items():
        z = z.withColumn(f"{e}_cell", F.explode(cells_around(F.col(lat), F.col(lon), F.col(radius), F.col(f"{e}_level"))))
    t = flat(trips, t_name, t_end).join(asked, "_key")
    t = t.withColumns({f"{e}_cell": cell(F.col(lat), F.col(lon), F.col(f"{e}_level")) for e, (lat, lon) in t_end.items()})
    levels = [f"{e}_level" for e in ENDS]
    both = t.drop(*levels).join(z.drop(*levels), ["_key", *[f"{e}_cell" for e in ENDS]])
    both = both.withColumns({f"{e}_distance": geo.haversine(F.col(t_end[e][0]), F.col(t_end[e][1]), F.col(lat), F.col(lon)) for e, (lat, lon, _) in z_end.items()})
    both = both.filter(" and ".join(f"{e}_distance <= {z_end[e][2]}" for e in ENDS))
    whole = lambda names: F.struct(*[F.col(n).alias(c) for c, n in names.items()])
    return both.select(F.col("_key").alias(key), whole(t_name).alias("trip"), whole(z_name).alias("zone"), *[f"{e}_distance" for e in ENDS])
