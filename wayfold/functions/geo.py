"""Geodesy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.core import cases, per
from wayfold.schema import EARTH_RADIUS_M


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360); 0 for equal points."""
    gap = F.radians(lon2 - lon1)
    x = F.sin(gap) * F.cos(F.radians(lat2))
    y = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(gap)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def bearing_change(before: Column, after: Column) -> Column:
    """Signed turn in [-180, 180]; both ends stay."""
    turn = after - before
    return cases((turn > 180, turn - 360), (turn < -180, turn + 360), other=turn)


def speed(metres: Column, seconds: Column) -> Column:
    return per(metres, seconds)


def acceleration(v1: Column, v2: Column, seconds: Column) -> Column:
    return per(v2 - v1, seconds)


def is_valid_coordinate(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def is_null_island(lat: Column, lon: Column, tolerance: float = 1e-4) -> Column:
    return (F.abs(lat) < tolerance) & (F.abs(lon) < tolerance)


def gps_error(reported: Column, calculated: Column, seconds: Column) -> Column:
    return F.abs(reported - calculated) * seconds


def bounding_box(lat: Column, lon: Column, radius: Column) -> dict[str, Column]:
    """min_lat, max_lat, min_lon, max_lon of a circle; also the prefilter of zone joins."""
    dlat = radius / (F.lit(111132.92) - F.lit(559.82) * F.cos(2 * F.radians(lat)))
    dlon = radius / (F.lit(111412.84) * F.cos(F.radians(lat)))
    return {"min_lat": lat - dlat, "max_lat": lat + dlat, "min_lon": lon - dlon, "max_lon": lon + dlon}


def line_distance(p: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column], *, correct_axes: bool = False) -> Column:
    """Metres of point p from the line a-b, on a plane; points are (lat, lon).

    By default a point's first coordinate is scaled by longitude metres, at the
    mean of the second coordinates; correct_axes scales latitudes by latitude
    metres and longitudes by longitude metres.
    """
    north = 0 if correct_axes else 1
    shrink = F.cos(F.radians((p[north] + a[north] + b[north]) / 3))
    scale = [F.lit(111412.84) * shrink, F.lit(111412.84) * shrink]
    scale[north] = F.lit(111132.92)
    dx, dy = (b[0] - a[0]) * scale[0], (b[1] - a[1]) * scale[1]
    px, py = (p[0] - a[0]) * scale[0], (p[1] - a[1]) * scale[1]
    length = F.sqrt(dx * dx + dy * dy)
    return F.when(length > 0, F.abs(dy * px - dx * py) / length).otherwise(F.sqrt(px * px + py * py))
