"""Coordinates in text and distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Thresholds


def strict_coordinate(packed: Column, place: int) -> Column:
    """Part `place` of a text split at bars, if it is a decimal number with digits on both sides of the point."""
    part = F.trim(F.get(F.split(packed, r"\|"), F.lit(place)))
    return F.when(part.rlike(r"^[+-]?\d+\.\d+$"), part.try_cast("double"))


def lenient_coordinates(packed: Column) -> Column:
    """struct(lat, lon): whole numbers too, within 90 and 180 degrees; else the first pair of numbers around a bar."""
    part = lambda i: F.trim(F.get(F.split(packed, r"\|"), F.lit(i))).try_cast("double")
    pair = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    inside = lambda a, b: a.between(-90, 90) & b.between(-180, 180)
    pattern = r"(-?\d+(?:\.\d+)?)\s*\|\s*(-?\d+(?:\.\d+)?)"
    a, b = part(0), part(1)
    c, d = (F.nullif(F.regexp_extract(packed, pattern, i), F.lit("")).try_cast("double") for i in (1, 2))
    nothing = pair(F.lit(None).cast("double"), F.lit(None).cast("double"))
    return F.when(F.coalesce(inside(a, b), F.lit(False)), pair(a, b)).when(F.coalesce(inside(c, d), F.lit(False)), pair(c, d)).otherwise(nothing)


def spaced_coordinate(packed: Column, place: int) -> Column:
    """Part `place` of a text split at space, bar, space; `None` is missing."""
    return F.nullif(F.get(F.split(packed, r" \| "), F.lit(place)), F.lit("None")).try_cast("double")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = Thresholds.earth_radius_m) -> Column:
    """Metres between two places."""
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return F.lit(2 * radius) * F.asin(F.sqrt(h))


def step_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine metres; 0 where the place before is missing."""
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    return F.when(known(lat1) & known(lon1), haversine(lat1, lon1, lat2, lon2)).otherwise(F.lit(0.0))
