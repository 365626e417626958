"""Geodetic functions as Column expressions. Angles in degrees, distances in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii and metres per degree of the models in use.
SPHERE = 6_371_000.0
EQUATOR = 6_378_137.0
PER_DEGREE_LON, PER_DEGREE_LAT = 111_320.0, 110_540.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, null without coordinates; the root's argument is kept within
    0 and 1."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # greatest and least skip nulls, so a missing coordinate is kept apart.
    return F.when(a.isNotNull(), 2 * SPHERE * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a)))))


def move_enu(lat: Column, lon: Column, east: Column, north: Column, radius: float = SPHERE) -> Column:
    """Struct ``lat``, ``lon`` after a local step; longitude is scaled at the start."""
    new_lat = lat + F.degrees(north / radius)
    new_lon = lon + F.degrees(east / (radius * F.cos(F.radians(lat))))
    return F.struct(new_lat.alias("lat"), new_lon.alias("lon"))


def to_enu(lat: Column, lon: Column, lat0: Column, lon0: Column, radius: float = SPHERE) -> Column:
    """Struct ``east``, ``north`` of a point about a reference."""
    east = F.radians(lon - lon0) * radius * F.cos(F.radians(lat0))
    return F.struct(east.alias("east"), (F.radians(lat - lat0) * radius).alias("north"))


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Struct ``east``, ``north`` by fixed metres per degree."""
    east = (lon - lon0) * PER_DEGREE_LON * F.cos(F.radians(lat0))
    return F.struct(east.alias("east"), ((lat - lat0) * PER_DEGREE_LAT).alias("north"))


def normalize_heading(h: Column) -> Column:
    """0 (included) to 360 (not)."""
    return (h % 360 + 360) % 360


def angle_diff_deg(target: Column, current: Column) -> Column:
    """Signed turn from current to target, -180 to 180; the remainder keeps its sign."""
    d = (target - current) % 360
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def abs_angle_diff_deg(a: Column, b: Column) -> Column:
    return F.abs(angle_diff_deg(a, b))


def bearing_from_enu(east: Column, north: Column) -> Column:
    """Compass bearing of a local step."""
    return (F.degrees(F.atan2(east, north)) + 360) % 360


def drift_percent(error: Column, distance: Column) -> Column:
    """Error in percent of the distance; NaN if either is NaN or the distance is nil."""
    undefined = F.isnan(error) | F.isnan(distance) | (distance < 1e-6)
    return F.when(undefined, F.lit(math.nan)).otherwise(F.try_divide(error, distance) * 100)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)


def to_compass_deg(math_rad: Column) -> Column:
    """Compass degrees of a mathematical angle from East."""
    return normalize_heading(90 - F.degrees(math_rad))
