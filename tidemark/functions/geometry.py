"""Plane and sphere geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres between points in degrees."""
    half_lon = F.radians(lon2 - lon1) / 2
    half_lat = F.radians(lat2 - lat1) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def bearing(
    lon1: Column, lat1: Column, lon2: Column, lat2: Column, reference: Column | None = None
) -> Column:
    """Heading in degrees from the first point to the second, clockwise from ``reference``."""
    reference = F.lit(0.0) if reference is None else reference
    dlon = F.radians(lon2 - lon1)
    east = F.sin(dlon) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)) - reference, F.lit(360.0))


def rotate_2d(x: Column, y: Column, theta: Column) -> tuple[Column, Column]:
    """Row vector times the rotation matrix ((cos, -sin), (sin, cos))."""
    return (
        x * F.cos(theta) + y * F.sin(theta),
        y * F.cos(theta) - x * F.sin(theta),
    )
