"""Distances on a sphere, coordinates and foreign clocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Microseconds from 1601-01-01, where one browser family's clock begins, to 1970-01-01.
WEBKIT_OFFSET = 11_644_473_600_000_000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    """Negative on the southern and western hemispheres."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)


def webkit_time(us: Column) -> Column:
    """Null for the clock's zero."""
    return F.when(us > 0, F.date_trunc("second", F.timestamp_micros(us - WEBKIT_OFFSET)))


def unix_time(us: Column) -> Column:
    return F.when(us > 0, F.date_trunc("second", F.timestamp_micros(us)))


def bounding_box(lat: Column, lon: Column, center_lat: float, center_lon: float, km: float) -> Column:
    """A cheap filter that holds all points within ``km`` of a centre; it can be pushed to the scan."""
    import math

    d_lat = math.degrees(km / EARTH_KM)
    shrink = math.cos(math.radians(min(89.9, abs(center_lat) + d_lat)))
    d_lon = min(180.0, math.degrees(km / EARTH_KM) / shrink)
    inside = lat.between(center_lat - d_lat, center_lat + d_lat)
    if abs(center_lon) + d_lon >= 180 or abs(center_lat) + d_lat >= 90:
        return inside
    return inside & lon.between(center_lon - d_lon, center_lon + d_lon)
