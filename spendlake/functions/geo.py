"""Geographic column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((b - a) / 2)
    half_lng = F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    h = half_lat * half_lat + F.cos(a) * F.cos(b) * half_lng * half_lng
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def place_key(lat: Column, lng: Column, address: Column, digits: int = 4) -> Column:
    """``lat,lng`` at fixed digits, else the address, else ``unknown_location``."""
    text = F.format_string(f"%.{digits}f,%.{digits}f", lat, lng)
    return F.when(lat.isNotNull() & lng.isNotNull(), text).otherwise(
        F.coalesce(F.when(address != "", address), F.lit("unknown_location"))
    )
