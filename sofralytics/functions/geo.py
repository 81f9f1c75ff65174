"""Distances and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sofralytics.functions import fixed_values as fv

KM_PER_DEGREE = 111.19492664455873  # great-circle length of one degree on the 6371 km sphere


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres; NULL when a coordinate is missing."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (half_lng * half_lng)
    return F.lit(2 * fv.EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """Four range predicates that reach the file scan."""
    return lat.between(south, north) & lng.between(west, east)


def within_km(lat: Column, lng: Column, centre_lat: float, centre_lng: float, radius_km: float) -> Column:
    """Inside a circle: the bounding box prunes files and rows first, the exact distance decides."""
    from math import cos, radians

    d_lat = radius_km / KM_PER_DEGREE * 1.0000001
    edge = min(89.9, abs(centre_lat) + d_lat)
    d_lng = min(180.0, d_lat / cos(radians(edge)))
    box = in_box(lat, lng, centre_lat - d_lat, centre_lng - d_lng, centre_lat + d_lat, centre_lng + d_lng)
    return box & (haversine_km(lat, lng, F.lit(centre_lat), F.lit(centre_lng)) <= radius_km)


def nearest_district(lat: Column, lng: Column) -> Column:
    """Name of the nearest district centre by squared degrees; the earlier one wins a tie."""
    options = [
        F.struct(
            ((lat - F.lit(y)) * (lat - F.lit(y)) + (lng - F.lit(x)) * (lng - F.lit(x))).alias("d2"),
            F.lit(i).alias("i"),
            F.lit(name).alias("name"),
        )
        for i, (name, y, x) in enumerate(fv.DISTRICT_CENTRES)
    ]
    return F.when(lat.isNotNull() & lng.isNotNull(), F.least(*options)["name"])


def district(address: Column, lat: Column, lng: Column) -> Column:
    """District named in the address, else the nearest centre; empty when neither is known."""
    from sofralytics.functions.parsing import district_from_text

    named = district_from_text(address)
    return F.when(named != "", named).otherwise(F.coalesce(nearest_district(lat, lng), F.lit("")))
