"""Scalar expressions for roads: class speeds, travel times, distances, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: km/h by road class, the first part that the class contains wins.
CLASS_SPEEDS = [("motorway", 50.0), ("trunk", 50.0), ("primary", 40.0), ("secondary", 30.0), ("tertiary", 25.0), ("residential", 20.0), ("living_street", 20.0), ("unclassified", 20.0)]
OTHER_SPEED = 15.0
EARTH_M = 6_371_000.0


def class_speed(highway: Column) -> Column:
    h, out = F.lower(highway), F.lit(OTHER_SPEED)
    for part, kmh in reversed(CLASS_SPEEDS):
        out = F.when(h.contains(part), kmh).otherwise(out)
    return out


def travel_time(length_m: Column, kmh: Column) -> Column:
    """Seconds, at 3 km/h at least, and no less than a millisecond."""
    return F.greatest(F.coalesce(length_m, F.lit(10.0)) / (F.greatest(kmh, F.lit(3.0)) / 3.6), F.lit(0.001))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def remaining_time(lat1: Column, lon1: Column, lat2: Column, lon2: Column, free_kmh: float = 25.0) -> Column:
    """Straight-line seconds at free flow (1 m/s at least); 0 where a coordinate is missing."""
    return F.coalesce(haversine(lat1, lon1, lat2, lon2) / max(free_kmh / 3.6, 1.0), F.lit(0.0))


def speed_class(kmh: Column) -> Column:
    return F.when(kmh >= 35, "free").when(kmh >= 20, "moderate").otherwise("congested")


def component_rating(share: Column) -> Column:
    return F.when(share > 80, "excellent").when(share >= 50, "acceptable").when(share >= 20, "weak").otherwise("unusable")


def period(hour: Column) -> Column:
    return F.when(hour.between(9, 11), "morning_peak").when(hour.between(17, 20), "evening_peak").when(hour.between(12, 16), "midday").otherwise("off_peak")


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Bin number of (e0, e1], (e1, e2], ...; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        out = F.when((value > edges[i]) & (value <= edges[i + 1]), i).otherwise(out)
    return out
