"""Spherical geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phenogrid.rules import COMPASS


def unit_vector(lng: Column, lat: Column) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat), F.radians(lng)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def lng_of(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def lat_of(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.atan2(z, F.hypot(x, y)))


def clipped(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def arc(lng_a: Column, lat_a: Column, lng_b: Column, lat_b: Column) -> Column:
    """Central angle in radians."""
    a, b = unit_vector(lng_a, lat_a), unit_vector(lng_b, lat_b)
    return F.acos(clipped(a[0] * b[0] + a[1] * b[1] + a[2] * b[2], -1.0, 1.0))


def along_arc(lng_a: Column, lat_a: Column, lng_b: Column, lat_b: Column, angle: Column, part: Column) -> tuple[Column, Column]:
    """(lng, lat) at ``part`` of the great circle from a to b; a itself when the arc is nil."""
    a, b = unit_vector(lng_a, lat_a), unit_vector(lng_b, lat_b)
    still = angle < 1e-9
    ka = F.when(still, 1.0).otherwise(F.sin((1 - part) * angle) / F.sin(angle))
    kb = F.when(still, 0.0).otherwise(F.sin(part * angle) / F.sin(angle))
    x, y, z = (p * ka + q * kb for p, q in zip(a, b, strict=True))
    return lng_of(x, y), F.degrees(F.asin(clipped(z, -1.0, 1.0)))


def compass(degrees: Column) -> Column:
    sector = F.pmod(F.floor(degrees / 45 + 0.5), F.lit(8)).cast("int")
    return F.get(F.array(*[F.lit(word) for word in COMPASS]), sector)


def blows_from(u: Column, v: Column) -> Column:
    """Sector a wind comes from (u towards east, v towards north)."""
    return compass(F.pmod(F.degrees(F.atan2(u, v)) + 540, F.lit(360.0)))


def flows_towards(u: Column, v: Column) -> Column:
    """Sector a current goes to."""
    return compass(F.pmod(F.degrees(F.atan2(u, v)) + 360, F.lit(360.0)))
