"""Value <-> byte contracts of raster channels, and the land-class rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phenogrid.rules import (
    ELEVATION_OFFSET, FLAT_SHADE, GAMMA, GREENNESS_TOP, GREENNESS_WORDS, ICE_SHEET_MIN_M, LAND_CLASSES,
    REFLECTANCE_WHITE, SEA_BYTE, SNOW_CLASS, WATER_CLASS, Channel,
)


def whole(value: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.rint(value)


def clip_int(value: Column, lo: int, hi: int) -> Column:
    return F.least(F.greatest(value, F.lit(float(lo))), F.lit(float(hi))).cast("int")


def to_byte(value: Column, ch: Channel) -> Column:
    """0..255 over the channel's range; no data reads as the low end."""
    v = F.coalesce(value, F.lit(float(ch.lo)))
    return clip_int(whole((v - ch.lo) / (ch.hi - ch.lo) * 255), 0, 255)


def from_byte(byte: Column, ch: Channel) -> Column:
    return F.lit(float(ch.lo)) + byte / F.lit(255.0) * (ch.hi - ch.lo)


def to_flagged_byte(value: Column, ch: Channel) -> Column:
    """1..255 over the channel's range, 0 for no data."""
    scaled = clip_int(whole((value - ch.lo) / (ch.hi - ch.lo) * 254 + 1), 1, 255)
    return F.when(value.isNull(), F.lit(0)).otherwise(scaled)


def from_flagged_byte(byte: Column, ch: Channel) -> Column:
    return F.when(byte > 0, F.lit(float(ch.lo)) + (byte - 1) / F.lit(254.0) * (ch.hi - ch.lo))


def elevation_word(metres: Column) -> Column:
    return clip_int(whole(F.coalesce(metres, F.lit(0.0)) + ELEVATION_OFFSET), 0, 65535)


def elevation_high(metres: Column) -> Column:
    return F.shiftright(elevation_word(metres), 8)


def elevation_low(metres: Column) -> Column:
    return elevation_word(metres).bitwiseAND(F.lit(255))


def elevation_metres(high: Column, low: Column) -> Column:
    return high * 256 + low - ELEVATION_OFFSET


def log_lights(radiance: Column) -> Column:
    return F.log10(F.lit(1.0) + F.greatest(F.coalesce(radiance, F.lit(0.0)), F.lit(0.0)))


def log_chlorophyll(value: Column) -> Column:
    return F.when(value > 0, F.log10(value))


def share_byte(share: Column) -> Column:
    return clip_int(whole(F.coalesce(share, F.lit(0.0)) * 255), 0, 255)


def is_sea(byte: Column) -> Column:
    return byte >= SEA_BYTE


def colour_byte(reflectance: Column) -> Column:
    """Display byte of a surface reflectance, gamma encoded; no scene is 0."""
    v = F.least(F.greatest(F.coalesce(reflectance, F.lit(0.0)) / REFLECTANCE_WHITE, F.lit(0.0)), F.lit(1.0))
    return whole(F.pow(v, F.lit(GAMMA)) * 255).cast("int")


def class_of_code(code: Column) -> Column:
    """Class index of a land-cover code, 0 for anything unknown."""
    chain = F.lit(0)
    for index, _, _, known in LAND_CLASSES:
        if known is not None:
            chain = F.when(code == known, F.lit(index)).otherwise(chain)
    return F.when(code.isNull(), F.lit(0)).otherwise(chain)


def land_class(code: Column, land_share: Column, sea_share: Column, ice_m: Column) -> Column:
    """Class per pixel: unmapped land and modelled sea are ocean, thick ice beyond the map is snow."""
    cls = class_of_code(code)
    unmapped = F.coalesce(land_share, F.lit(0.0)) < 0.5
    sea = (cls == WATER_CLASS) & (F.coalesce(sea_share, F.lit(0.0)) >= 0.5)
    ice = unmapped & (F.coalesce(ice_m, F.lit(0.0)) >= ICE_SHEET_MIN_M)
    return F.when(ice, F.lit(SNOW_CLASS)).when(unmapped | sea, F.lit(0)).otherwise(cls)


def land_tree(cls: Column, tree_byte: Column) -> Column:
    return F.when(cls == 0, F.lit(0)).otherwise(tree_byte)


def shade_or_flat(shade: Column) -> Column:
    return clip_int(whole(F.coalesce(shade, F.lit(float(FLAT_SHADE)))), 0, 255)


def water_share(recurrence: Column, mask: Column) -> Column:
    """Share of the whole pixel under water: recurrence of its wet part times how much of it is wet."""
    return F.coalesce(recurrence * mask, F.lit(0.0))


def greenness(ndvi: Column) -> Column:
    chain = F.lit(GREENNESS_TOP)
    for limit, word in reversed(GREENNESS_WORDS):
        chain = F.when(ndvi < limit, F.lit(word)).otherwise(chain)
    return chain
