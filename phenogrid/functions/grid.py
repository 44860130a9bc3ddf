"""Fixed-degree grid cells, world shards and named regions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from phenogrid.rules import ELSEWHERE, HOME_REGION, REGIONS, SHARDS

WORLD_CELLS = 180 * 360  # cells of one degree: what bounds a per-cell dimension


def snap_lat(lat: Column) -> Column:
    """South edge of the one-degree cell; the pole belongs to the last row."""
    return F.least(F.greatest(F.floor(lat).cast("int"), F.lit(-90)), F.lit(89))


def snap_lng(lng: Column) -> Column:
    """West edge of the one-degree cell; the antimeridian belongs to the last column."""
    return F.least(F.greatest(F.floor(lng).cast("int"), F.lit(-180)), F.lit(179))


def degree_text(value: Column) -> Column:
    """A whole or half degree without a trailing ``.0``."""
    whole = F.floor(value)
    return F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))


def cell_id(lat0: Column, lng0: Column) -> Column:
    return F.concat_ws("_", lat0.cast("string"), lng0.cast("string"))


def cell_id_sized(lat0: Column, lng0: Column) -> Column:
    return F.concat_ws("_", degree_text(lat0), degree_text(lng0))


def cell_at(lng: Column, lat: Column, size: float) -> Column:
    """Cell of any size that holds a point (no clamping at the edges)."""
    return cell_id_sized(F.floor(lat / size) * F.lit(size), F.floor(lng / size) * F.lit(size))


def cell_lat(cell: Column) -> Column:
    """South edge from a cell id, NULL when the id is not ``lat_lng``."""
    parts = F.split(cell, "_")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("double"))


def cell_lng(cell: Column) -> Column:
    parts = F.split(cell, "_")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).try_cast("double"))


def whole_lat(cell: str = "cell") -> Column:
    """South edge of a one-degree cell from its (valid) id."""
    return F.substring_index(cell, "_", 1).cast("int")


def whole_lng(cell: str = "cell") -> Column:
    return F.substring_index(cell, "_", -1).cast("int")


def is_cell_id(cell: Column) -> Column:
    return cell_lat(cell).isNotNull() & cell_lng(cell).isNotNull()


def cell_ring(lat0: Column, lng0: Column, size: float) -> Column:
    """Closed ring of [lng, lat] corners, counter-clockwise from the south-west."""
    south, west, north, east = lat0, lng0, lat0 + F.lit(size), lng0 + F.lit(size)
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return F.array(*[F.array(x, y) for x, y in corners])


def hemisphere_text(value: Column, positive: str, negative: str) -> Column:
    side = F.when(value >= 0, positive).otherwise(negative)
    return F.concat(F.format_string("%.0f", F.abs(value).cast("double")), F.lit("°"), side)


def cell_bounds_text(lat0: Column, lng0: Column, size: float) -> Column:
    return F.concat(
        hemisphere_text(lat0, "N", "S"), F.lit(" to "), hemisphere_text(lat0 + F.lit(size), "N", "S"), F.lit(", "),
        hemisphere_text(lng0, "E", "W"), F.lit(" to "), hemisphere_text(lng0 + F.lit(size), "E", "W"),
    )


def in_box(lat: Column, lng: Column, box: tuple) -> Column:
    """Half-open box."""
    lat0, lat1, lng0, lng1 = box
    return (lat >= lat0) & (lat < lat1) & (lng >= lng0) & (lng < lng1)


def in_shard_box(lat: Column, lng: Column, box: tuple) -> Column:
    """Half-open box on raw coordinates, closed at the north pole and the antimeridian."""
    lat0, lat1, lng0, lng1 = box
    north = lat <= lat1 if lat1 == 90 else lat < lat1
    east = lng <= lng1 if lng1 == 180 else lng < lng1
    return (lat >= lat0) & north & (lng >= lng0) & east


def any_box(lat: Column, lng: Column, boxes, test=in_box) -> Column:
    return reduce(lambda a, b: a | b, [test(lat, lng, box) for box in boxes])


def shard_boxes(shard_id: str) -> tuple:
    for known, _, boxes in SHARDS:
        if known == shard_id:
            return boxes
    raise ValueError(f"unknown shard {shard_id!r}")


def first_box(boxes: list[tuple], lng: str, lat: str) -> str:
    """SQL of the name of the first box (name, lat0, lat1, lng0, lng1) that holds a point, else NULL.

    The boxes are a constant array that is searched per point, so nothing is joined; as a CASE chain
    they would be a method too long for the JVM to compile.
    """
    listed = ", ".join(f"named_struct('name', '{n}', 'a', {a}, 'b', {b}, 'c', {c}, 'd', {d})" for n, a, b, c, d in boxes)
    inside = f"box -> {lat} >= box.a AND {lat} < box.b AND {lng} >= box.c AND {lng} < box.d"
    return f"try_element_at(filter(array({listed}), {inside}), 1).name"


def shard_of(lat0: str = "lat0", lng0: str = "lng0") -> Column:
    """Owner shard of a cell."""
    return F.expr(first_box([(shard, *box) for shard, _, boxes in SHARDS for box in boxes], lng0, lat0))


def region_of(lng: str, lat: str, home: str) -> Column:
    """Named region of a point (two SQL columns): the home set first, then the first box that holds it."""
    return F.expr(f"CASE WHEN {home} THEN '{HOME_REGION}' ELSE coalesce({first_box(list(REGIONS), lng, lat)}, '{ELSEWHERE}') END")


def hilbert_steps() -> list[int]:
    """Step table of the Hilbert curve: for an orientation and the next bit of x and y, the quadrant
    entered and the orientation inside it.

    An orientation is two flags, both axes mirrored and axes swapped. They commute, so following the
    curve only toggles them: entering either lower quadrant swaps, the lower right one also mirrors.
    """
    table = []
    for state in range(4):
        mirrored, swapped = state >> 1, state & 1
        for bits in range(4):
            x, y = (bits >> 1) ^ mirrored, (bits & 1) ^ mirrored
            if swapped:
                x, y = y, x
            lower = 1 - y
            table.append(((3 * x) ^ y) << 2 | (state ^ (lower & x) << 1 ^ lower))
    return table


def hilbert_index(n: int, x: str, y: str) -> Column:
    """Place of (x, y), two SQL columns, along the Hilbert curve of an n x n grid, n a power of two.

    Walks the bits from the top; the running value packs the place so far and the orientation. The
    point is bound as a lambda variable, so what computes it runs once and not once per bit.
    """
    order = n.bit_length() - 1
    table = "array(" + ", ".join(str(v) for v in hilbert_steps()) + ")"
    bits = "(((shiftright(p.x, k) & 1) * 2) + (shiftright(p.y, k) & 1))"
    walk = f"""aggregate(sequence({order - 1}, 0, -1), 0,
        (walk, k) -> shiftleft(shiftright(walk, 2), 4) | {table}[(walk & 3) * 4 + {bits}])"""
    return F.expr(f"transform(array(named_struct('x', {x}, 'y', {y})), p -> shiftright({walk}, 2))[0]")
