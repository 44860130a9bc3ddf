"""Tile sets: availability, ancestors, sources of a tile, and shard replacement.

Tiles are rows ``(z, x, y)``. Availability is kept as the distinct tile table; the bit index of a
level is a product of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import tiles
from phenogrid.rules import LAND_CLASSES

INDEX_WORD = 4096 * 8  # bits of one stored chunk of a level's index


def tiles_of_points(points: DataFrame, z: int) -> DataFrame:
    return points.select(
        "*", F.lit(z).alias("z"), tiles.tile_x(F.col("lng"), z).alias("x"), tiles.tile_y(F.col("lat"), z).alias("y")
    )


def level_cols(z: Column) -> Column:
    return F.call_function("shiftleft", F.lit(2).cast("long"), z)


def ancestors(rows: DataFrame, lowest: int = 0) -> DataFrame:
    """Every ancestor of every tile down to level ``lowest`` (the tile itself is not one)."""
    spread = rows.where(F.col("z") > lowest).withColumn("_l", F.explode(F.sequence(F.lit(lowest), F.col("z") - 1)))
    by = F.col("z") - F.col("_l")
    return spread.select(
        F.col("_l").alias("z"), F.call_function("shiftright", F.col("x"), by).alias("x"),
        F.call_function("shiftright", F.col("y"), by).alias("y"),
    )


def reach(rows: DataFrame) -> DataFrame:
    """Tiles with some tile below them."""
    return ancestors(rows).distinct()


def has_deeper(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    return candidates.join(reach(rows), ["z", "x", "y"], "left_semi")


def descendants(rows: DataFrame, levels: int) -> DataFrame:
    """Every tile ``levels`` below, row-major inside its ancestor."""
    side = 2**levels
    steps = F.sequence(F.lit(0), F.lit(side - 1))
    spread = rows.withColumn("_j", F.explode(steps)).withColumn("_i", F.explode(steps))
    return spread.select(
        F.col("z").alias("from_z"), F.col("x").alias("from_x"), F.col("y").alias("from_y"),
        (F.col("z") + levels).alias("z"), (F.col("x") * side + F.col("_i")).alias("x"), (F.col("y") * side + F.col("_j")).alias("y"),
    )


def tiles_in_boxes(boxes: DataFrame, z: int) -> DataFrame:
    """Tiles that overlap each box (id, west, south, east, north)."""
    edge = tiles.tile_span(z)
    x0 = F.greatest(F.floor((F.col("west") + 180) / edge), F.lit(0))
    x1 = F.least(F.ceil((F.col("east") + 180) / edge), F.lit(tiles.tile_cols(z))) - 1
    y0 = F.greatest(F.floor((F.lit(90) - F.col("north")) / edge), F.lit(0))
    y1 = F.least(F.ceil((F.lit(90) - F.col("south")) / edge), F.lit(tiles.tile_rows(z))) - 1
    spread = boxes.withColumn("y", F.explode(F.sequence(y0.cast("int"), y1.cast("int"))))
    spread = spread.withColumn("x", F.explode(F.sequence(x0.cast("int"), x1.cast("int"))))
    return spread.select("id", F.lit(z).alias("z"), "x", "y")


def site_boxes(points: DataFrame, z: int, radius: int) -> DataFrame:
    """Box of whole tiles, (2 radius + 1) a side and cut at the edges of the world, around each point."""
    x, y = tiles.tile_x(F.col("lng"), z), tiles.tile_y(F.col("lat"), z)
    edge = tiles.tile_span(z)
    x0, x1 = F.greatest(x - radius, F.lit(0)), F.least(x + radius, F.lit(tiles.tile_cols(z) - 1))
    y0, y1 = F.greatest(y - radius, F.lit(0)), F.least(y + radius, F.lit(tiles.tile_rows(z) - 1))
    return points.select(
        "id", tiles.tile_west(x0, z).alias("west"), (tiles.tile_north(y1, z) - edge).alias("south"),
        (tiles.tile_west(x1, z) + edge).alias("east"), tiles.tile_north(y0, z).alias("north"),
    )


def level_index(rows: DataFrame) -> DataFrame:
    """Bit index of each level (bit y * cols + x, lowest first), base64, in chunks of 4096 bytes.

    A chunk is built by the bitmap aggregate with map-side combining; chunk ``n`` starts at byte
    4096 n, so the chunks put together are the whole index. Trailing zero bytes of a level beyond
    its last tile are part of the last chunk.
    """
    bit = F.col("y").cast("long") * level_cols(F.col("z")) + F.col("x")
    return rows.select("z", bit.alias("bit")).groupBy("z", F.floor(F.col("bit") / INDEX_WORD).alias("chunk")).agg(
        F.base64(F.bitmap_construct_agg((F.col("bit") % INDEX_WORD).cast("long"))).alias("bits"), F.count_distinct("bit").alias("tiles"),
    )


def level_counts(rows: DataFrame) -> DataFrame:
    return rows.distinct().groupBy("z").agg(F.count("*").alias("tiles"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def land_tile_plan(mask: DataFrame, width: int, height: int, z: int, dilate: int = 1) -> DataFrame:
    """Level-z tiles with land in a global mask (gx, gy of land pixels), grown by ``dilate`` pixels.

    The mask wraps on both axes, as rolling an array does. Tiles coarser than a mask pixel hold
    any of its pixels; finer ones read the pixel under their centre.
    """
    steps = F.array(*[F.lit(d) for d in range(-dilate, dilate + 1)])
    grown = (
        mask.select("gx", "gy").withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
        .select(F.pmod(F.col("gx") + F.col("_dx"), F.lit(width)).alias("gx"), F.pmod(F.col("gy") + F.col("_dy"), F.lit(height)).alias("gy"))
        .distinct()
    )
    cols, rows = tiles.tile_cols(z), tiles.tile_rows(z)
    if height % rows == 0 and width % cols == 0:
        x, y = F.floor(F.col("gx") / (width // cols)), F.floor(F.col("gy") / (height // rows))
        return grown.select(x.cast("int").alias("x"), y.cast("int").alias("y")).distinct()
    from phenogrid.operators.raster import resample_nearest

    return resample_nearest(grown, height, width, rows, cols).select(F.col("gx").alias("x"), F.col("gy").alias("y"))


def sampled_ancestor(rows: DataFrame, have: DataFrame, finest: int) -> DataFrame:
    """For tiles finer than ``finest``: the ancestor they sample and where they sit inside it."""
    by = F.greatest(F.col("z") - finest, F.lit(0))
    n = F.call_function("shiftleft", F.lit(1), by)
    ax, ay = F.call_function("shiftright", F.col("x"), by), F.call_function("shiftright", F.col("y"), by)
    placed = rows.select(
        "z", "x", "y", (F.col("z") - by).alias("az"), ax.alias("ax"), ay.alias("ay"), (F.lit(1.0) / n).alias("scale"),
        ((F.col("x") - ax * n) / n).alias("u"), ((F.col("y") - ay * n) / n).alias("v"),
    )
    held = have.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    return placed.join(held, ["az", "ax", "ay"], "left_semi")


def source_for(rows: DataFrame, availability: DataFrame) -> DataFrame:
    """The tile set that holds each tile, the one whose levels start finest first.

    ``availability`` has set, min_level, z, x, y. The best is a ``max_by`` with map-side combining.
    """
    best = availability.groupBy("z", "x", "y").agg(F.max_by("set", F.struct("min_level", "set")).alias("set"))
    return rows.join(best, ["z", "x", "y"], "left")


class ForeignTileError(ValueError):
    """A shard's drop holds a tile that is not the shard's."""


def absorb_shard(served: DataFrame, incoming: DataFrame, shard: tuple[int, int, int]) -> DataFrame:
    """Served tiles with one shard's tiles replaced at the levels it brings.

    Tiles of other shards and of other levels stay. A drop with a tile outside its shard is refused whole.
    """
    stray = foreign_tiles(incoming, shard).select("z", "x", "y").first()
    if stray is not None:
        raise ForeignTileError(f"shard {'/'.join(map(str, shard))} brings tile {'/'.join(map(str, stray))} from outside")
    levels = incoming.select("z").distinct()
    mine = inside_shard(served, shard).join(F.broadcast(levels), "z", "left_semi")
    kept = served.join(mine.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_anti")
    return kept.unionByName(incoming.select(*served.columns))


def inside_shard(rows: DataFrame, shard: tuple[int, int, int]) -> DataFrame:
    return rows.where(_inside(shard))


def foreign_tiles(incoming: DataFrame, shard: tuple[int, int, int]) -> DataFrame:
    """Incoming tiles that lie outside the shard: a reason to refuse it."""
    return incoming.where(~_inside(shard))


def _inside(shard: tuple[int, int, int]) -> Column:
    sz, sx, sy = shard
    by = F.greatest(F.col("z") - sz, F.lit(0))
    return (
        (F.col("z") >= sz) & (F.call_function("shiftright", F.col("x"), by) == sx)
        & (F.call_function("shiftright", F.col("y"), by) == sy)
    )


def region_levels(rows: DataFrame, shard_level: int = 3) -> DataFrame:
    """Shards present in a tile set with their first and last level, for the manifest."""
    by = F.col("z") - shard_level
    deep = rows.where(F.col("z") >= shard_level)
    return deep.groupBy(
        F.call_function("shiftright", F.col("x"), by).alias("sx"), F.call_function("shiftright", F.col("y"), by).alias("sy")
    ).agg(F.min("z").alias("first_level"), F.max("z").alias("last_level"), F.count("*").alias("tiles"))


WORLD = (-180.0, -90.0, 180.0, 90.0)


def manifest(
    rows: DataFrame, name: str, channels: list, sources: dict[str, str] | None = None, units: dict[str, str] | None = None, tile_px: int = 256,
    bounds: tuple[float, float, float, float] = WORLD, ndvi: tuple[int, int] | None = None, rgb: str | None = None, regions: int | None = None,
) -> DataFrame:
    """One row that describes a tile set: scheme, levels, bounds, counts, channels, land classes, regions.

    ``ndvi`` gives the levels with greenness tiles of their own, ``rgb`` the path of true-colour tiles, ``regions`` the
    level of the shards to list. What is gathered is bounded: an entry per level and per shard. The bit index grows with
    the tiles and is a table of its own, ``level_index``, found under ``index``.
    """
    one = F.lit(1).alias("_one")
    counts = level_counts(rows).groupBy().agg(
        F.min("z").alias("first_level"), F.max("z").alias("last_level"),
        F.sort_array(F.collect_list(F.struct("z", "tiles"))).alias("counts"),
    )
    if regions is None:
        counts = counts.withColumn("regions", F.array().cast("array<struct<shard:string,first_level:int,last_level:int>>"))
    else:
        shard = F.concat_ws("/", F.lit(regions), "sx", "sy").alias("shard")
        listed = region_levels(rows, regions).agg(F.sort_array(F.collect_list(F.struct(shard, "first_level", "last_level"))).alias("regions"))
        counts = counts.select("*", one).join(listed.select("*", one), "_one").drop("_one")  # one row each
    encodings = {"class": "class index", "hillshade": "brightness"}
    described = F.array(*[
        F.struct(
            F.lit(c.name).alias("name"), F.lit(float(c.lo)).alias("lo"), F.lit(float(c.hi)).alias("hi"), F.lit((units or {}).get(c.name)).cast("string").alias("unit"),
            F.lit((sources or {}).get(c.name)).cast("string").alias("source"), F.lit(encodings.get(c.name, "linear from lo to hi")).alias("encoding"),
        )
        for c in channels
    ])
    classes = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(n).alias("name"), F.lit(label).alias("label"), F.lit(code).cast("int").alias("code")) for i, n, label, code in LAND_CLASSES])
    levels = F.array(*[F.lit(z) for z in ndvi]) if ndvi else F.lit(None).cast("array<int>")
    return counts.select(
        F.lit(1).alias("version"), F.lit(name).alias("name"), F.lit("EPSG:4326, 2^(z+1) x 2^z tiles, y from the north").alias("scheme"), F.lit(tile_px).alias("tile_px"),
        F.array(*[F.lit(float(x)) for x in bounds]).alias("bounds"), "first_level", "last_level", "counts", F.lit("index").alias("index"),
        described.alias("channels"), classes.alias("classes"), levels.alias("ndvi_levels"), F.lit(rgb).cast("string").alias("rgb_path"), "regions",
    )
