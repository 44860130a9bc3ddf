"""Which tiles of a quadtree hold land, at any level and in any box.

The table is built once from a mask: a row per tile that holds land at its level or has one that does below it. A search
goes down from level 0 and opens only tiles that are there and overlap the box, so it costs what it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import tiles
from phenogrid.operators import tileset
from phenogrid.session import cut_lineage


def whole_levels(width: int, height: int) -> int:
    """The finest level whose tiles are whole blocks of mask pixels."""
    z = 0
    while height % tiles.tile_rows(z + 1) == 0 and width % tiles.tile_cols(z + 1) == 0:
        z += 1
    return z


def occupancy(mask: DataFrame, width: int, height: int, finest: int, dilate: int = 1) -> DataFrame:
    """z, x, y, held (land at this level) of every tile with land at its own or a finer level.

    Levels of whole pixel blocks follow from each other, from the finest such level down to 0. Finer levels read the pixel
    under a tile's centre, each on its own.
    """
    whole = min(whole_levels(width, height), finest)
    level = tileset.land_tile_plan(mask, width, height, whole, dilate).select(F.lit(whole).alias("z"), "x", "y")
    held = level.unionByName(tileset.ancestors(level).distinct())
    for z in range(whole + 1, finest + 1):
        held = held.unionByName(tileset.land_tile_plan(mask, width, height, z, dilate).select(F.lit(z).alias("z"), "x", "y"))
    marked = held.withColumn("held", F.lit(True))
    above = tileset.ancestors(held).withColumn("held", F.lit(False))
    return marked.unionByName(above).groupBy("z", "x", "y").agg(F.bool_or("held").alias("held"))


def _overlaps(z: int, x: Column, y: Column) -> Column:
    """Does the tile share a part of the box's inside. Written as the range of tiles of a box is, with its rounding."""
    edge = tiles.tile_span(z)
    inside_x = (x >= F.floor((F.col("west") + 180) / edge)) & (x < F.ceil((F.col("east") + 180) / edge))
    return inside_x & (y >= F.floor((F.lit(90) - F.col("north")) / edge)) & (y < F.ceil((F.lit(90) - F.col("south")) / edge))


def in_boxes(boxes: DataFrame, table: DataFrame, finest: int) -> DataFrame:
    """Land tiles that overlap each box (id, west, south, east, north), for all levels up to ``finest``: id, z, x, y, and
    ``pos``, the tile's place in its level row by row."""
    box = ["id", "west", "south", "east", "north"]
    table = cut_lineage(table)
    both = F.array(F.lit(0), F.lit(1))
    start = boxes.select(*box, F.explode(both).alias("x"), F.lit(0).alias("y")).where(_overlaps(0, F.col("x"), F.col("y")))
    out, at = None, start
    for z in range(finest + 1):
        if z:
            at = at.withColumn("_i", F.explode(both)).withColumn("_j", F.explode(both))
            at = at.select(*box, (F.col("x") * 2 + F.col("_i")).alias("x"), (F.col("y") * 2 + F.col("_j")).alias("y")).where(_overlaps(z, F.col("x"), F.col("y")))
        at = cut_lineage(at.join(table.where(F.col("z") == z).select("x", "y", "held"), ["x", "y"]))
        found = at.where("held").select("id", F.lit(z).alias("z"), "x", "y", (F.col("y").cast("long") * tiles.tile_cols(z) + F.col("x")).alias("pos"))
        out = found if out is None else out.unionByName(found)
        at = at.drop("held")
    return out
