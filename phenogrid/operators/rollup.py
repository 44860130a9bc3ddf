"""Roll-up of what changed: ancestors of changed tiles rebuilt level by level, everything else left alone.

Tiles are known by their pixels ``(z, gx, gy, ...)``; a tile is there if it has a pixel. A change set is a table of tiles at
the finest level. Its ancestors follow from shifts, before any pixel is read, and each level reads only the pixels under
them: the rebuilt ones of the level below, and those of unchanged siblings, which the level column and the tile select.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.operators import raster
from phenogrid.session import cut_lineage


def tile_of(tile_px: int) -> dict[str, Column]:
    return {"x": F.floor(F.col("gx") / tile_px).cast("int"), "y": F.floor(F.col("gy") / tile_px).cast("int")}


def tiles_in(pixels: DataFrame, tile_px: int) -> DataFrame:
    return pixels.select(*[c.alias(n) for n, c in tile_of(tile_px).items()]).distinct()


def parents_of(tiles: DataFrame, levels: int = 1) -> DataFrame:
    return tiles.select(F.shiftright("x", levels).alias("x"), F.shiftright("y", levels).alias("y")).distinct()


def under(pixels: DataFrame, parents: DataFrame, tile_px: int, levels: int = 1) -> DataFrame:
    """Pixels whose tile lies under one of the tiles ``levels`` above."""
    placed = pixels.withColumns({n: F.shiftright(c, levels) for n, c in tile_of(tile_px).items()})
    return placed.join(parents, ["x", "y"], "left_semi").drop("x", "y")


def missing_quarters(children: DataFrame, parents: DataFrame, tile_px: int) -> DataFrame:
    """Every coarse pixel (gx, gy) of the quarters whose child tile isn't there."""
    both, half = F.array(F.lit(0), F.lit(1)), tile_px // 2
    four = parents.withColumn("_i", F.explode(both)).withColumn("_j", F.explode(both))
    four = four.select((F.col("x") * 2 + F.col("_i")).alias("x"), (F.col("y") * 2 + F.col("_j")).alias("y"))
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    gone = four.join(children, ["x", "y"], "left_anti").withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps))
    return gone.select((F.col("x") * half + F.col("_a")).cast("int").alias("gx"), (F.col("y") * half + F.col("_b")).cast("int").alias("gy"))


def reduced(children: DataFrame, tile_px: int, channels: Sequence[str]) -> DataFrame:
    """Tiles from their children: each channel's mean over 2 x 2 pixels, halves to even; a missing child is black.

    Tiles without any child don't come out.
    """
    held = tiles_in(children, tile_px)
    means = children.groupBy(F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).agg(*[F.bround(F.avg(c)).cast("int").alias(c) for c in channels])
    black = missing_quarters(held, parents_of(held), tile_px).select("gx", "gy", *[F.lit(0).alias(c) for c in channels])
    return means.unionByName(black)


def changed_levels(levels: DataFrame, changed: DataFrame, top: int, bottom: int, tile_px: int, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Pixels (z, gx, gy, channels) of all ancestors of the changed tiles, from level ``top`` - 1 down to ``bottom``.

    ``levels`` holds the new pixels of the top level and the old ones of the others; ``changed`` are tiles (x, y) of the
    top level that were added, altered or removed. Every level is checkpointed, because the next reads it.
    """
    columns = ["gx", "gy", *channels]
    out, fresh, below = None, None, cut_lineage(changed.select("x", "y").distinct())
    for z in range(top - 1, bottom - 1, -1):
        parents = parents_of(below)
        children = under(levels.where(F.col("z") == z + 1).select(*columns), parents, tile_px)
        if fresh is not None:  # tiles that were rebuilt one level below, or lost their last child there
            children = children.withColumns(tile_of(tile_px)).join(below, ["x", "y"], "left_anti").select(*columns).unionByName(fresh.select(*columns))
        fresh = cut_lineage(reduced(children, tile_px, channels).withColumn("z", F.lit(z)))
        out = fresh if out is None else out.unionByName(fresh)
        below = parents
    return out.select("z", *columns)


def replaced(levels: DataFrame, changed: DataFrame, rebuilt: DataFrame, top: int, bottom: int, tile_px: int) -> DataFrame:
    """All levels with the ancestors of the changed tiles exchanged for the rebuilt ones."""
    up = F.explode(F.sequence(F.lit(bottom), F.lit(top - 1))).alias("z")
    by = F.lit(top) - F.col("z")
    stale = changed.select("x", "y", up).select("z", F.call_function("shiftright", F.col("x"), by).alias("x"), F.call_function("shiftright", F.col("y"), by).alias("y")).distinct()
    kept = levels.withColumns(tile_of(tile_px)).join(stale, ["z", "x", "y"], "left_anti").drop("x", "y")
    return kept.unionByName(rebuilt.select(*levels.columns))


def world_levels(detail: DataFrame, world: DataFrame, top: int, bottom: int, tile_px: int) -> DataFrame:
    """World levels ``top`` to ``bottom`` with every tile above detail rebuilt: z, gx, gy, cls, tree, rewritten.

    ``detail`` are the pixels of level ``top`` + 1, ``world`` those of the world levels so far. A tile is reduced from its
    children; where a child is missing, the tile's own quarter stays. A tile that would hold no land stays as it was.
    ``rewritten`` marks the pixels of tiles that differ from before.
    """
    todo = cut_lineage(parents_of(tiles_in(detail, tile_px)))
    children, out = detail.select("gx", "gy", "cls", "tree"), None
    for z in range(top, bottom - 1, -1):
        old = world.where(F.col("z") == z).select("gx", "gy", "cls", "tree")
        made = raster.parents_from_children(under(children, todo, tile_px), old, tile_px).select("gx", "gy", "cls", "tree")
        land = raster.land_tiles(made, tile_px)
        made = made.withColumns(tile_of(tile_px)).join(land, ["x", "y"], "left_semi")
        was = old.select("gx", "gy", F.struct("cls", "tree").alias("_was"))
        compared = made.join(was, ["gx", "gy"], "left").withColumn("_new", ~F.struct("cls", "tree").eqNullSafe(F.col("_was")))
        differ = compared.groupBy("x", "y").agg(F.bool_or("_new").alias("rewritten"))
        rest = old.withColumns(tile_of(tile_px)).join(land, ["x", "y"], "left_anti").withColumn("rewritten", F.lit(False))
        level = made.join(differ, ["x", "y"]).unionByName(rest).drop("x", "y").withColumn("z", F.lit(z))
        children = cut_lineage(level)
        out = children if out is None else out.unionByName(children)
        children, todo = children.select("gx", "gy", "cls", "tree"), parents_of(todo)
    return out.select("z", "gx", "gy", "cls", "tree", "rewritten")
