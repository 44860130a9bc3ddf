"""Raster operators on a pixel table.

A raster is a table with one row per pixel and whole-number grid coordinates ``gx`` (east) and
``gy`` (south) at some level; no data is NULL. Every reduction is an aggregate on shifted grid
coordinates, so its groups are blocks of a few pixels and no key can become hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenogrid.functions import geo, layers, tiles
from phenogrid.functions.months import month_anchor
from phenogrid.rules import CLEAR_SCENES, CLOUD_LIMIT, KM_PER_DEG, LAND_CLASSES, SUN_ALTITUDE, SUN_AZIMUTH, WATER_CLASS
from phenogrid.session import cut_lineage, split_by

CLASSES = len(LAND_CLASSES)

#: Pixels a task makes out of fewer rows, and the side of the blocks that are dealt out for it.
PIXELS_PER_TASK = 1 << 19
PIECE_BLOCK = 64


def block_keys(factor: int) -> tuple[Column, Column]:
    return F.floor(F.col("gx") / factor).cast("int").alias("gx"), F.floor(F.col("gy") / factor).cast("int").alias("gy")


def mode_from_counts(counts: list[Column]) -> Column:
    """Most common land class from the counts of classes 1..n: ocean only without any land, ties to
    the lower class."""
    best = F.greatest(*counts)
    chain = F.lit(0)
    for i in reversed(range(len(counts))):
        chain = F.when(counts[i] == best, F.lit(i + 1)).otherwise(chain)
    return F.when(best > 0, chain).otherwise(F.lit(0))


def block_mode(pixels: DataFrame, factor: int = 2, column: str = "cls") -> DataFrame:
    """Class of each factor x factor block. The class list is fixed, so counting every class at once
    needs a single shuffle with map-side combining."""
    counted = pixels.groupBy(*block_keys(factor)).agg(*[
        F.count_if(F.col(column) == i).alias(f"_n{i}") for i in range(1, CLASSES)
    ])
    return counted.select("gx", "gy", mode_from_counts([F.col(f"_n{i}") for i in range(1, CLASSES)]).alias(column))


def block_mean(pixels: DataFrame, factor: int, *columns: str) -> DataFrame:
    """Mean of each block over the pixels with data; a block without any stays NULL."""
    return pixels.groupBy(*block_keys(factor)).agg(*[F.avg(c).alias(c) for c in columns])


def halve(pixels: DataFrame, means: tuple[str, ...] = ("tree", "elev")) -> DataFrame:
    """Next coarser level: class by mode and the other layers by mean, in one shuffle."""
    counted = pixels.groupBy(F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).agg(
        *[F.count_if(F.col("cls") == i).alias(f"_n{i}") for i in range(1, CLASSES)], *[F.avg(c).alias(c) for c in means]
    )
    return counted.select("gx", "gy", mode_from_counts([F.col(f"_n{i}") for i in range(1, CLASSES)]).alias("cls"), *means)


def pyramid(pixels: DataFrame, finest: int, coarsest: int, means: tuple[str, ...] = ("tree", "elev")) -> DataFrame:
    """All levels from ``finest`` to ``coarsest`` with a level column ``z``.

    Each level is built once from the one below and checkpointed, so the union neither repeats the
    finer levels nor reaches back to the source when an executor is lost.
    """
    level = pixels.select("gx", "gy", "cls", *means)
    out = level.withColumn("z", F.lit(finest))
    for z in range(finest - 1, coarsest - 1, -1):
        level = cut_lineage(halve(level, means))
        out = out.unionByName(level.withColumn("z", F.lit(z)))
    return out


def land_tiles(pixels: DataFrame, tile_px: int) -> DataFrame:
    """Tiles (x, y) with any land pixel."""
    x, y = F.floor(F.col("gx") / tile_px).cast("int"), F.floor(F.col("gy") / tile_px).cast("int")
    return pixels.where(F.col("cls") > 0).select(x.alias("x"), y.alias("y")).distinct()


def on_land_tiles(pixels: DataFrame, tile_px: int) -> DataFrame:
    """Pixels of the land-bearing tiles only."""
    x, y = F.floor(F.col("gx") / tile_px).cast("int"), F.floor(F.col("gy") / tile_px).cast("int")
    return pixels.withColumns({"x": x, "y": y}).join(land_tiles(pixels, tile_px), ["x", "y"], "left_semi")


def tile_census(pixels: DataFrame, tile_px: int) -> DataFrame:
    """Every tile with what it holds: water, ocean, land."""
    x, y = F.floor(F.col("gx") / tile_px).cast("int").alias("x"), F.floor(F.col("gy") / tile_px).cast("int").alias("y")
    cls = F.col("cls")
    return pixels.groupBy(x, y).agg(
        F.bool_or(cls == WATER_CLASS).alias("has_water"), F.bool_or(cls == 0).alias("has_ocean"),
        F.bool_or(cls > 0).alias("has_land"), F.count("*").alias("pixels"),
    )


def neighbours(rows: DataFrame, radius: int = 1, wrap: int | None = None, height: int | None = None) -> DataFrame:
    """Each (x, y) with the tiles around it as ``nx, ny``; x wraps round the world, y stops at the poles."""
    steps = [F.lit(d) for d in range(-radius, radius + 1)]
    spread = rows.withColumn("_dx", F.explode(F.array(*steps))).withColumn("_dy", F.explode(F.array(*steps)))
    nx, ny = F.col("x") + F.col("_dx"), F.col("y") + F.col("_dy")
    spread = spread.withColumns({"nx": F.pmod(nx, F.lit(wrap)) if wrap else nx, "ny": ny}).drop("_dx", "_dy")
    return spread if height is None else spread.where((F.col("ny") >= 0) & (F.col("ny") < height))


def coastal_tiles(census: DataFrame, z: int) -> DataFrame:
    """Water tiles that see ocean: in themselves or in one of their neighbours, where a tile that is
    not there is open sea."""
    water = census.where("has_water").select("x", "y")
    near = neighbours(water, 1, tiles.tile_cols(z), tiles.tile_rows(z))
    around = census.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("has_ocean").alias("_ocean"))
    seen = near.join(around, ["nx", "ny"], "left").withColumn("_sea", F.coalesce("_ocean", F.lit(True)))
    return seen.groupBy("x", "y").agg(F.bool_or("_sea").alias("_sees")).where("_sees").select("x", "y")


def patch_sea(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Water under a sea mask pixel becomes ocean without trees."""
    marked = pixels.join(mask.select("gx", "gy", "sea"), ["gx", "gy"], "left")
    turned = (F.col("cls") == WATER_CLASS) & layers.is_sea(F.coalesce("sea", F.lit(0)))
    return marked.withColumns({
        "new_cls": F.when(turned, F.lit(0)).otherwise(F.col("cls")),
        "new_tree": F.when(turned, F.lit(0.0)).otherwise(F.col("tree")), "changed": turned,
    })


def patch_coarse(coarse: DataFrame, below: DataFrame, changed: DataFrame) -> DataFrame:
    """Coarse pixels re-derived from the level below, only where they were water and only under
    tiles or pixels that changed (``changed`` holds fine gx, gy)."""
    parents = changed.select(F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).distinct()
    touched = coarse.where(F.col("cls") == WATER_CLASS).join(parents, ["gx", "gy"], "left_semi")
    siblings = below.withColumns({"_px": F.shiftright("gx", 1), "_py": F.shiftright("gy", 1)}).join(
        touched.select(F.col("gx").alias("_px"), F.col("gy").alias("_py")), ["_px", "_py"], "left_semi"
    )
    derived = block_mode(siblings.select("gx", "gy", "cls"), 2).withColumnRenamed("cls", "_derived")
    joined = coarse.join(derived, ["gx", "gy"], "left")
    cls = F.when(F.col("cls") == WATER_CLASS, F.coalesce("_derived", "cls")).otherwise(F.col("cls"))
    return joined.withColumn("new_cls", cls).withColumns({
        "new_tree": F.when(F.col("new_cls") == 0, F.lit(0.0)).otherwise(F.col("tree")),
        "changed": F.col("new_cls") != F.col("cls"),
    }).drop("_derived")


def patch_pyramid(pyramid_rows: DataFrame, mask: DataFrame, finest: int, coarsest: int) -> DataFrame:
    """Sea patch of the finest level, then of each coarser level above changed pixels only."""
    columns = ["z", "gx", "gy", "old_cls", "cls", "tree", "changed"]

    def shaped(rows: DataFrame, z: int) -> DataFrame:
        renamed = rows.withColumnRenamed("cls", "old_cls").drop("tree").withColumnsRenamed({"new_cls": "cls", "new_tree": "tree"})
        return renamed.withColumn("z", F.lit(z)).select(*columns)

    base = pyramid_rows.where(F.col("z") == finest)
    level = cut_lineage(shaped(patch_sea(base, mask), finest))
    out = level
    for z in range(finest - 1, coarsest - 1, -1):
        coarse = pyramid_rows.where(F.col("z") == z)
        level = cut_lineage(shaped(patch_coarse(coarse, level, level.where("changed")), z))
        out = out.unionByName(level)
    return out


def change_report(patched: DataFrame, tile_px: int) -> DataFrame:
    """Pixels and tiles changed per level."""
    tile = F.struct(F.floor(F.col("gx") / tile_px), F.floor(F.col("gy") / tile_px))
    return patched.groupBy("z").agg(
        F.count_if("changed").alias("pixels"), F.count_distinct(F.when(F.col("changed"), tile)).alias("tiles")
    )


def parents_from_children(detail: DataFrame, old: DataFrame, tile_px: int) -> DataFrame:
    """Coarse pixels from the level below where that exists, else the old coarse pixel, else nothing.

    Works a quarter tile at a time: a child tile replaces its whole quarter. Only parents with at
    least one child are produced. ``detail`` and ``old`` hold gx, gy, cls, tree.
    """
    child_x, child_y = F.floor(F.col("gx") / tile_px), F.floor(F.col("gy") / tile_px)
    children = detail.select(child_x.cast("int").alias("cx"), child_y.cast("int").alias("cy")).distinct()
    parents = children.select(F.shiftright("cx", 1).alias("px"), F.shiftright("cy", 1).alias("py")).distinct()
    fine = halve(detail, ("tree",)).withColumn("tree", F.when(F.col("cls") == 0, F.lit(0.0)).otherwise(layers.whole(F.col("tree"))))
    quarter = tile_px // 2
    kept = (
        old.withColumns({"cx": F.floor(F.col("gx") / quarter).cast("int"), "cy": F.floor(F.col("gy") / quarter).cast("int")})
        .withColumns({"px": F.shiftright("cx", 1), "py": F.shiftright("cy", 1)})
        .join(parents, ["px", "py"], "left_semi").join(children, ["cx", "cy"], "left_anti")
    )
    return fine.select("gx", "gy", "cls", "tree", F.lit("detail").alias("origin")).unionByName(
        kept.select("gx", "gy", "cls", "tree", F.lit("old").alias("origin"))
    )


# ---- composites over time ----------------------------------------------------------------------

def climatology(values: DataFrame, *keys: str) -> DataFrame:
    """Mean per pixel and calendar month over all years (columns ts, value)."""
    return values.groupBy(*keys, F.month("ts").alias("month")).agg(F.avg("value").alias("value"), F.count("value").alias("scenes"))


def mean_of_years(values: DataFrame, *keys: str) -> DataFrame:
    """Mean of the yearly means per pixel and month: years weigh the same, missing years are skipped.

    Both steps share the partitioning of the outer keys, so the second one does not shuffle again.
    """
    spread = values.withColumns({"month": F.month("ts"), "year": F.year("ts")}).groupBy(*keys, "month", "year")
    return spread.agg(F.avg("value").alias("value")).groupBy(*keys, "month").agg(
        F.avg("value").alias("value"), F.count("value").alias("years")
    )


def clear_scenes(scenes: DataFrame, first_day: str, end_day: str) -> DataFrame:
    """Scenes in the date window with few clouds, and of those the clear pixels."""
    return scenes.where(
        (F.col("ts") >= F.lit(first_day).cast("timestamp")) & (F.col("ts") < F.lit(end_day).cast("timestamp"))
        & (F.col("cloud") < CLOUD_LIMIT) & F.col("scl").isin(*CLEAR_SCENES)
    )


def median_composite(scenes: DataFrame, *keys: str) -> DataFrame:
    """Median of the scenes of each pixel.

    Equal values of a pixel are counted first, so a pixel with very many scenes is spread over its
    values. What meets in one group are distinct values: sensor values are 16-bit numbers.
    """
    counted = scenes.groupBy(*keys, "value").agg(F.count("value").alias("_n")).where(F.col("_n") > 0)
    return counted.groupBy(*keys).agg(F.percentile("value", F.lit(0.5), F.col("_n")).alias("value"), F.sum("_n").alias("scenes"))


def every_nth_day(values: DataFrame, first_day: str, days: int, step: int, *keys: str) -> DataFrame:
    """Mean of the scenes taken every ``step`` days from ``first_day`` on."""
    day = F.datediff(F.col("ts"), F.lit(first_day).cast("date"))
    return values.where((day >= 0) & (day < days) & (day % step == 0)).groupBy(*keys).agg(
        F.avg("value").alias("value"), F.count("value").alias("scenes")
    )


def covered_share(pixels: DataFrame, factor: int, flag: Column) -> DataFrame:
    """Share of each block for which the flag holds."""
    return pixels.groupBy(*block_keys(factor)).agg(F.avg(F.when(flag, 1.0).otherwise(0.0)).alias("share"))


# ---- resampling --------------------------------------------------------------------------------

def nearest_targets(index: str, size: int, out: int) -> tuple[Column, Column]:
    """First and last target index that read source ``index`` when ``size`` pixels become ``out``.

    Target i reads the source under its centre, so source s is read from ceil((2 s out - size) /
    (2 size)) on; whole numbers throughout.
    """
    first = f"({2 * out}L * ({{s}}) + {size - 1}) div {2 * size}"
    return F.expr(f"cast({first.format(s=index)} AS int)"), F.expr(f"cast({first.format(s=index + ' + 1')} - 1 AS int)")


def resample_nearest(pixels: DataFrame, height: int, width: int, out_h: int, out_w: int, *columns: str) -> DataFrame:
    """Nearest-neighbour resize: every source pixel emits the target pixels that read it, no join."""
    y0, y1 = nearest_targets("gy", height, out_h)
    x0, x1 = nearest_targets("gx", width, out_w)
    span = pixels.withColumns({"_y0": y0, "_y1": y1, "_x0": x0, "_x1": x1}).where("_y0 <= _y1 and _x0 <= _x1")
    return span.withColumn("_ty", F.explode(F.sequence("_y0", "_y1"))).withColumn("_tx", F.explode(F.sequence("_x0", "_x1"))).select(
        F.col("_tx").alias("gx"), F.col("_ty").alias("gy"), *columns
    )


def _axis_weights(rows: DataFrame, axis: str, size: int, out: int) -> DataFrame:
    """Target indexes along one axis that blend a source pixel, with its weight (centres aligned,
    edges clamp)."""
    scale = out / size
    low = F.when(F.col(axis) == 0, F.lit(0)).otherwise(F.ceil((F.col(axis) - 0.5) * scale - 0.5))
    high = F.when(F.col(axis) == size - 1, F.lit(out - 1)).otherwise(F.floor((F.col(axis) + 1.5) * scale - 0.5))
    spread = rows.withColumn("_t", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(out - 1)).cast("int"))))
    place = F.least(F.greatest((F.col("_t") + 0.5) * size / out - 0.5, F.lit(0.0)), F.lit(float(size - 1)))
    weight = F.lit(1.0) - F.abs(place - F.col(axis))
    return spread.withColumn(f"_w_{axis}", weight).where(F.col(f"_w_{axis}") > 0).withColumn(axis, F.col("_t")).drop("_t")


def resample_bilinear(pixels: DataFrame, height: int, width: int, out_h: int, out_w: int, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bilinear resize: source pixels emit their weighted share to the targets they touch, then one
    aggregate per target. A target that touches missing data is missing. ``keys`` tell several
    images apart."""
    spread = _axis_weights(_axis_weights(pixels.select(*keys, "gx", "gy", column), "gy", height, out_h), "gx", width, out_w)
    weight = F.col("_w_gx") * F.col("_w_gy")
    blended = spread.groupBy(*keys, "gx", "gy").agg(F.sum(F.col(column) * weight).alias("_v"), F.sum(F.when(F.col(column).isNotNull(), weight)).alias("_w"))
    return blended.select(*keys, "gx", "gy", F.when(F.col("_w") > 1 - 1e-9, F.col("_v")).alias(column))


def quarter_upsample(pixels: DataFrame, tile_px: int, column: str) -> DataFrame:
    """Child tiles from the quarters of their parents at twice the size, for every tile at once.

    A child (x, y) reads its own quarter only, so the edges of a quarter clamp. All its pixels come out, NULL where a
    pixel they read is missing. Quarters are dealt out whole, to as many tasks as the pixels that come out ask for.
    """
    half = tile_px // 2
    x, y = F.floor(F.col("gx") / half).cast("int"), F.floor(F.col("gy") / half).cast("int")
    cut = pixels.select(x.alias("x"), y.alias("y"), (F.col("gx") % half).alias("gx"), (F.col("gy") % half).alias("gy"), column)
    cut = split_by(cut, 4, PIXELS_PER_TASK, "x", "y")
    cells = F.sequence(F.lit(0), F.lit(tile_px - 1))
    targets = cut.select("x", "y").distinct().withColumn("gx", F.explode(cells)).withColumn("gy", F.explode(cells))
    return targets.join(resample_bilinear(cut, half, half, tile_px, tile_px, column, ("x", "y")), ["x", "y", "gx", "gy"], "left")


def cut_level(base: DataFrame, height: int, width: int, out_h: int, out_w: int) -> DataFrame:
    """A level cut from a base layer (cls, tree): coarser by mode and rounded mean, finer by nearest
    and rounded bilinear, the same size as it is."""
    if (out_h, out_w) == (height, width):
        return base.select("gx", "gy", "cls", "tree")
    if out_h < height:
        reduced = block_mode(base, height // out_h).join(block_mean(base, height // out_h, "tree"), ["gx", "gy"])
        return reduced.withColumn("tree", layers.whole(F.col("tree")))
    classes = resample_nearest(base, height, width, out_h, out_w, "cls")
    tree = resample_bilinear(base, height, width, out_h, out_w, "tree")
    return classes.join(tree, ["gx", "gy"], "left").withColumn("tree", layers.whole(F.col("tree")))


def sample_layer(points: DataFrame, raster: DataFrame, width: int, height: int, t: float, value: str = "value") -> DataFrame:
    """Monthly raster at points: four neighbours (longitude wraps, latitude clamps) of the two months
    around ``t``, blended.

    ``points`` has id, lng, lat; ``raster`` has gx, gy, month (0-based) and the value. Points read
    the raster by an equi join on the pixel. Every point comes out; one that reads a missing pixel is NULL.
    """
    first, second, part = month_anchor(t)
    blend = part * part * (3 - 2 * part)
    fx = (F.col("lng") + 180) / 360 * width - 0.5
    fy = F.least(F.greatest((F.lit(90) - F.col("lat")) / 180 * height - 0.5, F.lit(0.0)), F.lit(float(height - 1)))
    placed = points.select("id", "lng", "lat", fx.alias("_fx"), fy.alias("_fy"))
    x0, y0 = F.floor("_fx"), F.floor("_fy")
    tx, ty = F.col("_fx") - x0, F.col("_fy") - y0
    corners = [
        (x0, y0, (1 - tx) * (1 - ty)), (x0 + 1, y0, tx * (1 - ty)), (x0, y0 + 1, (1 - tx) * ty), (x0 + 1, y0 + 1, tx * ty),
    ]
    entries = [
        F.struct(
            F.pmod(x, F.lit(width)).cast("int").alias("gx"), F.least(y, F.lit(height - 1)).cast("int").alias("gy"),
            F.lit(m).alias("month"), (w * share).alias("w"),
        )
        for m, share in ((first, 1 - blend), (second, blend)) for x, y, w in corners
    ]
    spread = placed.select("id", F.inline(F.array(*entries))).where(F.col("w") > 0)
    read = spread.join(raster.select("gx", "gy", "month", F.col(value).alias("_v")), ["gx", "gy", "month"], "left").groupBy("id").agg(
        F.sum(F.col("_v") * F.col("w")).alias("_sum"), F.sum(F.when(F.col("_v").isNotNull(), F.col("w"))).alias("_w")
    )
    return read.select("id", F.when(F.col("_w") > 1 - 1e-9, F.col("_sum")).alias(value))


def pixel_of(lng: Column, lat: Column, width: int, height: int) -> tuple[Column, Column]:
    """Pixel of a global width x height grid that holds a point, clamped at the edges."""
    x = F.least(F.greatest(F.floor((lng + 180) / 360 * width), F.lit(0)), F.lit(width - 1)).cast("int")
    y = F.least(F.greatest(F.floor((F.lit(90) - lat) / 180 * height), F.lit(0)), F.lit(height - 1)).cast("int")
    return x, y


def nearest_pixel(points: DataFrame, layer: DataFrame, width: int, height: int) -> DataFrame:
    """Layer values of the pixel under each point (left join: NULL where the layer has none)."""
    x, y = pixel_of(F.col("lng"), F.col("lat"), width, height)
    return points.withColumns({"gx": x, "gy": y}).join(layer, ["gx", "gy"], "left")


def environment_lines(
    places: DataFrame, on_land: Column, ground: Column, tree: Column, elevation: Column, wind: tuple[Column, Column], air: Column, ndvi: Column,
    water: Column, snow: Column, lights: Column, current: tuple[Column, Column], plankton: Column,
) -> DataFrame:
    """What the layers under a place say, one column a line.

    On land: ground with tree cover, height, greenness, water, snow, and night light where there is any. At sea: depth,
    current and plankton. Everywhere: wind and air. Lights and plankton are stored as logarithms. A value that a layer
    lacks leaves its line NULL.
    """
    speed, flow = F.hypot(*wind), F.hypot(*current)
    words = lambda value: layers.whole(value).cast("int").cast("string")
    cover = F.when(tree >= 5, F.concat(ground, F.lit(" · "), words(tree), F.lit(" % tree cover"))).otherwise(ground)
    share = lambda value, rest: F.when(value < 0.5, F.lit("none")).otherwise(F.concat(words(value), F.lit(rest)))
    return places.withColumns({
        "ground": F.when(on_land, cover), "height_m": F.when(on_land, layers.whole(elevation).cast("long")),
        "depth": F.when(~on_land, F.when(elevation < 0, F.concat(words(-elevation), F.lit(" m"))).otherwise(F.lit("coast"))),
        "wind": F.when(speed < 0.5, F.lit("calm")).otherwise(F.concat(F.format_string("%.1f", speed), F.lit(" m/s from the "), geo.blows_from(*wind))),
        "air": F.concat(words(air), F.lit(" °C")),
        "greenness": F.when(on_land, layers.greenness(ndvi)),
        "water": F.when(on_land, share(water, " % of the area")), "snow": F.when(on_land, share(snow, " % cover")),
        "lights": F.when(on_land & (lights > 0.15), F.concat(F.format_string("%.1f", F.pow(F.lit(10.0), lights) - 1), F.lit(" nW/cm²/sr"))),
        "current": F.when(~on_land, F.when(flow < 0.03, F.lit("slack")).otherwise(F.concat(F.format_string("%.2f", flow), F.lit(" m/s towards the "), geo.flows_towards(*current)))),
        "plankton": F.when(~on_land, F.concat(F.format_string("%.2f", F.pow(F.lit(10.0), plankton)), F.lit(" mg/m³ chlorophyll"))),
    })


# ---- neighbourhood operators -------------------------------------------------------------------

def halo_blocks(pixels: DataFrame, block: int, radius: int = 1) -> DataFrame:
    """Each pixel in its own block and, near an edge, in the neighbouring blocks too.

    Adds ``bx, by`` and ``inside``. Blocks of fixed size hold everything a neighbourhood operator
    needs, so it runs per block after one shuffle that carries only the halo twice.
    """
    def memberships(axis: str) -> Column:
        own = F.floor(F.col(axis) / block)
        before = F.floor((F.col(axis) - radius) / block)
        after = F.floor((F.col(axis) + radius) / block)
        return F.array_distinct(F.array(own, before, after))

    spread = pixels.withColumn("bx", F.explode(memberships("gx"))).withColumn("by", F.explode(memberships("gy")))
    inside = (F.floor(F.col("gx") / block) == F.col("bx")) & (F.floor(F.col("gy") / block) == F.col("by"))
    return spread.withColumn("inside", inside)


def hillshade(pixels: DataFrame, z: int, tile_px: int, block: int = 256, exaggeration: float | None = None) -> DataFrame:
    """Shaded relief byte per pixel (sun from the north-west, flat = 181) from ``elev``.

    Slopes come from the neighbours east-west and north-south, one-sided at an edge. Both windows
    run inside blocks on one shared partitioning.
    """
    pixel_deg = tiles.tile_span(z) / tile_px
    exag = tiles.exaggeration(z, tile_px) if exaggeration is None else exaggeration
    blocks = halo_blocks(pixels.select("gx", "gy", (F.coalesce("elev", F.lit(0.0)) * exag).alias("h")), block)
    shared = blocks.repartition("bx", "by")

    def slope(along: str, across: str) -> Column:
        w = Window.partitionBy("bx", "by", across).orderBy(along)
        before, after = F.lag("h").over(w), F.lead("h").over(w)
        has_before = F.lag(along).over(w) == F.col(along) - 1
        has_after = F.lead(along).over(w) == F.col(along) + 1
        return (
            F.when(has_before & has_after, (after - before) / 2).when(has_after, after - F.col("h"))
            .when(has_before, F.col("h") - before).otherwise(0.0)
        )

    sloped = shared.withColumn("_gx", slope("gx", "gy")).withColumn("_gy", slope("gy", "gx")).where("inside")
    dy = pixel_deg * KM_PER_DEG * 1000.0
    lat = F.lit(90.0) - (F.col("gy") + 0.5) * pixel_deg
    dx = F.greatest(F.lit(dy) * F.cos(F.radians(lat)), F.lit(1.0))
    east, north = F.col("_gx") / dx, -F.col("_gy") / F.lit(dy)
    steep = F.atan(F.hypot(east, north))
    aspect = F.atan2(-east, -north)
    zenith, azimuth = math.radians(90.0 - SUN_ALTITUDE), math.radians(SUN_AZIMUTH)
    shade = F.lit(math.cos(zenith)) * F.cos(steep) + F.lit(math.sin(zenith)) * F.sin(steep) * F.cos(F.lit(azimuth) - aspect)
    byte = layers.whole(F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return sloped.select("gx", "gy", byte.alias("shade"))


def gaussian_kernel(sigma: float) -> list[float]:
    radius = math.ceil(sigma * 2.5)
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [k / sum(raw) for k in raw]


def cell_kernel(scale: int, sigma: float) -> list[tuple[int, float]]:
    """(texel offset from the cell's first texel, weight) that a cell of ``scale`` equal texels adds
    to its surroundings in a one-dimensional blur."""
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    out = []
    for target in range(-radius, scale + radius):
        weight = sum(kernel[source - target + radius] for source in range(scale) if abs(source - target) <= radius)
        out.append((target, weight))
    return out


def smooth_cells(values: DataFrame, keys: tuple[str, ...], scale: int = 4, sigma_cells: float = 0.45, cell_size: float = 1.0) -> DataFrame:
    """Cell values (lat0, lng0, value) spread by a separable Gaussian at ``scale`` texels per cell.

    Each cell adds its weighted value to the texel columns around it, then to the rows; columns
    wrap round the world and rows repeat at the poles. Result per texel: ``tx, ty, value``.
    """
    cols, rows = round(360 / cell_size) * scale, round(180 / cell_size) * scale
    sigma = sigma_cells * scale
    kernel = cell_kernel(scale, sigma)
    col0 = F.floor((F.col("lng0") + 180) / cell_size) * scale
    row = F.floor((F.lit(90) - (F.col("lat0") + cell_size)) / cell_size)
    across = F.array(*[
        F.struct(F.pmod(col0 + step, F.lit(cols)).cast("int").alias("tx"), (F.least(F.col("value"), F.lit(1.0)) * w).alias("v"))
        for step, w in kernel
    ])
    first = values.select(*keys, row.cast("int").alias("_row"), F.inline(across)).groupBy(*keys, "tx", "_row").agg(F.sum("v").alias("v"))

    # A texel row beyond a pole reads the edge row, so an edge cell weighs more there.
    plain = gaussian_kernel(sigma)
    radius = len(plain) // 2

    def edge_weight(target: int, edge_first: bool) -> float:
        beyond = range(-radius, 0) if edge_first else range(scale, scale + radius)
        return sum(plain[source - target + radius] for source in beyond if abs(source - target) <= radius)

    top = {t: edge_weight(t, True) for t, _ in kernel}
    bottom = {t: edge_weight(t, False) for t, _ in kernel}
    last_row = rows // scale - 1
    down = F.array(*[
        F.struct(
            (F.col("_row") * scale + step).cast("int").alias("ty"),
            (F.col("v") * (
                F.lit(w) + F.when(F.col("_row") == 0, F.lit(top[step])).otherwise(0.0)
                + F.when(F.col("_row") == last_row, F.lit(bottom[step])).otherwise(0.0)
            )).alias("v"),
        )
        for step, w in kernel
    ])
    return (
        first.select(*keys, "tx", F.inline(down)).where((F.col("ty") >= 0) & (F.col("ty") < rows))
        .groupBy(*keys, "tx", "ty").agg(F.sum("v").alias("value"))
    )


def smooth_surface(values: DataFrame, keys: tuple[str, ...], px_per_cell: int = 8, pad: int = 1, cell_size: float = 1.0) -> DataFrame:
    """Soft image of cell values: smoothstep blend of the four nearest cell centres, rows spaced in
    Web Mercator. Result per pixel with a visible value: ``px, py, alpha`` (0..255).

    Every cell emits its weighted share to the pixel rows around it, and what a row has of a cell column to the pixels
    around that; an aggregate after each axis keeps the fan-out to one axis. A pixel row belongs to the cell
    rows around its latitude; the inverse (cell row to pixel rows) has a closed form because
    Mercator is monotone.
    """
    # Every aggregate below is cheap and its groups are (key) extents: one row per species.
    extent = values.groupBy(*keys).agg(
        F.greatest(F.lit(-85.0), F.min("lat0") - pad * cell_size).alias("lat_min"),
        F.least(F.lit(85.0), F.max("lat0") + (1 + pad) * cell_size).alias("lat_top"),
        (F.min("lng0") - pad * cell_size).alias("lng_min"), (F.max("lng0") + (1 + pad) * cell_size).alias("lng_max"),
    ).withColumns({
        "rows": F.round((F.col("lat_top") - F.col("lat_min")) / cell_size).cast("int"),
        "cols": F.round((F.col("lng_max") - F.col("lng_min")) / cell_size).cast("int"),
    }).withColumn("lat_top", F.col("lat_min") + F.col("rows") * cell_size)
    placed = values.join(extent, list(keys))

    def mercator(lat: Column) -> Column:
        return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))

    row = F.round((F.col("lat0") - F.col("lat_min")) / cell_size).cast("int")
    col = F.round((F.col("lng0") - F.col("lng_min")) / cell_size).cast("int")
    y_top, y_bottom = mercator(F.col("lat_top")), mercator(F.col("lat_min"))
    height = F.col("rows") * px_per_cell

    def pixel_row(lat: Column) -> Column:
        inside = F.least(F.greatest(lat, F.col("lat_min")), F.col("lat_top"))
        return (mercator(inside) - y_top) / (y_bottom - y_top) * height - 0.5

    centre = (F.col("_row") + 0.5) * cell_size + F.col("lat_min")
    high = F.least(F.ceil(pixel_row(centre - cell_size)), height - 1)
    low = F.greatest(F.floor(pixel_row(centre + cell_size)), F.lit(0))
    spread = (
        placed.withColumns({"_row": row, "_col": col, "_y_top": y_top, "_y_bottom": y_bottom})
        .where((F.col("_row") >= 0) & (F.col("_row") < F.col("rows")))
        .withColumn("py", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    )
    y = F.col("_y_top") + (F.col("py") + 0.5) / height * (F.col("_y_bottom") - F.col("_y_top"))
    lat = F.degrees(F.atan(F.exp(y))) * 2 - 90
    v = (lat - F.col("lat_min")) / cell_size - 0.5
    spread = spread.withColumn("_wy", _smooth_weight(v, F.col("_row"), F.col("rows"))).where("_wy > 0")
    value = F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0))
    spread = spread.groupBy(*keys, "py", "_col", "cols").agg(F.sum(value * F.col("_wy")).alias("_v"))  # one axis is done
    x_low = F.greatest((F.col("_col") - 1) * px_per_cell, F.lit(0))
    x_high = F.least((F.col("_col") + 2) * px_per_cell, F.col("cols") * px_per_cell) - 1
    spread = spread.withColumn("px", F.explode(F.sequence(x_low.cast("int"), x_high.cast("int"))))
    u = (F.col("px") + 0.5) / px_per_cell - 0.5
    spread = spread.withColumn("_wx", _smooth_weight(u, F.col("_col"), F.col("cols"))).where("_wx > 0")
    return spread.groupBy(*keys, "px", "py").agg(F.sum(F.col("_v") * F.col("_wx")).alias("_a")).select(
        *keys, "px", "py", F.floor(F.col("_a") * 255 + 0.5).cast("int").alias("alpha")
    ).where(F.col("alpha") > 0)


def _smooth_weight(place: Column, index: Column, count: Column) -> Column:
    """Weight of the centre ``index`` at ``place`` between centres, eased; edge centres repeat outwards."""
    inside = F.least(F.greatest(place, F.lit(0.0)), (count - 1).cast("double"))
    near = F.lit(1.0) - F.abs(inside - index)
    return F.when(near > 0, near * near * (3 - 2 * near)).otherwise(0.0)


def piece_cover(pieces: DataFrame) -> DataFrame:
    """How often each pixel is covered by rectangular pieces (x, y, w, h).

    Pieces are cut at the edges of blocks and dealt out by block, so a task counts whole blocks by itself: pieces move, not
    their pixels, and there are as many tasks as the pixels ask for.
    """
    ends = {"_x": (F.col("x"), F.col("x") + F.col("w") - 1), "_y": (F.col("y"), F.col("y") + F.col("h") - 1)}
    spans = pieces.dropna(subset=["x", "y", "w", "h"]).select(*[end(a, z).alias(f"{axis}{i}") for axis, (a, z) in ends.items() for i, end in enumerate((F.least, F.greatest))])
    block = lambda c: F.floor(F.col(c) / PIECE_BLOCK).cast("int")
    cut = spans
    for axis in ends:
        cut = cut.withColumn(f"{axis}b", F.explode(F.sequence(block(f"{axis}0"), block(f"{axis}1"))))
        edge = F.col(f"{axis}b") * PIECE_BLOCK
        cut = cut.withColumn(f"{axis}0", F.greatest(f"{axis}0", edge)).withColumn(f"{axis}1", F.least(f"{axis}1", edge + (PIECE_BLOCK - 1)))
    pixels = ((F.col("_x1") - F.col("_x0") + 1) * (F.col("_y1") - F.col("_y0") + 1)).cast("double")
    return (
        split_by(cut, pixels, PIXELS_PER_TASK, "_xb", "_yb").withColumn("gx", F.explode(F.sequence("_x0", "_x1")))
        .withColumn("gy", F.explode(F.sequence("_y0", "_y1")))
        .groupBy("_xb", "_yb", "gx", "gy").agg(F.count("*").alias("hits")).drop("_xb", "_yb")
    )
