"""Pixel reductions, composites, resampling, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.functions import layers, tiles
from phenogrid.operators import quality, raster
from phenogrid.rules import CLIMATE, LAND, OCEAN, RELIEF, SURFACE
from phenogrid.sources import bindings as b

P1 = ref.halved("p1", "px")


@query("a20_block_mode", ref.pixels("SELECT CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, cls FROM p1", P1))
def a20(spark, sf):
    return raster.block_mode(b.pixels(spark, sf), 2)


@query("a21_block_mean", ref.pixels("SELECT CAST(gx // 4 AS INTEGER) AS gx, CAST(gy // 4 AS INTEGER) AS gy, round(avg(tree), 8) AS tree, round(avg(elev), 8) AS elev FROM px GROUP BY ALL"))
def a21(spark, sf):
    return raster.block_mean(b.pixels(spark, sf), 4, "tree", "elev").select("gx", "gy", F.round("tree", 8).alias("tree"), F.round("elev", 8).alias("elev"))


LEVELS = [ref.halved(f"p{i}", "px" if i == 1 else f"p{i - 1}") for i in range(1, 5)]


@query("a30_pyramid", ref.pixels("""
SELECT 15 AS z, gx, gy, cls, round(tree, 7) AS tree, round(elev, 7) AS elev FROM px UNION ALL SELECT 14, CAST(gx AS INTEGER), CAST(gy AS INTEGER), cls, round(tree, 7), round(elev, 7) FROM p1
UNION ALL SELECT 13, CAST(gx AS INTEGER), CAST(gy AS INTEGER), cls, round(tree, 7), round(elev, 7) FROM p2 UNION ALL SELECT 12, CAST(gx AS INTEGER), CAST(gy AS INTEGER), cls, round(tree, 7), round(elev, 7) FROM p3""", *LEVELS[:3]))
def a30(spark, sf):
    rows = raster.pyramid(b.pixels(spark, sf), b.LEVEL, b.LEVEL - 3)
    return rows.select("z", "gx", "gy", "cls", F.round("tree", 7).alias("tree"), F.round("elev", 7).alias("elev"))


@query("a22_climatology", "SELECT l_partkey AS pixel, CAST(month(l_shipdate) AS INTEGER) AS month, round(avg(l_quantity), 8) AS value, count(*) AS scenes FROM lineitem GROUP BY ALL")
def a22(spark, sf):
    return raster.climatology(b.scenes(spark, sf), "pixel").select("pixel", "month", F.round("value", 8).alias("value"), "scenes")


@query("a23_mean_of_years", """
SELECT pixel, CAST(month AS INTEGER) AS month, round(avg(v), 8) AS value, count(*) AS years FROM (
  SELECT l_partkey AS pixel, month(l_shipdate) AS month, year(l_shipdate) AS year, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) GROUP BY pixel, month""")
def a23(spark, sf):
    return raster.mean_of_years(b.scenes(spark, sf), "pixel").select("pixel", "month", F.round("value", 8).alias("value"), "years")


@query("a24_median_composite", """
SELECT l_partkey AS pixel, median(l_quantity) AS value, count(*) AS scenes FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2001-01-01' AND l_linenumber * 8 < 40 AND l_returnflag IN ('A', 'R') GROUP BY l_partkey""")
def a24(spark, sf):
    return raster.median_composite(raster.clear_scenes(b.scenes(spark, sf), "1995-01-01", "2001-01-01"), "pixel")


@query("a25_every_nth_day", """
SELECT l_partkey AS pixel, round(avg(l_quantity), 8) AS value, count(*) AS scenes FROM lineitem
WHERE date_diff('day', DATE '1998-01-01', CAST(l_shipdate AS DATE)) BETWEEN 0 AND 365 AND date_diff('day', DATE '1998-01-01', CAST(l_shipdate AS DATE)) % 8 = 0 GROUP BY l_partkey""")
def a25(spark, sf):
    return raster.every_nth_day(b.scenes(spark, sf), "1998-01-01", 366, 8, "pixel").select("pixel", F.round("value", 8).alias("value"), "scenes")


@query("a26_covered_share", ref.pixels("SELECT CAST(gx // 4 AS INTEGER) AS gx, CAST(gy // 4 AS INTEGER) AS gy, round(avg(CASE WHEN cls = 8 THEN 1.0 ELSE 0.0 END), 8) AS share FROM px GROUP BY ALL"))
def a26(spark, sf):
    return raster.covered_share(b.pixels(spark, sf), 4, F.col("cls") == 8).select("gx", "gy", F.round("share", 8).alias("share"))


CENSUS = """
cs AS (SELECT CAST(gx // 8 AS INTEGER) AS x, CAST(gy // 8 AS INTEGER) AS y, bool_or(cls = 8) AS has_water, bool_or(cls = 0) AS has_ocean, bool_or(cls > 0) AS has_land, count(*) AS pixels FROM px GROUP BY ALL)"""


@query("a27_tile_census", ref.pixels("SELECT * FROM cs", CENSUS))
def a27(spark, sf):
    return raster.tile_census(b.pixels(spark, sf), b.TILE_PX)


@query("j12_coastal_tiles", ref.pixels("""
SELECT DISTINCT w.x, w.y FROM (SELECT x, y FROM c2 WHERE has_water) w, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) d(dy)
LEFT JOIN c2 n ON n.x = (w.x + a.dx + 65536) % 65536 AND n.y = w.y + d.dy WHERE w.y + d.dy BETWEEN 0 AND 32767 AND (n.x IS NULL OR n.has_ocean)""", """
c2 AS (SELECT CAST(gx // 2 AS INTEGER) AS x, CAST(gy // 2 AS INTEGER) AS y, bool_or(cls = 8) AS has_water, bool_or(cls = 0) AS has_ocean FROM px GROUP BY ALL)"""))
def j12(spark, sf):
    """Tiles of 2 px, so that the pixels make enough of them."""
    return raster.coastal_tiles(raster.tile_census(b.pixels(spark, sf), 2), b.LEVEL)


def _mask(spark, sf):
    """Sea mask bytes from the parts' prices, missing for every fifth pixel."""
    p = b.pixels(spark, sf)
    return p.where(F.col("p_partkey") % 5 != 0).select("gx", "gy", layers.share_byte((F.col("elev") * 10 % 100) / 100).alias("sea"))


MASK = """
mk AS (SELECT gx, gy, CAST(round_even(fmod(elev * 10, 100) / 100 * 255, 0) AS INTEGER) AS sea FROM px WHERE p_partkey % 5 <> 0),
f0 AS (SELECT p.gx, p.gy, p.cls AS old_cls, CASE WHEN p.cls = 8 AND coalesce(m.sea, 0) >= 128 THEN 0 ELSE p.cls END AS cls, CASE WHEN p.cls = 8 AND coalesce(m.sea, 0) >= 128 THEN 0 ELSE p.tree END AS tree,
  p.cls = 8 AND coalesce(m.sea, 0) >= 128 AS changed FROM px p LEFT JOIN mk m ON m.gx = p.gx AND m.gy = p.gy)"""


@query("j11_patch_sea", ref.pixels("SELECT gx, gy, cls, round(tree, 8) AS tree, changed FROM f0", MASK))
def j11(spark, sf):
    rows = raster.patch_sea(b.pixels(spark, sf), _mask(spark, sf))
    return rows.select("gx", "gy", F.col("new_cls").alias("cls"), F.round("new_tree", 8).alias("tree"), "changed")


COARSE = """
d1_n AS (SELECT gx // 2 AS gx, gy // 2 AS gy, cls, count(*) AS n FROM f0 GROUP BY ALL),
d1 AS (SELECT gx, gy, coalesce(min(cls) FILTER (WHERE rk = 1 AND cls > 0), 0) AS cls FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY (cls = 0), n DESC, cls) AS rk FROM d1_n) GROUP BY ALL),
f1 AS (SELECT o.gx, o.gy, o.cls AS old_cls, CASE WHEN o.cls = 8 THEN d.cls ELSE o.cls END AS cls, o.cls = 8 AND d.cls <> 8 AS changed FROM p1 o JOIN d1 d ON d.gx = o.gx AND d.gy = o.gy)"""


@query("j14_derive_coarse", ref.pixels("SELECT CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(old_cls AS INTEGER) AS old_cls, CAST(cls AS INTEGER) AS cls, changed FROM f1", P1, MASK, COARSE))
def j14(spark, sf):
    levels = raster.pyramid(b.pixels(spark, sf), b.LEVEL, b.LEVEL - 1)
    patched = raster.patch_pyramid(levels, _mask(spark, sf), b.LEVEL, b.LEVEL - 1)
    return patched.where(F.col("z") == b.LEVEL - 1).select("gx", "gy", "old_cls", "cls", "changed")


@query("a36_change_report", ref.pixels("""
SELECT 15 AS z, count(*) FILTER (WHERE changed) AS pixels, count(DISTINCT CASE WHEN changed THEN (gx // 8) || '_' || (gy // 8) END) AS tiles FROM f0
UNION ALL SELECT 14, count(*) FILTER (WHERE changed), count(DISTINCT CASE WHEN changed THEN (gx // 8) || '_' || (gy // 8) END) FROM f1""", P1, MASK, COARSE))
def a36(spark, sf):
    levels = raster.pyramid(b.pixels(spark, sf), b.LEVEL, b.LEVEL - 1)
    return raster.change_report(raster.patch_pyramid(levels, _mask(spark, sf), b.LEVEL, b.LEVEL - 1), b.TILE_PX)


@query("j13_parents_from_children", ref.pixels("""
SELECT CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(cls AS INTEGER) AS cls, tree, 'detail' AS origin FROM (SELECT gx, gy, cls, CASE WHEN cls = 0 THEN 0 ELSE round_even(tree, 0) END AS tree FROM d1)
UNION ALL SELECT CAST(o.gx AS INTEGER), CAST(o.gy AS INTEGER), CAST(o.cls AS INTEGER), CAST(o.cls AS DOUBLE), 'old' FROM p1 o
WHERE (o.gx // 8, o.gy // 8) IN (SELECT (gx // 16, gy // 16) FROM dt) AND (o.gx // 4, o.gy // 4) NOT IN (SELECT (gx // 8, gy // 8) FROM dt)""", P1, """
dt AS (SELECT p_partkey, gx, gy, cls, tree, elev FROM px WHERE (gx // 8 + gy // 8) % 3 <> 0)""", ref.halved("d1", "dt")))
def j13(spark, sf):
    """Detail exists for two thirds of the tiles; the rest keep the old coarse pixels."""
    p = b.pixels(spark, sf)
    detail = p.where((F.floor(F.col("gx") / 8) + F.floor(F.col("gy") / 8)) % 3 != 0).select("gx", "gy", "cls", "tree")
    old = raster.halve(p, ()).withColumn("tree", F.col("cls").cast("double"))
    return raster.parents_from_children(detail, old, b.TILE_PX)


# ---- resampling the level's grid ---------------------------------------------------------------

H15, W15 = 262144, 524288


@query("r01_nearest", ref.pixels("""
SELECT CAST(x AS INTEGER) AS gx, CAST(y AS INTEGER) AS gy, cls FROM (
  SELECT px.*, gy * 3 // 2 + j AS y, gx * 3 // 2 + i AS x FROM px, (SELECT unnest(range(-1, 3)) AS i), (SELECT unnest(range(-1, 3)) AS j))
WHERE ((2 * y + 1) * 2) // 6 = gy AND ((2 * x + 1) * 2) // 6 = gx"""))
def r01(spark, sf):
    return raster.resample_nearest(b.pixels(spark, sf), H15, W15, H15 * 3 // 2, W15 * 3 // 2, "cls")


def _bilinear(out: str, ratio: str, source: str, column: str) -> str:
    """Targets that read a source pixel, blended from four neighbours; missing unless all with a weight are there."""
    return f"""
{out}_t AS (SELECT DISTINCT CAST(floor(gx * {ratio}) AS BIGINT) + i AS x, CAST(floor(gy * {ratio}) AS BIGINT) + j AS y FROM {source}, (SELECT unnest(range(-1, 4)) AS i), (SELECT unnest(range(-1, 4)) AS j)),
{out}_s AS (SELECT x, y, (x + 0.5) / {ratio} - 0.5 AS sx, (y + 0.5) / {ratio} - 0.5 AS sy FROM {out}_t),
{out}_n AS (SELECT x, y, {source}.{column} AS v, (1 - abs(sx - {source}.gx)) * (1 - abs(sy - {source}.gy)) AS w
  FROM {out}_s, (VALUES (0), (1)) h(i), (VALUES (0), (1)) k(j) JOIN {source} ON {source}.gx = floor(sx) + h.i AND {source}.gy = floor(sy) + k.j),
{out} AS (SELECT CAST(x AS INTEGER) AS gx, CAST(y AS INTEGER) AS gy, CASE WHEN sum(w) FILTER (WHERE v IS NOT NULL) > 1 - 1e-9 THEN sum(v * w) END AS v FROM {out}_n WHERE w > 0 GROUP BY x, y)"""


@query("r02_bilinear", ref.pixels("SELECT gx, gy, round(v, 7) AS elev FROM bl", _bilinear("bl", "CAST(2.5 AS DOUBLE)", "px", "elev")))
def r02(spark, sf):
    rows = raster.resample_bilinear(b.pixels(spark, sf), H15, W15, H15 * 5 // 2, W15 * 5 // 2, "elev")
    return rows.select("gx", "gy", F.round("elev", 7).alias("elev"))


@query("r03_cut_level", ref.pixels("""
SELECT 15 AS z, gx, gy, cls, elev AS tree FROM px
UNION ALL SELECT 14, CAST(gx AS INTEGER), CAST(gy AS INTEGER), cls, round_even(elev, 0) FROM p1
UNION ALL SELECT 16, CAST(2 * px.gx + i AS INTEGER), CAST(2 * px.gy + j AS INTEGER), px.cls, round_even(bl.v, 0) FROM px CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) e(j)
  LEFT JOIN bl ON bl.gx = 2 * px.gx + i AND bl.gy = 2 * px.gy + j""", P1, _bilinear("bl", "CAST(2 AS DOUBLE)", "px", "elev")))
def r03(spark, sf):
    """The level as it is, one coarser and one finer."""
    base = b.pixels(spark, sf).select("gx", "gy", "cls", F.col("elev").alias("tree"))
    sizes = {15: (H15, W15), 14: (H15 // 2, W15 // 2), 16: (H15 * 2, W15 * 2)}
    parts = [raster.cut_level(base, H15, W15, *size).select(F.lit(z).alias("z"), "gx", "gy", "cls", "tree") for z, size in sizes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("r04_quarter_upsample", ref.pixels("""
SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(tx AS INTEGER) AS gx, CAST(ty AS INTEGER) AS gy,
  round((a.elev * (1 - fx) + b.elev * fx) * (1 - fy) + (c.elev * (1 - fx) + d.elev * fx) * fy, 7) AS elev
FROM (SELECT *, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM (
  SELECT x, y, tx, ty, least(3, greatest(0, (tx + 0.5) * CAST(0.5 AS DOUBLE) - 0.5)) AS sx, least(3, greatest(0, (ty + 0.5) * CAST(0.5 AS DOUBLE) - 0.5)) AS sy
  FROM (SELECT DISTINCT gx // 4 AS x, gy // 4 AS y FROM px), (SELECT unnest(range(0, 8)) AS tx), (SELECT unnest(range(0, 8)) AS ty)))
LEFT JOIN px a ON a.gx = x * 4 + x0 AND a.gy = y * 4 + y0 LEFT JOIN px b ON b.gx = x * 4 + least(3, x0 + 1) AND b.gy = y * 4 + y0
LEFT JOIN px c ON c.gx = x * 4 + x0 AND c.gy = y * 4 + least(3, y0 + 1) LEFT JOIN px d ON d.gx = x * 4 + least(3, x0 + 1) AND d.gy = y * 4 + least(3, y0 + 1)"""))
def r04(spark, sf):
    rows = raster.quarter_upsample(b.pixels(spark, sf), b.TILE_PX, "elev")
    return rows.select("x", "y", "gx", "gy", F.round("elev", 7).alias("elev"))


# ---- hillshade ---------------------------------------------------------------------------------

_PIXEL = 180.0 / 2**15 / 8
_EXAG = tiles.exaggeration(15, 8)
SHADE = f"""
hz AS (SELECT gx, gy, coalesce(elev, 0) * CAST(40 * {_EXAG!r} AS DOUBLE) AS h FROM px),
gr AS (SELECT a.gx, a.gy,
  CASE WHEN e.h IS NOT NULL AND w.h IS NOT NULL THEN (e.h - w.h) / 2 WHEN e.h IS NOT NULL THEN e.h - a.h WHEN w.h IS NOT NULL THEN a.h - w.h ELSE 0 END AS dx,
  CASE WHEN s.h IS NOT NULL AND n.h IS NOT NULL THEN (s.h - n.h) / 2 WHEN s.h IS NOT NULL THEN s.h - a.h WHEN n.h IS NOT NULL THEN a.h - n.h ELSE 0 END AS dy
  FROM hz a LEFT JOIN hz e ON e.gx = a.gx + 1 AND e.gy = a.gy LEFT JOIN hz w ON w.gx = a.gx - 1 AND w.gy = a.gy LEFT JOIN hz s ON s.gx = a.gx AND s.gy = a.gy + 1 LEFT JOIN hz n ON n.gx = a.gx AND n.gy = a.gy - 1),
sl AS (SELECT gx, gy, dx / greatest(CAST({_PIXEL * 111.32 * 1000.0!r} AS DOUBLE) * cos(radians(90 - (gy + 0.5) * CAST({_PIXEL!r} AS DOUBLE))), 1) AS sx, -dy / CAST({_PIXEL * 111.32 * 1000.0!r} AS DOUBLE) AS sy FROM gr)"""


@query("w11_hillshade", ref.pixels("""
SELECT gx, gy, CAST(round_even(greatest(0, least(1, cos(radians(45)) * cos(atan(sqrt(sx * sx + sy * sy))) + sin(radians(45)) * sin(atan(sqrt(sx * sx + sy * sy))) * cos(radians(315) - atan2(-sx, -sy)))) * 255, 0) AS INTEGER) AS shade FROM sl""", SHADE))
def w11(spark, sf):
    steep = b.pixels(spark, sf).withColumn("elev", F.col("elev") * 40)
    return raster.hillshade(steep, b.LEVEL, b.TILE_PX, block=16)


# ---- encodings ---------------------------------------------------------------------------------

@query("e08_layer_bytes", """
SELECT l_orderkey, l_linenumber, tree_byte, flagged, CAST(floor(word / 256) AS INTEGER) AS elev_high, CAST(word % 256 AS INTEGER) AS elev_low, lights, chl, CAST(word - 11000 AS INTEGER) AS metres,
  round(tree_byte / CAST(255 AS DOUBLE) * 100, 8) AS tree_back, CASE WHEN flagged > 0 THEN round(-1.5 + (flagged - 1) / CAST(254 AS DOUBLE) * 3, 8) END AS current_back, colour, share
FROM (SELECT l_orderkey, l_linenumber,
  CAST(greatest(0, least(255, round_even(l_quantity / 100 * 255, 0))) AS INTEGER) AS tree_byte,
  CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(greatest(1, least(255, round_even((l_discount * 20 - 1 + 1.5) / 3 * 254 + 1, 0))) AS INTEGER) END AS flagged,
  CAST(greatest(0, least(65535, round_even(l_extendedprice / 10 - 3000 + 11000, 0))) AS INTEGER) AS word,
  CAST(greatest(0, least(255, round_even(log10(1 + l_quantity) / 2.5 * 255, 0))) AS INTEGER) AS lights,
  CASE WHEN l_discount > 0 THEN CAST(greatest(1, least(255, round_even((log10(l_discount) + 2) / 3.5 * 254 + 1, 0))) AS INTEGER) ELSE 0 END AS chl,
  CAST(round_even(pow(greatest(0, least(1, l_discount * 4 / CAST(0.3 AS DOUBLE))), CAST(1 AS DOUBLE) / 2.2) * 255, 0) AS INTEGER) AS colour,
  CAST(greatest(0, least(255, round_even(l_tax * 10 * 255, 0))) AS INTEGER) AS share FROM lineitem)""")
def e08(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount")
    current = F.when(F.col("l_linenumber") != 3, d * 20 - 1)
    metres = F.col("l_extendedprice") / 10 - 3000
    coded = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", layers.to_byte(q, LAND[1]).alias("tree_byte"), layers.to_flagged_byte(current, OCEAN[0]).alias("flagged"),
        layers.elevation_high(metres).alias("elev_high"), layers.elevation_low(metres).alias("elev_low"),
        layers.to_byte(layers.log_lights(q), RELIEF[1]).alias("lights"), layers.to_flagged_byte(layers.log_chlorophyll(d), OCEAN[2]).alias("chl"),
        layers.colour_byte(d * 4).alias("colour"), layers.share_byte(F.col("l_tax") * 10).alias("share"),
    )
    return coded.select(
        "*", layers.elevation_metres(F.col("elev_high"), F.col("elev_low")).alias("metres"),
        F.round(layers.from_byte(F.col("tree_byte"), LAND[1]), 8).alias("tree_back"), F.round(layers.from_flagged_byte(F.col("flagged"), OCEAN[0]), 8).alias("current_back"),
    )


CLASS = "CASE code WHEN 10 THEN 1 WHEN 20 THEN 2 WHEN 30 THEN 3 WHEN 40 THEN 4 WHEN 50 THEN 5 WHEN 60 THEN 6 WHEN 70 THEN 7 WHEN 80 THEN 8 WHEN 90 THEN 9 WHEN 95 THEN 10 WHEN 100 THEN 11 ELSE 0 END"


@query("e09_land_classes", f"""
SELECT l_orderkey, l_linenumber, code, CASE WHEN share < 0.5 AND ice >= 10 THEN 7 WHEN share < 0.5 OR (raw = 8 AND sea >= 0.5) THEN 0 ELSE raw END AS cls FROM (
  SELECT *, {CLASS} AS raw FROM (SELECT l_orderkey, l_linenumber, CAST((l_partkey % 11) * 10 AS INTEGER) AS code, l_discount * 10 AS share, CASE WHEN l_linenumber = 2 THEN 0 ELSE l_tax * 10 END AS sea, l_quantity AS ice FROM lineitem))""")
def e09(spark, sf):
    code = ((F.col("l_partkey") % 11) * 10).cast("int")
    sea = F.when(F.col("l_linenumber") != 2, F.col("l_tax") * 10)
    cls = layers.land_class(code, F.col("l_discount") * 10, sea, F.col("l_quantity"))
    return b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"), cls.alias("cls"))


@query("e10_land_pixels", ref.pixels("""
SELECT gx, gy, cls, CASE WHEN cls = 0 THEN 0 ELSE CAST(greatest(0, least(255, round_even(coalesce(tree, 0) / 100 * 255, 0))) AS INTEGER) END AS tree,
  CAST(greatest(0, least(255, round_even(coalesce(CASE WHEN cls <> 5 THEN elev - 800 END, 181), 0))) AS INTEGER) AS shade FROM px"""))
def e10(spark, sf):
    shade = F.when(F.col("cls") != 5, F.col("elev") - 800)
    return b.pixels(spark, sf).select(
        "gx", "gy", "cls", layers.land_tree(F.col("cls"), layers.to_byte(F.col("tree"), LAND[1])).alias("tree"), layers.shade_or_flat(shade).alias("shade")
    )


@query("e11_water_share", ref.pixels("SELECT gx, gy, round(coalesce(tree * (cls / CAST(11 AS DOUBLE)), 0), 8) AS water FROM px"))
def e11(spark, sf):
    return b.pixels(spark, sf).select("gx", "gy", F.round(layers.water_share(F.col("tree"), F.col("cls") / 11.0), 8).alias("water"))


@query("e12_exaggeration", ref.places("""
SELECT name, CAST(population % 13 AS INTEGER) AS z, round(least(8, greatest(1.5, 8 * sqrt(CAST(180 AS DOUBLE) / pow(2, population % 13) / 256 * 111.32 / 10))), 8) AS exaggeration FROM pl"""))
def e12(spark, sf):
    z = (F.col("population") % 13).cast("int")
    return b.places(spark, sf).select("name", z.alias("z"), F.round(tiles.exaggeration_column(z), 8).alias("exaggeration"))


# ---- layers read at places ---------------------------------------------------------------------

W, H = 72, 36


def _monthly_layer(spark, sf):
    """Monthly raster of 5-degree pixels: records per pixel and month, missing where there are none."""
    x, y = raster.pixel_of(F.col("lng"), F.col("lat"), W, H)
    return b.records(spark, sf).groupBy(x.alias("gx"), y.alias("gy"), (F.col("month") - 1).alias("month")).agg(F.count("*").cast("double").alias("value"))


LAYER = f"""
ml AS (SELECT greatest(0, least({W - 1}, CAST(floor((lng + 180) / 360 * {W}) AS INTEGER))) AS gx, greatest(0, least({H - 1}, CAST(floor((90 - lat) / 180 * {H}) AS INTEGER))) AS gy, month - 1 AS month, CAST(count(*) AS DOUBLE) AS v FROM rec GROUP BY ALL),
pt AS (SELECT name, lng, lat, (lng + 180) / 360 * {W} - 0.5 AS fx, least({H - 1}, greatest(0, (90 - lat) / 180 * {H} - 0.5)) AS fy FROM pl),
nb AS (SELECT name, (CAST(floor(fx) AS INTEGER) + dx + {W}) % {W} AS gx, least({H - 1}, CAST(floor(fy) AS INTEGER) + dy) AS gy, m.month,
  (CASE WHEN dx = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) * (CASE WHEN dy = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * m.share AS w
  FROM pt, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy), (VALUES (8, CAST(0.84375 AS DOUBLE)), (9, CAST(0.15625 AS DOUBLE))) m(month, share))"""


@query("j16_sample_layer", ref.sql("""
SELECT n.name AS id, CASE WHEN sum(n.w) FILTER (WHERE l.v IS NOT NULL) > 1 - 1e-9 THEN round(sum(l.v * n.w), 11) END AS value
FROM nb n LEFT JOIN ml l ON l.gx = n.gx AND l.gy = n.gy AND l.month = n.month WHERE n.w > 0 GROUP BY n.name""", ref.RECORDS, ref.PLACES, LAYER))
def j16(spark, sf):
    """At t = 8.75 the months 8 and 9 blend with the smoothstep of a quarter."""
    points = b.places(spark, sf).select(F.col("name").alias("id"), "lng", "lat")
    return raster.sample_layer(points, _monthly_layer(spark, sf), W, H, 8.75).select("id", F.round("value", 11).alias("value"))


def _static_layer(spark, sf):
    """Static layer of 5-degree pixels with records: flags and bytes."""
    x, y = raster.pixel_of(F.col("lng"), F.col("lat"), W, H)
    return b.records(spark, sf).groupBy(x.alias("gx"), y.alias("gy")).agg(
        F.count("*").alias("n"), F.max("sp").alias("sp"), F.min("year").alias("year")
    ).select("gx", "gy", (F.col("n") % 256).cast("int").alias("byte"), (F.col("n") % 2 == 0).alias("land"), F.col("sp"), F.col("n").alias("n"))


STATIC = f"""
st AS (SELECT greatest(0, least({W - 1}, CAST(floor((lng + 180) / 360 * {W}) AS INTEGER))) AS gx, greatest(0, least({H - 1}, CAST(floor((90 - lat) / 180 * {H}) AS INTEGER))) AS gy, count(*) AS n, max(sp) AS sp FROM rec GROUP BY ALL),
pp AS (SELECT name, greatest(0, least({W - 1}, CAST(floor((lng + 180) / 360 * {W}) AS INTEGER))) AS gx, greatest(0, least({H - 1}, CAST(floor((90 - lat) / 180 * {H}) AS INTEGER))) AS gy, population FROM pl)"""


@query("j22_nearest_pixel", ref.sql("SELECT p.name, p.gx, p.gy, CAST(s.n % 256 AS INTEGER) AS byte, coalesce(s.n % 2 = 0, false) AS land FROM pp p LEFT JOIN st s ON s.gx = p.gx AND s.gy = p.gy", ref.RECORDS, ref.PLACES, STATIC))
def j22(spark, sf):
    rows = raster.nearest_pixel(b.places(spark, sf), _static_layer(spark, sf), W, H)
    return rows.select("name", "gx", "gy", "byte", F.coalesce("land", F.lit(False)).alias("land"))


@query("j20_environment_lines", ref.sql("""
SELECT name, land,
  CASE WHEN land THEN CASE WHEN tree >= 5 THEN 'class ' || (sp % 12) || ' · ' || tree || ' % tree cover' ELSE 'class ' || (sp % 12) END END AS ground,
  CASE WHEN land THEN 300 - n END AS height_m, CASE WHEN NOT land THEN CASE WHEN n > 300 THEN (n - 300) || ' m' ELSE 'coast' END END AS depth,
  CASE WHEN wind < 0.5 THEN 'calm' ELSE printf('%.1f', wind) || ' m/s from the ' || from_sector END AS wind, CAST(n % 60 - 20 AS VARCHAR) || ' °C' AS air,
  CASE WHEN land THEN CASE WHEN n % 4 = 0 THEN 'bare or water' WHEN n % 4 = 2 THEN 'moderate' END END AS greenness,
  CASE WHEN land THEN CASE WHEN n % 5 = 0 THEN 'none' ELSE n % 5 || ' % of the area' END END AS water,
  CASE WHEN land THEN CASE WHEN n % 7 = 0 THEN 'none' ELSE n % 7 || ' % cover' END END AS snow,
  CASE WHEN land AND sp % 3 > 0 THEN CASE sp % 3 WHEN 1 THEN '9.0' ELSE '99.0' END || ' nW/cm²/sr' END AS lights,
  CASE WHEN NOT land THEN CASE WHEN flow < 0.03 THEN 'slack' ELSE printf('%.2f', flow) || ' m/s towards the ' || to_sector END END AS current,
  CASE WHEN NOT land THEN CASE sp % 3 WHEN 0 THEN '1.00' WHEN 1 THEN '10.00' ELSE '100.00' END || ' mg/m³ chlorophyll' END AS plankton
FROM (SELECT p.name, s.n, s.sp, s.n % 100 AS tree, s.n % 2 = 0 AS land, s.n % 17 - 8.0 AS u, sqrt(pow(s.n % 17 - 8.0, 2)) AS wind, s.n % 9 - 4.0 AS cv, sqrt(pow(s.n % 9 - 4.0, 2)) AS flow,
    CASE WHEN s.n % 17 > 8 THEN 'west' ELSE 'east' END AS from_sector, CASE WHEN s.n % 9 > 4 THEN 'north' ELSE 'south' END AS to_sector
  FROM pp p LEFT JOIN st s ON s.gx = p.gx AND s.gy = p.gy)""", ref.RECORDS, ref.PLACES, STATIC))
def j20(spark, sf):
    """All lines of every place; a place without a pixel keeps its row, with no lines."""
    placed = raster.nearest_pixel(b.places(spark, sf), _static_layer(spark, sf), W, H)
    n, third = F.col("n"), F.col("sp") % 3
    lines = raster.environment_lines(
        placed, on_land=F.col("land"), ground=F.concat(F.lit("class "), (F.col("sp") % 12).cast("string")), tree=n % 100, elevation=(F.lit(300) - n).cast("double"),
        wind=(n % 17 - 8.0, F.lit(0.0)), air=(n % 60 - 20).cast("double"), ndvi=(n % 4) / 5.0, water=(n % 5).cast("double"), snow=(n % 7).cast("double"),
        lights=third.cast("double"), current=(F.lit(0.0), n % 9 - 4.0), plankton=third.cast("double"),
    )
    return lines.select("name", "land", "ground", "height_m", "depth", "wind", "air", "greenness", "water", "snow", "lights", "current", "plankton")


@query("q03_piece_cover", """
SELECT (mx + 1) * (my + 1) - count(*) AS gaps, count(*) FILTER (WHERE hits > 1) AS overlaps, count(*) AS covered FROM (
  SELECT x + i AS gx, y + j AS gy, count(*) AS hits FROM (
    SELECT (p_partkey % 20) * 5 AS x, (p_partkey // 20) * 4 AS y, CASE WHEN p_size % 7 = 0 THEN 6 ELSE 5 END AS w, CASE WHEN p_size % 11 = 0 THEN 3 ELSE 4 END AS h FROM part) p,
    LATERAL (SELECT unnest(range(0, p.w)) AS i), LATERAL (SELECT unnest(range(0, p.h)) AS j) GROUP BY ALL),
  (SELECT max(p_partkey % 20) * 5 + 4 AS mx, max(p_partkey // 20) * 4 + 3 AS my FROM part) WHERE gx <= mx AND gy <= my GROUP BY mx, my""")
def q03(spark, sf):
    """Pieces in a grid of 20 columns, some too wide and some too low."""
    part = b.table(spark, sf, "part")
    row = F.floor(F.col("p_partkey") / 20).cast("int")
    pieces = part.select(
        ((F.col("p_partkey") % 20) * 5).cast("int").alias("x"), (row * 4).alias("y"),
        F.when(F.col("p_size") % 7 == 0, 6).otherwise(5).alias("w"), F.when(F.col("p_size") % 11 == 0, 3).otherwise(4).alias("h"),
    )
    size = part.agg((F.max(F.col("p_partkey") % 20) * 5 + 5).alias("width"), (F.max(row) * 4 + 4).alias("height"))
    inside = raster.piece_cover(pieces).withColumn("_one", F.lit(1)).join(F.broadcast(size.withColumn("_one", F.lit(1))), "_one")  # one row
    hits = inside.where("gx < width and gy < height")
    return quality.cover_report(hits, F.max(F.col("width") * F.col("height")))


@query("q04_layer_contract", """
SELECT CASE l_linenumber % 5 WHEN 0 THEN 'surface' WHEN 1 THEN 'climate' WHEN 2 THEN 'ocean' WHEN 3 THEN 'land' ELSE 'relief' END AS layer,
  count(*) FILTER (WHERE l_partkey % 17 = 0 AND (l_linenumber % 5 <> 4 OR l_partkey % 3 < 2)) AS wrong_channel, count(*) FILTER (WHERE l_quantity <= 25) AS empty_range, count(*) FILTER (WHERE l_returnflag = 'R') AS no_source,
  count(*) FILTER (WHERE l_suppkey % 4 = 0) AS not_twelve_months FROM lineitem GROUP BY 1""")
def q04(spark, sf):
    """Channel descriptions, one per line item, some of them broken."""
    layers_by_number = {0: ("surface", SURFACE), 1: ("climate", CLIMATE), 2: ("ocean", OCEAN), 3: ("land", LAND), 4: ("relief", RELIEF)}
    number, place = F.col("l_linenumber") % 5, (F.col("l_partkey") % 3).cast("int")
    layer, name = F.lit(None).cast("string"), F.lit("extra")
    for n, (label, channels) in layers_by_number.items():
        layer = F.when(number == n, label).otherwise(layer)
        for i, ch in enumerate(channels):
            name = F.when((number == n) & (place == i), ch.name).otherwise(name)
    described = b.table(spark, sf, "lineitem").select(
        layer.alias("layer"), place.alias("ord"), F.when(F.col("l_partkey") % 17 == 0, "broken").otherwise(name).alias("name"),
        F.lit(25.0).alias("lo"), F.col("l_quantity").alias("hi"), F.when(F.col("l_returnflag") != "R", "survey").alias("source"),
        F.when(F.col("l_suppkey") % 4 == 0, 11).otherwise(12).alias("months"),
    )
    return quality.layer_violations(described)


