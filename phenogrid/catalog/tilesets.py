"""Tile sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.operators import tileset
from phenogrid.sources import bindings as b

# Tiles of places at levels 3 to 9: a place's level follows its population.
TILES = f"""
zl AS (SELECT name, lng, lat, CAST(3 + population % 7 AS INTEGER) AS z FROM pl),
tl AS (SELECT DISTINCT z, CAST(greatest(0, least((2 << z) - 1, floor((lng + 180) / (CAST(180 AS DOUBLE) / (1 << z))))) AS INTEGER) AS x,
  CAST(greatest(0, least((1 << z) - 1, floor((90 - lat) / (CAST(180 AS DOUBLE) / (1 << z))))) AS INTEGER) AS y FROM zl)"""


def _tiles(spark, sf):
    p = b.places(spark, sf).withColumn("z", (F.col("population") % 7 + 3).cast("int"))
    parts = [tileset.tiles_of_points(p.where(F.col("z") == z).drop("z"), z).select("z", "x", "y") for z in range(3, 10)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


@query("a28_level_counts", ref.places("SELECT z, count(*) AS tiles, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM tl GROUP BY z", TILES))
def a28(spark, sf):
    return tileset.level_counts(_tiles(spark, sf))


@query("a28_level_index", ref.places("""
SELECT z, bit // 32768 AS chunk, count(*) AS tiles, CAST(min(bit % 32768) AS INTEGER) AS first_bit FROM (SELECT z, CAST(y AS BIGINT) * (2 << z) + x AS bit FROM tl) GROUP BY ALL""", TILES))
def a28_index(spark, sf):
    """The bit index itself, read back: set bits per chunk and the first of them."""
    index = tileset.level_index(_tiles(spark, sf))
    raw = F.unbase64("bits")
    ones = F.bitmap_count(raw)
    lead = F.length(F.regexp_extract(F.hex(raw), "^((?:00)*)", 1)) / 2
    byte = F.conv(F.substring(F.hex(raw), (lead * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    low = byte.bitwiseAND(-byte)
    return index.select("z", "chunk", ones.alias("tiles"), (lead * 8 + F.log2(low)).cast("int").alias("first_bit"))


@query("a39_reach", ref.places("SELECT DISTINCT CAST(a.l AS INTEGER) AS z, x >> CAST(z - a.l AS INTEGER) AS x, y >> CAST(z - a.l AS INTEGER) AS y FROM tl, LATERAL (SELECT unnest(range(0, tl.z)) AS l) a", TILES))
def a39(spark, sf):
    return tileset.reach(_tiles(spark, sf))


@query("a39_has_deeper", ref.places("""
SELECT t.z, t.x, t.y FROM tl t WHERE EXISTS (SELECT 1 FROM tl d WHERE d.z > t.z AND (d.x >> (d.z - t.z)) = t.x AND (d.y >> (d.z - t.z)) = t.y)""", TILES))
def a39_deeper(spark, sf):
    rows = _tiles(spark, sf)
    return tileset.has_deeper(rows, rows)


@query("a29_land_tile_plan", ref.sql("""
SELECT DISTINCT CAST(gx // 9 AS INTEGER) AS x, CAST(gy // 9 AS INTEGER) AS y FROM (
  SELECT (gx + dx + 144) % 144 AS gx, (gy + dy + 72) % 72 AS gy FROM mk, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy))""", ref.RECORDS, """
mk AS (SELECT DISTINCT greatest(0, least(143, CAST(floor((lng + 180) / 360 * 144) AS INTEGER))) AS gx, greatest(0, least(71, CAST(floor((90 - lat) / 180 * 72) AS INTEGER))) AS gy FROM rec)"""))
def a29(spark, sf):
    """Level-3 tiles around a mask of the 2.5-degree pixels that hold records, grown by one pixel (U8)."""
    return tileset.land_tile_plan(_mask(spark, sf), 144, 72, 3)


def _mask(spark, sf):
    from phenogrid.operators.raster import pixel_of

    x, y = pixel_of(F.col("lng"), F.col("lat"), 144, 72)
    return b.records(spark, sf).select(x.alias("gx"), y.alias("gy")).distinct()


@query("u08_grown_mask", ref.sql("""
SELECT DISTINCT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT unnest(range(0, 256)) AS x), (SELECT unnest(range(0, 128)) AS y),
  (SELECT DISTINCT (gx + dx + 144) % 144 AS gx, (gy + dy + 72) % 72 AS gy FROM mk, (VALUES (-2), (-1), (0), (1), (2)) a(dx), (VALUES (-2), (-1), (0), (1), (2)) b(dy))
WHERE least(143, (2 * x + 1) * 144 // 512) = gx AND least(71, (2 * y + 1) * 72 // 256) = gy""", ref.RECORDS, """
mk AS (SELECT DISTINCT greatest(0, least(143, CAST(floor((lng + 180) / 360 * 144) AS INTEGER))) AS gx, greatest(0, least(71, CAST(floor((90 - lat) / 180 * 72) AS INTEGER))) AS gy FROM rec)"""))
def u08(spark, sf):
    """Tiles finer than the mask read the pixel under their centre; the mask is grown by two pixels."""
    return tileset.land_tile_plan(_mask(spark, sf), 144, 72, 7, dilate=2)


@query("j15_sampled_ancestor", ref.places("""
SELECT t.z, t.x, t.y, a.z AS az, a.x AS ax, a.y AS ay, CAST(1 AS DOUBLE) / (1 << (t.z - a.z)) AS scale, CAST(t.x - a.x * (1 << (t.z - a.z)) AS DOUBLE) / (1 << (t.z - a.z)) AS u, CAST(t.y - a.y * (1 << (t.z - a.z)) AS DOUBLE) / (1 << (t.z - a.z)) AS v
FROM tl t JOIN (SELECT z, x, y FROM tl WHERE z <= 6 UNION SELECT 6, x >> (z - 6), y >> (z - 6) FROM tl WHERE z > 6 AND x % 2 = 0) a ON a.z = least(t.z, 6) AND a.x = t.x >> (t.z - least(t.z, 6)) AND a.y = t.y >> (t.z - least(t.z, 6))""", TILES))
def j15(spark, sf):
    """Tiles finer than level 6 sample their level-6 ancestor, where that is held."""
    rows = _tiles(spark, sf)
    by = F.col("z") - 6
    coarse = rows.where("z > 6 and x % 2 = 0").select(F.lit(6).alias("z"), F.call_function("shiftright", "x", by).alias("x"), F.call_function("shiftright", "y", by).alias("y"))
    held = rows.where("z <= 6").unionByName(coarse).distinct()
    return tileset.sampled_ancestor(rows, held, 6)


@query("j21_source_for", ref.places("""
SELECT t.z, t.x, t.y, s.set FROM tl t LEFT JOIN (SELECT z, x, y, arg_max(set, min_level) AS set FROM (
  SELECT 'world' AS set, 0 AS min_level, z, x, y FROM tl WHERE z <= 6 UNION ALL SELECT 'detail', 5, z, x, y FROM tl WHERE z >= 5 AND y % 3 <> 0) GROUP BY ALL) s ON s.z = t.z AND s.x = t.x AND s.y = t.y""", TILES))
def j21(spark, sf):
    rows = _tiles(spark, sf)
    world = rows.where("z <= 6").select(F.lit("world").alias("set"), F.lit(0).alias("min_level"), "z", "x", "y")
    detail = rows.where("z >= 5 and y % 3 <> 0").select(F.lit("detail").alias("set"), F.lit(5).alias("min_level"), "z", "x", "y")
    return tileset.source_for(rows, world.unionByName(detail))


@query("u07_absorb_shard", ref.places("""
SELECT z, x, y, 'old' AS version FROM tl WHERE NOT (z IN (SELECT z FROM inc) AND z >= 3 AND x >> (z - 3) = 8 AND y >> (z - 3) = 3)
UNION ALL SELECT z, x, y, 'new' FROM inc""", TILES, """
inc AS (SELECT DISTINCT z + 1 AS z, 2 * x AS x, 2 * y AS y FROM tl WHERE z >= 4 AND x >> (z - 3) = 8 AND y >> (z - 3) = 3)"""))
def u07(spark, sf):
    """A shard brings tiles one level below its old ones; only its own levels are replaced."""
    rows = _tiles(spark, sf)
    shard = (3, 8, 3)
    finer = tileset.inside_shard(rows, shard).where("z >= 4")
    incoming = finer.select((F.col("z") + 1).alias("z"), (F.col("x") * 2).alias("x"), (F.col("y") * 2).alias("y"), F.lit("new").alias("version"))
    return tileset.absorb_shard(rows.withColumn("version", F.lit("old")), incoming, shard)


@query("u07_foreign_tiles", ref.places("SELECT z, x, y FROM tl WHERE NOT (x >> (z - 3) = 8 AND y >> (z - 3) = 3)", TILES))
def u07_foreign(spark, sf):
    """Tiles that would make a drop of shard 3/8/3 be refused."""
    return tileset.foreign_tiles(_tiles(spark, sf), (3, 8, 3))


@query("sk12_region_levels", ref.places("""
SELECT x >> (z - 3) AS sx, y >> (z - 3) AS sy, min(z) AS first_level, max(z) AS last_level, count(*) AS tiles FROM tl GROUP BY ALL""", TILES))
def sk12_regions(spark, sf):
    return tileset.region_levels(_tiles(spark, sf), 3)
