"""One query per command that has no other: ingest, names, places, coast, world tiles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from phenogrid.catalog import joins, rasters, scans
from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.operators import presence
from phenogrid.plans import products, world
from phenogrid.rules import SHARDS, PresenceRules
from phenogrid.session import new_path
from phenogrid.sources import bindings as b
from phenogrid.sources import sinks


def ingested(spark, sf):
    """The counts of all records as a file, taken in shard by shard: (tables, metrics of the shards)."""
    tsv, tables = new_path(spark, "tsv"), new_path(spark, "tables")
    counts = b.month_counts(spark, sf).select("specieskey", F.col("sci").alias("species"), "family", "month", "lat0", "lng0", "n")
    sinks.write_counts_tsv(counts, tsv)
    metrics = [world.world_shard(spark, tsv, shard, tables, b.SENSITIVE) for shard, _, _ in SHARDS]
    out = metrics[0]
    for frame in metrics[1:]:
        out = out.unionByName(frame)
    return tables, out


@query("x02_world_shard", ref.occ(f"""
SELECT s.shard, coalesce(m.rows, 0) AS rows, coalesce(m.records, 0) AS records, coalesce(m.pairs, 0) AS pairs, coalesce(m.species, 0) AS species, coalesce(m.cells, 0) AS cells
FROM (VALUES {", ".join(f"('{shard}')" for shard, _, _ in SHARDS)}) s(shard) LEFT JOIN (
  SELECT {ref.SHARD_CASE} AS shard, count(*) AS rows, CAST(sum(n) AS BIGINT) AS records, count(DISTINCT CASE WHEN sci IS NOT NULL THEN sci || '|' || cell END) AS pairs, count(DISTINCT sci) AS species, count(DISTINCT cell) AS cells
  FROM masked GROUP BY 1) m ON m.shard = s.shard"""))
def x02_world_shard(spark, sf):
    """Metrics of every shard as its ingest returns them."""
    return ingested(spark, sf)[1]


@query("x02_world_names", ref.occ("""
SELECT w.sci, coalesce(b.key, nullif(w.specieskey, ''), w.sci) AS key, coalesce(b.common, '') AS common, coalesce(nullif(b.family, ''), w.family, '') AS family, b.key IS NULL AS unmatched
FROM wanted w LEFT JOIN best b ON b.sci = w.sci""", joins.SOURCES))
def x02_world_names(spark, sf):
    """Names of the species that the ingested shards hold, by priority of the sources."""
    pairs, _ = world.shard_tables(spark, ingested(spark, sf)[0])
    return world.world_names(pairs, *joins._name_sources(spark, sf))


@query("x02_places", ref.places(f"""
SELECT CASE WHEN population >= 15000 OR kind = 0 THEN 'major' ELSE {ref.tile_x('lng', 3)} || '_' || {ref.tile_y('lat', 3)} END AS chunk, count(*) AS places,
  CAST(sum(population) AS BIGINT) AS people, count(*) FILTER (WHERE country NOT LIKE 'A%') AS with_admin, min(CASE WHEN country NOT LIKE 'A%' THEN admin_code || ' of ' || country END) AS first_admin
FROM ok GROUP BY 1""", scans.DUMP))
def x02_places(spark, sf):
    """The place product from a dump and the table of regions: what each stored chunk holds."""
    out = new_path(spark, "places")
    products.places(spark, scans._dump(spark, sf), scans.admin_dump(spark, sf), out)
    stored = spark.read.json(f"{out}/chunks", schema="name string, population bigint, country string, admin1 string, chunk string")
    return stored.groupBy("chunk").agg(F.count("*").alias("places"), F.sum("population").alias("people"), F.count_if(F.col("admin1") != "").alias("with_admin"), F.min(F.nullif("admin1", F.lit(""))).alias("first_admin"))


@query("x02_coast_plan", ref.pixels("""
SELECT DISTINCT w.x, w.y FROM (SELECT x, y FROM c2 WHERE has_water) w, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) d(dy)
LEFT JOIN c2 n ON n.x = (w.x + a.dx + 65536) % 65536 AND n.y = w.y + d.dy WHERE w.y + d.dy BETWEEN 0 AND 32767 AND (n.x IS NULL OR n.has_ocean)""", """
c2 AS (SELECT CAST(gx // 4 AS INTEGER) AS x, CAST(gy // 4 AS INTEGER) AS y, bool_or(cls = 8) AS has_water, bool_or(cls = 0) AS has_ocean FROM px GROUP BY ALL)"""))
def x02_coast_plan(spark, sf):
    """Coastal tiles from the pixels, in tiles of 4 px."""
    return products.coast_plan(b.pixels(spark, sf), b.LEVEL, 4)


@query("x02_coast_patch", ref.pixels("""
SELECT 15 AS z, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(cls AS INTEGER) AS cls, changed, (SELECT count(*) FILTER (WHERE changed) FROM f0) AS changed_on_level FROM f0
UNION ALL SELECT 14, CAST(gx AS INTEGER), CAST(gy AS INTEGER), CAST(cls AS INTEGER), changed, (SELECT count(*) FILTER (WHERE changed) FROM f1) FROM f1""", rasters.P1, rasters.MASK, rasters.COARSE))
def x02_coast_patch(spark, sf):
    """Both levels after the sea patch, beside what the report says of them."""
    levels = rasters.raster.pyramid(b.pixels(spark, sf), b.LEVEL, b.LEVEL - 1)
    patched, report = products.coast_patch(levels, rasters._mask(spark, sf), b.LEVEL, b.LEVEL - 1, b.TILE_PX)
    return patched.join(report.select("z", F.col("pixels").alias("changed_on_level")), "z").select("z", "gx", "gy", "cls", "changed", "changed_on_level")


@query("x02_tiles_world", ref.pixels("""
SELECT z, gx, gy, cls, tree FROM (SELECT 15 AS z, gx, gy, cls, elev AS tree FROM px UNION ALL SELECT 14, CAST(gx AS INTEGER), CAST(gy AS INTEGER), cls, round_even(elev, 0) FROM p1)
WHERE (z, gx // 8, gy // 8) IN (SELECT (15, gx // 8, gy // 8) FROM px WHERE cls > 0 UNION ALL SELECT (14, gx // 8, gy // 8) FROM p1 WHERE cls > 0)""", rasters.P1))
def x02_tiles_world(spark, sf):
    """Two levels cut from a base layer, written as tiles and read back: those that bear land."""
    out = new_path(spark, "tiles")
    base = b.pixels(spark, sf).select("gx", "gy", "cls", F.col("elev").alias("tree"))
    products.tiles_world(base, rasters.H15, rasters.W15, {15: (rasters.H15, rasters.W15), 14: (rasters.H15 // 2, rasters.W15 // 2)}, out, b.TILE_PX)
    return spark.read.schema("gx int, gy int, cls int, tree double, z int").parquet(out).select("z", "gx", "gy", "cls", "tree")


SHARD = (13, 8192, 1024)
IN_SHARD = "(gx // 8) >> 2 = 8192 AND (gy // 8) >> 2 = 1024"


@query("x02_absorb_shard", ref.pixels("""
SELECT a.z, CAST(a.gx AS INTEGER) AS gx, CAST(a.gy AS INTEGER) AS gy, CAST(a.cls AS INTEGER) AS cls, c.tiles FROM ab a JOIN (SELECT z, count(DISTINCT (gx // 8, gy // 8)) AS tiles FROM ab WHERE cls > 0 GROUP BY z) c ON c.z = a.z""", rasters.P1, f"""
ab AS (SELECT 15 AS z, gx, gy, cls FROM px WHERE NOT ({IN_SHARD}) UNION ALL SELECT 15, gx, gy, 3 FROM px WHERE {IN_SHARD} AND gx % 2 = 0 UNION ALL SELECT 14, gx, gy, cls FROM p1)"""))
def x02_absorb(spark, sf):
    """A shard brings new pixels of the finest level: the stored set, and the tiles of each level by its new manifest."""
    out = new_path(spark, "absorbed")
    levels = rasters.raster.pyramid(b.pixels(spark, sf), b.LEVEL, b.LEVEL - 1, ()).select("z", "gx", "gy", "cls")
    x, y = F.shiftright(F.floor(F.col("gx") / 8).cast("int"), 2), F.shiftright(F.floor(F.col("gy") / 8).cast("int"), 2)
    incoming = levels.where((F.col("z") == b.LEVEL) & (x == SHARD[1]) & (y == SHARD[2]) & (F.col("gx") % 2 == 0)).withColumn("cls", F.lit(3))
    manifest = products.absorb_shard(levels, incoming, SHARD, "detail", out, b.TILE_PX)
    held = spark.read.schema("gx int, gy int, cls int, z int").parquet(f"{out}/tiles")
    counts = manifest.select(F.explode("counts").alias("c")).select(F.col("c.z").alias("z"), F.col("c.tiles").alias("tiles"))
    return held.join(counts, "z").select("z", "gx", "gy", "cls", "tiles")


@query("x01_other_rules", ref.sql("SELECT DISTINCT sci, cell, p FROM sl", ref.RECORDS, ref.BY_SCI.replace("t >= 30 AS surveyed", "t >= 10 AS surveyed").replace("CAST(0.2 AS DOUBLE) * peak", "CAST(0.5 AS DOUBLE) * peak").replace("a.records < 5", "a.records < 3")))
def x01(spark, sf):
    """Labels under rules passed in: half of the peak, effort of 10, three records."""
    pairs, effort = b.pairs_and_effort(spark, sf)
    rules = replace(PresenceRules(), peak_share=0.5, effort_floor=10, species_records=3)
    return presence.label_presence(pairs, effort, rules).select("sci", "cell", "p")
