"""Sources and sinks: every query writes what Spark derived from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import published
from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.functions import grid, months
from phenogrid.operators import counting, documents, naming, places, quality, raster, tileset
from phenogrid.plans import world
from phenogrid.rules import LAND
from phenogrid.session import new_path
from phenogrid.sources import bindings as b
from phenogrid.sources import files, sinks


def _tsv(spark, sf):
    """Counts as the provider ships them: strings, with a quote and a backslash in some names."""
    path = new_path(spark, "counts")
    counts = b.month_counts(spark, sf)
    sinks.write_counts_tsv(counts.select(
        "specieskey", F.concat(F.lit(" "), "sci").alias("species"),
        F.when(F.col("family") == "Family 1", 'Fam"ily\\1').otherwise(F.col("family")).alias("family"),
        "month", "lat0", "lng0", "n",
    ), path)
    return path


@query("sc01_counts_tsv", ref.occ(r"""
SELECT specieskey, sci, CASE WHEN family = 'Family 1' THEN 'Fam"ily\1' ELSE family END AS family, month, lat0, lng0, n FROM counts"""))
def sc01(spark, sf):
    return counting.typed_counts(files.counts_tsv(spark, _tsv(spark, sf)))


def _facets(spark, sf):
    """Facet bodies per cell and month, one folder per month; some cells lack December."""
    path = new_path(spark, "facets")
    counts = counting.with_cell(b.month_counts(spark, sf))
    per_species = counts.groupBy("cell", "lat0", "month", "specieskey").agg(F.sum("n").alias("n"))
    bodies = per_species.groupBy("cell", "lat0", "month").agg(
        F.sum("n").alias("count"),
        F.map_from_entries(F.collect_list(F.when(F.col("specieskey").isNotNull(), F.struct("specieskey", "n")))).alias("species"),
    ).where((F.col("lat0") % 5 != 0) | (F.col("month") != 12))
    folder = F.format_string("m%02d", F.col("month"))
    bodies.select("cell", "count", "species", folder.alias("mm")).write.partitionBy("mm").json(path)
    return path


FACETS = """
f AS (SELECT lat0 || '_' || lng0 AS cell, lat0, month, specieskey, sum(n) AS n FROM counts WHERE lat0 % 5 <> 0 OR month <> 12 GROUP BY ALL),
full_cells AS (SELECT cell FROM f GROUP BY cell HAVING count(DISTINCT month) = 12)"""


@query("sc02_facet_json", ref.occ(f"""
SELECT cell, specieskey AS key, {ref.pivot('n', 'c')} FROM f WHERE specieskey IS NOT NULL AND cell IN (SELECT cell FROM full_cells)
GROUP BY cell, specieskey""", FACETS))
def sc02(spark, sf):
    facets = files.facet_files(spark, _facets(spark, sf))
    _, species, _ = files.cell_summaries(facets)
    dense = counting.dense_months(species, ["cell", "key"])
    return dense.select("cell", "key", *months.wide("c", "c"))


@query("q02_incomplete_cells", ref.occ("SELECT cell, count(DISTINCT month) AS months FROM f GROUP BY cell HAVING count(DISTINCT month) < 12", FACETS))
def q02(spark, sf):
    return quality.incomplete_cells(files.facet_files(spark, _facets(spark, sf)))


@query("sc03_species_json", ref.occ("""
SELECT key, sci, common, family, '' AS "order" FROM names"""))
def sc03(spark, sf):
    path = new_path(spark, "species")
    named = b.names(spark, sf).select("key", F.col("sci").alias("scientific"), F.nullif("common", F.lit("")).alias("common"), "family")
    named.write.json(path)
    return files.species_records(spark, path)


def _ranges(spark, sf):
    path = new_path(spark, "ranges")
    labelled, _ = b.labelled(spark, sf)
    ranges = labelled.groupBy("key").agg(
        F.struct(F.col("key"), F.concat(F.lit("Sci "), "key").alias("scientific"), F.lit("").alias("common"), F.lit("Fam").alias("family")).alias("name"),
        F.map_from_entries(F.collect_list(F.struct("cell", F.array("c", "t")))).alias("cells"),
    )
    ranges.write.json(path)
    return path


@query("sc04_ranges_json", ref.by_key("""
SELECT key, cell, 'Sci ' || key AS sci, CAST(sum(c) AS BIGINT) AS records, CAST(sum(t) AS BIGINT) AS effort, CAST(max(c) FILTER (WHERE month = 3) AS BIGINT) AS march
FROM kl GROUP BY key, cell"""))
def sc04(spark, sf):
    rows = files.global_ranges(spark, _ranges(spark, sf))
    return rows.select("key", "cell", "sci", months.total("c").alias("records"), months.total("t").alias("effort"), months.at("c", 2).alias("march"))


def _shards(spark, sf):
    path = new_path(spark, "pairs")
    counts = b.masked_counts(spark, sf)
    sharded = counts.withColumn("shard", grid.shard_of())
    pairs = counting.with_cell(sharded).where(F.col("sci").isNotNull()).groupBy("shard", "sci", "cell").agg(months.sum_by_month("n").alias("c"))
    sinks.write_shards(sinks.pairs_for_sink(pairs), path, ["sci", "cell"])
    return path


@query("sc05_shard_union", ref.occ(f"""
SELECT shard, sci, cell, {ref.pivot('n', 'c')} FROM (SELECT *, {ref.SHARD_CASE} AS shard FROM masked WHERE sci IS NOT NULL) GROUP BY shard, sci, cell"""))
def sc05(spark, sf):
    return files.shard_table(spark, _shards(spark, sf)).select("shard", "sci", "cell", *[f"c{m:02d}" for m in range(1, 13)])


@query("u01_one_shard", ref.occ(f"""
SELECT sci, cell, CAST(sum(n) AS BIGINT) AS records FROM (SELECT *, {ref.SHARD_CASE} AS shard FROM masked WHERE sci IS NOT NULL)
WHERE shard IN ('africa', 'americas') GROUP BY sci, cell"""))
def u01(spark, sf):
    table = files.shard_table(spark, _shards(spark, sf), ["africa", "americas"])
    return table.select("sci", "cell", months.wide_total("c").alias("records"))


@query("sk01_replace_shard", ref.occ(f"""
SELECT shard, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS records FROM (
  SELECT shard, sci, cell, sum(n) AS n FROM (SELECT *, {ref.SHARD_CASE} AS shard FROM (
     SELECT CASE WHEN sci IN ('Species 3', 'Species 12') THEN NULL ELSE sci END AS sci, lat0, lng0, lat0 || '_' || lng0 AS cell,
            1 AS n, l_orderkey FROM rec) WHERE sci IS NOT NULL)
  WHERE shard <> 'oceania' AND (shard <> 'americas' OR l_orderkey % 2 = 0) GROUP BY ALL) GROUP BY shard"""))
def sk01(spark, sf):
    """One shard comes again with fewer records, one has become empty; the other shards stay as written."""
    path = _shards(spark, sf)
    hidden = F.coalesce(F.col("sci").isin(*b.SENSITIVE), F.lit(False))
    second = b.records(spark, sf).where(F.col("l_orderkey") % 2 == 0).withColumn("sci", F.when(~hidden, F.col("sci")))
    counts = counting.count_records(second).withColumn("shard", grid.shard_of())
    pairs = counting.with_cell(counts).where(F.col("sci").isNotNull() & (F.col("shard") == "americas")).groupBy("shard", "sci", "cell").agg(
        months.sum_by_month("n").alias("c")
    )
    sinks.replace_shard(sinks.pairs_for_sink(pairs), path, "americas", ["sci", "cell"])
    sinks.replace_shard(sinks.pairs_for_sink(pairs).where("shard = 'oceania'"), path, "oceania", ["sci", "cell"])
    table = files.shard_table(spark, path)
    return table.groupBy("shard").agg(F.count("*").alias("pairs"), F.sum(months.wide_total("c")).alias("records"))


@query("sk02_cell_documents", ref.by_key("""
SELECT e.cell AS id, CAST(sum(DISTINCT CASE WHEN e.month = 6 THEN e.t END) AS BIGINT) AS june, (SELECT count(*) FROM kp WHERE kp.cell = e.cell) AS species
FROM effort e GROUP BY e.cell"""))
def sk02(spark, sf):
    path = new_path(spark, "cells")
    labelled, effort = b.labelled(spark, sf)
    docs = documents.cell_documents(labelled, effort)
    band = F.floor(grid.whole_lat("id") / 30).cast("int")
    sinks.write_documents(docs.withColumn("band", band), path, "band")
    schema = "id string, total array<bigint>, species array<struct<k:string,c:array<bigint>,p:string,m:array<int>>>, band int"
    return spark.read.schema(schema).json(path).select("id", months.at("total", 5).alias("june"), F.size("species").cast("long").alias("species"))


@query("sk03_species_documents", ref.ranged("""
SELECT key AS k, cell, p, CAST(max(r) AS DOUBLE) AS peak, count(*) FILTER (WHERE r > 0) AS months FROM rl GROUP BY ALL"""))
def sk03(spark, sf):
    path = new_path(spark, "species")
    labelled, _ = b.labelled(spark, sf)
    sinks.write_documents(documents.species_documents(labelled), path, key="k")
    rows = spark.read.schema("k string, cells map<string, struct<r:array<double>,p:string>>").json(path)
    flat = rows.select("k", F.explode("cells").alias("cell", "v"))
    return flat.select("k", "cell", "v.p", F.array_max("v.r").alias("peak"), F.size(F.filter("v.r", lambda x: x > 0)).cast("long").alias("months"))


SPECIES_INDEX = ref.by_key("""
SELECT k.key AS k, coalesce(min(n.sci), k.key) AS sci, coalesce(nullif(arg_min(n.common, n.sci), ''), min(n.sci), k.key) AS name, coalesce(arg_min(n.family, n.sci), '') AS family, max(k.cells) AS cells
FROM (SELECT key, count(*) AS cells FROM kp GROUP BY key) k LEFT JOIN names n ON n.key = k.key GROUP BY k.key""")


@query("sk04_indexes", SPECIES_INDEX)
def sk04(spark, sf):
    """The species index of a published build, all its columns."""
    root = new_path(spark, "site")
    world.publish(spark, published.world_bundle(spark, sf), root)
    return world.published(spark, root, "species_index", files.INDEX_SCHEMA)


@query("sk04_cell_index", ref.occ("""
SELECT e.cell AS id, array_to_string(list(e.t ORDER BY e.month), ',') AS total, array_to_string(list(coalesce(s.n, 0) ORDER BY e.month), ',') AS richness,
  array_to_string(list(CASE WHEN e.t >= 500 THEN 'well' WHEN e.t >= 50 THEN 'some' ELSE 'limited' END ORDER BY e.month), ',') AS coverage
FROM effort e LEFT JOIN (SELECT cell, month, count(DISTINCT key) AS n FROM keyed GROUP BY cell, month) s ON s.cell = e.cell AND s.month = e.month GROUP BY e.cell"""))
def sk04_cells(spark, sf):
    root = new_path(spark, "site")
    world.publish(spark, published.world_bundle(spark, sf), root)
    index = world.published(spark, root, "cell_index", "id string, total array<bigint>, richness array<bigint>, coverage array<string>")
    return index.select("id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("total", "richness", "coverage")])


@query("sc08_species_index", SPECIES_INDEX)
def sc08(spark, sf):
    path = new_path(spark, "index")
    labelled, _ = b.labelled(spark, sf)
    sinks.write_documents(documents.species_index(labelled, b.names(spark, sf)), path, key="k")
    return files.species_index(spark, path)


# ---- text dumps --------------------------------------------------------------------------------

def _dump(spark, sf):
    """A 19-field place dump from the customers; every 13th line is short, every 17th is off the globe."""
    path = new_path(spark, "dump")
    p = b.places(spark, sf).withColumn("i", F.regexp_extract("name", r"(\d+)$", 1).cast("long"))
    blank = F.lit("")
    lat = F.when(F.col("i") % 17 == 5, F.lit("95.0")).otherwise(F.col("lat").cast("string"))
    fields = [F.col("i").cast("string"), F.col("name"), blank, blank, lat, F.col("lng").cast("string"), F.lit("P"), F.col("code"), F.col("country"),
              blank, F.col("admin_code"), blank, blank, blank, F.col("population").cast("string"), blank, blank, blank, F.lit("2024-01-01")]
    line = F.when(F.col("i") % 13 == 4, F.concat_ws("\t", *fields[:5])).otherwise(F.concat_ws("\t", *fields))
    p.select(line.alias("value")).write.text(path)
    return path


DUMP = """
d AS (SELECT *, CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) AS i FROM pl),
ok AS (SELECT * FROM d WHERE i % 13 <> 4 AND i % 17 <> 5)"""


@query("sc06_place_dump", ref.places("SELECT name, lng, lat, population, kind, country, admin_code FROM ok", DUMP))
def sc06(spark, sf):
    parsed = places.parsed_places(files.geonames_lines(spark, _dump(spark, sf)))
    return places.valid_places(parsed).select("name", "lng", "lat", "population", "kind", "country", "admin_code")


@query("sc06_place_dump_report", ref.places("SELECT (SELECT count(*) FROM ok) AS places, (SELECT count(*) FROM d) - (SELECT count(*) FROM ok) AS malformed", DUMP))
def sc06_report(spark, sf):
    return places.parse_report(places.parsed_places(files.geonames_lines(spark, _dump(spark, sf))))


def admin_dump(spark, sf):
    path = new_path(spark, "admin")
    p = b.places(spark, sf).select(F.concat_ws(".", "country", "admin_code").alias("code"), F.concat_ws(" of ", "admin_code", "country").alias("name")).distinct()
    line = F.when(F.col("code").startswith("A"), F.col("code")).otherwise(F.concat_ws("\t", "code", "name", "name", F.lit("1")))
    p.select(line.alias("value")).write.text(path)
    return path


@query("sc07_admin_codes", ref.places("""
SELECT DISTINCT country || '.' || admin_code AS code, admin_code || ' of ' || country AS name FROM pl WHERE country NOT LIKE 'A%'"""))
def sc07(spark, sf):
    return files.admin_codes(spark, admin_dump(spark, sf))


@query("sc09_entity_claims", """
SELECT 'Q' || (l_partkey + 1) AS item, 'P' || (l_linenumber % 3) AS prop,
       CASE WHEN l_tax > CAST(0.06 AS DOUBLE) THEN 'preferred' WHEN l_tax < CAST(0.01 AS DOUBLE) THEN 'deprecated' ELSE 'normal' END AS rank,
       CAST(l_suppkey AS VARCHAR) AS value, count(*) AS n
FROM lineitem GROUP BY ALL""")
def sc09(spark, sf):
    """A dump of entities with their claims by property, read back and flattened."""
    path = new_path(spark, "entities")
    stated = b.claims(spark, sf).groupBy("item", "prop").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "rank", "value"))), lambda x: F.struct(x["rank"].alias("rank"), x["value"].alias("value"))).alias("c")
    )
    entities = stated.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("prop", "c"))).alias("claims"))
    entities.select(F.col("item").alias("id"), "claims").write.json(path)
    flat = files.entity_claims(files.entity_dump(spark, path))
    return flat.groupBy("item", "prop", "rank", "value").agg(F.count("*").alias("n"))


@query("sc10_pixel_centres", ref.pixels("SELECT p_partkey, gx, gy, round(-180 + (gx + 0.5) * (CAST(360 AS DOUBLE) / 524288), 7) AS lng, round(90 - (gy + 0.5) * (CAST(180 AS DOUBLE) / 262144), 7) AS lat FROM px"))
def sc10(spark, sf):
    placed = files.pixel_centres(b.pixels(spark, sf), 524288, 262144)
    return placed.select("p_partkey", "gx", "gy", F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"))


@query("sk08_ingest_stats", ref.occ("""
SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS records, count(DISTINCT sci || '|' || cell) AS pairs, count(DISTINCT sci) AS species, count(DISTINCT cell) AS cells FROM masked"""))
def sk08(spark, sf):
    """Rows and records are counted while the table is written; the rest from the written table."""
    path = new_path(spark, "counts")
    seen = sinks.counted_write(counting.with_cell(b.masked_counts(spark, sf)), path, "ingest", rows=F.count("*"), records=F.sum("n"))
    pairs = spark.read.parquet(path).groupBy("sci", "cell").agg(F.count("*").alias("n"))
    return pairs.agg(
        F.lit(seen["rows"]).alias("rows"), F.lit(seen["records"]).alias("records"), F.count("sci").alias("pairs"),
        F.count_distinct("sci").alias("species"), F.count_distinct("cell").alias("cells"),
    )


@query("sk09_place_chunks", ref.places(f"""
SELECT CASE WHEN population >= 15000 OR kind = 0 THEN 'major' ELSE {ref.tile_x('lng', 3)} || '_' || {ref.tile_y('lat', 3)} END AS chunk, count(*) AS places, max(population) AS biggest
FROM pl GROUP BY 1"""))
def sk09(spark, sf):
    path = new_path(spark, "places")
    kinded = b.places(spark, sf).withColumn("kind", places.place_kind(F.col("code")))
    sinks.write_places(places.with_chunk(places.with_major(kinded)), path)
    schema = "name string, lng double, lat double, population bigint, kind int, major boolean, chunk string"
    return spark.read.schema(schema).json(path).groupBy("chunk").agg(F.count("*").alias("places"), F.max("population").alias("biggest"))


@query("sk11_tile_sink", ref.pixels("""
SELECT z, count(*) AS pixels, CAST(sum(cls) AS BIGINT) AS classes FROM (
  SELECT 15 AS z, p.* FROM (SELECT gx, gy, cls FROM px) p UNION ALL SELECT 14, gx, gy, cls FROM p1)
WHERE (z, gx // 8, gy // 8) IN (SELECT (15, gx // 8, gy // 8) FROM px WHERE cls > 0 UNION ALL SELECT (14, gx // 8, gy // 8) FROM p1 WHERE cls > 0)
GROUP BY z""", ref.halved("p1", "px")))
def sk11(spark, sf):
    path = new_path(spark, "tiles")
    levels = raster.pyramid(b.pixels(spark, sf), b.LEVEL, b.LEVEL - 1)
    for z in (b.LEVEL, b.LEVEL - 1):
        sinks.write_tiles(raster.on_land_tiles(levels.where(F.col("z") == z), b.TILE_PX), path)
    return spark.read.parquet(path).groupBy("z").agg(F.count("*").alias("pixels"), F.sum("cls").alias("classes"))


@query("sk12_tile_manifest", ref.pixels("""
SELECT 'detail' AS name, 14 AS first_level, 15 AS last_level, '14:' || (SELECT count(DISTINCT (gx // 8, gy // 8)) FROM p1 WHERE cls > 0) || ',15:' || (SELECT count(DISTINCT (gx // 8, gy // 8)) FROM px WHERE cls > 0) AS counts,
  'class 0-255,tree 0-100,hillshade 0-255' AS channels, '%/-' AS tree_unit_and_source, CAST(12 AS BIGINT) AS classes, 'mangrove' AS tenth, CAST(8 AS INTEGER) AS tile_px, '-180 -90 180 90' AS bounds, '14-15' AS ndvi, 'rgb' AS rgb_path,
  (SELECT string_agg('3/' || sx || '/' || sy || ' ' || lo || '-' || hi, ',' ORDER BY '3/' || sx || '/' || sy) FROM (
    SELECT sx, sy, min(z) AS lo, max(z) AS hi FROM (SELECT 15 AS z, (gx // 8) >> 12 AS sx, (gy // 8) >> 12 AS sy FROM px WHERE cls > 0 UNION ALL SELECT 14, (gx // 8) >> 11, (gy // 8) >> 11 FROM p1 WHERE cls > 0) GROUP BY sx, sy)) AS regions""", ref.halved("p1", "px")))
def sk12(spark, sf):
    path = new_path(spark, "manifest")
    levels = raster.pyramid(b.pixels(spark, sf), b.LEVEL, b.LEVEL - 1)
    x, y = F.floor(F.col("gx") / b.TILE_PX).cast("int").alias("x"), F.floor(F.col("gy") / b.TILE_PX).cast("int").alias("y")
    held = levels.where(F.col("cls") > 0).select("z", x, y).distinct()
    made = tileset.manifest(held, "detail", list(LAND), units={"tree": "%"}, tile_px=b.TILE_PX, ndvi=(14, 15), rgb="rgb", regions=3)
    sinks.write_small(made, path)
    m = spark.read.schema(made.schema).json(path)
    text = lambda c: F.array_join(F.col(c).cast("array<int>").cast("array<string>"), " ")
    each = lambda c, fn: F.array_join(F.transform(c, fn), ",")
    span = lambda v: F.concat(v["lo"].cast("int").cast("string"), F.lit("-"), v["hi"].cast("int").cast("string"))
    return m.select(
        "name", "first_level", "last_level", each("counts", lambda c: F.concat_ws(":", c["z"], c["tiles"])).alias("counts"),
        each("channels", lambda c: F.concat_ws(" ", c["name"], span(c))).alias("channels"),
        F.concat_ws("/", F.get("channels", F.lit(1))["unit"], F.coalesce(F.get("channels", F.lit(1))["source"], F.lit("-"))).alias("tree_unit_and_source"),
        F.size("classes").cast("long").alias("classes"), F.get("classes", F.lit(10))["name"].alias("tenth"), "tile_px", text("bounds").alias("bounds"),
        F.array_join(F.col("ndvi_levels").cast("array<string>"), "-").alias("ndvi"), "rgb_path",
        each("regions", lambda r: F.concat(r["shard"], F.lit(" "), r["first_level"].cast("string"), F.lit("-"), r["last_level"].cast("string"))).alias("regions"),
    )


@query("sk06_place_csv", ref.by_key(f"""
SELECT cell, taxon_key, scientific_name, common_name, presence, records_jan, records_jul, present_jan, present_dec FROM (
  SELECT cell, '' AS taxon_key, 'ALL BIRD RECORDS' AS scientific_name, '' AS common_name, '' AS presence,
    max(t) FILTER (WHERE month = 1) AS records_jan, max(t) FILTER (WHERE month = 7) AS records_jul, CAST(NULL AS INTEGER) AS present_jan, CAST(NULL AS INTEGER) AS present_dec
  FROM effort GROUP BY cell
  UNION ALL
  SELECT l.cell, l.key, coalesce(i.sci, ''), coalesce(i.name, ''), l.p, max(c) FILTER (WHERE month = 1), max(c) FILTER (WHERE month = 7),
    max(CAST(present AS INTEGER)) FILTER (WHERE month = 1), max(CAST(present AS INTEGER)) FILTER (WHERE month = 12)
  FROM kl l LEFT JOIN idx i ON i.k = l.key GROUP BY l.cell, l.key, i.sci, i.name, l.p)""", """
idx AS (SELECT k.key AS k, coalesce(min(n.sci), k.key) AS sci, coalesce(nullif(arg_min(n.common, n.sci), ''), min(n.sci), k.key) AS name
  FROM (SELECT DISTINCT key FROM kp) k LEFT JOIN names n ON n.key = k.key GROUP BY k.key)"""))
def sk06(spark, sf):
    path = new_path(spark, "place_csv")
    labelled, effort = b.labelled(spark, sf)
    rows = documents.place_csv_rows(labelled, effort, documents.species_index(labelled, b.names(spark, sf)))
    ordered = rows.repartition("cell").sortWithinPartitions("cell", "ord", F.col("records").desc(), "taxon_key").drop("ord", "records")
    sinks.write_csv(ordered, path)
    back = spark.read.option("escape", '"').schema(ordered.schema).csv(path, header=True)
    text_columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("taxon_key", "scientific_name", "common_name", "presence")]
    return back.select("cell", *text_columns, "records_jan", "records_jul", "present_jan", "present_dec")


def _of_month(name: str, month: int) -> str:
    """Rate and share of the peak of one month, the share half up in whole units."""
    u = f"max(l.u) FILTER (WHERE l.month = {month})"
    return (
        f"max(l.r) FILTER (WHERE l.month = {month}) AS rate_{name}, "
        f"CAST(({u} * 20000 + CASE WHEN max(k.peak) > 0 THEN max(k.peak) ELSE 10000 END) // (2 * CASE WHEN max(k.peak) > 0 THEN max(k.peak) ELSE 10000 END) AS DOUBLE) / 10000 AS of_peak_{name}"
    )


@query("sk07_species_csv", ref.ranged(f"""
SELECT l.key AS taxon_key, coalesce(max(i.sci), '') AS scientific_name, l.cell AS cell_id, CAST(l.lat0 AS DOUBLE) AS lat_min, CAST(l.lng0 AS DOUBLE) AS lng_min, CAST(1 AS DOUBLE) AS cell_size_deg, l.p AS presence,
  {", ".join(_of_month(name, i + 1) for i, name in enumerate(documents.MONTH_FIELDS))}
FROM rl l JOIN (SELECT key, max(u) AS peak FROM rl GROUP BY key) k ON k.key = l.key
LEFT JOIN (SELECT x.key, coalesce(min(n.sci), x.key) AS sci FROM (SELECT DISTINCT key FROM kp) x LEFT JOIN names n ON n.key = x.key GROUP BY x.key) i ON i.key = l.key
GROUP BY l.key, l.cell, l.lat0, l.lng0, l.p"""))
def sk07(spark, sf):
    """All 31 columns of the export, read back from the file."""
    path = new_path(spark, "species_csv")
    labelled, _ = b.labelled(spark, sf)
    rows = documents.species_csv_rows(labelled, documents.species_index(labelled, b.names(spark, sf)))
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query("sk05_publish_diff", ref.by_key("""
SELECT coalesce(o.cell, n.cell) AS id, CASE WHEN o.cell IS NULL THEN 'added' WHEN n.cell IS NULL THEN 'removed' WHEN o.body = n.body THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT cell, string_agg(key || ':' || c || ':' || t, ',' ORDER BY key, month) AS body FROM kl WHERE lat0 < 40 GROUP BY cell) o
FULL OUTER JOIN (SELECT cell, string_agg(key || ':' || (CASE WHEN lng0 > 100 AND month = 6 THEN c + 1 ELSE c END) || ':' || t, ',' ORDER BY key, month) AS body FROM kl WHERE lat0 >= -40 GROUP BY cell) n ON n.cell = o.cell"""))
def sk05(spark, sf):
    """Two builds that differ: cells in the south are new, those in the far north are gone, some changed."""
    labelled, effort = b.labelled(spark, sf)
    lat, lng = grid.whole_lat(), grid.whole_lng()
    old = documents.cell_documents(labelled.where(lat < 40), effort.where(lat < 40)).where(F.size("species") > 0)
    bumped = labelled.where(lat >= -40).withColumn("c", F.when(lng > 100, months.each_month("c[i] + if(i = 5, 1, 0)")).otherwise(F.col("c")))
    new = documents.cell_documents(bumped, effort.where(lat >= -40)).where(F.size("species") > 0)
    return documents.document_diff(old, new, ["id"]).select("id", "state")


@query("u06_stale_keys", ref.occ("""
SELECT DISTINCT sci FROM masked WHERE sci IS NOT NULL AND month <= 3 EXCEPT SELECT DISTINCT sci FROM masked WHERE sci IS NOT NULL AND month > 6 AND lat0 > 0"""))
def u06(spark, sf):
    """Documents of an earlier build that the new one no longer has."""
    counts = b.masked_counts(spark, sf).where(F.col("sci").isNotNull())
    old = counts.where("month <= 3").select("sci").distinct()
    new = counts.where("month > 6 and lat0 > 0").select("sci")
    return naming.still_to_do(old, new, "sci")


@query("t01_write_order", ref.occ("SELECT sci, cell, CAST(sum(n) AS BIGINT) AS records FROM masked WHERE sci IS NOT NULL GROUP BY sci, cell"))
def t01(spark, sf):
    """Rows clustered by species and sorted inside each file, without a global sort."""
    pairs, _ = b.pairs_and_effort(spark, sf)
    ordered = pairs.repartitionByRange("sci", "cell").sortWithinPartitions("sci", "cell")
    return ordered.select("sci", "cell", months.total("c").alias("records"))

