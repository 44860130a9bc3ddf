"""Documents, indexes, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.functions import grid, months, text
from phenogrid.operators import counting, documents
from phenogrid.plans import world
from phenogrid.rules import SHARDS
from phenogrid.session import new_path
from phenogrid.sources import bindings as b


@query("a10_species_index", ref.by_key("""
SELECT k.key AS k, coalesce(min(n.sci), k.key) AS sci, coalesce(nullif(arg_min(n.common, n.sci), ''), min(n.sci), k.key) AS name, coalesce(arg_min(n.family, n.sci), '') AS family, max(k.cells) AS cells
FROM (SELECT key, count(*) AS cells FROM kp GROUP BY key) k LEFT JOIN names n ON n.key = k.key GROUP BY k.key"""))
def a10(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return documents.species_index(labelled, b.names(spark, sf))


CELL_DOCUMENTS = ref.by_key("""
SELECT e.cell AS id, array_to_string(list(e.t ORDER BY e.month), ',') AS total, coalesce(max(d.species), '[]') AS species
FROM effort e LEFT JOIN (
  SELECT cell, CAST(to_json(list({'k': key, 'c': c, 'p': p, 'm': m} ORDER BY key)) AS VARCHAR) AS species FROM (
    SELECT cell, key, p, list(c ORDER BY month) AS c, list(CAST(present AS INTEGER) ORDER BY month) AS m FROM kl GROUP BY cell, key, p) GROUP BY cell) d ON d.cell = e.cell
GROUP BY e.cell""")


@query("a11_cell_documents", CELL_DOCUMENTS)
def a11(spark, sf):
    labelled, effort = b.labelled(spark, sf)
    docs = documents.cell_documents(labelled, effort)
    return docs.select("id", F.array_join(F.col("total").cast("array<string>"), ",").alias("total"), F.to_json("species").alias("species"))


SPECIES_DOCUMENTS = ref.ranged("""
SELECT key AS k, string_agg(cell || ':' || p || ':' || u, ';' ORDER BY cell) AS cells FROM (
  SELECT key, cell, p, string_agg(CAST(u AS VARCHAR), ',' ORDER BY month) AS u FROM rl GROUP BY key, cell, p) GROUP BY key""")


def flat_species(docs):
    flat = F.transform(F.array_sort(F.map_entries("cells")), lambda e: F.concat_ws(
        ":", e["key"], e["value"]["p"], F.array_join(F.transform(e["value"]["r"], lambda r: F.round(r * 10000).cast("long").cast("string")), ",")
    ))
    return docs.select("k", F.array_join(flat, ";").alias("cells"))


@query("a12_species_documents", SPECIES_DOCUMENTS)
def a12(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return flat_species(documents.species_documents(labelled))


@query("a33_coverage_manifest", ref.occ(f"""
SELECT CAST(s.ord AS INTEGER) AS ord, s.id, s.name, s.boxes, CASE WHEN m.records IS NULL THEN 'pending' ELSE 'loaded' END AS status, m.records, m.cells, m.species,
  CASE WHEN m.records IS NOT NULL THEN '2026-01-0' || (s.ord + 1) END AS built, CASE WHEN m.records IS NOT NULL AND s.ord % 2 = 0 THEN '10.0/' || s.id END AS doi
FROM (VALUES (0, 'south-asia', 'South Asia', '0 40 60 100'), (1, 'africa', 'Africa and Arabia', '-90 38 -30 60'), (2, 'europe', 'Europe and the Middle East', '38 90 -30 60'), (3, 'east-asia', 'East, Southeast and North Asia', '0 90 100 180;40 90 60 100'), (4, 'americas', 'The Americas', '-90 90 -180 -30'), (5, 'oceania', 'Oceania and the southern oceans', '-90 0 60 180')) s(ord, id, name, boxes)
LEFT JOIN (SELECT {ref.SHARD_CASE} AS shard, CAST(sum(n) AS BIGINT) AS records, count(DISTINCT cell) AS cells, count(DISTINCT sci) AS species FROM masked GROUP BY 1) m ON m.shard = s.id"""))
def a33(spark, sf):
    """The DOI and time of ingest come with the shards' own metadata."""
    metrics = counting.shard_metrics(b.masked_counts(spark, sf))
    order = F.array_position(F.array(*[F.lit(s) for s, _, _ in SHARDS]), F.col("shard"))
    manifest = documents.coverage_manifest(metrics.withColumns({
        "built": F.concat(F.lit("2026-01-0"), order.cast("string")), "doi": F.when(order % 2 == 1, F.concat(F.lit("10.0/"), "shard")),
    }))
    boxes = F.array_join(F.transform("boxes", lambda x: F.array_join(F.transform(x, lambda v: v.cast("int").cast("string")), " ")), ";")
    return manifest.withColumn("boxes", boxes)


@query("a35_coverage_note", ref.occ(f"""
SELECT pending = 0 AS complete, loaded, pending, CASE WHEN pending = 0 THEN 'No bird records in this grid square yet.' WHEN n = 0 THEN 'Species lists are still loading region by region.' ELSE
  'Species lists cover ' || CASE WHEN n = 1 THEN names[1] ELSE array_to_string(names[1:n - 1], ', ') || ' and ' || names[n] END || ' for now; ' || pending ||
  CASE WHEN pending = 1 THEN ' more region is' ELSE ' more regions are' END || ' on the way. Elsewhere the globe shows the ranges of species recorded there.' END AS note
FROM (SELECT 6 - count(*) AS pending, count(*) AS n, string_agg(s.name, ', ' ORDER BY s.ord) AS loaded, list(s.name ORDER BY s.ord) AS names
  FROM (VALUES (0, 'south-asia', 'South Asia'), (1, 'africa', 'Africa and Arabia'), (2, 'europe', 'Europe and the Middle East'), (3, 'east-asia', 'East, Southeast and North Asia'), (4, 'americas', 'The Americas'), (5, 'oceania', 'Oceania and the southern oceans')) s(ord, id, name)
  WHERE s.id IN (SELECT DISTINCT {ref.SHARD_CASE} FROM masked))"""))
def a35(spark, sf):
    return documents.coverage_state(documents.coverage_manifest(counting.shard_metrics(b.masked_counts(spark, sf))))


INDEX_BODIES = """
ix AS (SELECT k.key AS k, coalesce(min(n.sci), k.key) AS sci, coalesce(nullif(arg_min(n.common, n.sci), ''), min(n.sci), k.key) AS name, coalesce(arg_min(n.family, n.sci), '') AS family, max(k.cells) AS cells
  FROM (SELECT key, count(*) AS cells FROM kp GROUP BY key) k LEFT JOIN names n ON n.key = k.key GROUP BY k.key),
sb AS (SELECT strlen('{"k":"' || k || '","sci":"' || sci || '","name":"' || name || '","family":"' || family || '","cells":' || cells || '}') AS bytes FROM ix)"""


@query("a34_build_summary", ref.by_key(f"""
SELECT (SELECT count(DISTINCT {ref.SHARD_CASE}) FROM masked) AS regions, (SELECT count(*) FROM cells) AS cells, count(DISTINCT key) AS species, count(*) AS species_cells,
  2 * ((SELECT count(*) FROM cells) + count(DISTINCT key)) AS changed, CAST(0 AS BIGINT) AS removed,
  (SELECT CAST(sum(bytes) AS BIGINT) FROM sb) + (SELECT CAST(sum(strlen('{{"id":"' || id || '","total":[' || total || '],"species":' || species || '}}')) AS BIGINT) FROM ({CELL_DOCUMENTS[CELL_DOCUMENTS.index('SELECT e.cell AS id'):]})) AS bytes
FROM kp""", INDEX_BODIES))
def a34(spark, sf):
    """What a first publish wrote: every cell and species, as a document and as an index entry. Bytes are those of the cell
    documents and the species index, whose JSON has no fractions."""
    bundle = world_bundle(spark, sf)
    changes = world.publish(spark, bundle, new_path(spark, "site"))
    counted = F.when(F.col("kind").isin("cells", "species_index"), F.col("bytes"))
    return documents.build_summary(bundle.labelled, bundle.effort, bundle.manifest, changes.withColumn("bytes", counted))


def shard_rows(spark, sf):
    """(pairs, effort) of all shards, as the shard tables hold them. The records are read once: both come from stored counts."""
    counted, path = b.masked_counts(spark, sf), new_path(spark, "counts")
    counted.write.parquet(path)
    counts = counting.with_cell(spark.read.schema(counted.schema).parquet(path)).withColumn("shard", grid.shard_of())
    pairs = counts.where(F.col("sci").isNotNull()).groupBy("shard", "sci", "cell").agg(
        F.min("specieskey").alias("specieskey"), F.min("family").alias("family"), months.sum_by_month("n").alias("c")
    )
    return pairs, counts.groupBy("shard", "cell").agg(months.sum_by_month("n").alias("t"))


def world_bundle(spark, sf, change=lambda pairs, effort: (pairs, effort), rows=None):
    """A build of all shards after a change; ``rows`` are those of ``shard_rows`` where several builds share them."""
    pairs, effort = change(*(shard_rows(spark, sf) if rows is None else rows))
    return world.world_build(pairs, effort, b.names(spark, sf), b.sensitive(spark, sf), store=new_path(spark, "store"))


CELL_BODY = "id string, total array<bigint>, species array<struct<k:string,c:array<bigint>,p:string,m:array<int>>>"


@query("x02_world_build", CELL_DOCUMENTS)
def x02_world_build(spark, sf):
    """The whole job: shards merged, named, labelled, written as documents, and read back."""
    root = new_path(spark, "site")
    world.publish(spark, world_bundle(spark, sf), root)
    docs = world.published(spark, root, "cells", CELL_BODY)
    return docs.select("id", F.array_join(F.col("total").cast("array<string>"), ",").alias("total"), F.to_json("species").alias("species"))


@query("x02_published_species", SPECIES_DOCUMENTS)
def x02_published_species(spark, sf):
    root = new_path(spark, "site")
    world.publish(spark, world_bundle(spark, sf), root)
    return flat_species(world.published(spark, root, "species", "k string, cells map<string, struct<r:array<double>,p:string>>"))


@query("x02_meta", ref.occ(f"""
SELECT 'occurrence records' AS source, 'month' AS resolution, CASE WHEN count(*) = 6 THEN 'worldwide' ELSE string_agg(s.name, ', ' ORDER BY s.ord) END AS coverage,
  coalesce(string_agg(s.id || ' 10.0/' || s.id, ',' ORDER BY s.ord) FILTER (WHERE s.ord % 2 = 0), '') AS datasets
FROM (VALUES (0, 'south-asia', 'South Asia'), (1, 'africa', 'Africa and Arabia'), (2, 'europe', 'Europe and the Middle East'), (3, 'east-asia', 'East, Southeast and North Asia'), (4, 'americas', 'The Americas'), (5, 'oceania', 'Oceania and the southern oceans')) s(ord, id, name)
WHERE s.id IN (SELECT DISTINCT {ref.SHARD_CASE} FROM masked)"""))
def x02_meta(spark, sf):
    """The published row: what it covers, and the datasets of the loaded regions that name one, in publishing order."""
    pairs, effort = shard_rows(spark, sf)
    order = F.array_position(F.array(*[F.lit(s) for s, _, _ in SHARDS]), F.col("shard"))
    ingested = effort.select("shard").distinct().select("shard", F.lit("2026-01-01").alias("built"), F.when(order % 2 == 1, F.concat(F.lit("10.0/"), "shard")).alias("doi"))
    root = new_path(spark, "site")
    world.publish(spark, world.world_build(pairs, effort, b.names(spark, sf), b.sensitive(spark, sf), store=new_path(spark, "store"), ingested=ingested), root)
    meta = world.published(spark, root, "meta", "source string, resolution string, coverage string, datasets array<struct<region:string,doi:string>>")
    return meta.select("source", "resolution", "coverage", F.array_join(F.transform("datasets", lambda d: F.concat_ws(" ", d["region"], d["doi"])), ",").alias("datasets"))


def two_builds():
    """Changes to (pairs, effort) of two builds: the south is new in the second, the far north gone, and some is changed."""
    lat, lng = grid.whole_lat(), grid.whole_lng()
    more = F.when(lng > 100, months.each_month("c[i] + if(i = 5, 1, 0)")).otherwise(F.col("c"))
    return (
        lambda pairs, effort: (pairs.where(lat < 40), effort.where(lat < 40)),
        lambda pairs, effort: (pairs.where(lat >= -40).withColumn("c", more), effort.where(lat >= -40)),
    )


@query("x02_publish_in_place", ref.by_key("""
SELECT coalesce(o.cell, n.cell) AS id, CASE WHEN o.cell IS NULL THEN 'added' WHEN n.cell IS NULL THEN 'removed' WHEN o.body = n.body THEN 'unchanged' ELSE 'changed' END AS state, n.species
FROM (SELECT e.cell, coalesce(max(x.body), '') AS body FROM cells e LEFT JOIN (SELECT cell, string_agg(key || ':' || c, ',' ORDER BY key, month) AS body FROM kl GROUP BY cell) x ON x.cell = e.cell WHERE e.lat0 < 40 GROUP BY e.cell) o
FULL OUTER JOIN (SELECT e.cell, coalesce(max(x.body), '') AS body, coalesce(max(x.species), 0) AS species FROM cells e LEFT JOIN (SELECT cell, string_agg(key || ':' || (CASE WHEN lng0 > 100 AND month = 6 THEN c + 1 ELSE c END), ',' ORDER BY key, month) AS body, count(DISTINCT key) AS species FROM kl GROUP BY cell) x ON x.cell = e.cell WHERE e.lat0 >= -40 GROUP BY e.cell) n ON n.cell = o.cell"""))
def x02_publish_in_place(spark, sf):
    """A rebuild over its own predecessor: some cells new, some gone, some changed; the site then holds the new build."""
    root, rows = new_path(spark, "site"), shard_rows(spark, sf)
    for change in two_builds():
        changes = world.publish(spark, world_bundle(spark, sf, change, rows), root)
    held = world.published(spark, root, "cells", CELL_BODY).select("id", F.size("species").cast("long").alias("species"))
    return changes.where("kind = 'cells'").select("id", "state").join(held, "id", "full_outer")


@query("sk05_publish_counts", ref.occ("""
SELECT count(*) FILTER (WHERE o IS NOT NULL AND n IS NOT NULL AND o = n) AS unchanged, count(*) FILTER (WHERE o <> n) AS changed,
  count(*) FILTER (WHERE o IS NULL) AS added, count(*) FILTER (WHERE n IS NULL) AS removed
FROM (SELECT cell, sum(n) FILTER (WHERE month <= 9 AND lat0 < 45) AS o, sum(n) FILTER (WHERE month <= 9 AND lat0 >= -45 OR lat0 BETWEEN -45 AND 0) AS n
  FROM masked GROUP BY cell) WHERE o IS NOT NULL OR n IS NOT NULL"""))
def sk05_counts(spark, sf):
    counts = counting.with_cell(b.masked_counts(spark, sf))
    old = counts.where("month <= 9 and lat0 < 45").groupBy("cell").agg(F.sum("n").alias("records"))
    new = counts.where("month <= 9 and lat0 >= -45 or lat0 between -45 and 0").groupBy("cell").agg(F.sum("n").alias("records"))
    return documents.publish_counts(documents.document_diff(old, new, ["cell"]))


@query("w01_dense_ids", ref.occ("SELECT cell, CAST(row_number() OVER (ORDER BY cell) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT cell FROM masked)"))
def w01(spark, sf):
    return documents.dense_ids(counting.with_cell(b.masked_counts(spark, sf)), "cell")


@query("cell_index", ref.by_key("""
SELECT e.cell AS id, array_to_string(list(e.t ORDER BY e.month), ',') AS total, array_to_string(list(coalesce(r.n, 0) ORDER BY e.month), ',') AS richness,
  array_to_string(list(CASE WHEN e.t >= 500 THEN 'well' WHEN e.t >= 50 THEN 'some' ELSE 'limited' END ORDER BY e.month), ',') AS coverage
FROM effort e LEFT JOIN (SELECT cell, month, count(*) FILTER (WHERE c > 0) AS n FROM kl GROUP BY ALL) r ON r.cell = e.cell AND r.month = e.month GROUP BY e.cell"""))
def cell_index(spark, sf):
    labelled, effort = b.labelled(spark, sf)
    index = documents.cell_index(labelled, effort)
    return index.select("id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("total", "richness", "coverage")])


@query("t06_species_by_records", ref.by_key("SELECT cell, key, records, CAST(row_number() OVER (PARTITION BY cell ORDER BY records DESC, key) AS INTEGER) AS pos FROM kp"))
def t06(spark, sf):
    """Species of each cell by yearly records; a cell lists each taxon once, which bounds the group."""
    labelled, _ = b.labelled(spark, sf)
    rows = labelled.select("cell", "key", months.total("c").alias("records"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("cell").orderBy(F.col("records").desc(), "key")))


@query("e20_csv_fields", """
SELECT doc_id, CASE WHEN regexp_matches(s, '[",\\n\\r]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS field
FROM (SELECT doc_id, CASE WHEN left(t, 1) IN ('=', '+', '-', '@') THEN '''' || t ELSE t END AS s FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '=' || text ELSE text END AS t FROM documents))""")
def e20(spark, sf):
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("="), "text")).otherwise(F.col("text"))
    return b.table(spark, sf, "documents").select("doc_id", text.csv_field(raw).alias("field"))


@query("e27_citations", ref.occ("""
SELECT sci, 'Occurrence almanac (2024). ' || sci || '. Built from ' || count(*) || ' records, ' || min(year) || '–' || max(year) || '; data generated 2024-01-31 (accessed 2024-02-01).' AS citation
FROM rec WHERE sci IS NOT NULL GROUP BY sci"""))
def e27(spark, sf):
    per_species = b.records(spark, sf).where(F.col("sci").isNotNull()).groupBy("sci").agg(
        F.count("*").alias("n"), F.min("year").alias("y0"), F.max("year").alias("y1")
    )
    source = F.concat(F.col("n").cast("string"), F.lit(" records"))
    years = F.concat_ws("–", F.col("y0").cast("string"), F.col("y1").cast("string"))
    return per_species.select("sci", text.citation("Occurrence almanac", F.col("sci"), source, years, "2024-01-31", "2024-02-01").alias("citation"))
