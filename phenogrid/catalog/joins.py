"""Name resolution, overrides and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.functions import grid, months
from phenogrid.operators import counting, documents, naming, presence, profiles
from phenogrid.sources import bindings as b


@query("j02_key_by_name", ref.occ("""
SELECT coalesce(nm.key, x.sci) AS key, x.sci, x.cell, CAST(sum(x.n) AS BIGINT) AS records
FROM masked x LEFT JOIN names nm ON nm.sci = x.sci WHERE x.sci IS NOT NULL GROUP BY ALL"""))
def j02(spark, sf):
    pairs, _ = b.pairs_and_effort(spark, sf)
    return naming.with_keys(pairs, b.names(spark, sf)).select("key", "sci", "cell", months.total("c").alias("records"))


@query("j03_drop_sensitive", ref.occ("""
SELECT sci, cell, CAST(sum(n) AS BIGINT) AS records FROM (SELECT sci, lat0 || '_' || lng0 AS cell, n FROM counts)
WHERE sci IS NOT NULL AND sci NOT IN ('Species 3', 'Species 12') GROUP BY ALL"""))
def j03(spark, sf):
    pairs = counting.species_months(b.month_counts(spark, sf))
    return naming.drop_sensitive(pairs, b.sensitive(spark, sf)).select("sci", "cell", months.total("c").alias("records"))


@query("j04_cells_without_species", ref.by_key("""
SELECT e.cell, CAST(sum(e.t) AS BIGINT) AS records, coalesce(max(k.n), 0) AS species
FROM effort e LEFT JOIN (SELECT cell, count(*) AS n FROM kp GROUP BY cell) k ON k.cell = e.cell GROUP BY e.cell"""))
def j04(spark, sf):
    """Cells whose species are all unnamed still get a document, with an empty list."""
    labelled, effort = b.labelled(spark, sf)
    docs = documents.cell_documents(labelled, effort)
    return docs.select(F.col("id").alias("cell"), months.total("total").alias("records"), F.size("species").cast("long").alias("species"))


def _name_sources(spark, sf):
    """Cache, checklist and match results, each knowing some of the species."""
    known = b.names(spark, sf).withColumn("number", F.regexp_extract("sci", r"(\d+)", 1).cast("int"))
    number, columns = F.col("number"), ("sci", "key", "common", "family")
    cache = known.where(number % 3 == 0).select("sci", F.concat(F.lit("c"), "key").alias("key"), "common", "family")
    checklist = known.where(number % 2 == 0).select("sci", F.concat(F.lit("l"), "key").alias("key"), "common", F.lit("").alias("family"))
    match = known.where(number > 20).select(*columns)
    return cache, checklist, match


SOURCES = """
kn AS (SELECT *, CAST(regexp_extract(sci, '([0-9]+)', 1) AS INTEGER) AS number FROM names),
src AS (
  SELECT 0 AS ord, sci, 'c' || key AS key, common, family FROM kn WHERE number % 3 = 0
  UNION ALL SELECT 1, sci, 'l' || key, common, '' FROM kn WHERE number % 2 = 0
  UNION ALL SELECT 2, sci, key, common, family FROM kn WHERE number > 20),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sci ORDER BY ord) AS rn FROM src) WHERE rn = 1),
wanted AS (SELECT sci, min(specieskey) AS specieskey, min(family) AS family FROM masked WHERE sci IS NOT NULL GROUP BY sci)"""


@query("j05_resolve_names", ref.occ("""
SELECT w.sci, coalesce(b.key, nullif(w.specieskey, ''), w.sci) AS key, coalesce(b.common, '') AS common,
  coalesce(nullif(b.family, ''), w.family, '') AS family, b.key IS NULL AS unmatched
FROM wanted w LEFT JOIN best b ON b.sci = w.sci""", SOURCES))
def j05(spark, sf):
    wanted = counting.species_list(b.masked_counts(spark, sf).where(F.col("sci").isNotNull()))
    return naming.resolve_names(wanted, *_name_sources(spark, sf))


@query("u04_first_source_wins", ref.occ("SELECT sci, key, common, family FROM best", SOURCES))
def u04(spark, sf):
    return naming.first_wins(list(_name_sources(spark, sf)), "sci")


def _detail_and_ranges(spark, sf):
    """Detail: cells of the northern half. Ranges: whatever moves, everywhere, with doubled effort."""
    labelled, effort = b.labelled(spark, sf)
    north = labelled.where(grid.whole_lat() >= 0)
    doubled = effort.select("cell", months.each_month("t[i] * 2").alias("t"))
    wide = labelled.where(F.col("p").isin("seasonal", "passage")).select("key", "cell", "c")
    return north, presence.label_presence(wide, doubled)


@query("j06_ranges_override_detail", ref.by_key("""
SELECT key, cell, round(max(r) FILTER (WHERE month = 2) / 2, 4) AS feb, 'range' AS origin FROM kl WHERE p IN ('seasonal', 'passage') GROUP BY key, cell
UNION ALL SELECT key, cell, round(max(r) FILTER (WHERE month = 2), 4), 'detail' FROM kl WHERE lat0 >= 0 AND p NOT IN ('seasonal', 'passage') GROUP BY key, cell"""))
def j06(spark, sf):
    detail, ranges = _detail_and_ranges(spark, sf)
    columns = ["key", "cell", F.round(months.at("r", 1), 4).alias("feb")]
    return naming.override_ranges(detail.select(*columns, F.lit("detail").alias("origin")), ranges.select(*columns, F.lit("range").alias("origin")))


@query("j07_default_names", ref.by_key("""
SELECT k.key, k.cells, coalesce(nullif(CASE WHEN n.key IS NOT NULL THEN n.sci ELSE r.sci END, ''), k.key) AS sci,
  coalesce(nullif(CASE WHEN n.key IS NOT NULL THEN n.common ELSE r.common END, ''), nullif(CASE WHEN n.key IS NOT NULL THEN n.sci ELSE r.sci END, ''), k.key) AS name,
  coalesce(CASE WHEN n.key IS NOT NULL THEN n.family ELSE r.family END, '') AS family
FROM (SELECT key, count(*) AS cells FROM kp GROUP BY key) k
LEFT JOIN (SELECT key, min(sci) AS sci, arg_min(common, sci) AS common, arg_min(family, sci) AS family FROM names WHERE key < '1020' GROUP BY key) n ON n.key = k.key
LEFT JOIN (SELECT key, 'Range ' || key AS sci, '' AS common, 'F' AS family FROM (SELECT DISTINCT key FROM kp WHERE key LIKE '10%2')) r ON r.key = k.key"""))
def j07(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    species = labelled.groupBy("key").agg(F.count("*").alias("cells"))
    known = b.names(spark, sf).where(F.col("key") < "1020").groupBy("key").agg(
        F.min("sci").alias("sci"), F.min_by("common", "sci").alias("common"), F.min_by("family", "sci").alias("family")
    )
    brought = species.where(F.col("key").like("10%2")).select("key", F.concat(F.lit("Range "), "key").alias("sci"), F.lit("").alias("common"), F.lit("F").alias("family"))
    return naming.default_names(species, known, brought)


@query("j10_names_of_cell_lists", ref.by_key("""
SELECT p.cell, p.key, coalesce(min(n.sci), p.key) AS sci, coalesce(nullif(arg_min(n.common, n.sci), ''), min(n.sci), p.key) AS name
FROM kp p LEFT JOIN names n ON n.key = p.key GROUP BY p.cell, p.key"""))
def j10(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    index = documents.species_index(labelled, b.names(spark, sf)).select(F.col("k").alias("key"), "sci", "name")
    return labelled.select("cell", "key").join(index, "key", "left").select("cell", "key", "sci", "name")


FEATURED = "('Species 1'), ('Species 2'), ('Species 5'), ('Species 41'), ('Species 43')"


@query("u02_add_featured", ref.occ(f"""
SELECT DISTINCT sci FROM masked WHERE sci IS NOT NULL UNION SELECT v.sci FROM (VALUES {FEATURED}) v(sci)"""))
def u02(spark, sf):
    listed = b.masked_counts(spark, sf).where(F.col("sci").isNotNull()).select("sci").distinct()
    featured = spark.createDataFrame([(s,) for s in b.FEATURED], "sci string")
    return naming.add_missing(listed, featured)


@query("u03_remaining_work", ref.occ("""
SELECT DISTINCT sci, cell FROM masked WHERE sci IS NOT NULL EXCEPT SELECT DISTINCT sci, cell FROM masked WHERE month <= 2"""))
def u03(spark, sf):
    counts = counting.with_cell(b.masked_counts(spark, sf)).where(F.col("sci").isNotNull())
    planned = counts.select("sci", "cell").distinct()
    return naming.still_to_do(planned, counts.where("month <= 2"), "sci", "cell")


@query("u05_other_names", """
WITH al AS (SELECT 'Q' || (p_partkey // 12) AS item, p_partkey AS pos, trim(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || ' ' END) AS alias FROM part),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, lower(alias) ORDER BY pos) AS rn FROM al) WHERE rn = 1 AND alias <> ''),
k AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT 'Q' || (p_partkey // 12) AS item, p_name AS name FROM part WHERE p_size = 7) e WHERE e.item = f.item AND lower(e.name) = lower(f.alias)))
SELECT item, CAST(place AS INTEGER) AS place, alias FROM (SELECT item, alias, row_number() OVER (PARTITION BY item ORDER BY pos) AS place FROM k) WHERE place <= 8""")
def u05(spark, sf):
    part = b.table(spark, sf, "part").withColumn("item", F.concat(F.lit("Q"), F.floor(F.col("p_partkey") / 12).cast("long").cast("string")))
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    excluded = part.where("p_size = 7").select("item", F.col("p_name").alias("name")).distinct()
    return profiles.other_names(part.select("item", F.col("p_partkey").alias("pos"), spelled.alias("alias")), excluded)


@query("e18_name_records", """
SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN 'A' || c_custkey END, ''), nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'S' || c_custkey END, ''), 'K' || c_custkey) AS key,
  coalesce(nullif(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END, ''), 'Full ' || c_name) AS sci, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS common, '' AS family, 'O' AS "order" FROM customer""")
def e18(spark, sf):
    key, name = F.col("c_custkey"), F.col("c_name")
    label = key.cast("string")
    raw = b.table(spark, sf, "customer").select(
        "c_custkey", F.when(key % 4 == 0, F.concat(F.lit("A"), label)).alias("acceptedKey"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("S"), label)).alias("speciesKey"), F.concat(F.lit("K"), label).alias("key"), F.lit("U").alias("usageKey"),
        F.when(key % 5 == 0, "").otherwise(name).alias("canonicalName"), F.concat(F.lit("Full "), name).alias("scientificName"),
        F.lit("").alias("common"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("english"), F.lit(None).cast("string").alias("vernacularName"),
        F.lit("").alias("family"), F.lit("O").alias("order"),
    )
    return naming.name_records(raw, "c_custkey")


@query("e17_english_names", """
SELECT user_id, coalesce(arg_min(name, event_id) FILTER (WHERE lang IN ('eng', 'en') AND name <> ''), '') AS name
FROM (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'eng' WHEN 'view' THEN 'fra' WHEN 'error' THEN 'en' ELSE 'deu' END AS lang, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'N' || event_id END AS name FROM events) GROUP BY user_id""")
def e17(spark, sf):
    """The first English name among a user's events."""
    kind = F.col("event_type")
    language = F.when(kind == "click", "eng").when(kind == "view", "fra").when(kind == "error", "en").otherwise("deu")
    name = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("N"), F.col("event_id").cast("string")))
    named = b.table(spark, sf, "events").select("user_id", "event_id", name.alias("name"), language.alias("language"))
    return naming.english_names(named, "user_id", "event_id")
