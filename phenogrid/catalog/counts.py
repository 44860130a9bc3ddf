"""Counting, pivots, effort, rates and presence labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.functions import grid, months
from phenogrid.operators import counting, documents, drill, naming, presence, quality
from phenogrid.plans import detail
from phenogrid.rules import CoverageRules, DrillRules, QualityWindow
from phenogrid.session import new_path
from phenogrid.sources import bindings as b
from phenogrid.sources import files


@query("e03_presence", ref.by_sci("SELECT sci, cell, p, records, months_present FROM sp"))
def e03(spark, sf):
    pairs, effort = b.pairs_and_effort(spark, sf)
    return presence.presence_rows(presence.label_presence(pairs, effort))


@query("a01_count_records", ref.occ("""
SELECT sci, specieskey, family, month, lat0, lng0, count(*) AS n FROM rec
WHERE class = 'Aves' AND status = 'PRESENT' AND has_coordinate AND NOT has_issue
  AND year BETWEEN 1996 AND 2000 AND month IS NOT NULL GROUP BY ALL"""))
def a01(spark, sf):
    window = QualityWindow(first_year=1996, last_year=2000)
    return counting.count_records(counting.usable_records(b.records(spark, sf), window))


@query("a02_month_pivot", ref.occ(f"""
SELECT sci, cell, min(specieskey) AS specieskey, min(family) AS family, {ref.pivot('n', 'c')}
FROM masked WHERE sci IS NOT NULL GROUP BY sci, cell"""))
def a02(spark, sf):
    rows = counting.species_months(b.masked_counts(spark, sf))
    return rows.select("sci", "cell", "specieskey", "family", *months.wide("c", "c"))


@query("a03_effort_pivot", ref.occ(f"SELECT cell, {ref.pivot('n', 't')} FROM masked GROUP BY cell"))
def a03(spark, sf):
    return counting.effort_months(b.masked_counts(spark, sf)).select("cell", *months.wide("t", "t"))


@query("a04_dense_months", f"""
WITH f AS (
  SELECT user_id % 50 AS user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 15 AS m, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, {ref.pivot('n', 'c', 'm')} FROM f GROUP BY user_id, event_type""")
def a04(spark, sf):
    events = b.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long") % 15
    facets = events.groupBy((F.col("user_id") % 50).alias("user_id"), "event_type", k.alias("m")).agg(F.count("*").alias("n"))
    entries = facets.groupBy("user_id", "event_type").agg(F.collect_list(F.struct("m", "n")).alias("e"))
    dense = entries.select("user_id", "event_type", months.dense_from_entries("e").alias("c"))
    return dense.select("user_id", "event_type", *months.wide("c", "c"))


@query("a05_merge_shards", ref.occ(f"SELECT key, cell, {ref.pivot('n', 'c')} FROM keyed GROUP BY key, cell"))
def a05(spark, sf):
    pairs, _ = b.pairs_and_effort(spark, sf)
    merged = counting.merge_pairs(naming.with_keys(pairs, b.names(spark, sf)), "key", "cell")
    return merged.select("key", "cell", *months.wide("c", "c"))


@query("a06_shard_metrics", ref.occ(f"""
SELECT {ref.SHARD_CASE} AS shard, count(*) AS rows, CAST(sum(n) AS BIGINT) AS records,
       count(DISTINCT CASE WHEN sci IS NOT NULL THEN sci || '|' || cell END) AS pairs,
       count(DISTINCT sci) AS species, count(DISTINCT cell) AS cells
FROM masked GROUP BY 1"""))
def a06(spark, sf):
    return counting.shard_metrics(b.masked_counts(spark, sf))


@query("a07_species_list", ref.occ("SELECT sci, min(specieskey) AS specieskey, min(family) AS family FROM masked WHERE sci IS NOT NULL GROUP BY sci"))
def a07(spark, sf):
    return counting.species_list(b.masked_counts(spark, sf).where(F.col("sci").isNotNull()))


@query("a19_effort_for_cells", ref.by_sci(f"""
SELECT cell, {ref.pivot('n', 't')} FROM masked
WHERE cell IN (SELECT cell FROM sp WHERE p = 'uncertain' OR p = 'resident') GROUP BY cell"""))
def a19(spark, sf):
    """Effort of the cells where some species is resident or uncertain."""
    masked = b.masked_counts(spark, sf)
    pairs, effort = b.pairs_and_effort(spark, sf)
    cells = presence.label_presence(pairs, effort).where(F.col("p").isin("uncertain", "resident"))
    return counting.effort_for_cells(masked, cells).select("cell", *months.wide("t", "t"))


@query("a19_effort_by_class", ref.occ(f"""
SELECT class, cell, {ref.pivot('n', 't')} FROM (SELECT class, lat0 || '_' || lng0 AS cell, month, count(*) AS n FROM rec GROUP BY ALL) GROUP BY class, cell"""))
def a19_class(spark, sf):
    counted = class_counts(b.records(spark, sf))
    return counting.effort_by_class(counted, counting.with_cell(counted)).select("class", "cell", *months.wide("t", "t"))


def class_counts(records):
    """Month counts that keep the class of the records."""
    south, west = grid.snap_lat(F.col("lat")).alias("lat0"), grid.snap_lng(F.col("lng")).alias("lng0")
    return records.groupBy("sci", "specieskey", "class", "month", south, west).agg(F.count("*").alias("n"))


@query("a31_drill_down", ref.occ(f"""
SELECT f.sci, f.lat0 || '_' || f.lng0 AS cell, {ref.pivot('f.n', 'c', 'f.month')}, CAST(sum(f.n) AS BIGINT) AS records
FROM (SELECT n.*, l5 AS a5, g5 AS b5 FROM named n) f
JOIN k5 ON k5.sci = f.sci AND k5.l5 = f.a5 AND k5.g5 = f.b5
GROUP BY f.sci, f.lat0, f.lng0""", """
named AS (SELECT *, floor((lat0 + 90) / 20) AS l20, floor((lng0 + 180) / 20) AS g20, floor((lat0 + 90) / 5) AS l5, floor((lng0 + 180) / 5) AS g5
  FROM masked WHERE sci IS NOT NULL),
b20 AS (SELECT sci, l20, g20, sum(n) AS n FROM named GROUP BY ALL),
k20 AS (SELECT b.* FROM b20 b JOIN (SELECT sci, sum(n) AS tot FROM b20 GROUP BY sci) t ON t.sci = b.sci WHERE b.n >= greatest(10, 0.0005 * t.tot)),
b5 AS (SELECT n.sci, n.l5, n.g5, sum(n.n) AS n FROM named n JOIN k20 k ON k.sci = n.sci AND k.l20 = n.l20 AND k.g20 = n.g20 GROUP BY ALL),
k5 AS (SELECT b.* FROM b5 b JOIN (SELECT sci, sum(n) AS tot FROM b5 GROUP BY sci) t ON t.sci = b.sci WHERE b.n >= greatest(10, 0.0005 * t.tot))"""))
def a31(spark, sf):
    cells = drill.drill_down(b.masked_counts(spark, sf), DrillRules())
    return cells.select("sci", "cell", *months.wide("c", "c"), "records")


@query("j01_counts_with_effort", ref.by_sci("SELECT sci, cell, month, c AS n, t AS effort FROM sl"))
def j01(spark, sf):
    pairs, effort = b.pairs_and_effort(spark, sf)
    joined = presence.beside_cells(pairs, effort)
    return joined.select("sci", "cell", months.month_rows(month="i + 1", n="c[i]", effort="t[i]"))


@query("e01_monthly_rates", ref.by_sci("SELECT sci, cell, month, r AS rate FROM sl"))
def e01(spark, sf):
    pairs, effort = b.pairs_and_effort(spark, sf)
    return presence.by_month(presence.label_presence(pairs, effort), "sci", "cell").select("sci", "cell", "month", "rate")


@query("e02_present_months", ref.by_sci("SELECT sci, cell, month, present FROM sl"))
def e02(spark, sf):
    pairs, effort = b.pairs_and_effort(spark, sf)
    return presence.by_month(presence.label_presence(pairs, effort), "sci", "cell").select("sci", "cell", "month", "present")


@query("e04_rounded_rates", ref.by_sci("SELECT sci, cell, month, round(r, 4) AS rate FROM sl WHERE c > 0"))
def e04(spark, sf):
    pairs, effort = b.pairs_and_effort(spark, sf)
    labelled = presence.label_presence(pairs, effort).withColumn("r", months.rounded("r"))
    return presence.by_month(labelled, "sci", "cell").where("n > 0").select("sci", "cell", "month", "rate")


@query("w03_longest_run", ref.by_sci("SELECT g.sci, g.cell, coalesce(n.run, 0) AS run FROM sg g LEFT JOIN sn n ON n.sci = g.sci AND n.cell = g.cell"))
def w03(spark, sf):
    pairs, effort = b.pairs_and_effort(spark, sf)
    return presence.label_presence(pairs, effort).select("sci", "cell", months.longest_run("m").alias("run"))


@query("a08_richness", ref.by_key("SELECT cell, month, count(*) FILTER (WHERE c > 0) AS richness FROM kl GROUP BY cell, month"))
def a08(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    rich = documents.richness(labelled)
    return rich.select("cell", months.month_rows(month="i + 1", richness="richness[i]"))


@query("a09_coverage", ref.occ("""
SELECT cell, month, CASE WHEN t >= 60 THEN 'well' WHEN t >= 35 THEN 'some' ELSE 'limited' END AS coverage FROM effort"""))
def a09(spark, sf):
    _, effort = b.pairs_and_effort(spark, sf)
    levels = effort.select("cell", months.coverage_vector("t", CoverageRules(well=60, some=35)).alias("v"))
    return levels.select("cell", months.month_rows(month="i + 1", coverage="v[i]"))


@query("e19_facet_bodies", """
SELECT user_id, count(*) AS count, CAST(sum(n) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, count(DISTINCT event_type) AS types
FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS total, 1 AS n FROM events) WHERE user_id % 7 <> 3 GROUP BY user_id""")
def e19(spark, sf):
    """Bodies as the provider sends them, with every seventh user's count missing: those are refused."""
    events = b.table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.count("*").alias("count"))
    bodies = events.groupBy("user_id").agg(
        F.to_json(F.struct(
            F.when(F.col("user_id") % 7 != 3, F.sum("count")).alias("count"),
            F.array(F.struct(F.collect_list(F.struct("name", "count")).alias("counts"))).alias("facets"),
        )).alias("body")
    )
    count, entries = files.facet_body()
    parsed = bodies.select("user_id", count.alias("count"), F.map_from_entries(entries).alias("by")).where(F.col("count").isNotNull())
    return parsed.select("user_id", "count", F.try_element_at("by", F.lit("click")).alias("clicks"), F.size("by").alias("types"))


@query("q05_vector_checks", ref.by_sci("SELECT 0 AS wrong_length, 0 AS negative, count(*) AS rows FROM sg"))
def q05(spark, sf):
    pairs, effort = b.pairs_and_effort(spark, sf)
    joined = presence.beside_cells(pairs, effort)
    checked = quality.vector_violations(joined, "c", "t")
    return _with_rows(checked, joined)


def _with_rows(report, rows):
    one = F.lit(1).alias("_one")
    return report.select("*", one).join(rows.agg(F.count("*").alias("rows")).select("*", one), "_one").drop("_one")


DETAIL = f"""
fx AS (SELECT lat0 || '_' || lng0 AS cell, month, specieskey AS key, sum(n) AS n FROM counts GROUP BY ALL),
full_cells AS (SELECT cell FROM fx GROUP BY cell HAVING count(DISTINCT month) = 12),
dsrc AS (SELECT key, cell, month, n FROM fx WHERE key IS NOT NULL AND cell IN (SELECT cell FROM full_cells)),
{ref.labels("d", "key", "dsrc").strip()},
cx AS (SELECT *, CASE WHEN sp % 2 = 0 THEN 'Aves' ELSE 'Reptilia' END || '|' || lat0 || '_' || lng0 AS place FROM rec),
wsrc AS (SELECT specieskey AS key, place AS cell, month, count(*) AS n FROM cx WHERE sci IN ('Species 1', 'Species 2', 'Species 5') GROUP BY ALL),
weffort AS (SELECT c.cell, c.lat0, c.lng0, m.month, CAST(coalesce(sum(x.n), 0) AS BIGINT) AS t FROM (SELECT DISTINCT place AS cell, lat0, lng0 FROM cx) c CROSS JOIN mon m
  LEFT JOIN (SELECT place, month, count(*) AS n FROM cx GROUP BY ALL) x ON x.place = c.cell AND x.month = m.month GROUP BY ALL),
{ref.labels("w", "key", "wsrc").strip().replace("JOIN effort e", "JOIN weffort e")},
wide AS (SELECT key, split_part(cell, '|', 2) AS cell, month, p, r FROM wl),
allrows AS (SELECT * FROM wide UNION ALL SELECT key, cell, month, p, r FROM dl WHERE (key, cell) NOT IN (SELECT key, cell FROM wide))"""


@query("x02_detail_build", ref.occ("""
SELECT key AS k, cell, p, string_agg(CAST(round(round(r, 4) * 10000) AS BIGINT), ',' ORDER BY month) AS rates, any_value(n) AS cells
FROM allrows JOIN (SELECT key, count(DISTINCT cell) AS n FROM allrows GROUP BY key) USING (key) GROUP BY key, cell, p""", DETAIL))
def x02_detail(spark, sf):
    """A region with worldwide ranges of species of two classes, which share cells and differ in their effort."""
    records = b.records(spark, sf).withColumn("class", F.when(F.col("sp") % 2 == 0, "Aves").otherwise("Reptilia"))
    counted = class_counts(records)
    path = new_path(spark, "facets")
    bodies = counting.with_cell(counted).groupBy("cell", "month", "specieskey").agg(F.sum("n").alias("n")).groupBy("cell", "month").agg(
        F.sum("n").alias("count"), F.map_from_entries(F.collect_list(F.when(F.col("specieskey").isNotNull(), F.struct("specieskey", "n")))).alias("species"),
    )
    bodies.select("cell", "count", "species", F.format_string("m%02d", F.col("month")).alias("mm")).write.partitionBy("mm").json(path)
    featured = counting.with_cell(counted.where(F.col("sci").isin(*b.FEATURED)))
    cells = featured.groupBy("sci", "cell").agg(months.sum_by_month("n").alias("c"))
    keys = featured.groupBy("sci").agg(F.min("specieskey").alias("key"))
    ranges = detail.with_own_effort(cells, counted).join(keys, "sci").withColumns({"common": F.lit(""), "family": F.lit("")})
    made = detail.build(files.facet_files(spark, path), b.names(spark, sf), ranges)
    flat = made["species"].select("k", F.explode("cells").alias("cell", "v"))
    rates = F.array_join(F.transform("v.r", lambda r: F.round(r * 10000).cast("long").cast("string")), ",")
    return flat.select("k", "cell", "v.p", rates.alias("rates")).join(made["species_index"].select(F.col("key").alias("k"), "cells"), "k")
