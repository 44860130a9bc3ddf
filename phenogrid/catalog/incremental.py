"""Stores under versions: sites that follow their shards, publishing by document, one version of pairs and effort (A5, SK1-SK5, ST1, X2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import published
from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.functions import grid, months
from phenogrid.operators import counting, presence
from phenogrid.plans import live, world
from phenogrid.rules import SHARDS
from phenogrid.session import new_path
from phenogrid.sources import bindings as b
from phenogrid.sources import shard_store, snapshots
from phenogrid.streaming import shard_drops

#: The second version of the European shard: every other order.
LATER = "l_orderkey % 2 = 0"
EARLIER_ROWS = "FROM rec GROUP BY ALL"


def only(body: str, condition: str, *more: str) -> str:
    """SQL over species by key, from the records that meet a condition."""
    return ref.sql(body, ref.RECORDS.replace(EARLIER_ROWS, f"FROM rec WHERE {condition} GROUP BY ALL"), ref.BY_KEY, *more)


REPLACED = f"({ref.SHARD_CASE}) <> 'europe' OR {LATER}"


def gridded(spark, sf, records):
    counts = counting.with_cell(counting.mask_sensitive(counting.count_records(records), b.SENSITIVE)).withColumn("shard", grid.shard_of())
    return counts.groupBy("shard", "sci", "cell").agg(F.min("specieskey").alias("specieskey"), F.min("family").alias("family"), months.sum_by_month("n").alias("c"))


def settings(spark, sf):
    return live.Settings(b.names(spark, sf), b.sensitive(spark, sf))


def refreshed_site(spark, sf):
    """A site built from all shards, then one shard replaced and the site refreshed: (site, states of the refresh)."""
    tables, site = new_path(spark, "tables"), new_path(spark, "site")
    records = b.records(spark, sf)
    shard_store.replace(spark, tables, gridded(spark, sf, records), [s for s, _, _ in SHARDS])
    live.build(spark, tables, site, settings(spark, sf))
    shard_store.replace(spark, tables, gridded(spark, sf, records.where(LATER)).where("shard = 'europe'"), ["europe"])
    return site, live.refresh(spark, tables, site, settings(spark, sf))


@query("x02_incremental_cells", f"""
SELECT coalesce(n.id, o.cell) AS id, CASE WHEN n.id IS NULL THEN 'removed' WHEN o.later < o.records THEN 'changed' ELSE 'untouched' END AS state, n.total, n.species
FROM (SELECT lat0 || '_' || lng0 AS cell, count(*) AS records, count(*) FILTER (WHERE {REPLACED}) AS later FROM ({ref.sql('SELECT * FROM rec', ref.RECORDS)}) GROUP BY lat0, lng0) o
LEFT JOIN ({only(published.CELL_DOCUMENTS[published.CELL_DOCUMENTS.index('SELECT e.cell AS id'):], REPLACED)}) n ON n.id = o.cell""")
def x02_incremental_cells(spark, sf):
    """Every cell document after one shard was replaced, and what the refresh did with it."""
    site, states = refreshed_site(spark, sf)
    docs = world.published(spark, site, "cells", published.CELL_BODY)
    flat = docs.select("id", F.array_join(F.col("total").cast("array<string>"), ",").alias("total"), F.to_json("species").alias("species"))
    touched = states.where("kind = 'cells'").select("id", "state")
    return touched.join(flat, "id", "full_outer").select("id", F.coalesce("state", F.lit("untouched")).alias("state"), "total", "species")


@query("x02_incremental_species", only(published.SPECIES_DOCUMENTS[published.SPECIES_DOCUMENTS.index("SELECT key AS k"):], REPLACED, ref.RANGED))
def x02_incremental_species(spark, sf):
    """Every species document after one shard was replaced."""
    site, _ = refreshed_site(spark, sf)
    return published.flat_species(world.published(spark, site, "species", "k string, cells map<string, struct<r:array<double>,p:string>>"))


@query("x02_incremental_index", only("""
SELECT k.key AS k, coalesce(min(n.sci), k.key) AS sci, coalesce(nullif(arg_min(n.common, n.sci), ''), min(n.sci), k.key) AS name, coalesce(arg_min(n.family, n.sci), '') AS family, max(k.cells) AS cells
FROM (SELECT key, count(*) AS cells FROM kp GROUP BY key) k LEFT JOIN names n ON n.key = k.key GROUP BY k.key""", REPLACED))
def x02_incremental_index(spark, sf):
    """The species index after one shard was replaced, read after its layers were merged."""
    site, _ = refreshed_site(spark, sf)
    now = snapshots.latest(spark, site)
    snapshots.compact(spark, site, {"species": (["k"], world.SETS["species"].schema)}, now.notes["buckets"])
    return world.published(spark, site, "species_index", "k string, sci string, name string, family string, cells bigint")


@query("sk05_change_layer", ref.by_key("""
SELECT coalesce(o.cell, n.cell) AS id, n.cell IS NULL AS gone, CAST(1 AS INTEGER) AS layer
FROM (SELECT e.cell, coalesce(max(x.body), '') AS body FROM cells e LEFT JOIN (SELECT cell, string_agg(key || ':' || c, ',' ORDER BY key, month) AS body FROM kl GROUP BY cell) x ON x.cell = e.cell WHERE e.lat0 < 40 GROUP BY e.cell) o
FULL OUTER JOIN (SELECT e.cell, coalesce(max(x.body), '') AS body FROM cells e LEFT JOIN (SELECT cell, string_agg(key || ':' || (CASE WHEN lng0 > 100 AND month = 6 THEN c + 1 ELSE c END), ',' ORDER BY key, month) AS body FROM kl GROUP BY cell) x ON x.cell = e.cell WHERE e.lat0 >= -40 GROUP BY e.cell) n ON n.cell = o.cell
WHERE o.body IS DISTINCT FROM n.body"""))
def sk05_change_layer(spark, sf):
    """What a second publish wrote: a row for each document that is new, changed or gone, and none for the others."""
    root, rows = new_path(spark, "site"), published.shard_rows(spark, sf)
    for change in published.two_builds():
        world.publish(spark, published.world_bundle(spark, sf, change, rows), root)
    return snapshots.changes(spark, snapshots.latest(spark, root), "cells", world.SETS["cells"].schema).select("id", "gone", "layer")


class Broken(RuntimeError):
    pass


@query("st01_broken_write", ref.occ(f"""
SELECT phase, shard, CAST(sum(named) AS BIGINT) AS pairs, CAST(sum(records) AS BIGINT) AS effort FROM (
  SELECT phase, {ref.SHARD_CASE} AS shard, CAST(count(sci) FILTER (WHERE sci NOT IN ('Species 3', 'Species 12')) AS BIGINT) AS named, CAST(count(*) AS BIGINT) AS records
  FROM rec, (VALUES ('broken', 1), ('replayed', 2)) v(phase, version) WHERE version = 1 OR {REPLACED} GROUP BY phase, lat0, lng0)
GROUP BY phase, shard"""))
def st01_broken_write(spark, sf):
    """A drop whose write dies when its tables are written and not yet switched: the old pairs and the old effort are read.
    The replay gives both new ones."""
    drops, tables, state = new_path(spark, "drops"), new_path(spark, "current"), new_path(spark, "stream")
    records = b.records(spark, sf)
    shard_drops.write_drop(counting.count_records(records), drops, 1)
    shard_drops.ingest(spark, drops, tables, state, b.SENSITIVE)
    later = counting.count_records(records.where(LATER))
    shard_drops.write_drop(shard_drops.with_shard(later).where("shard = 'europe'").drop("shard"), drops, 2)

    def die():
        raise Broken("killed before the switch")

    def read(phase):
        now = snapshots.latest(spark, tables)
        pairs = shard_store.pairs(spark, now).groupBy("shard").agg(F.sum(months.total("c")).alias("pairs"))
        effort = shard_store.effort(spark, now).groupBy("shard").agg(F.sum(months.total("t")).alias("effort"))
        return effort.join(pairs, "shard", "left").select(F.lit(phase).alias("phase"), "shard", "pairs", "effort")

    try:
        shard_drops.ingest(spark, drops, tables, state, b.SENSITIVE, die)
    except Exception as error:  # the stream wraps it
        if "killed before the switch" not in str(error):
            raise
    broken = read("broken")
    shard_drops.ingest(spark, drops, tables, state, b.SENSITIVE)
    return broken.unionByName(read("replayed"))


@query("j01_bucketed_effort", ref.occ("""
SELECT p.sci, p.cell, CAST(sum(p.n) AS BIGINT) AS records, max(e.t) AS effort FROM masked p
JOIN (SELECT cell, CAST(sum(t) AS BIGINT) AS t FROM effort GROUP BY cell) e ON e.cell = p.cell WHERE p.sci IS NOT NULL GROUP BY p.sci, p.cell"""))
def j01_bucketed_effort(spark, sf):
    """Counts beside the effort of their cell, from shards that lie by cell: neither side moves."""
    tables = new_path(spark, "tables")
    now = shard_store.replace(spark, tables, gridded(spark, sf, b.records(spark, sf)), [s for s, _, _ in SHARDS])
    merged = counting.merge_pairs(shard_store.pairs(spark, now), "sci", "cell")
    joined = presence.beside_cells(merged, counting.merge_effort(shard_store.effort(spark, now)))
    return joined.select("sci", "cell", months.total("c").alias("records"), months.total("t").alias("effort"))


@query("a06_species_sketches", f"""
WITH located AS (SELECT 'Taxon ' || l_partkey AS sci, greatest(-90, least(89, CAST(floor(CAST((l_suppkey * 7919) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - 90) AS INTEGER))) AS lat0,
  greatest(-180, least(179, CAST(floor(CAST((l_suppkey * 104729) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180) AS INTEGER))) AS lng0 FROM lineitem),
s AS (SELECT sci, {ref.SHARD_CASE} AS shard FROM located)
SELECT count(DISTINCT sci) AS species, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT sci) AS n FROM s GROUP BY shard)) AS in_shards, true AS close FROM s""")
def a06_species_sketches(spark, sf):
    """Species over all shards from their stored sketches alone, held against the exact number: within 2 in 100."""
    line = b.table(spark, sf, "lineitem").selectExpr("concat('Taxon ', l_partkey) AS sci", "month(l_shipdate) AS month", b.LAT.format(key="l_suppkey") + " AS lat", b.LNG.format(key="l_suppkey") + " AS lng")
    none = F.lit(None).cast("string")
    fine = counting.month_grid(line).withColumns({"lat0": grid.whole_lat(), "lng0": grid.whole_lng()}).select(grid.shard_of().alias("shard"), "sci", "cell", none.alias("specieskey"), none.alias("family"), "c")
    now = shard_store.replace(spark, new_path(spark, "tables"), fine, [s for s, _, _ in SHARDS])
    merged = shard_store.species_in_all(shard_store.metrics(spark, now)).withColumn("one", F.lit(1))
    exact = shard_store.pairs(spark, now).agg(F.count_distinct("sci").alias("species")).withColumn("one", F.lit(1))
    return merged.join(exact, "one").select("species", "in_shards", (F.abs(F.col("estimate") - F.col("species")) * 50 <= F.col("species")).alias("close"))
