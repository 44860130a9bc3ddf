"""Leak check and incremental ingest (Q6, ST1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.functions import months
from phenogrid.operators import counting, quality
from phenogrid.session import new_path
from phenogrid.sources import bindings as b
from phenogrid.sources import shard_store, snapshots
from phenogrid.streaming import shard_drops


@query("q06_sensitive_leaks", ref.occ("SELECT 0 AS leaks, count(DISTINCT sci || '|' || cell) AS published FROM masked"))
def q06(spark, sf):
    pairs, _ = b.pairs_and_effort(spark, sf)
    leaks = quality.sensitive_leaks(pairs, b.sensitive(spark, sf)).withColumn("_one", F.lit(1))
    return leaks.join(pairs.agg(F.count("*").alias("published")).withColumn("_one", F.lit(1)), "_one").drop("_one")


@query("st01_shard_drops", ref.occ(f"""
SELECT shard, sci, cell, CAST(count(*) AS BIGINT) AS records FROM (
  SELECT {ref.SHARD_CASE} AS shard, CASE WHEN sci IN ('Species 3', 'Species 12') THEN NULL ELSE sci END AS sci, lat0 || '_' || lng0 AS cell, l_orderkey FROM rec)
WHERE sci IS NOT NULL AND (shard NOT IN ('europe', 'americas') OR l_orderkey % 2 = 0) GROUP BY ALL"""))
def st01(spark, sf):
    """A first drop that arrives in two runs, then a second version of two shards with fewer records, as a stream."""
    drops, tables = new_path(spark, "drops"), new_path(spark, "current")
    records = b.records(spark, sf)
    state = new_path(spark, "stream")
    for part in (F.col("l_linenumber") <= 2, F.col("l_linenumber") > 2):
        shard_drops.write_drop(counting.count_records(records.where(part)), drops, 1)
        shard_drops.ingest(spark, drops, tables, state, b.SENSITIVE)
    later = counting.count_records(records.where(F.col("l_orderkey") % 2 == 0))
    shard_drops.write_drop(shard_drops.with_shard(later).where(F.col("shard").isin("europe", "americas")).drop("shard"), drops, 2)
    shard_drops.ingest(spark, drops, tables, state, b.SENSITIVE)
    pairs = shard_store.pairs(spark, snapshots.latest(spark, tables))
    return pairs.select("shard", "sci", "cell", months.total("c").alias("records"))
