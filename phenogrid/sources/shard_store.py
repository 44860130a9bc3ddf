"""The shards' tables as one versioned store: pairs, effort and metrics of a shard change together.

Each shard's pairs and effort lie in folders of their own, bucketed by cell. The store's manifest says which folder is a
shard's current one, so a new drop of a shard is written beside the old and comes into force with the next manifest.
Readers see the pairs and the effort of one version, and join and group them by cell without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions import months
from phenogrid.session import new_path
from phenogrid.sources import buckets, sinks, snapshots
from phenogrid.sources.snapshots import Snapshot

_C, _T = (", ".join(f"{p}{m:02d} bigint" for m in range(1, months.MONTHS + 1)) for p in "ct")
PAIRS = f"sci string, specieskey string, family string, cell string, {_C}"
TOTALS = f"cell string, {_T}"
METRICS = "shard string, records bigint, cells bigint, pairs bigint, species bigint, sketch binary"

#: Sort columns of the two tables; both are bucketed by cell.
ORDER = {"pairs": ("cell", "sci"), "totals": ("cell",)}


def count_of(spark: SparkSession, now: Snapshot) -> int:
    """Buckets of the store, fixed by its first write."""
    return now.notes.get("buckets") or buckets.bucket_count(spark)


def metrics_of(gridded: DataFrame) -> DataFrame:
    """Exact metrics of each shard, and a sketch of its species that can be merged with other shards' sketches.

    Species and cells are made distinct by a grouping each, which map-side combining makes small; several distinct counts
    in one aggregate would copy every row for each.
    """
    species = gridded.groupBy("shard", "sci").agg(F.sum(months.total("c")).alias("records"), F.count("sci").alias("pairs")).groupBy("shard").agg(
        F.sum("records").cast("long").alias("records"), F.sum("pairs").alias("pairs"), F.count("sci").alias("species"), F.hll_sketch_agg("sci", 14).alias("sketch"),
    )
    cells = gridded.select("shard", "cell").distinct().groupBy("shard").agg(F.count("cell").alias("cells")).withColumnRenamed("shard", "_shard")
    return species.join(cells, F.col("shard").eqNullSafe(F.col("_shard"))).select("shard", "records", "cells", "pairs", "species", "sketch")


def replace(spark: SparkSession, root: str, gridded: DataFrame, shards: Sequence[str], notes: dict | None = None, before_commit=lambda: None) -> Snapshot:
    """Put new rows (shard, sci, cell, specieskey, family, c; sci NULL for effort only) in the place of some shards.

    All of them, and both tables of each, come into force with one manifest. A shard without rows has none afterwards.
    ``before_commit`` runs when everything is written and nothing is switched.
    """
    now = snapshots.latest(spark, root)
    count = count_of(spark, now)
    path = new_path(spark, "gridded")
    gridded.write.parquet(path)
    rows = spark.read.schema(gridded.schema).parquet(path)
    pairs = sinks.pairs_for_sink(rows.where("sci IS NOT NULL").select("sci", "specieskey", "family", "cell", "c", "shard"))
    totals = sinks.effort_for_sink(rows.groupBy("shard", "cell").agg(months.sum_vectors("c").alias("t")))
    tables: dict[str, Sequence[str]] = {f"{name}/{shard}": () for name in ORDER for shard in shards}
    for name, table in (("pairs", pairs), ("totals", totals)):
        layer = snapshots.new_layer(name)
        buckets.write(table, f"{root}/{layer}", "cell", count, ORDER[name], "shard")
        for folder in snapshots.listed(spark, f"{root}/{layer}"):
            if folder.startswith("shard=") and folder != f"shard={buckets.DEFAULT_PARTITION}":
                tables[f"{name}/{folder.removeprefix('shard=')}"] = [f"{layer}/{folder}"]
    strange = {t.split("/", 1)[1] for t in tables} - set(shards)
    if strange:
        raise ValueError(f"rows of shards that are not to be replaced: {sorted(strange)}")
    layer = snapshots.new_layer("metrics")
    metrics_of(rows).coalesce(1).write.parquet(f"{root}/{layer}")  # a row per shard
    tables |= {f"metrics/{shard}": [layer] if f"totals/{shard}" in tables and tables[f"totals/{shard}"] else () for shard in shards}
    before_commit()
    return snapshots.commit(spark, now, tables, {"buckets": count, **(notes or {})})


def shards_of(now: Snapshot) -> list[str]:
    return sorted(t.removeprefix("totals/") for t in now.tables if t.startswith("totals/"))


def _table(spark: SparkSession, now: Snapshot, name: str, schema: str, shards: Sequence[str] | None) -> DataFrame:
    folders = {s: paths[0] for s in (shards_of(now) if shards is None else shards) if (paths := now.paths(f"{name}/{s}"))}
    return buckets.table(spark, folders, "cell", count_of(spark, now), ORDER[name], schema)


def pairs(spark: SparkSession, now: Snapshot, shards: Sequence[str] | None = None) -> DataFrame:
    """shard, sci, specieskey, family, cell, c of a version, of all shards or some."""
    return _table(spark, now, "pairs", PAIRS, shards).select("shard", "sci", "specieskey", "family", "cell", months.from_wide("c").alias("c"))


def effort(spark: SparkSession, now: Snapshot, shards: Sequence[str] | None = None) -> DataFrame:
    """shard, cell, t of a version."""
    return _table(spark, now, "totals", TOTALS, shards).select("shard", "cell", months.from_wide("t").alias("t"))


def metrics(spark: SparkSession, now: Snapshot) -> DataFrame:
    """A row per shard: records, cells, pairs, species, and the sketch of its species."""
    out = spark.createDataFrame([], METRICS)
    for shard in shards_of(now):
        for path in now.paths(f"metrics/{shard}"):
            out = out.unionByName(spark.read.schema(METRICS).parquet(path).where(F.col("shard") == shard))
    return out


def species_in_all(metrics: DataFrame) -> DataFrame:
    """One row: species over all shards from the sketches alone, and the sum of the shards' own exact numbers."""
    return metrics.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch", False)), F.lit(0)).alias("estimate"), F.coalesce(F.sum("species"), F.lit(0)).alias("in_shards"))
