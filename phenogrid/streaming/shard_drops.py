"""Incremental ingest: drops of month counts arrive as files, and each replaces its shards.

A drop is a folder ``version=N`` of month counts. The stream reads new files once; every batch writes the shards it brings
beside the old ones and switches to them with one manifest, which also holds the versions. A batch that dies before has
changed nothing that anybody reads, and its replay switches to the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions import grid, months
from phenogrid.operators import counting
from phenogrid.sources import shard_store, snapshots

DROP_SCHEMA = "sci string, specieskey string, family string, month int, lat0 int, lng0 int, n bigint, shard string, version int"


def with_shard(counts: DataFrame) -> DataFrame:
    return counts.withColumn("shard", grid.shard_of())


def write_drop(counts: DataFrame, path: str, version: int) -> None:
    """Add a drop: month counts partitioned by version and shard."""
    with_shard(counts).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "shard").parquet(path)


def newest(batch: DataFrame) -> DataFrame:
    """The highest version of each shard among the batch's rows: a row per shard."""
    return batch.groupBy("shard").agg(F.max("version").alias("version"))


def due(batch: DataFrame, tables: str) -> dict[str, int]:
    """Version of each shard that the batch calls for, without those a later version of which is already in place.

    One row per shard, so the list is bounded by the shards.
    """
    held = snapshots.latest(batch.sparkSession, tables).notes.get("versions", {})
    return {r["shard"]: r["version"] for r in newest(batch).collect() if r["version"] >= held.get(r["shard"], r["version"])}


def replace_shards(batch: DataFrame, drops: str, tables: str, sensitive: Sequence[str], before_commit: Callable[[], None] = lambda: None) -> None:
    """Put the shards the batch names in the place of the old ones: pairs, effort, metrics and version at once.

    A version of a shard may arrive in several batches, so the whole drop is read, not only the batch's new files.
    """
    spark = batch.sparkSession
    named = due(batch, tables)
    if not named:
        return
    wanted = F.lit(False)
    for shard, version in named.items():
        wanted |= (F.col("shard") == shard) & (F.col("version") == version)
    masked = counting.mask_sensitive(spark.read.schema(DROP_SCHEMA).parquet(drops).where(wanted), sensitive)
    gridded = counting.with_cell(masked).groupBy("shard", "sci", "cell").agg(
        F.min("specieskey").alias("specieskey"), F.min("family").alias("family"), months.sum_by_month("n").alias("c")
    )
    held = snapshots.latest(spark, tables).notes.get("versions", {})
    shard_store.replace(spark, tables, gridded, list(named), {"versions": held | named}, before_commit)


def ingest(spark: SparkSession, drops: str, tables: str, checkpoint: str, sensitive: Sequence[str] = (), before_commit: Callable[[], None] = lambda: None) -> None:
    """Take in every drop that is there and not yet taken in, then stop."""
    stream = spark.readStream.schema(DROP_SCHEMA).parquet(drops)
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: replace_shards(batch, drops, tables, sensitive, before_commit))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
