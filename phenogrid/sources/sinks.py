"""Writers. Data files first, manifests last; re-running a write replaces only what it owns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions import months, tiles


def write_counts_tsv(counts: DataFrame, path: str) -> None:
    counts.write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="")


def write_shards(table: DataFrame, path: str, sort: list[str]) -> None:
    """Shard-partitioned parquet; only the partitions present in ``table`` are replaced.

    Rows are dealt out by shard and cell, so a shard that holds most of the rows is still written by as many tasks as the
    session has partitions.
    """
    (
        table.repartition("shard", "cell").sortWithinPartitions("shard", *sort)
        .write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def replace_shard(table: DataFrame, path: str, shard_id: str, sort: list[str]) -> None:
    """Write one shard over its old rows; with no rows left, its folder goes."""
    write_shards(table, path, sort)
    if table.isEmpty():
        drop_folder(table.sparkSession, f"{path}/shard={shard_id}")


def pairs_for_sink(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c != "c"]
    return pairs.select(*rest, *months.wide("c", "c"))


def effort_for_sink(effort: DataFrame) -> DataFrame:
    rest = [c for c in effort.columns if c != "t"]
    return effort.select(*rest, *months.wide("t", "t"))


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a partition folder, for what an overwrite by partition leaves when nothing is written to it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_documents(documents: DataFrame, path: str, by: str | None = None, key: str = "id") -> None:
    """Documents as JSON lines, many per file and in ranges of their key; optionally in folders by a coarse column."""
    ranged = documents.repartitionByRange(*([by] if by else []), key) if key in documents.columns else documents
    writer = ranged.write.mode("overwrite")
    (writer if by is None else writer.partitionBy(by)).json(path)


def write_small(rows: DataFrame, path: str) -> None:
    """A manifest of bounded size as one file: a row per region, level or set, never per species or document."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, by: str | None = None) -> None:
    """RFC 4180 CSV: quotes doubled, empty fields bare."""
    writer = rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    (writer if by is None else writer.partitionBy(by)).csv(path)


def write_tiles(pixels: DataFrame, path: str, files: int | None = None) -> None:
    """Pyramid pixels by level, in ranges along the Morton curve; only the levels present are replaced.

    A range is compact both ways, so the statistics on ``gx`` and ``gy`` rule out the files and row groups off a tile or a box
    whichever side they lie on. ``files`` asks for so many ranges.
    """
    curve = tiles.z_order(F.col("gx"), F.col("gy"))
    ranged = pixels.repartitionByRange(files, "z", curve) if files else pixels.repartitionByRange("z", curve)
    ranged.sortWithinPartitions("z", curve).write.partitionBy("z").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_places(chunked: DataFrame, path: str) -> None:
    """Places by chunk. The chunk of major places is dealt out further, by name; others are one file each."""
    salt = F.when(F.col("chunk") == "major", F.pmod(F.xxhash64("name"), F.lit(int(chunked.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).otherwise(F.lit(0))
    chunked.repartition("chunk", salt).write.partitionBy("chunk").mode("overwrite").json(path)


def counted_write(frame: DataFrame, path: str, name: str, **metrics) -> dict:
    """Write parquet and return metrics taken in the same pass."""
    seen = Observation(name)
    frame.observe(seen, *[column.alias(alias) for alias, column in metrics.items()]).write.mode("overwrite").parquet(path)
    return seen.get
