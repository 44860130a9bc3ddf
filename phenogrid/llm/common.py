"""Reading tables, storing intermediate tables in the shared folder, and groups that no hot key can overload."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.session import new_path

#: Parts that the rows of one key are dealt to; a key has at most so many rows in any per-key list.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there, and lost executors lose nothing."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    del df
    # Shuffle files go when the driver collects the plans that made them, which an idle driver hardly ever does by itself.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables from the shared folder, once all that is read from them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def salt_of(*ids: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int")


def salted_groups(rows: DataFrame, keys: list[str], best: Column) -> DataFrame:
    """Size and smallest ``best`` of every group of two rows or more, once per part of the group.

    ``rows`` has a column ``salt``. Returns keys, salt, n, first: a group of any size is counted in parts and
    handed back to its parts, so joining it to ``rows`` on keys and salt never meets a hot key.
    """
    parts = rows.groupBy(*keys, "salt").agg(F.count("*").alias("n"), F.min(best).alias("first"))
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
    return whole.where("n > 1").select(*keys, F.explode("salts").alias("salt"), "n", "first")


def carried(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the caller's whole row in a struct ``row``: no column made on the way can clash with one of its."""
    return docs.select(F.struct("*").alias("row"), *(c for c in ("doc_id", "text") if c in docs.columns))


#: Node numbers of rows without doc_id count down from here.
LAST_NODE = (1 << 63) - 1


def nodes(docs: DataFrame) -> DataFrame:
    """node (the doc_id, or a number from the far end for a row without one), known (whether it has one), text."""
    known = F.col("doc_id").isNotNull()
    return docs.select("doc_id", "text").select(F.coalesce("doc_id", F.lit(LAST_NODE) - F.monotonically_increasing_id()).alias("node"), known.alias("known"), "text")


_shipped: set[str] = set()


#: Bytes of rows that a Python worker is handed at once; Spark's own 64 MB is a lot for workers that share an executor.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the package to Spark once per application, so that Python workers anywhere can import it, and keep batches small.

    Spark serves the archive to the executors itself; nobody else reads the driver's copy. A batch size that was set by
    hand stays.
    """
    if spark.conf.get(BATCH) == "67108864b":
        spark.conf.set(BATCH, "4m")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
