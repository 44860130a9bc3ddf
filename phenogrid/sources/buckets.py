"""Bucketed folders: rows dealt out by a hash of one column, one sorted file a bucket.

Spark reads such a folder as already partitioned by that column, so joins and groupings on it move nothing. Spark knows of
buckets only through its catalog; a table is therefore registered for the session on first use, over folders that hold the
data and outlive it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a new table: the session's shuffle partitions, so that a shuffle and a bucketed side agree."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write(rows: DataFrame, path: str, by: str, buckets: int, sort: Sequence[str], partition: str | None = None) -> None:
    """Write to a new folder; a shuffle only where the rows don't lie by ``by`` already. With ``partition``, in folders by it."""
    name = f"phenogrid_write_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(*sort).format("parquet").option("path", path)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # the files are not the table's to take along


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table(spark: SparkSession, folders: Mapping[str, str] | str, by: str, buckets: int, sort: Sequence[str], schema: str, partition: str = "shard") -> DataFrame:
    """Read one bucketed folder, or several as values of the column ``partition``, each wherever it lies.

    All must have the same number of buckets. ``schema`` is that of the files, without the partition column.
    """
    single = isinstance(folders, str)
    what = [folders] if single else sorted(f"{k}={v}" for k, v in folders.items())
    name = "phenogrid_" + hashlib.md5("\n".join([by, str(buckets), schema, *what]).encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        clustered = f"CLUSTERED BY ({by}) SORTED BY ({', '.join(sort)}) INTO {buckets} BUCKETS"
        if single:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {clustered} LOCATION {_quoted(folders)}")
        else:
            if not folders:
                return spark.createDataFrame([], f"{schema}, {partition} string")
            # The table's own place stays empty: every partition has its folder.
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}, {partition} string) USING parquet PARTITIONED BY ({partition}) {clustered} LOCATION {_quoted(next(iter(folders.values())) + '/none')}")
            places = " ".join(f"PARTITION ({partition} = {_quoted(k)}) LOCATION {_quoted(v)}" for k, v in sorted(folders.items()))
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {places}")
    return spark.table(name)
