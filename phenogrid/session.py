"""Session settings and the shared working folder.

A cluster names its shared folder in ``spark.checkpoint.dir``; only a local session may fall back
to a folder of this machine.
"""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def build_session(app: str = "phenogrid", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from the session's ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="phenogrid-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps restart from files, not from the sources, when executors go."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def split_by(rows: DataFrame, weight: Column | int, per_task: int, *by: Column | str) -> DataFrame:
    """Rows dealt out by ``by`` to as many tasks as their summed ``weight`` asks for.

    For rows that are about to become many: a small file is read by one task, however much is made of it there. Asks
    for the sum, which is one pass over the rows.
    """
    found = rows.agg(F.sum(weight if isinstance(weight, Column) else F.lit(weight)).alias("n")).first()["n"]
    return rows.repartition(max(1, -(-int(found or 0) // per_task)), *by)


def together(spark: SparkSession, *jobs: Callable) -> list:
    """Run independent jobs at once, so that the tail of one leaves no executor idle; returns their results in order."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [w.result() for w in waiting]
