"""Tables under one version: immutable folders, and a manifest that is switched last.

A store is a folder of layers and manifests. A layer is written once and never changed. A manifest names, for every table
of the store, the layers that make it up; committing writes the next manifest under a name that nobody else may take, so
all tables change at once or not at all. A writer that dies before leaves folders no manifest names: readers never see
them, a replay writes others, ``vacuum`` removes them.

Keyed tables are log-structured: a base layer and layers of changes. A change is a whole row, or a key with ``gone`` set
where the row was removed; the latest layer wins. ``compact`` makes a base of what is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.sources import buckets

GONE = "gone"


class ConflictError(RuntimeError):
    """Another writer has committed since this one read the store."""


@dataclass(frozen=True)
class Snapshot:
    """One version of a store: layers of each table, oldest first, and what its writer noted."""

    root: str
    version: int = 0
    tables: dict[str, tuple[str, ...]] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def paths(self, table: str) -> list[str]:
        """Folders of a table's layers. Manifests name them from the root on, so a store may be moved or reached by another path."""
        return [f"{self.root}/{layer}" for layer in self.tables.get(table, ())]


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """A small file."""
    fs, where = _fs(spark, path)
    out = fs.create(where, False)
    out.write(bytearray(body.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def _manifests(spark: SparkSession, root: str) -> list[str]:
    return [n for n in listed(spark, f"{root}/manifests") if n.endswith(".json") and not n.startswith((".", "_"))]


def at_version(spark: SparkSession, root: str, version: int) -> Snapshot:
    held = json.loads(read_text(spark, f"{root}/manifests/{version:010d}.json"))
    return Snapshot(root, held["version"], {k: tuple(v) for k, v in held["tables"].items()}, held["notes"])


def latest(spark: SparkSession, root: str) -> Snapshot:
    """The current version; version 0 is an empty store."""
    names = _manifests(spark, root)
    return at_version(spark, root, int(names[-1].removesuffix(".json"))) if names else Snapshot(root)


def commit(spark: SparkSession, parent: Snapshot, tables: dict[str, Sequence[str]], notes: dict | None = None) -> Snapshot:
    """Make the next version from ``parent``: tables given are replaced (one without layers goes), the others stay, as do notes.

    The manifest is written aside and renamed. The new name must be free, so of two writers with one parent one fails.
    """
    held = {k: tuple(v) for k, v in (parent.tables | dict(tables)).items() if v}
    new = Snapshot(parent.root, parent.version + 1, held, parent.notes | (notes or {}))
    name = f"{new.root}/manifests/_{uuid.uuid4().hex}"
    write_text(spark, name, json.dumps({"version": new.version, "tables": new.tables, "notes": new.notes}))
    (fs, target), (_, aside) = _fs(spark, f"{new.root}/manifests/{new.version:010d}.json"), _fs(spark, name)
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise ConflictError(f"version {new.version} of {new.root} is taken")
    return new


def new_layer(table: str) -> str:
    """A folder nobody has written to, from the root on."""
    return f"layers/{table}-{uuid.uuid4().hex[:12]}"


def write_base(rows: DataFrame, root: str, table: str, keys: Sequence[str], count: int) -> str:
    """A whole table in buckets of its first key; returns the layer."""
    layer = new_layer(table)
    buckets.write(rows.withColumn(GONE, F.lit(False)), f"{root}/{layer}", keys[0], count, keys)
    return layer


def write_changes(rows: DataFrame, removed: DataFrame | None, root: str, table: str, keys: Sequence[str]) -> str:
    """Changed or added rows and the keys of removed ones; returns the layer."""
    layer = new_layer(table)
    every = rows.withColumn(GONE, F.lit(False))
    if removed is not None:
        every = every.unionByName(removed.select(*keys).withColumn(GONE, F.lit(True)), allowMissingColumns=True)
    every.sortWithinPartitions(*keys).write.parquet(f"{root}/{layer}")
    return layer


def changes(spark: SparkSession, snapshot: Snapshot, table: str, schema: str) -> DataFrame:
    """Rows of all change layers, with the number of their layer."""
    out = spark.createDataFrame([], f"{schema}, {GONE} boolean, layer int")
    for i, path in enumerate(snapshot.paths(table)[1:], 1):
        out = out.unionByName(spark.read.schema(f"{schema}, {GONE} boolean").parquet(path).withColumn("layer", F.lit(i)))
    return out


def read(spark: SparkSession, snapshot: Snapshot, table: str, keys: Sequence[str], schema: str, count: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The table as of a version: for every key its row in the latest layer that has one, unless that removes it.

    The base is read by its buckets. Only the keys of the change layers are joined to it, and with ``columns`` given, no
    other columns are read.
    """
    paths = snapshot.paths(table)
    kept = list(dict.fromkeys([*keys, *(columns if columns is not None else (f.split()[0] for f in _fields(schema)))]))
    if not paths:
        return spark.createDataFrame([], schema).select(*kept)
    base = buckets.table(spark, paths[0], keys[0], count, keys, f"{schema}, {GONE} boolean").select(*kept, GONE)
    if len(paths) == 1:
        return base.where(~F.col(GONE)).drop(GONE)
    marked = changes(spark, snapshot, table, schema).select(*kept, GONE, "layer")
    values = [c for c in (*kept, GONE) if c not in keys]
    newest = marked.groupBy(*keys).agg(F.max_by(F.struct(*values), "layer").alias("_row")).select(*keys, "_row.*")
    untouched = base.join(newest.select(*keys), list(keys), "left_anti").where(~F.col(GONE))
    return untouched.unionByName(newest.where(~F.col(GONE))).drop(GONE)


def _fields(schema: str) -> list[str]:
    """Fields of a schema in SQL, split at the commas outside of brackets."""
    out, depth, field_ = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(field_.strip())
            field_ = ""
        else:
            field_ += c
    return [*out, field_.strip()]


def compact(spark: SparkSession, root: str, keyed: dict[str, tuple[Sequence[str], str]], count: int) -> Snapshot:
    """One base layer for each table (name to keys and schema) that has changes; the content stays the same."""
    now = latest(spark, root)
    merged = {t: [write_base(read(spark, now, t, keys, schema, count), root, t, keys, count)] for t, (keys, schema) in keyed.items() if len(now.paths(t)) > 1}
    return commit(spark, now, merged) if merged else now


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the manifests but the last ``keep``, and the layers that none of those names. Not while others write."""
    names = _manifests(spark, root)
    held = {layer.split("/")[1] for n in names[-keep:] for layers in at_version(spark, root, int(n.removesuffix(".json"))).tables.values() for layer in layers}
    stale = [n for n in listed(spark, f"{root}/layers") if n not in held]
    for path in [*(f"{root}/layers/{n}" for n in stale), *(f"{root}/manifests/{n}" for n in names[:-keep])]:
        fs, where = _fs(spark, path)
        fs.delete(where, True)
    return stale
