"""A published site that follows its shard store: after a shard was replaced, only what it touched is labelled again.

The site is a versioned store of labelled species-cells, cell documents and species documents, and remembers from which
version of the shards it was built. ``refresh`` passes the change on step by step: shards whose folders differ, cells
whose rows in them differ, species-cells of those cells, species one of whose entries reads differently, documents whose
bodies differ. Each step is a semi join on the keys of the one before. All layers come into force with one manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions import months
from phenogrid.operators import counting, documents
from phenogrid.plans import world
from phenogrid.rules import CoverageRules, PresenceRules
from phenogrid.session import new_path, together
from phenogrid.sources import buckets, shard_store, snapshots
from phenogrid.sources.snapshots import Snapshot

LABELLED = "key string, cell string, c array<bigint>, u array<bigint>, m int, p string"
LABELLED_KEYS = ["cell", "key"]
STATES = "kind string, id string, state string, bytes bigint"


@dataclass(frozen=True)
class Settings:
    """All that decides what is published, besides the shards."""

    names: DataFrame
    sensitive: DataFrame
    rules: PresenceRules = PresenceRules()
    coverage: CoverageRules = CoverageRules()
    source: str = "occurrence records"
    generated: str = ""

    def mark(self) -> str:
        """Changes with the rules, the names or the sensitive list."""
        rows = [f.select(F.xxhash64(*f.columns).alias("h")).agg(F.count("*"), F.bit_xor("h")).first() for f in (self.names.select("sci", "key", "common", "family"), self.sensitive.select("sci"))]
        return f"{self.rules} {self.coverage} {[tuple(r) for r in rows]}"


def labelled_of(spark: SparkSession, now: Snapshot) -> DataFrame:
    return snapshots.read(spark, now, "labelled", LABELLED_KEYS, LABELLED, now.notes["buckets"])


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def build(spark: SparkSession, tables: str, site: str, settings: Settings) -> DataFrame:
    """Label and publish everything; returns kind, id, state and bytes of every document.

    Shards are read by their buckets, so species-cells meet their effort and their cell without a shuffle; the species
    documents need one.
    """
    shards, held = snapshots.latest(spark, tables), snapshots.latest(spark, site)
    count = held.notes.get("buckets") or buckets.bucket_count(spark)
    pairs, effort = shard_store.pairs(spark, shards), shard_store.effort(spark, shards)
    mark, names, sensitive, merged = together(
        spark, settings.mark, lambda: _stored(settings.names, "names"), lambda: _stored(settings.sensitive, "sensitive"),
        lambda: _stored(counting.merge_effort(effort), "effort"),
    )
    layer = snapshots.write_base(world.label(pairs, merged, names, sensitive, settings.rules), site, "labelled", LABELLED_KEYS, count)
    labelled = labelled_of(spark, Snapshot(site, 0, {"labelled": (layer,)}, {"buckets": count}))
    made = world.assemble(labelled, merged, names, shard_store.metrics(spark, shards), settings.coverage, settings.source, settings.generated)
    return world.publish(spark, made, site, {"shards": shards.version, "mark": mark}, {"labelled": [layer]})


def changed_shards(before: Snapshot, after: Snapshot) -> list[str]:
    """Shards with another folder than before, new and gone ones included."""
    tables = {t for t in before.tables.keys() | after.tables.keys() if t.startswith(("pairs/", "totals/"))}
    return sorted({t.split("/", 1)[1] for t in tables if before.tables.get(t) != after.tables.get(t)})


def _fingerprints(spark: SparkSession, now: Snapshot, shards: list[str], column: str) -> DataFrame:
    """What the shards say of each cell, as a few numbers. Bucketed by cell, so nothing is shuffled."""
    each = F.xxhash64("shard", "sci", "c")
    held = [s for s in shards if now.paths(f"pairs/{s}")]
    pairs = shard_store.pairs(spark, now, held).groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor(each).alias("x"))
    effort = shard_store.effort(spark, now, [s for s in shards if now.paths(f"totals/{s}")]).groupBy("cell").agg(months.sum_vectors("t").alias("t"))
    return effort.join(pairs, "cell", "left").select("cell", F.struct("t", "n", "x").alias(column))


def dirty_cells(spark: SparkSession, before: Snapshot, after: Snapshot) -> DataFrame:
    """Cells about which the changed shards say something else than before."""
    shards = changed_shards(before, after)
    old, new = _fingerprints(spark, before, shards, "old"), _fingerprints(spark, after, shards, "new")
    return old.join(new, "cell", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("cell")


def relabelled(spark: SparkSession, shards: Snapshot, cells: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(labelled species-cells, merged effort) of some cells only, from all shards."""
    effort = shard_store.effort(spark, shards).join(cells, "cell", "left_semi")
    pairs = shard_store.pairs(spark, shards).join(cells, "cell", "left_semi")
    merged = _stored(counting.merge_effort(effort), "dirty-effort")
    return _stored(world.label(pairs, merged, settings.names, settings.sensitive, settings.rules), "dirty-labelled"), merged


def label_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """cell, key, gone, seen of species-cells that differ; ``seen``: their species' document reads differently too."""
    was, now = (rows.select(*LABELLED_KEYS, F.struct("u", "p").alias(f"{v}_shown"), F.struct("c", "m").alias(f"{v}_rest")) for rows, v in ((old, "old"), (new, "new")))
    shown = ~F.col("old_shown").eqNullSafe(F.col("new_shown"))
    rest = ~F.col("old_rest").eqNullSafe(F.col("new_rest"))
    return was.join(now, LABELLED_KEYS, "full_outer").where(shown | rest).select(*LABELLED_KEYS, F.col("new_shown").isNull().alias("gone"), shown.alias("seen"))


def refresh(spark: SparkSession, tables: str, site: str, settings: Settings) -> DataFrame:
    """Bring the site up to the current shards; returns kind, id, state and bytes of the documents that were looked at.

    A site that is not there yet, or was made with other names, rules or sensitive species, is built in full.
    """
    shards, held = snapshots.latest(spark, tables), snapshots.latest(spark, site)
    if "shards" not in held.notes or held.notes["mark"] != settings.mark():
        return build(spark, tables, site, settings)
    if held.notes["shards"] == shards.version:
        return spark.createDataFrame([], STATES)
    before = snapshots.at_version(spark, tables, held.notes["shards"])
    cells = _stored(dirty_cells(spark, before, shards), "dirty-cells")
    settings = Settings(_stored(settings.names, "names"), _stored(settings.sensitive, "sensitive"), settings.rules, settings.coverage, settings.source, settings.generated)
    new, merged = relabelled(spark, shards, cells, settings)
    old = labelled_of(spark, held).join(cells, "cell", "left_semi")
    differ = _stored(label_changes(old, new), "dirty-pairs")
    layers = list(held.tables["labelled"])
    if not differ.isEmpty():
        layers.append(snapshots.write_changes(new.join(differ.where("NOT gone"), LABELLED_KEYS, "left_semi"), differ.where("gone"), site, "labelled", LABELLED_KEYS))
    species = _stored(differ.where("seen").select(F.col("key").alias("k")).distinct(), "dirty-species")
    after = labelled_of(spark, Snapshot(site, 0, {"labelled": tuple(layers)}, held.notes)).join(species, F.col("key") == F.col("k"), "left_semi")

    def one(name: str, bodies: DataFrame, among: DataFrame) -> tuple[list[str], DataFrame]:
        return world.document_changes(spark, held, name, _stored(bodies, "bodies"), among)

    bodies = {"cells": documents.cell_bodies(documents.cell_rows(new, merged, settings.coverage)), "species": documents.species_bodies(documents.species_rows(after), settings.names)}
    manifest = documents.coverage_manifest(shard_store.metrics(spark, shards))
    meta = documents.meta(manifest, settings.source, world.MEASURE, settings.generated)
    (cell_layers, cell_states), (species_layers, species_states), small = together(
        spark, lambda: one("cells", bodies["cells"], cells.select(F.col("cell").alias("id"))), lambda: one("species", bodies["species"], species),
        lambda: world.small_tables(spark, held, manifest, meta),
    )
    now = snapshots.commit(spark, held, {"labelled": layers, "cells": cell_layers, "species": species_layers, **small}, {"shards": shards.version})
    compacted(spark, world.compacted(spark, now))
    return cell_states.unionByName(species_states)


def compacted(spark: SparkSession, now: Snapshot) -> Snapshot:
    """The labelled species-cells as one layer again, once they have many."""
    if len(now.paths("labelled")) <= world.MOST_LAYERS:
        return now
    return snapshots.compact(spark, now.root, {"labelled": (LABELLED_KEYS, LABELLED)}, now.notes["buckets"])
