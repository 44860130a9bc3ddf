"""Worldwide product: counts of a shard to tables, names, and the published documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions import months
from phenogrid.operators import counting, documents, naming, presence
from phenogrid.rules import SENSITIVE, CoverageRules, PresenceRules, QualityWindow
from phenogrid.session import new_path, together
from phenogrid.sources import buckets, files, sinks, snapshots


def shard_counts(records: DataFrame, shard_id: str, window: QualityWindow = QualityWindow(), sensitive: Sequence[str] = SENSITIVE) -> DataFrame:
    """Month counts of a shard straight from occurrence records (``world-sql`` and its download)."""
    kept = counting.in_shard(counting.usable_records(records, window), shard_id)
    return counting.count_records(counting.without_sensitive(kept, sensitive))


def world_shard(spark: SparkSession, tsv: str, shard_id: str, tables: str, sensitive: Sequence[str] = SENSITIVE) -> DataFrame:
    """Ingest one shard's counts file, replacing only that shard; returns its metrics."""
    counts = counting.in_shard_cells(counting.typed_counts(files.counts_tsv(spark, tsv)), shard_id)
    return ingest_counts(counts, shard_id, tables, sensitive)


def ingest_counts(counts: DataFrame, shard_id: str, tables: str, sensitive: Sequence[str] = SENSITIVE) -> DataFrame:
    """Replace one shard's tables; a table that gets no rows loses its old ones too. Returns the shard's metrics.

    The counts are pivoted once into (species, cell) rows in the shared folder, from which both tables and the metrics come.
    """
    spark = counts.sparkSession
    masked = counting.mask_sensitive(counts, sensitive)
    pivot = counting.with_cell(masked).groupBy("sci", "cell").agg(
        F.min("specieskey").alias("specieskey"), F.min("family").alias("family"), months.sum_by_month("n").alias("c"), F.count("*").alias("rows"),
    )
    path = new_path(spark, "ingest")
    pivot.write.parquet(path)
    pivot = spark.read.schema(pivot.schema).parquet(path)
    shard = F.lit(shard_id).alias("shard")
    pairs = pivot.where("sci IS NOT NULL").select("sci", "cell", "specieskey", "family", "c")
    effort = pivot.groupBy("cell").agg(months.sum_vectors("c").alias("t"))
    sinks.replace_shard(sinks.pairs_for_sink(pairs).select("*", shard), f"{tables}/pairs", shard_id, ["sci", "cell"])
    sinks.replace_shard(sinks.effort_for_sink(effort).select("*", shard), f"{tables}/totals", shard_id, ["cell"])
    return pivot.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.sum(months.total("c")), F.lit(0)).cast("long").alias("records"),
        F.count("sci").alias("pairs"), F.count_distinct("sci").alias("species"), F.count_distinct("cell").alias("cells"),
    ).select(shard, "*")


def shard_tables(spark: SparkSession, tables: str, shards: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, effort) of the stored shards, as vectors."""
    pairs = files.shard_table(spark, f"{tables}/pairs", shards)
    totals = files.shard_table(spark, f"{tables}/totals", shards)
    return (
        pairs.select("shard", "sci", "specieskey", "family", "cell", months.from_wide("c").alias("c")),
        totals.select("shard", "cell", months.from_wide("t").alias("t")),
    )


def world_names(pairs: DataFrame, cache: DataFrame, checklist: DataFrame, match: DataFrame) -> DataFrame:
    """Names of every species of the shards, by priority of the sources."""
    return naming.resolve_names(counting.species_list(pairs), cache, checklist, match)


MEASURE = "records of the species per record of its class, by cell and month"


@dataclass(frozen=True)
class Bundle:
    """What is published, as lazy frames made when they are asked for."""

    labelled: DataFrame
    effort: DataFrame
    names: DataFrame
    manifest: DataFrame
    meta: DataFrame
    coverage: CoverageRules

    @cached_property
    def cell_rows(self) -> DataFrame:
        return documents.cell_rows(self.labelled, self.effort, self.coverage)

    @cached_property
    def species_rows(self) -> DataFrame:
        return documents.species_rows(self.labelled)

    @property
    def cells(self) -> DataFrame:
        return self.cell_rows.select("id", "total", "species")

    @property
    def cell_index(self) -> DataFrame:
        return self.cell_rows.select("id", "total", "richness", "coverage")

    @property
    def species(self) -> DataFrame:
        return self.species_rows.select("k", F.map_from_entries("entries").alias("cells"))

    @property
    def species_index(self) -> DataFrame:
        return documents.named_index(self.species_rows.select(F.col("k").alias("key"), "cells"), self.names)

    def bodies(self, name: str) -> DataFrame:
        """One row per cell or species with document, index entry, hashes and lengths: what ``publish`` writes."""
        return documents.cell_bodies(self.cell_rows) if name == "cells" else documents.species_bodies(self.species_rows, self.names)


LABELLED = ("key", "cell", "c", "u", "m", "p")


def label(pairs: DataFrame, effort: DataFrame, names: DataFrame, sensitive: DataFrame, rules: PresenceRules = PresenceRules()) -> DataFrame:
    """Species-cells by key with their counts, rates in whole units, months and label; ``effort`` is merged."""
    safe = naming.drop_sensitive(pairs, sensitive)
    keyed = counting.merge_pairs(naming.with_keys(safe.select("sci", "cell", "c"), names), "key", "cell")
    return documents.with_units(presence.label_presence(keyed, effort, rules)).select(*LABELLED)


def shard_metrics(pairs: DataFrame, effort: DataFrame) -> DataFrame:
    """Records, cells and species of each shard."""
    return effort.groupBy("shard").agg(F.sum(months.total("t")).alias("records"), F.count("*").alias("cells")).join(
        pairs.groupBy("shard").agg(F.count_distinct("sci").alias("species")), "shard", "left"
    )


def world_build(
    pairs: DataFrame, effort: DataFrame, names: DataFrame, sensitive: DataFrame, rules: PresenceRules = PresenceRules(),
    coverage: CoverageRules = CoverageRules(), store: str | None = None, ingested: DataFrame | None = None,
    source: str = "occurrence records", generated: str = "", metrics: DataFrame | None = None,
) -> Bundle:
    """Merge shards, name, label and assemble: shuffles by (key, cell), by cell and by key.

    Tables that are bucketed by cell need only the last. With ``store`` given, effort and labelled species-cells are
    written there once, in buckets of the cell, and every document and index is read from these; otherwise each document
    plan labels on its own. ``ingested`` (shard, built, doi) adds when and from which download a shard came; ``metrics``
    are the shards' numbers where they are at hand.
    """
    merged = counting.merge_effort(effort)
    if store is None:
        labelled = label(pairs, merged, names, sensitive, rules)
    else:
        # With files behind them, Spark knows how small the names and the effort are.
        names, sensitive, merged = together(
            effort.sparkSession, lambda: _copied(names, f"{store}/names"), lambda: _copied(sensitive, f"{store}/sensitive"),
            lambda: _kept(merged, f"{store}/effort", ("cell",)),
        )
        labelled = _kept(label(pairs, merged, names, sensitive, rules), f"{store}/labelled", ("cell", "key"))
    metrics = shard_metrics(pairs, effort) if metrics is None else metrics
    if ingested is not None:
        metrics = metrics.join(ingested.select("shard", "built", "doi"), "shard", "left")
    return assemble(labelled, merged, names, metrics, coverage, source, generated)


def assemble(labelled: DataFrame, merged: DataFrame, names: DataFrame, metrics: DataFrame, coverage: CoverageRules = CoverageRules(), source: str = "occurrence records", generated: str = "") -> Bundle:
    """Documents and indexes of labelled species-cells and the effort of their cells."""
    manifest = documents.coverage_manifest(metrics)
    return Bundle(labelled, merged, names, manifest, documents.meta(manifest, source, MEASURE, generated), coverage)


def _copied(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _kept(rows: DataFrame, path: str, sort: tuple[str, ...]) -> DataFrame:
    """Written once in buckets of the cell, and read back as such."""
    count = buckets.bucket_count(rows.sparkSession)
    buckets.write(rows, path, "cell", count, sort)
    return buckets.table(rows.sparkSession, path, "cell", count, sort, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields))


@dataclass(frozen=True)
class Published:
    """A stored set of documents: its key, and the column of the body of each kind it holds."""

    key: str
    kinds: dict[str, str]

    @property
    def schema(self) -> str:
        return f"{self.key} string, {documents.BODIES}"


SETS = {"cells": Published("id", {"cells": "value", "cell_index": "entry"}), "species": Published("k", {"species": "value", "species_index": "entry"})}
HASHES = {"value": "hash", "entry": "entry_hash"}
LENGTHS = {"value": "bytes", "entry": "entry_bytes"}

#: Change layers after which a set is written anew as one layer.
MOST_LAYERS = 16


def stored_bodies(spark: SparkSession, now: snapshots.Snapshot, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A set of documents as of a version of the site."""
    return snapshots.read(spark, now, name, [SETS[name].key], SETS[name].schema, now.notes.get("buckets", 1), columns)


def _state(body: str) -> Column:
    old, new = F.col(f"_{HASHES[body]}"), F.col(HASHES[body])
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").when(old == new, "unchanged").otherwise("changed")


def document_changes(spark: SparkSession, now: snapshots.Snapshot, name: str, made: DataFrame, among: DataFrame | None = None) -> tuple[list[str], DataFrame]:
    """Compare new bodies with the stored ones and write a layer of those that differ.

    Returns the set's layers for the next manifest, and a row (kind, id, state, bytes) per document. ``made`` must be stored:
    it is read for the comparison and for the layer. With ``among`` given (a column of keys), only these keys are
    compared, and ``made`` holds new bodies for them alone.
    """
    what = SETS[name]
    old = stored_bodies(spark, now, name, list(HASHES.values()))
    if among is not None:
        old = old.join(among, what.key, "left_semi")
    old = old.withColumnsRenamed({h: f"_{h}" for h in HASHES.values()})
    compared = made.select(what.key, *HASHES.values(), *LENGTHS.values()).join(old, what.key, "full_outer")
    path = new_path(spark, "changes")
    states = {body: f"{kind}_state" for kind, body in what.kinds.items()}
    compared.select(what.key, *LENGTHS.values(), *[_state(body).alias(column) for body, column in states.items()]).write.parquet(path)
    diff = spark.read.parquet(path)
    any_change = " OR ".join(f"{c} <> 'unchanged'" for c in states.values())
    touched, gone = diff.where(any_change).select(what.key), diff.where(f"{next(iter(states.values()))} = 'removed'").select(what.key)
    layers = list(now.tables[name])
    if not touched.isEmpty():
        layers.append(snapshots.write_changes(made.join(touched, what.key, "left_semi"), gone, now.root, name, [what.key]))
    return layers, _listed(diff, what, lambda body: F.col(states[body]))


def _listed(rows: DataFrame, what: Published, state) -> DataFrame:
    out = [rows.select(F.lit(kind).alias("kind"), F.col(what.key).alias("id"), state(body).alias("state"), F.when(state(body).isin("added", "changed"), F.col(LENGTHS[body])).alias("bytes")) for kind, body in what.kinds.items()]
    return out[0].unionByName(out[1])


def publish(spark: SparkSession, bundle: Bundle, root: str, notes: dict | None = None, beside: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Bring the published documents up to date; returns kind, id, state and written bytes of each.

    The site is a versioned store. A first publish writes each set once; a later one writes the new bodies aside,
    compares their hashes with the stored ones and adds a layer of the documents that changed, with marks for those that
    went. Everything, the coverage manifest and the meta row included, comes into force with one manifest, so a publish
    that broke off changes nothing and is simply run again. ``beside`` are layers of other tables of the site to switch with
    them.
    """
    now = snapshots.latest(spark, root)
    count = now.notes.get("buckets") or buckets.bucket_count(spark)

    def one(name: str) -> tuple[list[str], DataFrame]:
        what = SETS[name]
        if name not in now.tables:  # everything is added
            layer = snapshots.write_base(bundle.bodies(name), root, name, [what.key], count)
            return [layer], _listed(spark.read.schema(what.schema).parquet(f"{root}/{layer}"), what, lambda body: F.lit("added"))
        path = new_path(spark, "bodies")
        bundle.bodies(name).write.parquet(path)
        return document_changes(spark, now, name, spark.read.schema(what.schema).parquet(path))

    (cells, cell_states), (species, species_states), small = together(
        spark, lambda: one("cells"), lambda: one("species"), lambda: small_tables(spark, now, bundle.manifest, bundle.meta)
    )
    compacted(spark, snapshots.commit(spark, now, {"cells": cells, "species": species, **small, **(beside or {})}, {"buckets": count, **(notes or {})}))
    return cell_states.unionByName(species_states)


def compacted(spark: SparkSession, now: snapshots.Snapshot) -> snapshots.Snapshot:
    """Write sets with many layers anew."""
    long = {n: ([w.key], w.schema) for n, w in SETS.items() if len(now.paths(n)) > MOST_LAYERS}
    return snapshots.compact(spark, now.root, long, now.notes["buckets"]) if long else now


def small_tables(spark: SparkSession, now: snapshots.Snapshot, manifest: DataFrame, meta: DataFrame) -> dict[str, list[str]]:
    """Layers of the coverage manifest and the meta row, for those that changed; a row per region, and one."""
    lines = [rows.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("value")) for name, rows in (("coverage", manifest), ("meta", meta))]
    made = sorted(tuple(r) for r in lines[0].unionByName(lines[1]).collect())
    out = {}
    for name in ("coverage", "meta"):
        body = "".join(f"{value}\n" for of, value in made if of == name)
        held = now.paths(name)
        if not held or body != snapshots.read_text(spark, held[0]):
            out[name] = [f"{snapshots.new_layer(name)}.json"]
            snapshots.write_text(spark, f"{now.root}/{out[name][0]}", body)
    return out


def published(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    """Documents of a kind as they stand; ``schema`` names the fields to take from their bodies."""
    now = snapshots.latest(spark, root)
    if kind in ("coverage", "meta"):
        lines = spark.read.text(now.paths(kind)[0])
        return lines.select(F.from_json("value", schema).alias("d")).select("d.*")
    name, body = next((n, w.kinds[kind]) for n, w in SETS.items() if kind in w.kinds)
    return stored_bodies(spark, now, name, [body]).select(F.from_json(body, schema).alias("d")).select("d.*")


def export(spark: SparkSession, root: str, kind: str, path: str) -> None:
    """Documents of a kind as JSON lines, in ranges of their key."""
    now = snapshots.latest(spark, root)
    name, body = next((n, w.kinds[kind]) for n, w in SETS.items() if kind in w.kinds)
    key = SETS[name].key
    stored_bodies(spark, now, name, [body]).repartitionByRange(key).sortWithinPartitions(key).select(body).write.text(path)
