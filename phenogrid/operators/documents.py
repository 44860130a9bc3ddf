"""Published documents: cell documents, species documents, the indexes and the coverage manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenogrid.functions import months, text
from phenogrid.rules import SHARDS, CoverageRules
from phenogrid.session import cut_lineage

EMPTY_LIST = "array<struct<k:string,c:array<bigint>,p:string,m:array<int>>>"


def cell_rows(labelled: DataFrame, effort: DataFrame, rules: CoverageRules = CoverageRules()) -> DataFrame:
    """One row per cell with all that its document and its index entry say.

    A cell lists each taxon once, so its list is bounded by the taxa. Only the effort moves to the gathered lists; cells
    with effort but no named species come out with an empty list and no richness.
    """
    entry = F.struct(F.col("key").alias("k"), F.col("c"), F.col("p"), months.flags_vector("m").alias("m"))
    listed = labelled.groupBy("cell").agg(F.sort_array(F.collect_list(entry)).alias("species"), months.count_positive("c").alias("richness"))
    none = F.array(*[F.lit(0).cast("long")] * 12)
    return effort.join(listed, "cell", "left").select(
        F.col("cell").alias("id"), F.col("t").alias("total"), F.coalesce("species", F.array().cast(EMPTY_LIST)).alias("species"),
        F.coalesce("richness", none).alias("richness"), months.coverage_vector("t", rules).alias("coverage"),
    )


def cell_documents(labelled: DataFrame, effort: DataFrame) -> DataFrame:
    """One document per cell: total[12] and the species with counts, label and month flags."""
    return cell_rows(labelled, effort).select("id", "total", "species")


def with_units(labelled: DataFrame) -> DataFrame:
    """Adds the rates in whole units, unless they are stored with the table."""
    return labelled if "u" in labelled.columns else labelled.withColumn("u", months.units("c", "t"))


def species_rows(labelled: DataFrame) -> DataFrame:
    """One row per species: its cells with rates rounded to four digits and label, in order, and how many they are.

    A species has at most one entry per grid cell.
    """
    entry = F.struct(F.col("cell"), F.struct(months.from_units("u").alias("r"), F.col("p")).alias("v"))
    rows = with_units(labelled).groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return rows.select(F.col("key").alias("k"), "entries", F.size("entries").cast("long").alias("cells"))


def species_documents(labelled: DataFrame) -> DataFrame:
    """One document per species: cell -> rates and label."""
    return species_rows(labelled).select("k", F.map_from_entries("entries").alias("cells"))


def richness(labelled: DataFrame) -> DataFrame:
    """Species with records per cell and month."""
    return labelled.groupBy("cell").agg(months.count_positive("c").alias("richness"))


def cell_index(labelled: DataFrame, effort: DataFrame, rules: CoverageRules = CoverageRules()) -> DataFrame:
    """Every cell: effort, richness and coverage per month."""
    none = F.array(*[F.lit(0).cast("long")] * 12)
    return effort.join(richness(labelled), "cell", "left").select(
        F.col("cell").alias("id"), F.col("t").alias("total"), F.coalesce("richness", none).alias("richness"),
        months.coverage_vector("t", rules).alias("coverage"),
    )


def species_index(labelled: DataFrame, names: DataFrame) -> DataFrame:
    """Searchable species list: names by key and the number of cells."""
    return named_index(labelled.groupBy("key").agg(F.count("*").alias("cells")), names)


def with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds sci, name and family to rows with a ``key``: the first of those that share a key; species without one go by
    their key."""
    by_key = names.groupBy("key").agg(
        F.min("sci").alias("sci"), F.min_by("common", "sci").alias("common"), F.min_by("family", "sci").alias("family")
    )
    return rows.join(by_key, "key", "left").select(
        *rows.columns,
        F.coalesce("sci", "key").alias("sci"),
        F.coalesce(F.nullif(F.col("common"), F.lit("")), "sci", "key").alias("name"),
        F.coalesce("family", F.lit("")).alias("family"),
    )


def named_index(counted: DataFrame, names: DataFrame) -> DataFrame:
    """Names for (key, cells)."""
    return with_names(counted, names).select(F.col("key").alias("k"), "sci", "name", "family", "cells")


BODIES = "value string, hash bigint, bytes bigint, entry string, entry_hash bigint, entry_bytes bigint"


def bodies(rows: DataFrame, key: str, document: list[str | Column], entry: list[str | Column]) -> DataFrame:
    """One row per key with all that is published of it: the document and its index entry as JSON, a hash and the length of
    each."""
    made = rows.select(key, F.to_json(F.struct(*document)).alias("value"), F.to_json(F.struct(*entry)).alias("entry"))
    each = [(c, p, F.xxhash64(c).alias(f"{p}hash"), F.octet_length(c).cast("long").alias(f"{p}bytes")) for c, p in (("value", ""), ("entry", "entry_"))]
    return made.select(key, *[c for name, _, *rest in each for c in (name, *rest)])


def cell_bodies(cells: DataFrame) -> DataFrame:
    """From ``cell_rows``."""
    return bodies(cells, "id", ["id", "total", "species"], ["id", "total", "richness", "coverage"])


def species_bodies(species: DataFrame, names: DataFrame) -> DataFrame:
    """From ``species_rows``. Cells without a rate entry don't exist, so the order of the entries is that of the cells."""
    named = with_names(species.withColumnRenamed("k", "key"), names).withColumnRenamed("key", "k")
    return bodies(named, "k", ["k", F.map_from_entries("entries").alias("cells")], ["k", "sci", "name", "family", "cells"])


def regions_frame(like: DataFrame) -> DataFrame:
    """The shards in publishing order, with their boxes."""
    return like.sparkSession.createDataFrame(
        [(i, shard, name, [[float(x) for x in box] for box in boxes]) for i, (shard, name, boxes) in enumerate(SHARDS)],
        "ord int, id string, name string, boxes array<array<double>>",
    )


def coverage_manifest(metrics: DataFrame) -> DataFrame:
    """Every known region, loaded or pending, with its boxes, metrics, time of ingest and DOI where they are known."""
    optional = [F.col(c) if c in metrics.columns else F.lit(None).cast("string").alias(c) for c in ("built", "doi")]
    m = metrics.select(F.col("shard").alias("id"), "records", "cells", "species", *optional)
    return regions_frame(metrics).join(m, "id", "left").select(
        "ord", "id", "name", "boxes", F.when(F.col("records").isNull(), "pending").otherwise("loaded").alias("status"),
        "records", "cells", "species", "built", "doi",
    )


def meta(manifest: DataFrame, source: str, measure: str, generated: str) -> DataFrame:
    """One row that says what the product is: source, measure, coverage, and the DOIs of the regions. Bounded by the shards."""
    loaded = F.col("status") == "loaded"
    state = manifest.agg(
        F.bool_and(loaded).alias("complete"),
        F.array_sort(F.collect_list(F.when(loaded, F.struct("ord", "name")))).alias("names"),
        F.array_sort(F.collect_list(F.when(F.col("doi").isNotNull(), F.struct("ord", F.col("id").alias("region"), "doi")))).alias("found"),
    )
    return state.select(
        F.lit(source).alias("source"), F.lit("month").alias("resolution"), F.lit(measure).alias("measure"),
        F.when(F.col("complete"), "worldwide").otherwise(F.array_join(F.transform("names", lambda x: x["name"]), ", ")).alias("coverage"),
        F.transform("found", lambda x: F.struct(x["region"].alias("region"), x["doi"].alias("doi"))).alias("datasets"), F.lit(generated).alias("generated"),
    )


def coverage_state(manifest: DataFrame) -> DataFrame:
    """Are all regions loaded, which are, and what to tell a reader where no list exists.

    The manifest has one row per shard, so the list of names is bounded by the shard table.
    """
    named = F.collect_list(F.when(F.col("status") == "loaded", F.struct("ord", "name")))
    pending = F.count_if(F.col("status") != "loaded")
    state = manifest.agg(
        F.bool_and(F.col("status") == "loaded").alias("complete"),
        F.transform(F.array_sort(named), lambda x: x["name"]).alias("names"),
        pending.alias("pending"),
    )
    n = F.col("pending")
    rest = F.when(n == 0, "").otherwise(
        F.concat(F.lit("; "), n.cast("string"), F.when(n == 1, " more region is").otherwise(" more regions are"), F.lit(" on the way"))
    )
    note = (
        F.when(F.col("complete"), "No bird records in this grid square yet.")
        .when(F.size("names") == 0, "Species lists are still loading region by region.")
        .otherwise(F.concat(
            F.lit("Species lists cover "), text.name_list(F.col("names")), F.lit(" for now"), rest,
            F.lit(". Elsewhere the globe shows the ranges of species recorded there."),
        ))
    )
    return state.select("complete", F.array_join("names", ", ").alias("loaded"), "pending", note.alias("note"))


def dense_ids(keys: DataFrame, column: str) -> DataFrame:
    """0-based ids of distinct text keys in sorted order.

    Keys are dealt out by ranges and numbered inside each; only the sizes of the ranges, one per partition, meet. The
    dealt keys are stored, because sizes and numbers must come from one and the same dealing.
    """
    ranged = cut_lineage(keys.select(column).distinct().repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.withColumn("_i", inside).join(offsets, "_range").select(
        column, (F.col("_offset") + F.col("_i") - 1).cast("int").alias("id")
    )


def place_csv_rows(labelled: DataFrame, effort: DataFrame, species: DataFrame) -> DataFrame:
    """Rows of the place export per cell: the effort row first, then species by yearly records."""
    named = labelled.join(species.select(F.col("k").alias("key"), "sci", "name"), "key", "left") if "sci" not in labelled.columns else labelled
    blank = F.lit("")
    first = effort.select(
        "cell", F.lit(0).alias("ord"), F.lit(None).cast("long").alias("records"), blank.alias("taxon_key"),
        F.lit("ALL BIRD RECORDS").alias("scientific_name"), blank.alias("common_name"), blank.alias("presence"),
        *[months.at("t", i).alias(f"records_{m}") for i, m in enumerate(MONTH_FIELDS)],
        *[F.lit(None).cast("int").alias(f"present_{m}") for m in MONTH_FIELDS],
    )
    rest = named.select(
        "cell", F.lit(1).alias("ord"), months.total("c").alias("records"), F.col("key").alias("taxon_key"),
        text.formula_safe(F.coalesce("sci", blank)).alias("scientific_name"),
        text.formula_safe(F.coalesce("name", blank)).alias("common_name"), F.col("p").alias("presence"),
        *[months.at("c", i).alias(f"records_{m}") for i, m in enumerate(MONTH_FIELDS)],
        *[months.has_month("m", i).cast("int").alias(f"present_{m}") for i, m in enumerate(MONTH_FIELDS)],
    )
    return first.unionByName(rest)


MONTH_FIELDS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def species_csv_rows(labelled: DataFrame, species: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """Rows of the species export: rates and share of the species' peak rate per cell.

    The peak per species is a partial aggregate joined back, not a window over the species. Shares
    are rounded half up in whole units of 1e-4, which leaves no tie to the floating point.
    """
    rounded = with_units(labelled).withColumn("r", months.from_units("u"))
    peak = rounded.groupBy("key").agg(F.max(F.array_max("u")).alias("_peak"))
    joined = rounded.join(peak, "key").join(species.select(F.col("k").alias("key"), F.col("sci").alias("_sci")), "key", "left")
    top = F.when(F.col("_peak") > 0, F.col("_peak")).otherwise(F.lit(10_000).cast("long"))
    parts = F.split("cell", "_")
    return joined.select(
        F.col("key").alias("taxon_key"), F.coalesce("_sci", F.lit("")).alias("scientific_name"), F.col("cell").alias("cell_id"),
        F.get(parts, F.lit(0)).cast("double").alias("lat_min"), F.get(parts, F.lit(1)).cast("double").alias("lng_min"),
        F.lit(cell_size).alias("cell_size_deg"), F.col("p").alias("presence"),
        *[months.at("r", i).alias(f"rate_{m}") for i, m in enumerate(MONTH_FIELDS)],
        *[(F.call_function("div", months.at("u", i) * 20_000 + top, top * 2) / 10_000).alias(f"of_peak_{m}") for i, m in enumerate(MONTH_FIELDS)],
    )


def content_hash(columns: list[str]) -> Column:
    """Hash over the content of a document; maps as their entries, which documents keep in order."""
    return F.xxhash64(*[F.col(c) for c in sorted(columns)])


def hashes(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and content hash, all that a later build needs to know of a document."""
    maps = {f.name: F.map_entries(f.name) for f in documents.schema.fields if f.dataType.typeName() == "map"}
    return documents.withColumns(maps).select(*keys, content_hash([c for c in documents.columns if c not in keys]).alias("hash"))


def hash_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """State of every document from stored hashes: unchanged, changed, added or removed."""
    joined = old.withColumnRenamed("hash", "_old").join(new.withColumnRenamed("hash", "_new"), keys, "full_outer")
    state: Column = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    )
    return joined.select(*keys, state.alias("state"))


def document_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The same from whole documents."""
    return hash_diff(hashes(old, keys), hashes(new, keys), keys)


def publish_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[
        F.count_if(F.col("state") == s).alias(s) for s in ("unchanged", "changed", "added", "removed")
    ])


def build_summary(labelled: DataFrame, effort: DataFrame, manifest: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row: loaded regions, cells, species, species-cells, and what publishing changed (documents changed or added,
    removed, and bytes written)."""
    totals = labelled.groupBy("key").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("species"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("species_cells")
    )
    cells = effort.agg(F.count("*").alias("cells"))
    regions = manifest.agg(F.count_if(F.col("status") == "loaded").alias("regions"))
    parts = [regions, cells, totals]
    if changes is not None:
        parts.append(changes.agg(
            F.count_if(F.col("state").isin("changed", "added")).alias("changed"), F.count_if(F.col("state") == "removed").alias("removed"),
            F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
        ))
    keyed = [f.withColumn("_one", F.lit(1)) for f in parts]
    out = keyed[0]
    for frame in keyed[1:]:
        out = out.join(frame, "_one")
    return out.drop("_one")
