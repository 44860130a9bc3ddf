"""Readers with explicit schemas: nothing is inferred, so a scan never reads a file twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.rules import MONTHS

COUNT_COLUMNS = ("specieskey", "species", "family", "month", "lat0", "lng0", "n")


def counts_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated counts, all strings, no quoting: quotes and backslashes are plain text."""
    schema = ", ".join(f"`{c}` string" for c in COUNT_COLUMNS)
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="", comment="")


def shard_table(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """All shards of a partitioned table, or some: the partition column prunes the rest."""
    table = spark.read.parquet(path)
    return table if shards is None else table.where(F.col("shard").isin(*shards))


FACET_SCHEMA = "cell string, count bigint, species map<string, bigint>"


def facet_files(spark: SparkSession, path: str) -> DataFrame:
    """Cached facet bodies per cell and month; the month comes from the ``mMM`` part of the path."""
    month = F.regexp_extract("_metadata.file_path", r"[/=]m(\d{1,2})(?:\.json|/[^/]*)$", 1).cast("int")
    return spark.read.schema(FACET_SCHEMA).json(path, recursiveFileLookup=True).select("cell", month.alias("month"), "count", "species")


def cell_summaries(facets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(effort, species counts, incomplete cells) of the cells that have all 12 months."""
    months_seen = facets.groupBy("cell").agg(F.count_distinct("month").alias("months"))
    complete = months_seen.where(F.col("months") == MONTHS).select("cell")
    whole = facets.join(complete, "cell", "left_semi")
    effort = whole.select("cell", "month", F.coalesce("count", F.lit(0)).alias("n"))
    species = whole.select("cell", "month", F.explode("species").alias("key", "n"))
    return effort, species, months_seen.where(F.col("months") < MONTHS)


def species_records(spark: SparkSession, path: str) -> DataFrame:
    """Species records as a names dimension."""
    raw = spark.read.schema("key string, scientific string, common string, family string, `order` string").json(path)
    empty = F.lit("")
    return raw.select(
        "key", F.coalesce("scientific", empty).alias("sci"), F.coalesce("common", empty).alias("common"),
        F.coalesce("family", empty).alias("family"), F.coalesce("order", empty).alias("order"),
    )


RANGE_SCHEMA = (
    "key string, name struct<key:string, scientific:string, common:string, family:string>, "
    "cells map<string, array<array<bigint>>>"
)


def global_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Worldwide ranges: one row per (key, cell) with counts ``c`` and effort ``t``."""
    raw = spark.read.schema(RANGE_SCHEMA).json(path)
    return raw.select("key", "name", F.explode("cells").alias("cell", "_v")).select(
        "key", F.col("name.scientific").alias("sci"), F.col("name.common").alias("common"), F.col("name.family").alias("family"),
        "cell", F.get("_v", F.lit(0)).alias("c"), F.get("_v", F.lit(1)).alias("t"),
    )


INDEX_SCHEMA = "k string, sci string, name string, family string, cells bigint"


def species_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).json(path)


def geonames_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of a place dump, one string column ``value``."""
    return spark.read.text(path)


def admin_codes(spark: SparkSession, path: str) -> DataFrame:
    """First-order divisions: lines with a code and at least two fields."""
    fields = F.split("value", "\t", -1)
    return spark.read.text(path).select(F.get(fields, F.lit(0)).alias("code"), F.get(fields, F.lit(1)).alias("name")).where(
        (F.col("code") != "") & F.col("name").isNotNull()
    )


ENTITY_SCHEMA = (
    "id string, label string, title string, aliases array<string>, "
    "claims map<string, array<struct<rank:string, value:string>>>"
)


def entity_dump(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge-base entities, one JSON object per line."""
    return spark.read.schema(ENTITY_SCHEMA).json(path)


def entity_claims(entities: DataFrame) -> DataFrame:
    """(item, prop, pos, rank, value): every claim in the order it is stated."""
    stated = entities.select(F.col("id").alias("item"), F.explode("claims").alias("prop", "_c"))
    return stated.select("item", "prop", F.posexplode("_c").alias("pos", "_v")).select("item", "prop", "pos", "_v.*")


def facet_body(body: str = "body") -> tuple:
    """Parse one facet body column: (count, entries); a body without a count is not a facet."""
    parsed = F.from_json(F.col(body), "count bigint, facets array<struct<counts:array<struct<name:string,count:bigint>>>>")
    entries = F.flatten(F.transform(F.coalesce(parsed["facets"], F.array()), lambda f: f["counts"]))
    return parsed["count"], entries


def pixel_centres(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Longitude and latitude of pixel centres of a global north-up grid."""
    return pixels.withColumns({
        "lng": F.lit(-180.0) + (F.col("gx") + 0.5) * (360.0 / width), "lat": F.lit(90.0) - (F.col("gy") + 0.5) * (180.0 / height),
    })
