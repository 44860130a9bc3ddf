"""Exact deduplication: 128-bit content hash, smallest stable id, byte comparison inside groups. DataFrame operations only.

Texts are equal when they are identical after each run of ASCII white space became one space. A null text counts as
empty, and empty texts are copies of each other. Rows without a doc_id rank behind all others; of rows that repeat both
id and text exactly one is kept. Very long texts are hashed and compared whole. ``decide`` reads doc_id and text only;
``exact_dedup`` carries the caller's row in a struct, whatever its columns are called. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import carried, salt_of, salted_groups, stored

Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """One space for each run of white space; runs that are one space already need no replacement."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """The 16 bytes of MD5 over the UTF-8 text."""
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, digest: Digest) -> DataFrame:
    return docs.select("doc_id", normalised(F.col("text")).alias("body")).select("doc_id", "body", digest(F.col("body")).alias("hash"), salt_of("doc_id").alias("salt"))


def collided(docs: DataFrame, groups: DataFrame, digest: Digest = content_hash) -> DataFrame:
    """Hashes whose group holds different bytes.

    Only members of groups reach the comparison: least and greatest text of a group differ if any two do. Both are
    taken per part of the group first. The list of groups grows with the table, so it is never broadcast.
    """
    members = _keyed(docs, digest).join(groups.select("hash", "salt").hint("merge"), ["hash", "salt"], "left_semi")
    parts = members.groupBy("hash", "salt").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return parts.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("hash")


def decide(docs: DataFrame, digest: Digest = content_hash) -> DataFrame:
    """One row per input row: doc_id, hash, text_sha256, keep_id, group_size, kept (stored in the shared folder)."""
    rows = stored(
        _keyed(docs, digest).select("doc_id", "hash", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"), "salt", F.monotonically_increasing_id().alias("row")),
        "exact-rows",
    )
    best = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("row"))
    groups = stored(salted_groups(rows, ["hash"], best), "exact-groups")
    mixed = stored(collided(docs, groups, digest), "exact-mixed")
    if mixed.isEmpty():
        joined = rows.join(groups.hint("merge"), ["hash", "salt"], "left")
    else:  # the members of such hashes are grouped by their bytes instead
        inside = _keyed(docs, digest).join(mixed, "hash", "left_semi").select(
            "doc_id", "hash", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"), "salt", F.monotonically_increasing_id().alias("row"), F.col("body").alias("variant"),
        )
        rows = stored(rows.withColumn("variant", F.lit("")).join(mixed, "hash", "left_anti").unionByName(inside), "exact-rows")
        joined = rows.join(salted_groups(rows, ["hash", "variant"], best), ["hash", "variant", "salt"], "left")
    single = F.col("first").isNull()
    return joined.select(
        "doc_id",
        "hash",
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.when(single, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("first.row") == F.col("row"))).alias("kept"),
    )


def exact_dedup(docs: DataFrame, digest: Digest = content_hash) -> DataFrame:
    """The documents that stay, with all their columns: the smallest doc_id of each group of equal texts."""
    rows = decide(docs, digest)
    gone = stored(rows.groupBy("doc_id", "hash").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("stay")).where("stay < n"), "exact-gone")
    hashed = carried(docs).select("row", "doc_id", digest(normalised(F.col("text"))).alias("own"))
    out = hashed.join(gone.hint("merge"), (hashed["own"] == gone["hash"]) & hashed["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
    repeated = gone.where("stay > 0")
    if not repeated.isEmpty():
        again = hashed.join(repeated, (hashed["own"] == repeated["hash"]) & hashed["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi")
        out = out.unionByName(again.dropDuplicates(["doc_id", "own"]))
    return out.select("row.*")
