"""Names of species: resolution by priority, keys, sensitive and override rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import months


def first_wins(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of sources of decreasing priority, one row per key.

    ``min_by`` keeps a single row per key and combines on the map side, so a key repeated in every
    source costs no sort and no hot window partition.
    """
    columns = frames[0].columns
    ranked = None
    for i, frame in enumerate(frames):
        part = frame.select(*columns).withColumn("_source", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    rest = [c for c in columns if c != key]
    order = F.struct("_source", *rest)
    return ranked.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def resolve_names(wanted: DataFrame, cache: DataFrame, checklist: DataFrame, match: DataFrame) -> DataFrame:
    """Names for (sci, specieskey, family): cache, then checklist, then match, then a fallback record.

    A species no source knows keeps its own key, else its scientific name, and is flagged.
    """
    known = first_wins([cache, checklist, match], "sci").withColumnRenamed("family", "known_family")
    joined = wanted.join(known, "sci", "left")
    return joined.select(
        "sci",
        F.coalesce("key", F.nullif(F.col("specieskey"), F.lit("")), "sci").alias("key"),
        F.coalesce("common", F.lit("")).alias("common"),
        F.coalesce(F.nullif(F.col("known_family"), F.lit("")), "family", F.lit("")).alias("family"),
        F.col("key").isNull().alias("unmatched"),
    )


def with_keys(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Key of each pair by scientific name; a species without a names row keeps its scientific name.

    No hint on the names side: it grows with the taxa, so Spark checks its size.
    """
    return pairs.join(names.select("sci", F.col("key").alias("_key")), "sci", "left").select(
        F.coalesce("_key", "sci").alias("key"), *[F.col(c) for c in pairs.columns]
    )


def drop_sensitive(pairs: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Pairs of species that are not on the sensitive list (a table; its size is checked by Spark)."""
    return pairs.join(sensitive.select("sci"), "sci", "left_anti")


def override_ranges(detail: DataFrame, ranges: DataFrame) -> DataFrame:
    """Worldwide ranges win over detail for the same (key, cell); cells known elsewhere are added."""
    columns = detail.columns
    kept = detail.join(ranges.select("key", "cell"), ["key", "cell"], "left_anti")
    return kept.unionByName(ranges.select(*columns))


def default_names(species: DataFrame, names: DataFrame, range_names: DataFrame) -> DataFrame:
    """Species index names: the names dimension first, then what the range brought, then the key."""
    n = names.select("key", F.col("sci").alias("n_sci"), F.col("common").alias("n_common"), F.col("family").alias("n_family"))
    r = range_names.select("key", F.col("sci").alias("r_sci"), F.col("common").alias("r_common"), F.col("family").alias("r_family"))
    joined = species.join(n, "key", "left").join(r, "key", "left")
    known = F.col("n_sci").isNotNull() | F.col("n_common").isNotNull() | F.col("n_family").isNotNull()
    pick = {c: F.when(known, F.col(f"n_{c}")).otherwise(F.col(f"r_{c}")) for c in ("sci", "common", "family")}
    sci = F.nullif(pick["sci"], F.lit(""))
    return joined.select(
        *species.columns,
        F.coalesce(sci, "key").alias("sci"),
        F.coalesce(F.nullif(pick["common"], F.lit("")), sci, "key").alias("name"),
        F.coalesce(pick["family"], F.lit("")).alias("family"),
    )


def add_missing(listed: DataFrame, featured: DataFrame, key: str = "sci") -> DataFrame:
    """The list plus those featured entries it does not hold."""
    extra = featured.join(listed.select(key), key, "left_anti")
    return listed.unionByName(extra, allowMissingColumns=True)


def still_to_do(planned: DataFrame, have: DataFrame, *keys: str) -> DataFrame:
    return planned.join(have.select(*keys), list(keys), "left_anti")


def name_records(raw: DataFrame, *keep: str) -> DataFrame:
    """Name record from the fields a checklist entry may carry, first non-empty wins."""

    def first(*fields: str):
        return F.coalesce(*[F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields], F.lit(""))

    return raw.select(
        *keep, first("acceptedKey", "speciesKey", "key", "usageKey").alias("key"),
        first("canonicalName", "scientificName").alias("sci"),
        first("common", "english", "vernacularName").alias("common"),
        first("family").alias("family"),
        first("order").alias("order"),
    )


def range_rates(ranges: DataFrame) -> DataFrame:
    """Rates of a worldwide range from its own counts and effort."""
    return ranges.withColumn("r", months.rates("c", "t")).withColumn("r", months.rounded("r"))


def english_names(rows: DataFrame, entity: str, order: str) -> DataFrame:
    """First non-empty English name of each entity, in the given order; empty if there is none. Nothing is listed."""
    good = F.col("language").isin("eng", "en") & (F.col("name") != "")
    return rows.groupBy(entity).agg(F.coalesce(F.min_by("name", F.when(good, F.col(order))), F.lit("")).alias("name"))
