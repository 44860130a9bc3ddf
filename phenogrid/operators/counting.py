"""Occurrence records to monthly counts and effort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import grid, months
from phenogrid.functions.text import clean
from phenogrid.rules import MONTHS, SENSITIVE, QualityWindow


class SensitiveSpeciesError(ValueError):
    """A query names a species that is never shown at fine resolution."""


def usable_records(records: DataFrame, window: QualityWindow = QualityWindow()) -> DataFrame:
    """Quality predicate on raw columns only, so that all of it reaches the parquet scan."""
    return records.where(
        (F.col("class") == window.class_name)
        & (F.col("status") == window.status)
        & F.col("has_coordinate")
        & ~F.col("has_issue")
        & F.col("year").between(window.first_year, window.last_year)
        & F.col("month").isNotNull()
    )


def without_sensitive(records: DataFrame, sensitive: Sequence[str] = SENSITIVE) -> DataFrame:
    """Drop sensitive species altogether; records named to no species stay."""
    if not sensitive:
        return records
    return records.where(F.col("sci").isNull() | ~F.col("sci").isin(*sensitive))


def mask_sensitive(counts: DataFrame, sensitive: Sequence[str] = SENSITIVE) -> DataFrame:
    """Hide the names of sensitive species; their rows still count as effort."""
    if not sensitive:
        return counts
    hidden = F.coalesce(F.col("sci").isin(*sensitive), F.lit(False))
    return counts.withColumns({name: F.when(~hidden, F.col(name)) for name in ("sci", "specieskey", "family")})


def refuse_sensitive(names: Sequence[str], sensitive: Sequence[str] = SENSITIVE) -> None:
    """Fail before anything is planned when a query names a sensitive species."""
    named = sorted(set(names) & set(sensitive))
    if named:
        raise SensitiveSpeciesError(f"sensitive, not answered at fine resolution: {', '.join(named)}")


def in_window(records: DataFrame, country: str, lat: tuple[float, float], lng: tuple[float, float]) -> DataFrame:
    """Records of one country inside a half-open coordinate window."""
    return records.where(
        (F.col("country") == country) & grid.in_box(F.col("lat"), F.col("lng"), (*lat, *lng))
    )


def in_shard(records: DataFrame, shard_id: str) -> DataFrame:
    """Records inside a shard, tested on raw coordinates."""
    return records.where(
        grid.any_box(F.col("lat"), F.col("lng"), grid.shard_boxes(shard_id), grid.in_shard_box)
    )


def count_records(records: DataFrame) -> DataFrame:
    """Records per species, month and one-degree cell; ``sci`` is NULL above species level.

    The only shuffle is on the full grouping key, after map-side counting.
    """
    return (
        records.groupBy(
            "sci", "specieskey", "family", "month",
            grid.snap_lat(F.col("lat")).alias("lat0"), grid.snap_lng(F.col("lng")).alias("lng0"),
        )
        .agg(F.count("*").alias("n"))
    )


def typed_counts(raw: DataFrame) -> DataFrame:
    """String rows of a counts file to typed month counts, bad months dropped."""
    return raw.select(
        clean(F.col("specieskey")).alias("specieskey"),
        clean(F.col("species")).alias("sci"),
        clean(F.col("family")).alias("family"),
        F.col("month").cast("int").alias("month"),
        grid.snap_lat(F.col("lat0").cast("double")).alias("lat0"),
        grid.snap_lng(F.col("lng0").cast("double")).alias("lng0"),
        F.col("n").cast("long").alias("n"),
    ).where(F.col("month").between(1, MONTHS))


def in_shard_cells(counts: DataFrame, shard_id: str) -> DataFrame:
    """Count rows whose cell belongs to the shard (anything outside is dropped)."""
    return counts.where(grid.any_box(F.col("lat0"), F.col("lng0"), grid.shard_boxes(shard_id)))


def with_cell(counts: DataFrame) -> DataFrame:
    return counts.withColumn("cell", grid.cell_id(F.col("lat0"), F.col("lng0")))


def species_months(counts: DataFrame) -> DataFrame:
    """Month pivot per species and cell; rows without a species are left out."""
    return (
        with_cell(counts).where(F.col("sci").isNotNull())
        .groupBy("sci", "cell")
        .agg(
            F.min("specieskey").alias("specieskey"), F.min("family").alias("family"),
            months.sum_by_month("n").alias("c"),
        )
    )


def effort_months(counts: DataFrame) -> DataFrame:
    """Month pivot per cell over all rows: the effort."""
    return with_cell(counts).groupBy("cell").agg(months.sum_by_month("n").alias("t"))


def month_grid(records: DataFrame) -> DataFrame:
    """Month vectors per species and cell straight from records, NULL species included.

    One scan and one shuffle on (species, cell) after map-side counting; species pairs and effort
    both follow from it.
    """
    south, west = grid.snap_lat(F.col("lat")), grid.snap_lng(F.col("lng"))
    return records.groupBy("sci", south.alias("lat0"), west.alias("lng0")).agg(
        months.sum_by_month("1").alias("c")
    ).select("sci", grid.cell_id(F.col("lat0"), F.col("lng0")).alias("cell"), "c")


def split_grid(gridded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, effort) of a month grid.

    The species test also names the vector (a count is never negative). A test of the species alone
    would be pushed into the scan of one branch, and the two branches could no longer share the scan
    and its shuffle.
    """
    pairs = gridded.where(F.expr("CASE WHEN c[0] >= 0 THEN sci IS NOT NULL ELSE false END"))
    effort = gridded.groupBy("cell").agg(months.sum_vectors("c").alias("t"))
    return pairs, effort


def merge_pairs(pairs: DataFrame, *keys: str) -> DataFrame:
    """Partial pivots to final ones: vectors of equal keys are added up."""
    return pairs.groupBy(*keys).agg(months.sum_vectors("c").alias("c"))


def merge_effort(effort: DataFrame) -> DataFrame:
    """Effort of all shards per cell; cells without any effort in the year are dropped."""
    return (
        effort.groupBy("cell").agg(months.sum_vectors("t").alias("t")).where(months.total("t") > 0)
    )


def dense_months(facets: DataFrame, keys: Sequence[str], month: str = "month", n: str = "n") -> DataFrame:
    """Sparse month facets to dense vectors; months outside 1..12 are ignored."""
    return facets.groupBy(*keys).agg(months.sum_by_month(n, month).alias("c"))


def shard_metrics(counts: DataFrame) -> DataFrame:
    """Rows and records per shard, plus pairs, species and cells of the pivots, without a pivot.

    Distinct counts run on pre-aggregated (shard, cell, sci) rows.
    """
    shard = grid.shard_of()
    pairs = (
        with_cell(counts).withColumn("shard", shard)
        .groupBy("shard", "cell", "sci").agg(F.count("*").alias("rows"), F.sum("n").alias("records"))
    )
    return pairs.groupBy("shard").agg(
        F.sum("rows").alias("rows"),
        F.sum("records").cast("long").alias("records"),
        F.count("sci").alias("pairs"),
        F.count_distinct("sci").alias("species"),
        F.count_distinct("cell").alias("cells"),
    )


def species_list(pairs: DataFrame) -> DataFrame:
    """Distinct species over all shards with their first key and family."""
    return pairs.groupBy("sci").agg(F.min("specieskey").alias("specieskey"), F.min("family").alias("family"))


def effort_for_cells(records: DataFrame, cells: DataFrame) -> DataFrame:
    """Effort vectors of the given cells only."""
    return effort_months(records).join(cells.select("cell").distinct(), "cell", "left_semi")


def effort_by_class(records: DataFrame, cells: DataFrame) -> DataFrame:
    """Effort vectors per class and cell, of the given cells only."""
    grouped = with_cell(records).groupBy("class", "cell").agg(months.sum_by_month("n").alias("t"))
    return grouped.join(cells.select("cell").distinct(), "cell", "left_semi")
