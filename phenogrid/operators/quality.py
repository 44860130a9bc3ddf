"""Data-quality checks. Each returns rows of (rule, violations) or the offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import grid
from phenogrid.rules import CLIMATE, LAND, MONTHS, OCEAN, RELIEF, SHARDS, SURFACE


def shard_owners(cells: DataFrame) -> DataFrame:
    """Number of shards that own each cell; anything but 1 is a gap or an overlap."""
    owners = reduce(
        lambda a, b: a + b,
        [F.when(grid.any_box(F.col("lat0"), F.col("lng0"), boxes), 1).otherwise(0) for _, _, boxes in SHARDS],
    )
    return cells.withColumn("owners", owners)


def incomplete_cells(facets: DataFrame) -> DataFrame:
    """Cells that lack some of the 12 months."""
    return facets.groupBy("cell").agg(F.count_distinct("month").alias("months")).where(F.col("months") < MONTHS)


def cover_report(hits: DataFrame, pixels: int | Column) -> DataFrame:
    """Pixels covered never and more than once, of a raster of ``pixels`` pixels (a number or an
    aggregate over the hits)."""
    size = F.lit(pixels) if isinstance(pixels, int) else pixels
    return hits.agg(
        (size - F.count("*")).alias("gaps"), F.count_if(F.col("hits") > 1).alias("overlaps"), F.count("*").alias("covered")
    )


def vector_violations(rows: DataFrame, *vectors: str) -> DataFrame:
    """Rows whose vectors are not 12 long or hold a negative value."""
    wrong = reduce(lambda a, b: a + b, [F.count_if(F.size(v) != MONTHS) for v in vectors])
    negative = reduce(lambda a, b: a + b, [F.count_if(F.array_min(v) < 0) for v in vectors])
    return rows.agg(wrong.alias("wrong_length"), negative.alias("negative"))


def sensitive_leaks(published: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Published rows of sensitive species; must count zero."""
    return published.join(sensitive.select("sci"), "sci", "left_semi").agg(F.count("*").alias("leaks"))


REQUIRED_LAYERS = {"surface": SURFACE, "climate": CLIMATE, "ocean": OCEAN, "land": LAND, "relief": RELIEF}


def layer_violations(channels: DataFrame) -> DataFrame:
    """Layer contract: the required channels in order, a non-empty range and a source.

    ``channels`` has layer, ord, name, lo, hi, source, months. One row per rule and layer.
    """
    expected: Column = F.lit(None).cast("string")
    for layer, wanted in REQUIRED_LAYERS.items():
        for i, ch in enumerate(wanted):
            expected = F.when((F.col("layer") == layer) & (F.col("ord") == i), F.lit(ch.name)).otherwise(expected)
    checked = channels.withColumn("_expected", expected)
    return checked.groupBy("layer").agg(
        F.count_if(F.col("_expected").isNotNull() & ~F.col("name").eqNullSafe(F.col("_expected"))).alias("wrong_channel"),
        F.count_if(~F.coalesce(F.col("hi") > F.col("lo"), F.lit(False))).alias("empty_range"),
        F.count_if(F.coalesce("source", F.lit("")) == "").alias("no_source"),
        F.count_if(F.coalesce(F.col("months") != MONTHS, F.lit(True))).alias("not_twelve_months"),
    )
