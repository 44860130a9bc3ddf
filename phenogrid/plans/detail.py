"""Detail region plus worldwide ranges of featured species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import months
from phenogrid.operators import counting, documents, drill, naming, presence
from phenogrid.rules import CoverageRules, DrillRules, PresenceRules
from phenogrid.sources import files


def featured_ranges(counts: DataFrame, names: list[str], sensitive: tuple[str, ...], rules: DrillRules = DrillRules()) -> DataFrame:
    """Month vectors of featured species in the cells the drill-down keeps, with the effort of their own class.

    ``counts`` has a column ``class``: a turtle is divided by reptiles, not by birds.
    A sensitive name is refused before anything is planned.
    """
    counting.refuse_sensitive(names, sensitive)
    cells = drill.drill_down(counts.where(F.col("sci").isin(*names)), rules)
    return with_own_effort(cells, counts)


def with_own_effort(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Species-cells (sci, cell, c) with the effort ``t`` of the species' class in the cell."""
    of_class = counts.where(F.col("sci").isNotNull()).groupBy("sci").agg(F.min("class").alias("class"))
    return cells.select("sci", "cell", "c").join(of_class, "sci").join(counting.effort_by_class(counts, cells), ["class", "cell"]).drop("class")


def build(
    facets: DataFrame, names: DataFrame, ranges: DataFrame, rules: PresenceRules = PresenceRules(), coverage: CoverageRules = CoverageRules(),
) -> dict[str, DataFrame]:
    """Cell documents, indexes and species ranges of a detail region.

    ``facets`` are cached bodies per cell and month, ``ranges`` worldwide rows (key, cell, c, t,
    sci, common, family) that win over the region where both cover a cell. Each of these rows brings its own effort: two
    species of different classes in one cell are divided by different totals.
    """
    effort_rows, species_rows, _ = files.cell_summaries(facets)
    effort = counting.dense_months(effort_rows, ["cell"]).withColumnRenamed("c", "t").where(months.total("t") > 0)
    pairs = counting.dense_months(species_rows, ["cell", "key"])
    labelled = presence.label_presence(pairs, effort, rules)
    wide = presence.label_with_effort(ranges.select("key", "cell", "c", "t"), rules)
    columns = ["key", "cell", "c", "t", "r", "m", "p"]
    together = naming.override_ranges(labelled.select(*columns), wide.select(*columns))
    counted = together.groupBy("key").agg(F.count("*").alias("cells"))
    range_names = ranges.groupBy("key").agg(F.min("sci").alias("sci"), F.min("common").alias("common"), F.min("family").alias("family"))
    return {
        "cells": documents.cell_documents(labelled, effort), "cell_index": documents.cell_index(labelled, effort, coverage),
        "species": documents.species_documents(together), "species_index": naming.default_names(counted, names, range_names),
    }
