"""Hierarchical drill-down: open only the boxes that hold enough of a species' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenogrid.functions import grid, months
from phenogrid.rules import DrillRules
from phenogrid.session import cut_lineage


def box_edge(value: Column, low: int, size: int) -> Column:
    return (F.floor((value - low) / size) * size + low).cast("int")


def with_boxes(rows: DataFrame, size: int) -> DataFrame:
    """Adds the south-west corner of the box of ``size`` degrees that holds (lat0, lng0)."""
    return rows.withColumns({
        f"lat_{size}": box_edge(F.col("lat0"), -90, size), f"lng_{size}": box_edge(F.col("lng0"), -180, size),
    })


def kept_boxes(boxes: DataFrame, keys: list[str], rules: DrillRules) -> DataFrame:
    """Boxes with enough records, absolutely and as a share of the level's total per species.

    The window over a species holds its boxes of this size, a few thousand at most.
    """
    total = F.sum("n").over(Window.partitionBy("sci"))
    floor = F.greatest(F.lit(float(rules.box_records)), F.lit(rules.box_share) * F.col("_total"))
    return boxes.withColumn("_total", total).where(F.col("n") >= floor).select("sci", *keys)


def drill_down(counts: DataFrame, rules: DrillRules = DrillRules()) -> DataFrame:
    """Finest cells that survive every level, with their month vectors.

    The records are counted once, at the finest size, and checkpointed; the coarser levels are
    roll-ups of that much smaller table, and each level filters the next by a semi join.
    """
    finest = rules.sizes[-1]
    named = counts.where(F.col("sci").isNotNull())
    for size in rules.sizes:
        named = with_boxes(named, size)
    cells = named.groupBy("sci", *[f"{a}_{s}" for s in rules.sizes for a in ("lat", "lng")]).agg(
        months.sum_by_month("n").alias("c"), F.sum("n").alias("n")
    )
    cells = cut_lineage(cells)
    for size in rules.sizes[:-1]:
        keys = [f"lat_{size}", f"lng_{size}"]
        boxes = cells.groupBy("sci", *keys).agg(F.sum("n").alias("n"))
        cells = cells.join(kept_boxes(boxes, keys, rules), ["sci", *keys], "left_semi")
    return cells.where(F.col("n") > 0).select(
        "sci", grid.cell_id(F.col(f"lat_{finest}"), F.col(f"lng_{finest}")).alias("cell"), "c", F.col("n").alias("records")
    )
