"""Quantile sampling of a species' monthly distribution along the Hilbert curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenogrid.functions import grid, months

HILBERT_SIDE = 256


def hilbert_order(cells: DataFrame, side: int = HILBERT_SIDE) -> DataFrame:
    """Adds ``place``: where each cell (lat0, lng0) lies along the curve."""
    x = F.floor((F.col("lng0") + 180) * F.lit(side) / 360).cast("int")
    y = F.floor((F.col("lat0") + 90) * F.lit(side) / 180).cast("int")
    return cells.withColumns({"_x": x, "_y": y}).withColumn("place", grid.hilbert_index(side, "_x", "_y")).drop("_x", "_y")


def quantile_picks(weights: DataFrame, count: int, side: int = HILBERT_SIDE) -> DataFrame:
    """Cells picked by ``count`` evenly spaced quantiles of every (key, month).

    ``weights`` holds (key, month, cell, lat0, lng0, w) with positive whole weights. The running
    sums give each cell the interval of quantile numbers it owns, so the picks come from one pass
    instead of a range join. A (key, month) has at most one row per grid cell.
    """
    placed = hilbert_order(weights, side)
    w = Window.partitionBy("key", "month").orderBy("place", "cell")
    running = F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = weights.groupBy("key", "month").agg(F.sum("w").alias("total"))
    cumulated = placed.withColumn("cum", running).join(total, ["key", "month"])

    # Quantile i sits at (2i + 1) / 2N; a cell owns those in (cum - w, cum] of the total.
    owned = cumulated.withColumn("_hi", _floor_div(2 * count * F.col("cum") - F.col("total"), 2 * F.col("total")))
    owned = owned.withColumn("_lo", _floor_div(2 * count * (F.col("cum") - F.col("w")) - F.col("total"), 2 * F.col("total")) + 1)
    return owned.where(F.col("_lo") <= F.col("_hi")).select(
        "key", "month", "cell", "place", F.explode(F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int"))).alias("pick")
    )


def _floor_div(a, b):
    """Whole-number division rounding down, for a positive divisor."""
    q = F.call_function("div", a, b)
    return q - F.when((a < 0) & (q * b != a), 1).otherwise(0)


def filled_months(weights: DataFrame) -> DataFrame:
    """Per key and month, the month whose distribution is shown: itself, or the nearest earlier
    month with presence, going back round the year."""
    sets = weights.where(F.col("w") > 0).groupBy("key").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("month"))).alias("_set")
    )
    return sets.select("key", months.month_rows(month="i", shown=months.latest_month("_set")))
