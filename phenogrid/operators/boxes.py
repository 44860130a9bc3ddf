"""Points in boxes where the boxes are data: any number of them, overlapping, of any size.

Every box goes into the cells of a grid about as coarse as itself, at most nine of them, so a world-wide box costs no
more rows than a tiny one. A point goes into one cell of each grid that some box uses. The two meet in an equi join on grid
and cell, and the exact test follows. There are at most GRIDS grids, so a point makes so many rows at most.

The first box of a point does not need all of its boxes. A cell that lies wholly inside a box needs no box of a later order, nor do
the cells within it. Boxes are therefore cut into cells of an eighth of their grid's, and of a cell only what comes before the first
box over the whole of it is kept: on average a few pieces, however many boxes lie over each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.session import new_path, split_by

#: Cell sizes are 360 degrees, 180, 90 and so on.
GRIDS = 20

#: Points lie within so many degrees; boxes may reach further.
WORLD = 359.0

CELL = ["_g", "_x", "_y"]
INSIDE = "lat >= lat0 AND lat < lat1 AND lng >= lng0 AND lng < lng1"

#: Cells that a box is cut into are so many grids finer than its own, which makes about so many of them.
FINER = 3
CUTS = 81
CUTS_PER_TASK = 1 << 22

#: Points one task looks up.
POINTS_PER_TASK = 1 << 18


def _size(grid: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), grid)


def _cell(value: Column, grid: Column) -> Column:
    return F.floor(value / _size(grid)).cast("int")


def _spans(boxes: DataFrame, finer: int = 0) -> DataFrame:
    """Each box that holds anything, with its grid, or a finer one, and the first and last cell it touches both ways."""
    side = F.greatest(F.col("lat1") - F.col("lat0"), F.col("lng1") - F.col("lng0"))
    real = boxes.where(f"lat0 < lat1 AND lng0 < lng1 AND lat0 <= {WORLD} AND lat1 >= -{WORLD} AND lng0 <= {WORLD} AND lng1 >= -{WORLD}")
    at = real.withColumn("_g", F.greatest(F.lit(0), F.least(F.lit(GRIDS - 1), F.floor(F.log2(F.lit(360.0) / side)))).cast("int"))
    ends = {"_x0": ("lng0", F.greatest, -WORLD), "_x1": ("lng1", F.least, WORLD), "_y0": ("lat0", F.greatest, -WORLD), "_y1": ("lat1", F.least, WORLD)}
    return at.withColumn("_g", F.col("_g") + finer).withColumns({name: _cell(clamp(F.col(edge), F.lit(limit)), F.col("_g")) for name, (edge, clamp, limit) in ends.items()})


def _cells(spans: DataFrame, rim: int = 0) -> DataFrame:
    """A row for each cell of a span; ``rim`` leaves out so many at its ends."""
    across, down = (F.sequence(F.col(f"{axis}0") + rim, F.col(f"{axis}1") - rim) for axis in ("_x", "_y"))
    return spans.withColumn("_x", F.explode(across)).withColumn("_y", F.explode(down))


def box_cells(boxes: DataFrame) -> DataFrame:
    """Each box (lat0, lat1, lng0, lng1; half open) with the grid it belongs to and the cells it touches."""
    return _cells(_spans(boxes)).drop("_x0", "_x1", "_y0", "_y1")


def point_cells(points: DataFrame, boxes_in_cells: DataFrame) -> DataFrame:
    """Each point (lat, lng) with its cell in every grid that has a box."""
    used = sorted(r["_g"] for r in boxes_in_cells.select("_g").distinct().collect())
    at = points.withColumn("_g", F.explode(F.array(*[F.lit(g) for g in used]) if used else F.array().cast("array<int>")))
    return at.withColumns({"_x": _cell(F.col("lng"), F.col("_g")), "_y": _cell(F.col("lat"), F.col("_g"))})


def pairs(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every (point, box) with the point inside the box; columns of both, which must not share a name."""
    cells = box_cells(boxes)
    return point_cells(points, cells).join(cells, CELL).where(INSIDE).drop(*CELL)


def _before(rows: DataFrame, covers: DataFrame, grids: list[int]) -> DataFrame:
    """Spans without those inside one cell that a box of an earlier order covers; one join per grid."""
    for g in grids:
        coarser = [f"shiftright({end}, _g - {g})" for end in ("_x0", "_x1", "_y0", "_y1")]
        over = covers.where(F.col("_g") == g).select(F.col("_x").alias("_cx"), F.col("_y").alias("_cy"), "_first")
        held = F.expr(f"_g >= {g} AND {coarser[0]} = {coarser[1]} AND {coarser[2]} = {coarser[3]} AND {coarser[0]} = _cx AND {coarser[2]} = _cy")
        rows = rows.join(over.withColumnRenamed("_first", "_over"), held, "left").where("_over IS NULL OR _order <= _over").drop("_cx", "_cy", "_over")
    return rows


def foremost(boxes: DataFrame) -> DataFrame:
    """The pieces of boxes (with ``_order`` and ``_value``) that can be the first somewhere, by cell.

    A cell strictly between the first and the last that a box touches lies inside the box, whatever is rounded: cells grow with
    the coordinate. Boxes are held against the covers of all grids before they are cut, and their pieces afterwards.
    """
    spark, path = boxes.sparkSession, new_path(boxes.sparkSession, "boxes")
    spans = split_by(_spans(boxes.where("_order IS NOT NULL"), FINER), CUTS, CUTS_PER_TASK)
    inner = _cells(spans.where("_x1 - _x0 > 1 AND _y1 - _y0 > 1"), 1)
    covers = inner.groupBy(*CELL).agg(F.min("_order").alias("_first")).select("_x", "_y", "_first", "_g")
    covers.write.partitionBy("_g").parquet(f"{path}/covers")  # by grid, so that Spark knows how small the coarse ones are
    covers = spark.read.schema(covers.schema).parquet(f"{path}/covers")
    grids = sorted(r["_g"] for r in covers.select("_g").distinct().collect())
    pieces = _cells(_before(spans, covers, grids)).withColumns({f"{axis}{i}": F.col(axis) for axis in ("_x", "_y") for i in (0, 1)})
    kept = _before(pieces, covers, grids).drop("_x0", "_x1", "_y0", "_y1").distinct()
    kept.write.parquet(f"{path}/pieces")
    return spark.read.schema(kept.schema).parquet(f"{path}/pieces")


def first_box(points: DataFrame, boxes: DataFrame, id: str, order: str, value: str) -> DataFrame:
    """For each point (its ``id``) the ``value`` of the box with the smallest ``order`` that holds it, NULL if none does.

    Points go through the join with their id and place alone, dealt out by id, and meet only boxes that can be first there.
    """
    areas = foremost(boxes.select("lat0", "lat1", "lng0", "lng1", F.col(order).alias("_order"), F.col(value).alias("_value")))
    at = split_by(points.select(id, "lat", "lng").where(F.col(id).isNotNull()), 1, POINTS_PER_TASK, id)
    found = point_cells(at, areas).join(areas, CELL).where(INSIDE)
    best = found.groupBy(id).agg(F.min_by("_value", "_order").alias(value))
    return points.join(best, id, "left")
