"""Species-cell counts joined to effort, and the presence label of every species-cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import months
from phenogrid.rules import PresenceRules


def beside_cells(rows: DataFrame, cells: DataFrame, how: str = "inner") -> DataFrame:
    """Join a per-cell dimension on ``cell``. Spark sizes the dimension and broadcasts it where it is small."""
    return rows.join(cells, "cell", how)


def label_presence(pairs: DataFrame, effort: DataFrame, rules: PresenceRules = PresenceRules()) -> DataFrame:
    """Adds effort ``t``, rates ``r``, the present months ``m`` (bit set) and the label ``p``."""
    surveyed = effort.withColumn("surveyed", months.surveyed_set("t", rules))
    return _labelled(beside_cells(pairs, surveyed), rules)


def label_with_effort(rows: DataFrame, rules: PresenceRules = PresenceRules()) -> DataFrame:
    """The same for rows that bring their own effort ``t``."""
    return _labelled(rows.withColumn("surveyed", months.surveyed_set("t", rules)), rules)


def _labelled(joined: DataFrame, rules: PresenceRules) -> DataFrame:
    rated = joined.withColumn("r", months.rates("c", "t")).withColumn("peak", F.array_max("r"))
    floored = rated.withColumn("floor", months.present_floor("peak", rules)).drop("peak")
    marked = settled(floored, m=months.present_set("r", "floor"))
    return marked.withColumn("p", months.label("c", "m", "surveyed", rules)).drop("floor", "surveyed")


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters refer to by value.

    Spark pushes a filter through a projection by copying the projected expressions into it, which
    for twelve-month expressions built on each other grows beyond what can be compiled. A generator
    of one row stops that, while filters on the other columns still pass through it.
    """
    held = [f"_{name}" for name in columns]
    ready = rows.withColumns(dict(zip(held, columns.values(), strict=True)))
    one = F.array(F.struct(*[F.col(h).alias(name) for h, name in zip(held, columns, strict=True)]))
    return ready.select(*rows.columns, F.inline(one))


def presence_rows(labelled: DataFrame) -> DataFrame:
    """One row per species-cell: label, records and number of present months."""
    return labelled.select(
        "sci", "cell", "p", months.total("c").alias("records"), F.bit_count("m").alias("months_present"),
    )


def by_month(labelled: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per species-cell and month (1..12)."""
    rows = months.month_rows(month="i + 1", n="c[i]", effort="t[i]", rate="r[i]", present=months.in_set("m", "i"))
    return labelled.select(*keep, rows)
