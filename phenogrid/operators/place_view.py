"""What is recorded at a place in a month: evaluated for all cells and months at once.

Input is the labelled species-cell table (``key, cell, c, t, m, p``). The month is a column of the
result, so one pass answers every place and month; a filter on ``cell`` or ``month`` prunes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenogrid.functions import months
from phenogrid.operators.presence import beside_cells
from phenogrid.rules import COVERAGE_WORDS, DOING_ORDER, DOING_WORDS, MONTHS, MOVING, PRESENCE_ORDER, TierRules


# SQL tests of the 0-based month ``i``: records, and a label or month that counts; what the species
# is doing, with the months before and after on the circle of the year.
LISTED = f"c[i] > 0 AND (p IN ('resident', 'uncertain') OR {months.in_set('m', 'i')})"
DOING = f"""CASE WHEN p = 'resident' THEN 'resident' WHEN p = 'passage' THEN 'passing' WHEN p = 'uncertain' THEN 'recorded'
    WHEN NOT ({months.in_set('m', f'i + {MONTHS - 1}')}) THEN 'arriving' WHEN NOT ({months.in_set('m', 'i + 1')}) THEN 'leaving' ELSE 'staying' END"""


def listed_rows(labelled: DataFrame) -> DataFrame:
    """One row per listed species, cell and month: records, share of the effort and what it is doing."""
    rows = months.month_rows(LISTED, month="i + 1", count="c[i]", share="if(t[i] > 0, c[i] / t[i], 0D)", doing=DOING)
    return labelled.select("key", "cell", "p", rows)


def monthly_tops(labelled: DataFrame) -> DataFrame:
    """Records of the most reported listed species per cell and month, as a vector per cell."""
    listed = LISTED.replace("[i]", "[{i}]").replace("(i)", "({i})")
    return labelled.groupBy("cell").agg(months.unrolled(f"coalesce(max(CASE WHEN {listed} THEN c[{{i}}] END), 0)").alias("tops"))


def tiered_rows(labelled: DataFrame, rules: TierRules = TierRules()) -> DataFrame:
    """Listed rows with how often each species is reported next to the top species of its cell and
    month.

    The tops are a partial aggregate with one row per cell, joined back before the months are
    spread: no window over the species of a cell.
    """
    tier = f"""CASE WHEN c[i] < {rules.few_records} OR tops[i] <= 0 THEN 'rarely' WHEN c[i] / tops[i] >= {rules.often!r}D THEN 'often'
        WHEN c[i] / tops[i] >= {rules.sometimes!r}D THEN 'sometimes' ELSE 'rarely' END"""
    rows = months.month_rows(
        LISTED, month="i + 1", count="c[i]", share="if(t[i] > 0, c[i] / t[i], 0D)", doing=DOING, top="tops[i]", reported=tier
    )
    return beside_cells(labelled, monthly_tops(labelled)).select("key", "cell", "p", rows)


def ranked_in_group(rows: DataFrame) -> DataFrame:
    """Rank inside (cell, month, label) by share, ties by key.

    A group holds each taxon at most once, so the taxon list bounds it; the sort spills to disk.
    """
    w = Window.partitionBy("cell", "month", "p").orderBy(F.col("share").desc(), "key")
    return rows.withColumn("rank", F.row_number().over(w))


def label_order(p: Column) -> Column:
    chain = F.lit(len(PRESENCE_ORDER))
    for i, word in enumerate(PRESENCE_ORDER):
        chain = F.when(p == word, F.lit(i)).otherwise(chain)
    return chain


def doing_order(d: Column) -> Column:
    chain = F.lit(len(DOING_ORDER))
    for i, word in enumerate(DOING_ORDER):
        chain = F.when(d == word, F.lit(i)).otherwise(chain)
    return chain


def doing_words(d: Column) -> Column:
    chain = F.lit(None).cast("string")
    for word, shown in DOING_WORDS.items():
        chain = F.when(d == word, F.lit(shown)).otherwise(chain)
    return chain


def coverage_words(level: Column) -> Column:
    chain = F.lit(None).cast("string")
    for word, shown in COVERAGE_WORDS.items():
        chain = F.when(level == word, F.lit(shown)).otherwise(chain)
    return chain


def matches_filter(name: str) -> Column:
    """Row test of a filter chip: moving, one of the doings, or all."""
    if name == "all":
        return F.lit(True)
    if name == "moving":
        return F.col("doing").isin(*MOVING)
    return F.col("doing") == name


FILTERS = ("moving", "arriving", "leaving", "passing", "staying", "resident", "all")


def chip_counts(rows: DataFrame) -> DataFrame:
    """Rows per filter chip for every cell and month, in one pass."""
    return rows.groupBy("cell", "month").agg(*[F.count_if(matches_filter(f)).alias(f"n_{f}") for f in FILTERS])


def ordered_rows(rows: DataFrame, chip: str) -> DataFrame:
    """A chip's list per cell and month with the position of each species: by what they are doing
    for the mixed lists, then by records."""
    order = [F.col("count").desc(), F.col("key")]
    if chip in ("all", "moving"):
        order.insert(0, doing_order(F.col("doing")))
    w = Window.partitionBy("cell", "month").orderBy(*order)
    return rows.where(matches_filter(chip)).withColumn("pos", F.row_number().over(w))


def ordered_page(rows: DataFrame, chip: str, size: int) -> DataFrame:
    """First page of a chip's list per cell and month, with how many more there are."""
    total = rows.where(matches_filter(chip)).groupBy("cell", "month").agg(F.count("*").alias("total"))
    page = ordered_rows(rows, chip).where(F.col("pos") <= size)
    return page.join(total, ["cell", "month"]).withColumn("more", F.greatest(F.col("total") - size, F.lit(0)))


def place_summary(labelled: DataFrame, effort: DataFrame, rules: TierRules = TierRules()) -> DataFrame:
    """Per cell and month: listed species, how many move, records, and whether the evidence is thin."""
    per_month = listed_rows(labelled).groupBy("cell", "month").agg(
        F.count("*").alias("total"), F.count_if(F.col("doing").isin(*MOVING)).alias("moving")
    )
    every = effort.select("cell", months.month_rows(month="i + 1", records="t[i]", thin=f"t[i] < {rules.thin_records}"))
    return every.join(per_month, ["cell", "month"], "left").select(
        "cell", "month", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("moving", F.lit(0)).alias("moving"), "records", "thin"
    )


def wildlife_here(labelled: DataFrame, cell: str | None = None, month: int | None = None) -> DataFrame:
    """Listed species grouped by label, best share first; optionally for one place and month."""
    kept = labelled if cell is None else labelled.where(F.col("cell") == cell)
    rows = listed_rows(kept)
    if month is not None:
        rows = rows.where(F.col("month") == month)
    return ranked_in_group(rows)
