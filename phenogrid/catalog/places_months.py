"""What is recorded at a place in a month."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.filters import LISTED
from phenogrid.catalog.registry import query
from phenogrid.functions import layers, months
from phenogrid.operators import place_view, presence
from phenogrid.rules import TierRules
from phenogrid.sources import bindings as b

TIERED = """
ti AS (SELECT *, CASE WHEN c < 3 OR top <= 0 THEN 'rarely' WHEN CAST(c AS DOUBLE) / top >= 0.25 THEN 'often' WHEN CAST(c AS DOUBLE) / top >= 0.05 THEN 'sometimes' ELSE 'rarely' END AS reported
  FROM (SELECT *, max(c) OVER (PARTITION BY cell, month) AS top FROM li))"""
ORDERED = "CASE doing WHEN 'arriving' THEN 0 WHEN 'passing' THEN 1 WHEN 'leaving' THEN 2 WHEN 'staying' THEN 3 WHEN 'resident' THEN 4 ELSE 5 END"


@query("w04_doing", ref.by_key("SELECT key, cell, month, doing FROM li", LISTED))
def w04(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return place_view.listed_rows(labelled).select("key", "cell", "month", "doing")


@query("w05_reported_tier", ref.by_key("SELECT key, cell, month, c AS count, top, reported FROM ti", LISTED, TIERED))
def w05(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return place_view.tiered_rows(labelled).select("key", "cell", "month", "count", "top", "reported")


@query("w06_rank_in_label", ref.by_key("""
SELECT key, cell, month, p, CAST(row_number() OVER (PARTITION BY cell, month, p ORDER BY r DESC, key) AS INTEGER) AS rank, r AS share FROM li""", LISTED))
def w06(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return place_view.ranked_in_group(place_view.listed_rows(labelled)).select("key", "cell", "month", "p", "rank", "share")


@query("t03_place_list_order", ref.by_key(f"""
SELECT key, cell, month, doing, CAST(row_number() OVER (PARTITION BY cell, month ORDER BY {ORDERED}, c DESC, key) AS INTEGER) AS pos FROM li WHERE doing IN ('arriving', 'leaving', 'passing')""", LISTED))
def t03(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return place_view.ordered_rows(place_view.listed_rows(labelled), "moving").select("key", "cell", "month", "doing", "pos")


@query("t04_first_page", ref.by_key(f"""
SELECT key, cell, month, pos, total, greatest(total - 5, 0) AS more FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY cell, month ORDER BY {ORDERED}, c DESC, key) AS INTEGER) AS pos, count(*) OVER (PARTITION BY cell, month) AS total FROM li) WHERE pos <= 5""", LISTED))
def t04(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return place_view.ordered_page(place_view.listed_rows(labelled), "all", 5).select("key", "cell", "month", "pos", "total", "more")


@query("x03_place_summary", ref.by_key("""
SELECT e.cell, e.month, count(l.key) AS total, count(l.key) FILTER (WHERE doing IN ('arriving', 'leaving', 'passing')) AS moving, e.t AS records
FROM effort e LEFT JOIN li l ON l.cell = e.cell AND l.month = e.month GROUP BY e.cell, e.month, e.t""", LISTED))
def x03_place(spark, sf):
    labelled, effort = b.labelled(spark, sf)
    return place_view.place_summary(labelled, effort).select("cell", "month", "total", "moving", "records")


@query("q07_thin_evidence", ref.occ("SELECT cell, month, t AS records, t < 36 AS thin FROM effort"))
def q07(spark, sf):
    labelled, effort = b.labelled(spark, sf)
    return place_view.place_summary(labelled, effort, TierRules(thin_records=36)).select("cell", "month", "records", "thin")


@query("x03_wildlife_here", ref.by_key("""
SELECT cell, month, key, p, c AS count, CAST(row_number() OVER (PARTITION BY cell, month, p ORDER BY r DESC, key) AS INTEGER) AS rank FROM li""", LISTED))
def x03_wildlife(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return place_view.wildlife_here(labelled).select("cell", "month", "key", "p", "count", "rank")


@query("e22_words", ref.by_key("""
SELECT key, cell, month, CASE doing WHEN 'arriving' THEN 'Arriving' WHEN 'leaving' THEN 'Leaving' WHEN 'staying' THEN 'Visiting' WHEN 'passing' THEN 'Passing through' WHEN 'resident' THEN 'Year-round' ELSE 'Recorded' END AS words,
  CASE WHEN r < CAST(0.1 AS DOUBLE) THEN 'bare or water' WHEN r < CAST(0.25 AS DOUBLE) THEN 'sparse' WHEN r < CAST(0.45 AS DOUBLE) THEN 'moderate' WHEN r < CAST(0.65 AS DOUBLE) THEN 'green' ELSE 'lush' END AS greenness,
  CASE WHEN t >= 500 THEN 'Well recorded' WHEN t >= 50 THEN 'Some records' ELSE 'Limited data' END AS coverage
FROM li""", LISTED))
def e22(spark, sf):
    """Words of the labels; the greenness scale is read off the share of records."""
    labelled, effort = b.labelled(spark, sf)
    rows = presence.beside_cells(place_view.listed_rows(labelled), effort)
    level = F.expr(months.coverage_sql("t[month - 1]"))
    return rows.select(
        "key", "cell", "month", place_view.doing_words(F.col("doing")).alias("words"), layers.greenness(F.col("share")).alias("greenness"),
        place_view.coverage_words(level).alias("coverage"),
    )


@query("e23_months_in_words", ref.by_key("""
SELECT key, cell, CASE WHEN count(*) FILTER (WHERE c > 0) = 12 THEN 'Recorded in every month' WHEN count(*) FILTER (WHERE c > 0) = 0 THEN 'No records in any month'
  ELSE 'Recorded in ' || string_agg(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][month], ', ' ORDER BY month) FILTER (WHERE c > 0) END AS words
FROM kl GROUP BY key, cell"""))
def e23(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return labelled.withColumn("s", months.months_where("c[i] > 0")).select("key", "cell", months.months_in_words("s").alias("words"))
