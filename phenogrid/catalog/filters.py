"""Row filters and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.functions import grid, months, text, tiles
from phenogrid.operators import counting, place_view, places, profiles, raster
from phenogrid.rules import QualityWindow
from phenogrid.sources import bindings as b

WINDOW = QualityWindow(first_year=1996, last_year=2000)
QUALITY = "class = 'Aves' AND status = 'PRESENT' AND has_coordinate AND NOT has_issue AND year BETWEEN 1996 AND 2000"


@query("f01_clean_strings", """
SELECT p_partkey, nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END), '') AS name FROM part""")
def f01(spark, sf):
    raw = F.when(F.col("p_size") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return b.table(spark, sf, "part").select("p_partkey", text.clean(raw).alias("name"))


@query("f02_snap_and_clamp", """
SELECT s_suppkey, greatest(-90, least(89, CAST(floor(lat) AS INTEGER))) AS lat0, greatest(-180, least(179, CAST(floor(lng) AS INTEGER))) AS lng0
FROM (SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 90 WHEN 1 THEN -90 ELSE s_acctbal / 100 - 5 END AS lat,
             CASE s_suppkey % 9 WHEN 2 THEN 180 WHEN 3 THEN -180 ELSE s_acctbal / 30 - 150 END AS lng FROM supplier)""")
def f02(spark, sf):
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    lat = F.when(key % 9 == 0, 90.0).when(key % 9 == 1, -90.0).otherwise(balance / 100 - 5)
    lng = F.when(key % 9 == 2, 180.0).when(key % 9 == 3, -180.0).otherwise(balance / 30 - 150)
    return b.table(spark, sf, "supplier").select("s_suppkey", grid.snap_lat(lat).alias("lat0"), grid.snap_lng(lng).alias("lng0"))


@query("f03_valid_months_in_shard", ref.occ("""
SELECT sci, month, lat0, lng0, n FROM (SELECT sci, CASE WHEN lat0 % 4 = 0 THEN month + 6 ELSE month END AS month, lat0, lng0, n FROM counts)
WHERE month BETWEEN 1 AND 12 AND lat0 < 38 AND lng0 >= -30 AND lng0 < 60"""))
def f03(spark, sf):
    shifted = b.month_counts(spark, sf).withColumn("month", F.when(F.col("lat0") % 4 == 0, F.col("month") + 6).otherwise(F.col("month")))
    kept = counting.in_shard_cells(shifted.where(F.col("month").between(1, 12)), "africa")
    return kept.select("sci", "month", "lat0", "lng0", "n")


@query("f04_sensitive_mask", ref.occ("SELECT sci, specieskey, family, CAST(sum(n) AS BIGINT) AS records FROM masked GROUP BY ALL"))
def f04(spark, sf):
    return b.masked_counts(spark, sf).groupBy("sci", "specieskey", "family").agg(F.sum("n").alias("records"))


@query("f05_sensitive_exclude", ref.occ("SELECT sci, count(*) AS records FROM rec WHERE sci IS NULL OR sci NOT IN ('Species 3', 'Species 12') GROUP BY sci"))
def f05(spark, sf):
    return counting.without_sensitive(b.records(spark, sf), b.SENSITIVE).groupBy("sci").agg(F.count("*").alias("records"))


@query("f06_refused_names", ref.occ("""
SELECT x.sci, x.sci IN ('Species 3', 'Species 12') AS refused, CASE WHEN x.sci NOT IN ('Species 3', 'Species 12') THEN CAST(sum(x.n) AS BIGINT) END AS records
FROM counts x WHERE x.sci IS NOT NULL GROUP BY x.sci"""))
def f06(spark, sf):
    """Asks for every recorded name as a featured species: a sensitive one is refused before anything is planned, any other
    gets its worldwide records. The names are the taxa of the binding, at most 40."""
    counts = b.month_counts(spark, sf).where(F.col("sci").isNotNull())
    out = None
    for name in sorted(r["sci"] for r in counts.select("sci").distinct().collect()):
        try:
            counting.refuse_sensitive([name], b.SENSITIVE)
            asked = (F.col("sci") == name, F.lit(False))
        except counting.SensitiveSpeciesError:
            asked = (F.col("sci") == name, F.lit(True))
        out = [asked] if out is None else [*out, asked]
    refused = F.coalesce(*[F.when(is_it, no) for is_it, no in out]) if out else F.lit(False)
    return counts.withColumn("refused", refused).groupBy("sci", "refused").agg(F.sum("n").alias("n")).select("sci", "refused", F.when(~F.col("refused"), F.col("n")).alias("records"))


@query("f07_quality_predicate", ref.occ(f"SELECT l_orderkey, l_linenumber, sci, year, month FROM rec WHERE {QUALITY}"))
def f07(spark, sf):
    return counting.usable_records(b.records(spark, sf), WINDOW).select("l_orderkey", "l_linenumber", "sci", "year", "month")


@query("f08_box_predicate", ref.occ("""
SELECT shard, count(*) AS records FROM (
  SELECT CASE WHEN lat >= 38 AND lat <= 90 AND lng >= -30 AND lng < 60 THEN 'europe'
              WHEN (lat >= 0 AND lat <= 90 AND lng >= 100 AND lng <= 180) OR (lat >= 40 AND lat <= 90 AND lng >= 60 AND lng < 100) THEN 'east-asia' END AS shard FROM rec)
WHERE shard IS NOT NULL GROUP BY shard"""))
def f08(spark, sf):
    records = b.records(spark, sf)
    parts = [counting.in_shard(records, s).select(F.lit(s).alias("shard")) for s in ("europe", "east-asia")]
    return parts[0].unionByName(parts[1]).groupBy("shard").agg(F.count("*").alias("records"))


@query("f09_country_window", ref.occ("""
SELECT c.n_name AS country, r.month, count(*) AS records FROM rec r JOIN nation c ON c.n_nationkey = r.nation
WHERE c.n_name IN (SELECT n_name FROM nation WHERE n_nationkey = 6) AND lat >= -60 AND lat < 60 AND lng >= -150 AND lng < 150
  AND class = 'Aves' AND status = 'PRESENT' GROUP BY ALL"""))
def f09(spark, sf):
    nation = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("country"), "n_nationkey")
    records = b.records(spark, sf).join(nation, "nation")
    birds = records.where((F.col("class") == "Aves") & (F.col("status") == "PRESENT") & (F.col("n_nationkey") == 6))
    inside = birds.where(grid.in_box(F.col("lat"), F.col("lng"), (-60, 60, -150, 150)))
    return inside.groupBy("country", "month").agg(F.count("*").alias("records"))


@query("f10_cells_with_effort", ref.occ("""
SELECT cell, CAST(sum(n) AS BIGINT) AS records FROM (SELECT cell, CASE WHEN lat0 % 3 = 0 THEN 0 ELSE n END AS n FROM masked) GROUP BY cell HAVING sum(n) > 0"""))
def f10(spark, sf):
    thinned = b.masked_counts(spark, sf).withColumn("n", F.when(F.col("lat0") % 3 == 0, 0).otherwise(F.col("n")))
    return counting.merge_effort(counting.effort_months(thinned)).select("cell", months.total("t").alias("records"))


@query("f11_species_cells_with_records", ref.occ("""
SELECT sci, cell, CAST(sum(n) AS BIGINT) AS records FROM (SELECT sci, cell, CASE WHEN lng0 % 2 = 0 THEN 0 ELSE n END AS n FROM masked) WHERE sci IS NOT NULL
GROUP BY ALL HAVING sum(n) > 0"""))
def f11(spark, sf):
    thinned = b.masked_counts(spark, sf).withColumn("n", F.when(F.col("lng0") % 2 == 0, 0).otherwise(F.col("n")))
    pairs = counting.species_months(thinned).select("sci", "cell", months.total("c").alias("records"))
    return pairs.where("records > 0")


LISTED = """
li AS (SELECT l.*, CASE WHEN p = 'resident' THEN 'resident' WHEN p = 'passage' THEN 'passing' WHEN p = 'uncertain' THEN 'recorded'
    WHEN NOT prev THEN 'arriving' WHEN NOT nxt THEN 'leaving' ELSE 'staying' END AS doing
  FROM (SELECT a.*, b1.present AS prev, b2.present AS nxt FROM kl a
    JOIN kl b1 ON b1.key = a.key AND b1.cell = a.cell AND b1.month = (a.month + 10) % 12 + 1
    JOIN kl b2 ON b2.key = a.key AND b2.cell = a.cell AND b2.month = a.month % 12 + 1) l
  WHERE c > 0 AND (p IN ('resident', 'uncertain') OR present))"""


@query("f12_listed_in_month", ref.by_key("SELECT key, cell, month, c AS count FROM li", LISTED))
def f12(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return place_view.listed_rows(labelled).select("key", "cell", "month", "count")


@query("f13_filter_chips", ref.by_key("""
SELECT cell, month, count(*) FILTER (WHERE doing IN ('arriving', 'leaving', 'passing')) AS n_moving, count(*) FILTER (WHERE doing = 'arriving') AS n_arriving,
  count(*) FILTER (WHERE doing = 'leaving') AS n_leaving, count(*) FILTER (WHERE doing = 'passing') AS n_passing, count(*) FILTER (WHERE doing = 'staying') AS n_staying,
  count(*) FILTER (WHERE doing = 'resident') AS n_resident, count(*) AS n_all
FROM li GROUP BY cell, month""", LISTED))
def f13(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return place_view.chip_counts(place_view.listed_rows(labelled))


@query("f14_licence_gate", """
SELECT page_id, trim(CASE WHEN page_id % 3 = 0 THEN '  ' WHEN page_id % 3 = 1 THEN ' CC BY ' || (page_id % 5) ELSE 'Public domain' END) AS license FROM pages WHERE page_id % 3 <> 0""")
def f14(spark, sf):
    licence = F.when(F.col("page_id") % 3 == 0, "  ").when(F.col("page_id") % 3 == 1, F.concat(F.lit(" CC BY "), (F.col("page_id") % 5).cast("string"))).otherwise("Public domain")
    return profiles.licensed(b.table(spark, sf, "pages").select("page_id", licence.alias("license")))


@query("f15_valid_places", ref.places("""
SELECT name, lng, lat FROM (SELECT CASE WHEN population % 11 = 0 THEN '' ELSE name END AS name, lng * 1.1 AS lng, lat * 1.2 AS lat FROM pl)
WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND name <> ''"""))
def f15(spark, sf):
    p = b.places(spark, sf)
    skewed = p.select(F.when(F.col("population") % 11 == 0, "").otherwise(F.col("name")).alias("name"), (F.col("lng") * 1.1).alias("lng"), (F.col("lat") * 1.2).alias("lat"), "population", "code", "country", "admin_code")
    blank = F.lit("")
    line = F.concat_ws("\t", blank, "name", blank, blank, F.col("lat").cast("string"), F.col("lng").cast("string"), blank, "code", "country", blank, "admin_code",
                       blank, blank, blank, F.col("population").cast("string"), blank, blank, blank, blank)
    return places.valid_places(places.parsed_places(skewed.select(line.alias("value")))).select("name", "lng", "lat")


@query("f16_land_tiles", ref.pixels("SELECT DISTINCT CAST(gx // 2 AS INTEGER) AS x, CAST(gy // 2 AS INTEGER) AS y FROM px WHERE cls > 0"))
def f16(spark, sf):
    return raster.land_tiles(b.pixels(spark, sf), 2)


@query("f17_tiles_in_bounds", ref.places(f"""
SELECT name, x, y FROM (SELECT name, {ref.tile_x('lng', 9)} AS x, {ref.tile_y('lat', 9)} AS y FROM pl)
WHERE (x >> 6 = 5 AND y >> 6 = 2) OR (x * 0.3515625 - 180 < 40.5 AND -10.25 < x * 0.3515625 - 180 + 0.3515625 AND 90 - y * 0.3515625 - 0.3515625 < 55.0 AND 5.5 < 90 - y * 0.3515625)"""))
def f17(spark, sf):
    placed = b.places(spark, sf).select("name", tiles.tile_x(F.col("lng"), 9).alias("x"), tiles.tile_y(F.col("lat"), 9).alias("y"))
    x, y = F.col("x"), F.col("y")
    return placed.where(tiles.in_ancestor(x, y, 9, (3, 5, 2)) | tiles.overlaps_bounds(x, y, 9, (-10.25, 5.5, 40.5, 55.0)))


@query("f18_clear_scenes", """
SELECT l_partkey AS pixel, count(*) AS scenes, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_linenumber * 8 < 40 AND l_returnflag IN ('A', 'R') GROUP BY l_partkey""")
def f18(spark, sf):
    kept = raster.clear_scenes(b.scenes(spark, sf), "1996-01-01", "1999-01-01")
    return kept.groupBy("pixel").agg(F.count("*").alias("scenes"), F.sum("value").cast("long").alias("total"))


@query("f19_intro_gate", """
SELECT doc_id, linked, intro FROM (
  SELECT doc_id, doc_id % 3 <> 0 AS linked, lang, source,
    coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p, ' ')), lambda p: p <> '')[1], '') AS intro FROM documents)
WHERE doc_id % 10 <> 7 AND doc_id % 10 <> 8 AND (linked OR contains(lower(intro), lang))""")
def f19(spark, sf):
    docs = b.table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("sci"), (F.col("doc_id") % 3 != 0).alias("linked"), F.col("text").alias("extract"),
        (F.col("doc_id") % 10 == 7).alias("missing"), (F.col("doc_id") % 10 == 8).alias("disambiguation"),
    )
    return profiles.intros(docs).select("doc_id", "linked", "intro")
