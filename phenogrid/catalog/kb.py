"""Place names and species profiles (J8, J17-J19, W13, A32, A37, E13-E16, E21, E24, E25, SK10, T5, T7, T8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.catalog.scans import admin_dump
from phenogrid.functions import text
from phenogrid.operators import places, profiles
from phenogrid.plans import products
from phenogrid.rules import STATUS, UNITS
from phenogrid.session import new_path
from phenogrid.sources import bindings as b
from phenogrid.sources import files


def _places(spark, sf):
    return b.places(spark, sf).withColumn("kind", places.place_kind(F.col("code")))


@query("j08_places_with_admin", ref.places("""
SELECT name, country, CASE WHEN country LIKE 'A%' THEN '' ELSE admin_code || ' of ' || country END AS admin1 FROM pl"""))
def j08(spark, sf):
    admin = files.admin_codes(spark, admin_dump(spark, sf))
    return places.with_admin(_places(spark, sf), admin).select("name", "country", "admin1")


@query("t05_major_places", ref.places("""
SELECT name, population, population >= 15000 OR kind = 0 AS major, CAST(row_number() OVER (PARTITION BY chunk ORDER BY population DESC, name) AS INTEGER) AS pos, chunk
FROM (SELECT *, CASE WHEN population >= 15000 OR kind = 0 THEN 'major' ELSE """ + f"{ref.tile_x('lng', 3)} || '_' || {ref.tile_y('lat', 3)}" + """ END AS chunk FROM pl)"""))
def t05(spark, sf):
    """Places ordered by population; positions come from a distributed sort of each list."""
    chunked = places.with_chunk(places.with_major(_places(spark, sf)))
    return places.ranked_by_population(chunked).select("name", "population", "major", "pos", "chunk")


_FLOOR = places.population_floor(700.0)


@query("t08_place_labels", ref.places(f"""
SELECT name, round(priority, 8) AS priority, size FROM (
  SELECT name, lng, lat, log10(greatest(1, population)) + CASE kind WHEN 0 THEN 1.2 WHEN 1 THEN 0.4 ELSE 0 END AS priority,
    CASE WHEN population / {_FLOOR!r} > 20 OR kind = 0 THEN 'l' WHEN population / {_FLOOR!r} > 4 THEN 'm' ELSE 's' END AS size
  FROM pl WHERE population >= {_FLOOR!r} * CASE kind WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 1 END)
ORDER BY priority DESC, name, lng, lat LIMIT 60"""))
def t08(spark, sf):
    return places.top_labels(_places(spark, sf), 700.0, 60).select("name", F.round("priority", 8).alias("priority"), "size")


@query("t08_eligible_labels", ref.places(f"""
SELECT kind, count(*) AS places FROM pl WHERE population >= {_FLOOR!r} * CASE kind WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 1 END GROUP BY kind"""))
def t08_eligible(spark, sf):
    return places.label_candidates(_places(spark, sf), 700.0).groupBy("kind").agg(F.count("*").alias("places"))


@query("e21_place_kinds", ref.places("SELECT code, kind, count(*) AS places FROM pl GROUP BY code, kind"))
def e21_kinds(spark, sf):
    return _places(spark, sf).groupBy("code", "kind").agg(F.count("*").alias("places"))


@query("e25_short_names", """
SELECT c_custkey, coalesce(nullif(city, ''), nullif(town, ''), nullif(state, '')) AS name,
  array_to_string(list_filter([state, country], lambda p: p IS NOT NULL AND p <> '' AND p <> coalesce(nullif(city, ''), nullif(town, ''), nullif(state, ''))), ', ') AS detail
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS city, CASE WHEN c_custkey % 3 = 1 THEN 'Town ' || c_custkey END AS town,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS state, n_name AS country FROM customer JOIN nation ON n_nationkey = c_nationkey)
WHERE coalesce(nullif(city, ''), nullif(town, ''), nullif(state, '')) IS NOT NULL""")
def e25(spark, sf):
    key = F.col("c_custkey")
    nation = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    address = b.table(spark, sf, "customer").join(nation, "c_nationkey").select(
        "c_custkey", F.when(key % 3 == 0, F.col("c_name")).otherwise("").alias("city"), F.when(key % 3 == 1, F.concat(F.lit("Town "), key.cast("string"))).alias("town"),
        F.when(key % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("state"), F.col("n_name").alias("country"),
    )
    name, detail = places.short_name([F.col("city"), F.col("town")], F.col("state"), F.col("country"))
    return address.select("c_custkey", name.alias("name"), detail.alias("detail")).where(F.col("name").isNotNull())


# ---- claims and entities -----------------------------------------------------------------------

CLAIMS = """
cl AS (SELECT 'Q' || (l_partkey + 1) AS item, 'P' || (l_linenumber % 3) AS prop, l_orderkey * 8 + l_linenumber AS pos, CAST(l_suppkey AS VARCHAR) AS value, l_suppkey, l_quantity, l_extendedprice,
  CASE WHEN l_tax > CAST(0.06 AS DOUBLE) THEN 'preferred' WHEN l_tax < CAST(0.01 AS DOUBLE) THEN 'deprecated' ELSE 'normal' END AS rank FROM lineitem)"""


@query("w13_best_claims", ref.sql("""
SELECT item, prop, arg_min(value, (rank <> 'preferred', pos, CAST(value AS BIGINT))) AS value FROM cl WHERE rank <> 'deprecated' GROUP BY item, prop""", CLAIMS))
def w13(spark, sf):
    stated = b.claims(spark, sf).withColumn("pos", F.struct("pos", F.col("value").cast("long").alias("v")))
    return profiles.best_claims(stated)


@query("w13_ranked_claims", ref.sql("""
SELECT item, prop, value, CAST(row_number() OVER (PARTITION BY item, prop ORDER BY rank <> 'preferred', pos, CAST(value AS BIGINT)) AS INTEGER) AS place FROM cl WHERE rank <> 'deprecated'""", CLAIMS))
def w13_ranked(spark, sf):
    stated = b.claims(spark, sf).withColumn("pos", F.struct("pos", F.col("value").cast("long").alias("v")))
    return profiles.best_claims(stated, None).select("item", "prop", "value", "place")


UNIT_ITEMS = list(UNITS) + ["Q0"]
UNIT_CASE = "CASE l_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(UNIT_ITEMS)) + " END"


@query("a32_quantity_ranges", ref.sql(f"""
SELECT item, prop, round(min(least(a, lo, hi)), 1) AS lo, round(max(greatest(a, lo, hi)), 1) AS hi, arg_max(u, (rank <> 'preferred', pos, l_suppkey)) AS unit FROM (
  SELECT item, prop, rank, pos, l_suppkey, l_quantity * f AS a, (l_quantity - 0.5) * f AS lo, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE (l_quantity + 0.5) * f END AS hi, u FROM (
    SELECT *, CASE l_suppkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 100.0 WHEN 2 THEN CAST(0.1 AS DOUBLE) WHEN 3 THEN 1.0 WHEN 4 THEN 1000.0 END AS f, CASE WHEN l_suppkey % 6 < 3 THEN 'cm' ELSE 'g' END AS u FROM cl) WHERE f IS NOT NULL AND rank <> 'deprecated')
GROUP BY item, prop""", CLAIMS))
def a32(spark, sf):
    unit = F.lit(None).cast("string")
    for i, item in enumerate(UNIT_ITEMS):
        unit = F.when(F.col("l_suppkey") % 6 == i, item).otherwise(unit)
    q = F.col("l_quantity")
    stated = b.claims(spark, sf).select(
        "item", "prop", F.struct("pos", "l_suppkey").alias("pos"), "rank", unit.alias("unit"), q.alias("amount"), (q - 0.5).alias("lower"),
        F.when(F.col("l_suppkey") % 4 != 0, q + 0.5).alias("upper"),
    )
    return profiles.quantity_ranges(stated)


STATUS_ITEMS = list(STATUS)
STATUS_SQL = ", ".join(f"({i}, '{item}', '{STATUS[item][0]}', '{STATUS[item][1]}')" for i, item in enumerate(STATUS_ITEMS))


@query("e21_status", ref.sql(f"""
SELECT item, arg_min(code, (rank <> 'preferred', pos, l_suppkey)) AS code, arg_min(label, (rank <> 'preferred', pos, l_suppkey)) AS label
FROM cl JOIN (VALUES {STATUS_SQL}) s(i, q, code, label) ON s.i = cl.l_suppkey % 10 WHERE rank <> 'deprecated' GROUP BY item""", CLAIMS))
def e21_status(spark, sf):
    value = F.lit("Q1")
    for i, item in enumerate(STATUS_ITEMS):
        value = F.when(F.col("l_suppkey") % 10 == i, item).otherwise(value)
    stated = b.claims(spark, sf).withColumn("value", value).withColumn("pos", F.struct("pos", "l_suppkey"))
    return profiles.statuses(stated)


def _entities(spark, sf):
    """Species, claims and articles: every part is an entity with a taxon key and a name claim."""
    part = b.table(spark, sf, "part")
    item, number = F.concat(F.lit("Q"), (F.col("p_partkey") + 1).cast("string")), (F.col("p_partkey") % 40).cast("string")
    key = part.where("p_size % 3 <> 0").select(item.alias("item"), F.lit("P846").alias("prop"), F.concat(F.lit("10"), number).alias("value"), F.when(F.col("p_size") % 7 == 0, "deprecated").otherwise("normal").alias("rank"))
    name = part.where("p_size % 4 <> 0").select(item.alias("item"), F.lit("P225").alias("prop"), F.concat(F.lit("Species "), number).alias("value"), F.lit("normal").alias("rank"))
    species = part.select(F.concat(F.lit("Species "), number).alias("sci"), F.when(F.col("p_partkey") % 40 % 5 != 0, F.concat(F.lit("10"), number)).alias("k")).distinct()
    return species, key.unionByName(name), part.where("p_size > 20").select(item.alias("item"))


ENTITIES = """
en AS (SELECT 'Q' || (p_partkey + 1) AS item, p_partkey + 1 AS num, p_partkey % 40 AS sp, p_size FROM part),
sc AS (SELECT 'Species ' || sp AS sci, item, num, CAST(p_size % 3 <> 0 AND p_size % 7 <> 0 AND sp % 5 <> 0 AS INTEGER) AS k, CAST(p_size % 4 <> 0 AS INTEGER) AS n, CAST(p_size > 20 AS INTEGER) AS article FROM en)"""


@query("j17_resolve_items", ref.sql("""
SELECT sci, arg_max(item, (k + n, article, -num)) AS item, max(CAST(k + n AS BIGINT)) AS matches FROM sc WHERE k + n > 0 GROUP BY sci""", ENTITIES))
def j17(spark, sf):
    species, stated, articles = _entities(spark, sf)
    return profiles.resolve_items(species, stated, articles, "P846", "P225")


CHAIN = """
nd AS (SELECT p_partkey AS node, p_partkey // 2 AS parent, 'T' || p_partkey AS name, CASE WHEN p_size % 5 = 1 THEN 'genus' WHEN p_size % 5 = 2 THEN 'family' WHEN p_size % 5 = 3 THEN 'order' WHEN p_size % 25 = 4 THEN 'class' END AS rank FROM part),
wk AS (
  SELECT a.node, p.node AS at, p.parent AS next, 1 AS step, p.rank, p.name, coalesce(p.rank = 'class', false) AS done FROM nd a JOIN nd p ON p.node = a.parent AND a.node <> a.parent
  UNION ALL
  SELECT w.node, p.node, p.parent, w.step + 1, p.rank, p.name, w.done OR coalesce(p.rank = 'class', false) FROM wk w JOIN nd p ON p.node = w.next AND w.at <> w.next WHERE w.step < 12 AND NOT w.done)"""


@query("j18_taxon_chain", "WITH RECURSIVE " + CHAIN.strip() + """
SELECT a.node, arg_min(w.name, w.step) FILTER (WHERE w.rank = 'genus') AS genus, arg_min(w.name, w.step) FILTER (WHERE w.rank = 'family') AS family,
  arg_min(w.name, w.step) FILTER (WHERE w.rank = 'order') AS "order", arg_min(w.name, w.step) FILTER (WHERE w.rank = 'class') AS class
FROM nd a LEFT JOIN wk w ON w.node = a.node GROUP BY a.node""")
def j18(spark, sf):
    return profiles.taxon_chain(b.taxa(spark, sf))


@query("j19_final_titles", """
WITH t AS (SELECT 'page ' || p_partkey AS title FROM part),
n AS (SELECT 'page ' || p_partkey AS source, 'Page ' || p_partkey AS target FROM part WHERE p_size % 3 <> 0),
r AS (SELECT CASE WHEN p_size % 3 <> 0 THEN 'Page ' ELSE 'page ' END || p_partkey AS source, 'Article ' || (p_partkey % 100) AS target FROM part WHERE p_size % 2 = 0)
SELECT t.title, coalesce(r.target, n.target, t.title) AS final FROM t LEFT JOIN n ON n.source = t.title LEFT JOIN r ON r.source = coalesce(n.target, t.title)""")
def j19(spark, sf):
    part = b.table(spark, sf, "part")
    label = F.col("p_partkey").cast("string")
    titles = part.select(F.concat(F.lit("page "), label).alias("title"))
    normalized = part.where("p_size % 3 <> 0").select(F.concat(F.lit("page "), label).alias("source"), F.concat(F.lit("Page "), label).alias("target"))
    redirects = part.where("p_size % 2 = 0").select(
        F.concat(F.when(F.col("p_size") % 3 != 0, "Page ").otherwise("page "), label).alias("source"),
        F.concat(F.lit("Article "), (F.col("p_partkey") % 100).cast("string")).alias("target"),
    )
    return profiles.final_titles(titles, normalized, redirects)


# ---- text --------------------------------------------------------------------------------------

@query("e13_slugs", r"SELECT c_custkey, regexp_replace(regexp_replace(lower('  ' || c_name || ' (' || c_mktsegment || ')'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer")
def e13(spark, sf):
    raw = F.concat(F.lit("  "), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))
    return b.table(spark, sf, "customer").select("c_custkey", text.slug(raw).alias("slug"))


@query("e14_photo_captions", r"""
SELECT p_partkey, CASE WHEN regexp_matches(lower(f), '\bfemale\b|\(f\)|_f\b| f\.') THEN 'Female' WHEN regexp_matches(lower(f), '\bmale\b|\(m\)') THEN 'Male' ELSE '' END AS caption
FROM (SELECT p_partkey, p_name || CASE p_size % 7 WHEN 0 THEN ' Female.jpg' WHEN 1 THEN ' (M).jpg' WHEN 2 THEN '_f.jpg' WHEN 3 THEN ' male and female.jpg' WHEN 4 THEN ' Male.jpg' WHEN 5 THEN ' f.png' ELSE 'males.jpg' END AS f FROM part)""")
def e14(spark, sf):
    endings = (" Female.jpg", " (M).jpg", "_f.jpg", " male and female.jpg", " Male.jpg", " f.png", "males.jpg")
    ending = F.get(F.array(*[F.lit(e) for e in endings]), (F.col("p_size") % 7))
    return b.table(spark, sf, "part").select("p_partkey", text.photo_caption(F.concat("p_name", ending)).alias("caption"))


@query("e15_stripped_html", r"""
SELECT page_id, md5(concat(ltrim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), ' ééé¬it; &lt; €&zzz; x')) AS digest FROM pages""")
def e15(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", F.md5(text.strip_html(F.concat("html", F.lit(" &eacute;&#233;&#xE9;&notit; &amp;lt; &#128;&zzz; <i>x</i>&nbsp;")))).alias("digest"))


@query("e15_untracked_urls", """
SELECT page_id, CASE WHEN kept = '' THEN base ELSE base || '?' || kept END AS url FROM (
  SELECT page_id, split_part(u, '?', 1) AS base, array_to_string(list_filter(string_split(substr(u, length(split_part(u, '?', 1)) + 2), '&'), lambda p: NOT starts_with(p, 'utm_')), '&') AS kept
  FROM (SELECT page_id, url || '?utm_source=x' || CASE WHEN page_id % 2 = 0 THEN '&width=' || page_id || '&utm_medium=y&v=2' ELSE '' END AS u FROM pages))""")
def e15_urls(spark, sf):
    extra = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("&width="), F.col("page_id").cast("string"), F.lit("&utm_medium=y&v=2"))).otherwise("")
    return b.table(spark, sf, "pages").select("page_id", text.strip_tracking(F.concat("url", F.lit("?utm_source=x"), extra)).alias("url"))


@query("e16_display_names", """
SELECT p_partkey, upper(left(n, 1)) || substr(n, 2) AS name FROM (
  SELECT p_partkey, coalesce(CASE WHEN label <> '' AND lower(label) <> lower(sci) THEN label END, CASE WHEN given <> '' AND lower(given) <> lower(sci) THEN given END, CASE WHEN title <> '' AND lower(title) <> lower(sci) THEN title END, sci) AS n
  FROM (SELECT p_partkey, p_name AS sci, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE '' END AS label, CASE WHEN p_size % 4 = 0 THEN 'the ' || p_type END AS given, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE '' END AS title FROM part))""")
def e16(spark, sf):
    size = F.col("p_size")
    part = b.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("sci"), F.when(size % 3 == 0, F.upper("p_name")).otherwise("").alias("label"),
        F.when(size % 4 == 0, F.concat(F.lit("the "), "p_type")).alias("given"), F.when(size % 5 == 0, F.col("p_brand")).otherwise("").alias("title"),
    )
    return part.select("p_partkey", text.display_name(F.col("sci"), F.col("label"), F.col("given"), F.col("title")).alias("name"))


GROUPED = "CASE WHEN {v} < 1000 THEN CAST({v} AS VARCHAR) ELSE regexp_replace(CAST({v} // 1000 AS VARCHAR), '(\\d)((\\d\\d)+)$', '\\1,\\2') || ',' || lpad(CAST({v} % 1000 AS VARCHAR), 3, '0') END"


@query("e24_range_text", """
SELECT l_orderkey, l_linenumber, CASE WHEN lo = hi THEN one(hi) WHEN unit = 'g' AND hi >= 1000 THEN one(lo) || ' – ' || one(hi) ELSE whole(lo) || '–' || one(hi) END AS words,
  CASE WHEN unit <> 'g' THEN '' WHEN hg <= hi * 3 THEN 'Lighter than ' || heavier WHEN lighter IS NOT NULL THEN 'Heavier than ' || lighter ELSE '' END AS compared
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'g' ELSE 'cm' END AS unit, l_quantity AS lo, CASE WHEN l_linenumber = 4 THEN l_quantity ELSE l_quantity * l_linenumber * 30 END AS hi FROM lineitem) r,
LATERAL (SELECT min(g) AS hg, arg_min(n, g) AS heavier FROM wt WHERE g > r.hi) a, LATERAL (SELECT arg_max(n, g) AS lighter FROM wt WHERE g < r.lo) z""".replace(
    "one(hi)", "CASE WHEN unit = 'g' AND hi >= 1000 THEN CAST(floor(hi / 100 + 0.5) AS BIGINT) // 10 || CASE WHEN CAST(floor(hi / 100 + 0.5) AS BIGINT) % 10 = 0 THEN '' ELSE '.' || CAST(floor(hi / 100 + 0.5) AS BIGINT) % 10 END || ' kg' ELSE whole(hi) || ' ' || unit END"
).replace("one(lo)", "whole(lo) || ' ' || unit").replace("whole(lo)", "CAST(CAST(floor(lo + 0.5) AS BIGINT) AS VARCHAR)").replace(
    "whole(hi)", "CASE WHEN floor(hi + 0.5) < 1000 THEN CAST(CAST(floor(hi + 0.5) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(hi + 0.5) AS BIGINT) // 1000 AS VARCHAR) || ',' || lpad(CAST(CAST(floor(hi + 0.5) AS BIGINT) % 1000 AS VARCHAR), 3, '0') END"
).replace("FROM wt", "FROM (VALUES ('a coin', 5), ('a pencil', 8), ('a sparrow', 30), ('a cricket ball', 160), ('a mango', 300), ('a litre of milk', 1030), ('a bag of rice', 5000), ('a person', 65000), ('a car', 1300000), ('an elephant', 4000000)) w(n, g)"))
def e24(spark, sf):
    """Ranges of up to some thousands of grams or centimetres."""
    number = F.col("l_linenumber")
    rows = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(number % 2 == 0, "g").otherwise("cm").alias("unit"), F.col("l_quantity").alias("lo"),
        F.when(number == 4, F.col("l_quantity")).otherwise(F.col("l_quantity") * number * 30).alias("hi"),
    )
    lo, hi, unit = F.col("lo"), F.col("hi"), F.col("unit")
    return rows.select("l_orderkey", "l_linenumber", text.range_text(lo, hi, unit).alias("words"), text.weight_comparison(lo, hi, unit).alias("compared"))


@query("t07_first_images", """
SELECT item, CAST(place AS INTEGER) AS place, url FROM (SELECT 'Q' || (page_id // 8) AS item, url, row_number() OVER (PARTITION BY page_id // 8 ORDER BY page_id) AS place FROM pages) WHERE place <= 3""")
def t07(spark, sf):
    item = F.concat(F.lit("Q"), F.floor(F.col("page_id") / 8).cast("long").cast("string"))
    media = b.table(spark, sf, "pages").select(item.alias("item"), F.col("page_id").alias("pos"), "url")
    return profiles.first_images(media).select("item", "place", "url")


# ---- whole profiles ----------------------------------------------------------------------------

def _profiles(spark, sf):
    """Profiles of the parts' species: entity, chain, intro from a document, photos from the pages."""
    species, stated, articles = _entities(spark, sf)
    part = b.table(spark, sf, "part")
    number = F.regexp_extract("item", r"(\d+)", 1).cast("long") - 1
    entity = part.select((F.col("p_partkey")).alias("_n"), F.col("p_name").alias("label"), F.col("p_brand").alias("title"))
    found = profiles.resolve_items(species, stated, articles, "P846", "P225").withColumn("_n", number)
    items = found.join(entity, "_n").select("sci", "item", "_n", "label", "title", F.lit("").alias("common"), F.lit("Backup").alias("family"), F.concat(F.lit("about "), "label").alias("description"))
    chain = profiles.taxon_chain(b.taxa(spark, sf)).withColumn("item", F.concat(F.lit("Q"), (F.col("node") + 1).cast("string"))).drop("node")
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("_n"), F.col("text").alias("extract"))
    pages = items.join(docs, "_n").select(
        "sci", F.lit(True).alias("linked"), "extract", F.lit(False).alias("disambiguation"), F.lit(False).alias("missing"), F.concat(F.lit("wiki/"), "item").alias("url"),
    )
    media = b.table(spark, sf, "pages").select(
        F.concat(F.lit("Q"), (F.col("page_id") % 150 + 1).cast("string")).alias("item"), F.col("page_id").alias("pos"), "url", F.concat("url", F.lit("?t")).alias("thumb"),
        F.when(F.col("page_id") % 4 != 0, "CC BY").otherwise("").alias("license"), F.lit("").alias("caption"),
    )
    measured = part.select(
        F.concat(F.lit("Q"), (F.col("p_partkey") + 1).cast("string")).alias("item"), F.when(F.col("p_size") % 2 == 0, "mass").otherwise("length").alias("prop"),
        F.col("p_partkey").alias("pos"), F.lit("normal").alias("rank"), F.lit("Q41803").alias("unit"), F.col("p_retailprice").alias("amount"),
        F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
    )
    aliases = part.select(F.concat(F.lit("Q"), (F.col("p_partkey") + 1).cast("string")).alias("item"), F.lit(0).alias("pos"), F.col("p_type").alias("alias"))
    status = part.select(
        F.concat(F.lit("Q"), (F.col("p_partkey") + 1).cast("string")).alias("item"), F.lit("P141").alias("prop"), F.lit(0).alias("pos"), F.lit("normal").alias("rank"),
        F.element_at(F.array(F.lit("Q0"), *[F.lit(s) for s in STATUS]), (F.col("p_size") % 9 + 1).cast("int")).alias("value"),
    )
    return products.build_profiles(items, chain, pages, media, measured, status, aliases, "see each image")


WHOLE = """
it AS (SELECT sci, arg_max(item, (k + n, article, -num)) AS item, arg_max(num, (k + n, article, -num)) - 1 AS num FROM sc WHERE k + n > 0 GROUP BY sci),
ph AS (SELECT 'Q' || (page_id % 150 + 1) AS item, url, row_number() OVER (PARTITION BY page_id % 150 ORDER BY page_id) AS place FROM pages WHERE page_id % 4 <> 0)"""


@query("a37_profiles", ref.sql("""
SELECT lower(replace(i.sci, ' ', '-')) AS slug, i.sci AS scientific, upper(left(p.p_name, 1)) || substr(p.p_name, 2) AS name, i.item AS qid,
  coalesce(list_filter(list_transform(string_split(d.text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], '') AS extract,
  (SELECT count(*) FROM ph WHERE ph.item = i.item AND place <= 3) AS photos, CASE WHEN p.p_size % 2 = 0 THEN round(p.p_retailprice, 1) END AS mass_lo, CASE WHEN p.p_size % 2 = 1 THEN round(p.p_retailprice, 1) END AS length_hi, p.p_type AS other_name,
  'about ' || p.p_name AS description, CASE p.p_size % 9 WHEN 1 THEN 'LC' WHEN 2 THEN 'NT' WHEN 3 THEN 'VU' WHEN 4 THEN 'EN' WHEN 5 THEN 'CR' WHEN 6 THEN 'EW' WHEN 7 THEN 'EX' WHEN 8 THEN 'DD' END AS status,
  'entity ' || i.item || CASE WHEN d.doc_id IS NOT NULL THEN ',article wiki/' || i.item ELSE '' END AS sources, 'see each image' AS licence_note
FROM it i JOIN part p ON p.p_partkey = i.num LEFT JOIN documents d ON d.doc_id = i.num""", ENTITIES, WHOLE))
def a37(spark, sf):
    return _profiles(spark, sf).select(
        "slug", "scientific", "name", "qid", "extract", F.coalesce(F.size("images"), F.lit(0)).cast("long").alias("photos"),
        F.col("facts.mass.lo").alias("mass_lo"), F.col("facts.length.hi").alias("length_hi"), F.get("other_names", F.lit(0)).alias("other_name"),
        "description", F.col("facts.status.code").alias("status"), F.array_join(F.transform("sources", lambda x: F.concat_ws(" ", x["label"], x["at"])), ",").alias("sources"), "licence_note",
    )


@query("a37_profile_taxonomy", "WITH RECURSIVE " + ", ".join(x.strip() for x in (CHAIN, ENTITIES, WHOLE)) + """
SELECT i.sci AS scientific, arg_min(w.name, w.step) FILTER (WHERE w.rank = 'genus') AS genus, coalesce(arg_min(w.name, w.step) FILTER (WHERE w.rank = 'family'), 'Backup') AS family,
  arg_min(w.name, w.step) FILTER (WHERE w.rank = 'order') AS "order" FROM it i LEFT JOIN wk w ON w.node = i.num GROUP BY i.sci""")
def a37_taxonomy(spark, sf):
    return _profiles(spark, sf).select("scientific", "taxonomy.genus", "taxonomy.family", "taxonomy.order")


@query("sk10_profile_index", ref.sql("""
SELECT lower(replace(i.sci, ' ', '-')) AS slug, upper(left(p.p_name, 1)) || substr(p.p_name, 2) AS name, i.sci, (SELECT url || '?t' FROM ph WHERE ph.item = i.item AND place = 1) AS thumb
FROM it i JOIN part p ON p.p_partkey = i.num""", ENTITIES, WHOLE))
def sk10(spark, sf):
    return products.profiles(_profiles(spark, sf), new_path(spark, "profiles"))
