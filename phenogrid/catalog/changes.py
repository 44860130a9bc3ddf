"""Roll-up of changed tiles, land in boxes at all levels, boxes and searches as data, tiles along a curve (A29, A30, J9, J13, T2, SK11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.catalog.tilesets import _mask
from phenogrid.functions import grid
from phenogrid.operators import boxes, documents, occupancy, raster, rollup, search_index
from phenogrid.plans import products
from phenogrid.rules import REGIONS
from phenogrid.session import new_path
from phenogrid.sources import bindings as b
from phenogrid.sources import sinks

PX = b.TILE_PX
TOP, BOTTOM = b.LEVEL, b.LEVEL - 3

# ---- true colour: tiles of the finest level change, their ancestors follow -----------------------------------------

CHANNELS = "CAST(p_size * 5 % 256 AS INTEGER) AS r, CAST(p_partkey % 256 AS INTEGER) AS g, CAST(cls * 20 AS INTEGER) AS b"
#: Which tiles (x, y) of the finest level the old and the new set hold, and where red was inverted in between.
OLD, NEW, INVERTED = "(x + y) % 3 <> 0", "((x + y) % 3 = 1 AND y % 6 <> 0 OR (x + y) % 3 = 2 OR x % 4 = 0)", "(x + 2 * y) % 11 = 0"


def colour_level(name: str, source: str, z: int) -> str:
    """The level above ``source`` in full: means of 2 x 2, halves to even, black where a child tile is missing."""
    half = PX // 2
    return f"""
{name}_t AS (SELECT DISTINCT gx // {PX} AS x, gy // {PX} AS y FROM {source}),
{name} AS (
  SELECT CAST(gx // 2 AS INTEGER) AS gx, CAST(gy // 2 AS INTEGER) AS gy, CAST(round_even(avg(r), 0) AS INTEGER) AS r, CAST(round_even(avg(g), 0) AS INTEGER) AS g, CAST(round_even(avg(b), 0) AS INTEGER) AS b
  FROM {source} GROUP BY ALL
  UNION ALL SELECT CAST((2 * x + i) * {half} + a AS INTEGER), CAST((2 * y + j) * {half} + c AS INTEGER), 0, 0, 0
  FROM (SELECT DISTINCT x // 2 AS x, y // 2 AS y FROM {name}_t), (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j), (SELECT unnest(range({half})) AS a), (SELECT unnest(range({half})) AS c)
  WHERE (2 * x + i, 2 * y + j) NOT IN (SELECT (x, y) FROM {name}_t))"""


COLOUR = f"""
c15 AS (SELECT gx, gy, CASE WHEN {INVERTED} THEN 255 - r ELSE r END AS r, g, b FROM (
  SELECT px.gx, px.gy, px.gx // {PX} AS x, px.gy // {PX} AS y, {CHANNELS.replace('p_partkey', 'px.p_partkey')} FROM px JOIN part ON part.p_partkey = px.p_partkey) WHERE {NEW})"""


@query("a30_changed_tiles", ref.pixels(
    "\nUNION ALL ".join(f"SELECT CAST({z} AS INTEGER) AS z, gx, gy, r, g, b FROM c{z}" for z in range(TOP, BOTTOM - 1, -1)),
    COLOUR, *[colour_level(f"c{z}", f"c{z + 1}", z) for z in range(TOP - 1, BOTTOM - 1, -1)]))
def a30_changed(spark, sf):
    """An old three-channel pyramid, then tiles added, altered and removed: only what is above them is made anew, and the
    whole set equals a full roll-up."""
    part = b.table(spark, sf, "part").select("p_partkey", "p_size")
    p = b.pixels(spark, sf).join(part, "p_partkey").selectExpr("gx", "gy", *CHANNELS.split(", ")).withColumns(rollup.tile_of(PX))
    columns = ["z", "gx", "gy", "r", "g", "b"]
    old = p.where(OLD).select(F.lit(TOP).alias("z"), *columns[1:])
    before = rollup.changed_levels(old, rollup.tiles_in(old, PX), TOP, BOTTOM, PX).select(*columns)
    new = p.where(NEW).withColumn("r", F.when(F.expr(INVERTED), 255 - F.col("r")).otherwise(F.col("r"))).select(F.lit(TOP).alias("z"), *columns[1:])
    changed = p.where(f"({OLD}) <> ({NEW}) OR ({NEW}) AND {INVERTED}").select("x", "y").distinct()
    return products.true_colour_update(new.unionByName(before), changed, TOP, BOTTOM, PX).select(*columns)


# ---- world levels above a detail set -----------------------------------------------------------------------------------


def world_level(z: int, source: str) -> str:
    """SQL of one rebuilt world level from the level below: children first, the old quarter where one is missing."""
    return f"""
t{z} AS (SELECT DISTINCT gx // {PX * 2} AS x, gy // {PX * 2} AS y FROM {'dt' if z == TOP - 1 else f'u{z + 1}'}),
u{z} AS (SELECT x * {PX} AS gx, y * {PX} AS gy FROM t{z}),
k{z} AS (SELECT * FROM {source} WHERE (gx // {PX * 2}, gy // {PX * 2}) IN (SELECT (x, y) FROM t{z})),
{ref.halved(f'h{z}', f'k{z}').strip()},
n{z} AS (
  SELECT gx, gy, cls, CASE WHEN cls = 0 THEN 0 ELSE round_even(tree, 0) END AS tree FROM h{z}
  UNION ALL SELECT gx, gy, cls, tree FROM o{z} WHERE (gx // {PX}, gy // {PX}) IN (SELECT (x, y) FROM t{z}) AND (gx // {PX // 2}, gy // {PX // 2}) NOT IN (SELECT DISTINCT (gx // {PX}, gy // {PX}) FROM k{z})),
l{z} AS (SELECT DISTINCT gx // {PX} AS x, gy // {PX} AS y FROM n{z} WHERE cls > 0),
w{z} AS (
  SELECT n.gx, n.gy, n.cls, n.tree, CAST(NULL AS DOUBLE) AS elev, o.gx IS NULL OR o.cls <> n.cls OR o.tree IS DISTINCT FROM n.tree AS differs FROM n{z} n LEFT JOIN o{z} o ON o.gx = n.gx AND o.gy = n.gy WHERE (n.gx // {PX}, n.gy // {PX}) IN (SELECT (x, y) FROM l{z})
  UNION ALL SELECT gx, gy, cls, tree, NULL, false FROM o{z} WHERE (gx // {PX}, gy // {PX}) NOT IN (SELECT (x, y) FROM l{z}))"""


@query("j13_world_levels", ref.pixels(
    "\nUNION ALL ".join(f"SELECT CAST({z} AS INTEGER) AS z, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(cls AS INTEGER) AS cls, CAST(tree AS DOUBLE) AS tree, bool_or(differs) OVER (PARTITION BY gx // {PX}, gy // {PX}) AS rewritten FROM w{z}" for z in range(TOP - 1, BOTTOM - 1, -1)),
    *[ref.halved(f"p{i}", "px" if i == 1 else f"p{i - 1}") for i in range(1, 4)],
    ", ".join(f"o{TOP - i} AS (SELECT gx, gy, cls, CAST(cls AS DOUBLE) AS tree, elev FROM p{i})" for i in range(1, 4)),
    f"dt AS (SELECT gx, gy, cls, tree, elev FROM px WHERE (gx // {PX} + gy // {PX}) % 3 <> 0 AND (gx // {PX * 2}) % 3 <> 1)",
    *[world_level(z, "dt" if z == TOP - 1 else f"w{z + 1}") for z in range(TOP - 1, BOTTOM - 1, -1)]))
def j13_levels(spark, sf):
    """Detail for some tiles: every world level above is rebuilt from the one below and keeps its own quarters elsewhere."""
    p = b.pixels(spark, sf)
    x, y = F.floor(F.col("gx") / PX), F.floor(F.col("gy") / PX)
    detail = p.where(((x + y) % 3 != 0) & (F.floor(F.col("gx") / (2 * PX)) % 3 != 1)).select("gx", "gy", "cls", "tree")
    old = raster.pyramid(p, TOP, BOTTOM, ()).where(F.col("z") < TOP).withColumn("tree", F.col("cls").cast("double"))
    return products.world_from_detail(detail, old, TOP - 1, BOTTOM, PX)


# ---- land in boxes at any level ---------------------------------------------------------------------------------------------

FINEST = 5
MASK = """
mk AS (SELECT DISTINCT greatest(0, least(143, CAST(floor((lng + 180) / 360 * 144) AS INTEGER))) AS gx, greatest(0, least(71, CAST(floor((90 - lat) / 180 * 72) AS INTEGER))) AS gy FROM rec),
gr AS (SELECT DISTINCT (gx + dx + 144) % 144 AS gx, (gy + dy + 72) % 72 AS gy FROM mk, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy))"""


def land_level(z: int) -> str:
    cols, rows = 2 ** (z + 1), 2**z
    if 72 % rows == 0 and 144 % cols == 0:
        return f"SELECT DISTINCT {z} AS z, CAST(gx // {144 // cols} AS INTEGER) AS x, CAST(gy // {72 // rows} AS INTEGER) AS y FROM gr"
    return f"""SELECT DISTINCT {z} AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT unnest(range({cols})) AS x), (SELECT unnest(range({rows})) AS y), gr
  WHERE least(143, (2 * x + 1) * 144 // {2 * cols}) = gx AND least(71, (2 * y + 1) * 72 // {2 * rows}) = gy"""


BOX_SQL = """SELECT c_custkey AS id, CAST(c_custkey * 104729 % 33000 AS DOUBLE) / 100 - 180 AS west, CAST(c_custkey * 7919 % 16000 AS DOUBLE) / 100 - 90 AS south,
  CAST(c_custkey * 104729 % 33000 AS DOUBLE) / 100 - 180 + c_custkey % 28 + 0.25 AS east, CAST(c_custkey * 7919 % 16000 AS DOUBLE) / 100 - 90 + c_custkey % 19 + 0.25 AS north FROM customer"""


@query("a29_land_in_boxes", ref.sql(f"""
SELECT b.id, CAST(l.z AS INTEGER) AS z, l.x, l.y, CAST(l.y AS BIGINT) * (CAST(2 AS BIGINT) << l.z) + l.x AS pos FROM lands l JOIN bx b
  ON l.x >= floor((b.west + 180) / (180.0 / (1 << l.z))) AND l.x < ceil((b.east + 180) / (180.0 / (1 << l.z))) AND l.y >= floor((90 - b.north) / (180.0 / (1 << l.z))) AND l.y < ceil((90 - b.south) / (180.0 / (1 << l.z)))""",
    ref.RECORDS, MASK, f"bx AS ({BOX_SQL})", "lands AS (" + "\nUNION ALL ".join(land_level(z) for z in range(FINEST + 1)) + ")"))
def a29_boxes(spark, sf):
    """The land tiles of every level in the box of every customer, by going down one tree of tiles."""
    table = occupancy.occupancy(_mask(spark, sf), 144, 72, FINEST)
    key = F.col("c_custkey")
    west, south = (key * 104729 % 33000).cast("double") / 100 - 180, (key * 7919 % 16000).cast("double") / 100 - 90
    bx = b.table(spark, sf, "customer").select(key.alias("id"), west.alias("west"), south.alias("south"), (west + key % 28 + 0.25).alias("east"), (south + key % 19 + 0.25).alias("north"))
    return occupancy.in_boxes(bx, table, FINEST)


# ---- boxes as data -----------------------------------------------------------------------------------------------------------


@query("j09_boxes_as_data", """
WITH p AS (SELECT o_orderkey AS id, CAST((o_orderkey * 31 + 5) * 7919 % 18000 AS DOUBLE) / 100 - 90 AS lat, CAST((o_orderkey * 17 + 3) * 104729 % 36000 AS DOUBLE) / 100 - 180 AS lng FROM orders),
b AS (SELECT c_custkey AS ord, c_name AS name, lat0, lat0 + side AS lat1, lng0, lng0 + side * 1.5 AS lng1 FROM (
  SELECT *, CAST(c_custkey * 7919 % 17000 AS DOUBLE) / 100 - 90 AS lat0, CAST(c_custkey * 104729 % 34000 AS DOUBLE) / 100 - 180 AS lng0, CASE c_custkey % 5 WHEN 0 THEN 20 WHEN 1 THEN 3 ELSE 0.5 END::DOUBLE AS side FROM customer))
SELECT p.id, arg_min(b.name, b.ord) AS name FROM p LEFT JOIN b ON p.lat >= b.lat0 AND p.lat < b.lat1 AND p.lng >= b.lng0 AND p.lng < b.lng1 GROUP BY p.id""")
def j09_data(spark, sf):
    """The first of the customers' boxes, which overlap and differ forty times in size, around each order's point."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    points = b.table(spark, sf, "orders").select(o.alias("id"), (((o * 31 + 5) * 7919 % 18000).cast("double") / 100 - 90).alias("lat"), (((o * 17 + 3) * 104729 % 36000).cast("double") / 100 - 180).alias("lng"))
    side = F.when(c % 5 == 0, 20.0).when(c % 5 == 1, 3.0).otherwise(0.5)
    lat0, lng0 = (c * 7919 % 17000).cast("double") / 100 - 90, (c * 104729 % 34000).cast("double") / 100 - 180
    areas = b.table(spark, sf, "customer").select(c.alias("ord"), F.col("c_name").alias("name"), lat0.alias("lat0"), (lat0 + side).alias("lat1"), lng0.alias("lng0"), (lng0 + side * 1.5).alias("lng1"))
    return boxes.first_box(points, areas, "id", "ord", "name").select("id", "name")


@query("g12_regions_as_data", ref.occ("SELECT cell, region FROM regioned", ref.REGION_BOXES))
def g12_data(spark, sf):
    """Regions of cells with the boxes as a table: the home set first, then the first box, else elsewhere."""
    rows = [(i, name, float(a), float(z), float(w), float(e)) for i, (name, a, z, w, e) in enumerate(REGIONS)]
    regions = spark.createDataFrame(rows, "ord int, region string, lat0 double, lat1 double, lng0 double, lng1 double")
    cells = b.records(spark, sf).select(grid.snap_lat(F.col("lat")).alias("lat0"), grid.snap_lng(F.col("lng")).alias("lng0")).distinct()
    centres = cells.select(grid.cell_id(F.col("lat0"), F.col("lng0")).alias("cell"), F.expr(f"{b.HOME}").alias("home"), (F.col("lat0") + 0.5).alias("lat"), (F.col("lng0") + 0.5).alias("lng"))
    found = boxes.first_box(centres, regions, "cell", "ord", "region")
    return found.select("cell", F.when(F.col("home"), "India").otherwise(F.coalesce("region", F.lit("elsewhere"))).alias("region"))


# ---- search on postings ----------------------------------------------------------------------------------------------------

SEARCHES = ("Customer#00000001", "mer#", "11", "machinery", "customer", "7", "b", "zz", "Customer#000000149 ", "e")


@query("t02_indexed_search", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{q}' AS query, k, name, cells, rank FROM (
  SELECT k, name, cells, CASE WHEN starts_with(lower(name), '{q.strip().lower()}') OR starts_with(lower(sci), '{q.strip().lower()}') THEN 0
    WHEN len(list_filter(string_split_regex(lower(name), '\\s+'), lambda w: starts_with(w, '{q.strip().lower()}'))) > 0 THEN 1
    WHEN contains(lower(name), '{q.strip().lower()}') OR contains(lower(sci), '{q.strip().lower()}') THEN 2 END AS rank
  FROM (SELECT CAST(c_custkey AS VARCHAR) AS k, lower(c_mktsegment) || ' ' || c_name AS name, 'Q' || c_custkey || ' ' || c_nationkey AS sci, CAST(c_custkey % 90 AS BIGINT) AS cells FROM customer))
  WHERE rank IS NOT NULL ORDER BY rank, cells DESC, k LIMIT 6)""" for q in SEARCHES))
def t02_index(spark, sf):
    """Ten searches over names on stored postings: same rank and order as a scan of the list."""
    c = b.table(spark, sf, "customer")
    names = c.select(
        F.col("c_custkey").cast("string").alias("k"), F.concat(F.lower("c_mktsegment"), F.lit(" "), "c_name").alias("name"),
        F.concat(F.lit("Q"), F.col("c_custkey").cast("string"), F.lit(" "), F.col("c_nationkey").cast("string")).alias("sci"), (F.col("c_custkey") % 90).cast("long").alias("cells"),
    )
    path = new_path(spark, "postings")
    search_index.write(names, path)
    out = None
    for q in SEARCHES:
        found = search_index.search(spark, path, q).select(F.lit(q).alias("query"), "k", "name", "cells", "rank")
        out = found if out is None else out.unionByName(found)
    return out


# ---- tiles along a curve ---------------------------------------------------------------------------------------------------

WINDOWS = tuple((b.GX0 + x, b.GY0 + y, side) for side in (PX, 4 * PX) for x in (0, 2 * PX) for y in (0, 2 * PX))


@query("sk11_pruned_tiles", ref.pixels(" UNION ALL ".join(f"""
SELECT CAST({i} AS INTEGER) AS win, count(*) AS pixels, CAST(coalesce(sum(cls), 0) AS BIGINT) AS classes, true AS pruned FROM px WHERE gx >= {x} AND gx < {x + s} AND gy >= {y} AND gy < {y + s}""" for i, (x, y, s) in enumerate(WINDOWS))))
def sk11_pruned(spark, sf):
    """Tiles and boxes read back from a tile sink; ``pruned``: by their statistics, at most half of the files can hold a
    tile, and some can't hold a box."""
    path = new_path(spark, "tiles")
    sinks.write_tiles(b.pixels(spark, sf).withColumn("z", F.lit(TOP)), path, files=32)
    stored = spark.read.parquet(path).where(F.col("z") == TOP)
    spans = stored.groupBy(F.input_file_name().alias("file")).agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"))
    out = None
    for i, (x, y, side) in enumerate(WINDOWS):
        held = stored.where((F.col("gx") >= x) & (F.col("gx") < x + side) & (F.col("gy") >= y) & (F.col("gy") < y + side)).agg(F.count("*").alias("pixels"), F.coalesce(F.sum("cls"), F.lit(0)).cast("long").alias("classes"))
        touched = F.count_if((F.col("x1") >= x) & (F.col("x0") < x + side) & (F.col("y1") >= y) & (F.col("y0") < y + side))
        enough = touched * 2 <= F.count("*") if side == PX else touched < F.count("*")
        one = held.withColumn("win", F.lit(i)).join(spans.agg(enough.alias("pruned")).withColumn("win", F.lit(i)), "win")
        out = one if out is None else out.unionByName(one)
    return out.select("win", "pixels", "classes", "pruned")
