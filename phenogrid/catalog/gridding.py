"""Grid, tile and geo functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.registry import query
from phenogrid.functions import geo, grid, tiles
from phenogrid.operators import counting, flow, quality, species_view, tileset, tracks
from phenogrid.sources import bindings as b


def _cells(spark, sf):
    """Distinct cells of the records with their corner."""
    return counting.with_cell(b.month_counts(spark, sf)).select("cell", "lat0", "lng0").distinct()


@query("g01_cell_id", ref.occ("SELECT DISTINCT lat0, lng0, lat0 || '_' || lng0 AS cell FROM counts"))
def g01(spark, sf):
    return _cells(spark, sf)


HALF = "CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"


@query("g02_cell_at_half_degree", ref.places(f"""
SELECT name, {HALF.format(v='a')} || '_' || {HALF.format(v='o')} AS cell FROM (
  SELECT name, floor(lat / CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS a, floor(lng / CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS o FROM pl)"""))
def g02(spark, sf):
    return b.places(spark, sf).select("name", grid.cell_at(F.col("lng"), F.col("lat"), 0.5).alias("cell"))


@query("g03_cell_geometry", ref.occ("""
SELECT cell, CAST(lat0 + 0.5 AS DOUBLE) AS mid_lat, CAST(lng0 + 0.5 AS DOUBLE) AS mid_lng, lng0 || ' ' || lat0 || ',' || (lng0 + 1) || ' ' || lat0 || ',' || (lng0 + 1) || ' ' || (lat0 + 1) || ',' || lng0 || ' ' || (lat0 + 1) || ',' || lng0 || ' ' || lat0 AS ring
FROM cells"""))
def g03(spark, sf):
    ring = grid.cell_ring(F.col("lat0").cast("double"), F.col("lng0").cast("double"), 1.0)
    corner = F.transform(ring, lambda p: F.concat_ws(" ", p[0].cast("int").cast("string"), p[1].cast("int").cast("string")))
    return _cells(spark, sf).select("cell", (F.col("lat0") + 0.5).alias("mid_lat"), (F.col("lng0") + 0.5).alias("mid_lng"), F.array_join(corner, ",").alias("ring"))


@query("g04_parse_cell_id", ref.occ("""
SELECT DISTINCT lat0 || '_' || lng0 AS id, CAST(lat0 AS DOUBLE) AS lat, CAST(lng0 AS DOUBLE) AS lng FROM counts WHERE month % 3 = 0"""))
def g04(spark, sf):
    """Valid ids among mangled ones: a missing part, words and extra parts are rejected."""
    cells = counting.with_cell(b.month_counts(spark, sf))
    mangled = F.when(F.col("month") % 3 == 0, F.col("cell")).when(F.col("month") % 3 == 1, F.concat("cell", F.lit("_x"))).otherwise(F.concat(F.lit("a"), "cell"))
    ids = cells.select(mangled.alias("id")).distinct()
    return ids.where(grid.is_cell_id(F.col("id"))).select("id", grid.cell_lat(F.col("id")).alias("lat"), grid.cell_lng(F.col("id")).alias("lng"))


@query("g05_region_grid", ref.occ("""
SELECT s.lat || '_' || g.lng AS cell, coalesce(CAST(sum(c.n) AS BIGINT), 0) AS records
FROM (SELECT unnest(range(x0, x1 + 1)) AS lat FROM (SELECT min(lat0) AS x0, max(lat0) AS x1 FROM counts WHERE nation_box)) s
CROSS JOIN (SELECT unnest(range(y0, y1 + 1)) AS lng FROM (SELECT min(lng0) AS y0, max(lng0) AS y1 FROM counts WHERE nation_box)) g
LEFT JOIN counts c ON c.lat0 = s.lat AND c.lng0 = g.lng GROUP BY ALL""".replace("nation_box", "lat0 >= 0 AND lat0 < 40 AND lng0 >= -30 AND lng0 < 100")))
def g05(spark, sf):
    """Every cell of the region spanned by the records of a window, with its records or zero."""
    counts = counting.with_cell(b.month_counts(spark, sf))
    inside = counts.where(grid.in_box(F.col("lat0"), F.col("lng0"), (0, 40, -30, 100)))
    extent = inside.agg(F.min("lat0").alias("a0"), F.max("lat0").alias("a1"), F.min("lng0").alias("o0"), F.max("lng0").alias("o1"))
    cells = extent.where(F.col("a0").isNotNull()).withColumn("lat0", F.explode(F.sequence("a0", "a1"))).withColumn("lng0", F.explode(F.sequence("o0", "o1")))
    probed = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    return cells.select(grid.cell_id(F.col("lat0"), F.col("lng0")).alias("cell")).join(probed, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("records"))


@query("g06_cell_bounds_text", ref.occ("""
SELECT cell, abs(lat0) || '°' || CASE WHEN lat0 >= 0 THEN 'N' ELSE 'S' END || ' to ' || abs(lat0 + 1) || '°' || CASE WHEN lat0 + 1 >= 0 THEN 'N' ELSE 'S' END || ', ' ||
  abs(lng0) || '°' || CASE WHEN lng0 >= 0 THEN 'E' ELSE 'W' END || ' to ' || abs(lng0 + 1) || '°' || CASE WHEN lng0 + 1 >= 0 THEN 'E' ELSE 'W' END AS bounds FROM cells"""))
def g06(spark, sf):
    return _cells(spark, sf).select("cell", grid.cell_bounds_text(F.col("lat0"), F.col("lng0"), 1).alias("bounds"))


@query("g07_tile_at_point", ref.places(f"SELECT name, {ref.tile_x('lng', 8)} AS x, {ref.tile_y('lat', 8)} AS y FROM pl"))
def g07(spark, sf):
    return tileset.tiles_of_points(b.places(spark, sf), 8).select("name", "x", "y")


@query("g08_tile_bounds", ref.places(f"""
SELECT name, CAST(x * 0.703125 - 180 AS DOUBLE) AS west, CAST(90 - y * 0.703125 - 0.703125 AS DOUBLE) AS south, CAST(x * 0.703125 - 180 + 0.703125 AS DOUBLE) AS east, CAST(90 - y * 0.703125 AS DOUBLE) AS north, 512 AS cols, 256 AS rows, CAST(0.703125 AS DOUBLE) / 256 AS pixel_deg
FROM (SELECT name, {ref.tile_x('lng', 8)} AS x, {ref.tile_y('lat', 8)} AS y FROM pl)"""))
def g08(spark, sf):
    edge = tiles.tile_span(8)
    west, north = tiles.tile_west(F.col("x"), 8), tiles.tile_north(F.col("y"), 8)
    return tileset.tiles_of_points(b.places(spark, sf), 8).select(
        "name", west.alias("west"), (north - edge).alias("south"), (west + edge).alias("east"), north.alias("north"),
        F.lit(tiles.tile_cols(8)).alias("cols"), F.lit(tiles.tile_rows(8)).alias("rows"), F.lit(edge / 256).alias("pixel_deg"),
    )


@query("g09_tile_family", ref.places(f"""
SELECT DISTINCT x >> 2 AS px, y >> 2 AS py, (x >> 2) * 2 + i AS cx, (y >> 2) * 2 + j AS cy, x >> 5 AS ax, y >> 5 AS ay
FROM (SELECT {ref.tile_x('lng', 8)} AS x, {ref.tile_y('lat', 8)} AS y FROM pl), (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)"""))
def g09(spark, sf):
    """Parents two levels up with their children, and their ancestor at level 3."""
    placed = tileset.tiles_of_points(b.places(spark, sf), 8)
    parents = placed.select(F.lit(6).alias("z"), tiles.up(F.col("x"), 2).alias("x"), tiles.up(F.col("y"), 2).alias("y")).distinct()
    family = tileset.descendants(parents, 1)
    return family.select(
        F.col("from_x").alias("px"), F.col("from_y").alias("py"), F.col("x").alias("cx"), F.col("y").alias("cy"),
        tiles.up(F.col("from_x"), 3).alias("ax"), tiles.up(F.col("from_y"), 3).alias("ay"),
    )


@query("g10_tiles_in_boxes", ref.places(f"""
SELECT s.name AS id, 7 AS z, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y FROM (
  SELECT name, greatest(0, x - 1) * 0.3515625 - 180 AS west, 90 - (least(511, y + 1) + 1) * 0.3515625 AS south, (least(1023, x + 1) + 1) * 0.3515625 - 180 AS east, 90 - greatest(0, y - 1) * 0.3515625 AS north
  FROM (SELECT name, {ref.tile_x('lng', 9)} AS x, {ref.tile_y('lat', 9)} AS y FROM pl)) s,
  LATERAL (SELECT unnest(range(CAST(greatest(0, floor((s.west + 180) / 1.40625)) AS BIGINT), CAST(least(256, ceil((s.east + 180) / 1.40625)) AS BIGINT))) AS gx),
  LATERAL (SELECT unnest(range(CAST(greatest(0, floor((90 - s.north) / 1.40625)) AS BIGINT), CAST(least(128, ceil((90 - s.south) / 1.40625)) AS BIGINT))) AS gy)"""))
def g10(spark, sf):
    """Boxes of 3 x 3 level-9 tiles around each place, and the level-7 tiles they overlap."""
    points = b.places(spark, sf).select(F.col("name").alias("id"), "lng", "lat")
    return tileset.tiles_in_boxes(tileset.site_boxes(points, 9, 1), 7)


@query("g11_shard_of_cell", ref.occ(f"SELECT cell, {ref.SHARD_CASE} AS shard FROM cells"))
def g11(spark, sf):
    return _cells(spark, sf).select("cell", grid.shard_of().alias("shard"))


@query("g12_region_of_cell", ref.occ("SELECT cell, region FROM regioned", ref.REGION_BOXES))
def g12(spark, sf):
    centred = _cells(spark, sf).selectExpr("cell", "lat0", "lng0", "lat0 + 0.5D AS lat", "lng0 + 0.5D AS lng")
    return centred.select("cell", grid.region_of("lng", "lat", b.HOME).alias("region"))


HILBERT = """
h0 AS (SELECT cell, lat0, lng0, CAST(floor((lng0 + 180) * 256 / CAST(360 AS DOUBLE)) AS INTEGER) AS x, CAST(floor((lat0 + 90) * 256 / CAST(180 AS DOUBLE)) AS INTEGER) AS y, 0 AS d FROM cells),
""" + ",\n".join(
    f"""h{i + 1} AS (SELECT cell, lat0, lng0,
  CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN {s} - 1 - y ELSE y END) ELSE x END AS x,
  CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN {s} - 1 - x ELSE x END) ELSE y END AS y,
  d + {s * s} * xor(3 * rx, ry) AS d
 FROM (SELECT *, CASE WHEN x & {s} > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & {s} > 0 THEN 1 ELSE 0 END AS ry FROM h{i}))"""
    for i, s in enumerate((128, 64, 32, 16, 8, 4, 2, 1))
)


@query("g13_hilbert_order", ref.occ("SELECT cell, CAST(d AS INTEGER) AS place FROM h8", HILBERT))
def g13(spark, sf):
    return flow.hilbert_order(_cells(spark, sf)).select("cell", "place")


@query("g14_spherical_centres", ref.ranged("""
SELECT key, month - 1 AS month, round(degrees(atan2(y, x)), 6) AS lng, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat FROM (
  SELECT key, month, sum(cos(radians(lat0 + 0.5)) * cos(radians(lng0 + 0.5)) * u) AS x, sum(cos(radians(lat0 + 0.5)) * sin(radians(lng0 + 0.5)) * u) AS y, sum(sin(radians(lat0 + 0.5)) * u) AS z
  FROM rl WHERE u > 0 GROUP BY key, month)"""))
def g14(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    centres = species_view.monthly_centres(species_view.ranges(labelled))
    return centres.select("key", "month", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


TRACK = """
wp AS (SELECT o_orderkey % 100 AS track, o_orderkey // 100 AS seq,
  CAST(((o_orderkey * 13 + 1) * 104729) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180 AS lng, CAST(((o_orderkey * 7 + 5) * 7919) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - 90 AS lat FROM orders),
seg AS (SELECT a.track, a.seq, a.lng, a.lat, b.lng AS lng2, b.lat AS lat2,
  acos(greatest(-1, least(1, cos(radians(a.lat)) * cos(radians(a.lng)) * cos(radians(b.lat)) * cos(radians(b.lng)) + cos(radians(a.lat)) * sin(radians(a.lng)) * cos(radians(b.lat)) * sin(radians(b.lng)) + sin(radians(a.lat)) * sin(radians(b.lat))))) AS angle
  FROM wp a JOIN wp b ON b.track = a.track AND b.seq = a.seq + 1),
cum AS (SELECT *, coalesce(sum(angle) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(angle) OVER (PARTITION BY track) AS total, max(seq) OVER (PARTITION BY track) AS last FROM seg)"""


@query("g15_track_lengths", ref.sql("SELECT track, round(sum(angle) * 6371, 4) AS km, count(*) + 1 AS waypoints FROM seg GROUP BY track", TRACK))
def g15(spark, sf):
    return tracks.track_lengths(b.waypoints(spark, sf)).select("track", F.round("km", 4).alias("km"), "waypoints")


@query("g15_waypoint_fractions", ref.sql("""
SELECT track, seq, round(before / total, 8) AS fraction FROM cum UNION ALL SELECT DISTINCT track, last + 1, 1.0 FROM cum""", TRACK))
def g15_fractions(spark, sf):
    return tracks.waypoint_fractions(b.waypoints(spark, sf)).select("track", "seq", F.round("fraction", 8).alias("fraction"))


@query("g15_position_at", ref.sql("""
SELECT track, round(degrees(atan2(y, x)), 6) AS lng, round(degrees(asin(greatest(-1, least(1, z)))), 6) AS lat FROM (
  SELECT track, cos(radians(lat)) * cos(radians(lng)) * k1 + cos(radians(lat2)) * cos(radians(lng2)) * k2 AS x, cos(radians(lat)) * sin(radians(lng)) * k1 + cos(radians(lat2)) * sin(radians(lng2)) * k2 AS y, sin(radians(lat)) * k1 + sin(radians(lat2)) * k2 AS z
  FROM (SELECT *, sin((1 - t) * angle) / sin(angle) AS k1, sin(t * angle) / sin(angle) AS k2 FROM (
    SELECT *, least(1, (0.37 * total - before) / angle) AS t, row_number() OVER (PARTITION BY track ORDER BY seq) AS rn FROM cum WHERE 0.37 * total - before <= angle OR seq = last) WHERE rn = 1))""", TRACK))
def g15_position(spark, sf):
    return tracks.position_at(b.waypoints(spark, sf), 0.37).select("track", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


SECTOR = "CASE CAST(floor(({d}) / 45 + 0.5) AS INTEGER) % 8 WHEN 0 THEN 'north' WHEN 1 THEN 'north-east' WHEN 2 THEN 'east' WHEN 3 THEN 'south-east' WHEN 4 THEN 'south' WHEN 5 THEN 'south-west' WHEN 6 THEN 'west' ELSE 'north-west' END"


@query("g16_wind_sectors", f"""
SELECT l_orderkey, l_linenumber, round(sqrt(u * u + v * v), 6) AS speed, {SECTOR.format(d='fmod(degrees(atan2(u, v)) + 540, 360)')} AS blows_from, {SECTOR.format(d='fmod(degrees(atan2(u, v)) + 360, 360)')} AS flows_towards
FROM (SELECT l_orderkey, l_linenumber, l_quantity - 25.3 AS u, l_suppkey % 31 - 14.7 AS v FROM lineitem)""")
def g16(spark, sf):
    u, v = F.col("l_quantity") - 25.3, F.col("l_suppkey") % 31 - 14.7
    return b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.hypot(u, v), 6).alias("speed"), geo.blows_from(u, v).alias("blows_from"), geo.flows_towards(u, v).alias("flows_towards")
    )


@query("q01_shard_owners", ref.occ(f"SELECT cell, lat0, lng0, 1 AS owners FROM cells WHERE ({ref.SHARD_CASE}) IS NOT NULL"))
def q01(spark, sf):
    """Shards that own each recorded cell; every one must have exactly one owner."""
    return quality.shard_owners(_cells(spark, sf))


@query("j09_cells_in_boxes", ref.occ("""
SELECT s.shard, count(*) AS cells, CAST(sum(e.total) AS BIGINT) AS records FROM (SELECT cell, lat0, lng0, sum(t) AS total FROM effort GROUP BY ALL) e
JOIN (VALUES ('south-asia', 0, 40, 60, 100), ('africa', -90, 38, -30, 60), ('europe', 38, 90, -30, 60), ('east-asia', 0, 90, 100, 180), ('east-asia', 40, 90, 60, 100), ('americas', -90, 90, -180, -30), ('oceania', -90, 0, 60, 180)) s(shard, a, b, c, d)
  ON e.lat0 >= s.a AND e.lat0 < s.b AND e.lng0 >= s.c AND e.lng0 < s.d GROUP BY s.shard"""))
def j09(spark, sf):
    """Effort per shard box set: the box test is a literal CASE, so nothing is joined."""
    shard = grid.shard_of()
    per_cell = counting.with_cell(b.month_counts(spark, sf)).groupBy("cell", "lat0", "lng0").agg(F.sum("n").alias("n"))
    return per_cell.groupBy(shard.alias("shard")).agg(F.count("*").alias("cells"), F.sum("n").alias("records"))
