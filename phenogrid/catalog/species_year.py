"""The year of a species (A13-A18, A38, W7-W10, E5-E7, E26, T2, R5, W12, G14 with gridding)."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.catalog import reference_sql as ref
from phenogrid.catalog.gridding import HILBERT
from phenogrid.catalog.registry import query
from phenogrid.functions import grid, months
from phenogrid.operators import documents, flow, raster, species_view
from phenogrid.sources import bindings as b


def _ranged(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    return species_view.ranges(labelled)


@query("a13_peak_rates", ref.ranged("SELECT key, max(r) AS peak FROM rl GROUP BY key"))
def a13(spark, sf):
    return species_view.peak_rates(_ranged(spark, sf))


@query("a14_cells_per_month", ref.ranged("SELECT key, month, count(*) FILTER (WHERE r > 0) AS cells FROM rl GROUP BY key, month"))
def a14(spark, sf):
    rows = species_view.cells_per_month(_ranged(spark, sf))
    return rows.select("key", months.month_rows(month="i + 1", cells="cells[i]"))


@query("a15_year_curve", ref.ranged("""
SELECT s.key, s.month, s.u AS units, round(CAST(s.u AS DOUBLE) / 10000 / CASE WHEN t.top > 0 THEN CAST(t.top AS DOUBLE) / 10000 ELSE 1 END, 8) AS presence, t.peak_month, t.low_month
FROM (SELECT key, month, CAST(sum(u) AS BIGINT) AS u FROM rl GROUP BY key, month) s
JOIN (SELECT key, max(u) AS top, CAST(min(month) FILTER (WHERE u = mx) - 1 AS INTEGER) AS peak_month, CAST(min(month) FILTER (WHERE u = mn) - 1 AS INTEGER) AS low_month
  FROM (SELECT key, month, u, max(u) OVER (PARTITION BY key) AS mx, min(u) OVER (PARTITION BY key) AS mn FROM (SELECT key, month, sum(u) AS u FROM rl GROUP BY key, month)) GROUP BY key) t ON t.key = s.key"""))
def a15(spark, sf):
    rows = species_view.year_curve(_ranged(spark, sf))
    return rows.select("key", "peak_month", "low_month", months.month_rows(month="i + 1", units="s[i]", presence="round(presence[i], 8)"))


CENTRES = """
cn AS (SELECT key, month - 1 AS month, degrees(atan2(y, x)) AS lng, degrees(atan2(z, sqrt(x * x + y * y))) AS lat FROM (
  SELECT key, month, sum(cos(radians(lat0 + 0.5)) * cos(radians(lng0 + 0.5)) * u) AS x, sum(cos(radians(lat0 + 0.5)) * sin(radians(lng0 + 0.5)) * u) AS y, sum(sin(radians(lat0 + 0.5)) * u) AS z
  FROM rl WHERE u > 0 GROUP BY key, month))"""


@query("a16_latitude_shift", ref.ranged("SELECT key, round(max(lat) - min(lat), 6) AS shift_deg FROM cn GROUP BY key", CENTRES))
def a16(spark, sf):
    shift = species_view.latitude_shift(species_view.monthly_centres(_ranged(spark, sf)))
    return shift.select("key", F.round("shift_deg", 6).alias("shift_deg"))


@query("a17_behaviour", ref.by_key("""
SELECT key, CASE WHEN bool_and(p = 'resident') THEN 'resident' WHEN bool_or(p = 'resident') THEN 'mixed' ELSE 'migratory' END AS behaviour, count(*) AS total_cells FROM kp GROUP BY key"""))
def a17(spark, sf):
    return species_view.behaviour(_ranged(spark, sf))


REGIONS = """
rg AS (SELECT l.key, l.month - 1 AS month, r.region, CAST(sum(u) AS BIGINT) AS w, CAST(sum((2 * lng0 + 1) * u) AS DOUBLE) / 2 / CAST(sum(u) AS DOUBLE) AS lng, CAST(sum((2 * lat0 + 1) * u) AS DOUBLE) / 2 / CAST(sum(u) AS DOUBLE) AS lat
  FROM rl l JOIN regioned r ON r.cell = l.cell GROUP BY ALL HAVING sum(u) > 0),
dm AS (SELECT key, month, region, share, lng, lat, home_share FROM (
  SELECT *, CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY key, month) AS DOUBLE) AS share,
    CAST(coalesce(sum(w) FILTER (WHERE region = 'India') OVER (PARTITION BY key, month), 0) AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY key, month) AS DOUBLE) AS home_share,
    row_number() OVER (PARTITION BY key, month ORDER BY w DESC, region) AS rn FROM rg) WHERE rn = 1)"""
LEGS = """
cy AS (SELECT k.key, m.month - 1 AS month, d.region, d.share, d.lng, d.lat FROM (SELECT DISTINCT key FROM dm) k CROSS JOIN mon m LEFT JOIN dm d ON d.key = k.key AND d.month = m.month - 1),
ch AS (SELECT a.*, a.region IS NOT NULL AND a.region IS DISTINCT FROM b.region AS starts FROM cy a JOIN cy b ON b.key = a.key AND b.month = (a.month + 11) % 12),
dd AS (SELECT *, month + 12 * d AS mm FROM ch, (VALUES (0), (1)) v(d)),
ld AS (SELECT *, max(CASE WHEN starts THEN mm END) OVER (PARTITION BY key ORDER BY mm) AS s FROM dd),
ls AS (SELECT *, CASE WHEN s IS NULL THEN 0 ELSE s % 12 END AS first, CASE WHEN s IS NULL THEN month ELSE mm - s END AS step FROM ld WHERE d = 1 AND region IS NOT NULL),
lg AS (SELECT key, CAST(first AS INTEGER) AS from_month, CAST((first + max(step)) % 12 AS INTEGER) AS to_month, arg_min(region, step) AS region, max(share) AS share, arg_min(lng, step) AS lng, arg_min(lat, step) AS lat FROM ls GROUP BY key, first)"""


@query("a18_region_shares", ref.ranged("""
SELECT key, region, CAST(month AS INTEGER) AS month, w, round(lng, 6) AS lng, round(lat, 6) AS lat, round(CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY key, month) AS DOUBLE), 8) AS share FROM rg""", ref.REGION_BOXES, REGIONS))
def a18(spark, sf):
    shares = species_view.region_shares(_regions(spark, sf))
    return shares.select("key", "region", "month", "w", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), F.round("share", 8).alias("share"))


def _regions(spark, sf):
    return species_view.region_months(_ranged(spark, sf), b.HOME)


@query("w07_dominant_regions", ref.ranged("""
SELECT key, CAST(month AS INTEGER) AS month, region, round(share, 8) AS share, round(lng, 6) AS lng, round(lat, 6) AS lat, round(home_share, 8) AS home_share FROM dm""", ref.REGION_BOXES, REGIONS))
def w07(spark, sf):
    rows = species_view.dominant_regions(_regions(spark, sf))
    return rows.select("key", "month", "region", *[F.round(c, d).alias(c) for c, d in (("share", 8), ("lng", 6), ("lat", 6), ("home_share", 8))])


@query("w08_journey_legs", ref.ranged("""
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY (from_month = 0 OR from_month > to_month) DESC, from_month) AS INTEGER) AS leg, from_month, to_month, region, round(share, 8) AS share, round(lng, 6) AS lng, round(lat, 6) AS lat FROM lg""", ref.REGION_BOXES, REGIONS, LEGS))
def w08(spark, sf):
    legs = species_view.journey_legs(species_view.dominant_regions(_regions(spark, sf)))
    return legs.select("key", "leg", "from_month", "to_month", "region", *[F.round(c, d).alias(c) for c, d in (("share", 8), ("lng", 6), ("lat", 6))])


@query("a38_home_summary", ref.ranged("""
SELECT d.key, count(*) FILTER (WHERE home_share >= CAST(0.05 AS DOUBLE)) AS home_months, CAST(arg_min(month, -home_share * 100 + month / 1000000.0) FILTER (WHERE home_share >= CAST(0.05 AS DOUBLE)) AS INTEGER) AS home_peak, max(l.regions) AS regions, max(l.now) AS region_now
FROM dm d LEFT JOIN (SELECT key, count(DISTINCT region) AS regions, max(region) FILTER (WHERE CASE WHEN from_month <= to_month THEN 5 BETWEEN from_month AND to_month ELSE 5 >= from_month OR 5 <= to_month END) AS now FROM lg GROUP BY key) l ON l.key = d.key
GROUP BY d.key""", ref.REGION_BOXES, REGIONS, LEGS))
def a38(spark, sf):
    dominant = species_view.dominant_regions(_regions(spark, sf))
    return species_view.home_summary(dominant, species_view.journey_legs(dominant), 5)


@query("x03_species_summary", ref.ranged("""
SELECT b.key, b.behaviour, b.total_cells, s.peak_month, round(c.shift, 6) AS shift_deg FROM
 (SELECT key, CASE WHEN bool_and(p = 'resident') THEN 'resident' WHEN bool_or(p = 'resident') THEN 'mixed' ELSE 'migratory' END AS behaviour, count(*) AS total_cells FROM kp GROUP BY key) b
 JOIN (SELECT key, CAST(arg_min(month, -u * 100 + month) - 1 AS INTEGER) AS peak_month FROM (SELECT key, month, sum(u) AS u FROM rl GROUP BY key, month) GROUP BY key) s ON s.key = b.key
 LEFT JOIN (SELECT key, max(lat) - min(lat) AS shift FROM cn GROUP BY key) c ON c.key = b.key""", CENTRES))
def x03_species(spark, sf):
    rows = species_view.species_summary(_ranged(spark, sf))
    return rows.select("key", "behaviour", "total_cells", "peak_month", F.round("shift_deg", 6).alias("shift_deg"))


# t = 3.75: between mid-month anchors 3 and 4, a quarter of the way; cubic ease 4 u^3.
@query("e05_cell_intensity", ref.ranged("""
SELECT l.key, l.cell, round((max(r) FILTER (WHERE month = 4) * (1 - 4 * 0.25 ** 3) + max(r) FILTER (WHERE month = 5) * (4 * 0.25 ** 3)) / CASE WHEN max(k.peak) > 0 THEN max(k.peak) ELSE 1 END, 12) AS intensity
FROM rl l JOIN (SELECT key, max(r) AS peak FROM rl GROUP BY key) k ON k.key = l.key GROUP BY l.key, l.cell"""))
def e05(spark, sf):
    rows = species_view.cell_intensity(_ranged(spark, sf), 3.75)
    return rows.select("key", "cell", F.round("intensity", 12).alias("intensity"))


@query("e05_mass_at", ref.ranged("""
SELECT key, round((max(u) FILTER (WHERE month = 12) * (1 - 4 * 0.25 ** 3) + max(u) FILTER (WHERE month = 1) * (4 * 0.25 ** 3)) / CAST(max(u) AS DOUBLE), 12) AS mass
FROM (SELECT key, month, CAST(sum(u) AS DOUBLE) AS u FROM rl GROUP BY key, month) GROUP BY key"""))
def e05_mass(spark, sf):
    """At t = 11.75: from December into January."""
    return species_view.mass_at(_ranged(spark, sf), 11.75).select("key", F.round("mass", 12).alias("mass"))


@query("e06_wash_values", ref.ranged("""
SELECT l.key, l.cell, round(0.2 + 0.8 * (l.r / k.peak), 12) AS value FROM rl l JOIN (SELECT key, max(r) AS peak FROM rl GROUP BY key) k ON k.key = l.key WHERE l.month = 5 AND l.u > 0"""))
def e06(spark, sf):
    return species_view.wash_values(_ranged(spark, sf), 4).select("key", "cell", F.round("value", 12).alias("value"))


# t = 0.25: three quarters of the way from mid December to mid January; smoothstep of 0.75.
@query("e07_smooth_blend", ref.occ("""
SELECT cell, round(max(t) FILTER (WHERE month = 12) * (1 - 0.75 * 0.75 * (3 - 1.5)) + max(t) FILTER (WHERE month = 1) * (0.75 * 0.75 * (3 - 1.5)), 6) AS value
FROM (SELECT cell, month, CAST(t AS DOUBLE) AS t FROM effort) GROUP BY cell"""))
def e07(spark, sf):
    _, effort = b.pairs_and_effort(spark, sf)
    return effort.select("cell", F.round(months.blend_months("t", 0.25, months.ease_smooth), 6).alias("value"))


@query("e26_month_between", """
SELECT o_orderkey, CAST(round(((a + d * 0.25) + 12) - 12 * floor(((a + d * 0.25) + 12) / 12), 6) AS DOUBLE) AS month FROM (
  SELECT o_orderkey, a, CASE WHEN b - a > 6 THEN b - a - 12 WHEN b - a < -6 THEN b - a + 12 ELSE b - a END AS d FROM (
    SELECT o_orderkey, CAST(month(o_orderdate) - 1 AS DOUBLE) AS a, CAST(o_custkey % 12 AS DOUBLE) AS b FROM orders))""")
def e26(spark, sf):
    a, z = (F.month("o_orderdate") - 1).cast("double"), (F.col("o_custkey") % 12).cast("double")
    return b.table(spark, sf, "orders").select("o_orderkey", F.round(months.between_months(a, z, 0.25), 6).alias("month"))


@query("t02_species_search", ref.by_key("""
SELECT k, name, cells, rank FROM (
  SELECT k, name, cells, CASE WHEN starts_with(lower(name), 'bird 1') OR starts_with(lower(sci), 'bird 1') THEN 0 WHEN starts_with(lower(name), '1') OR len(list_filter(string_split(lower(name), ' '), lambda w: starts_with(w, 'bird 1'))) > 0 THEN 1
    WHEN contains(lower(name), 'bird 1') OR contains(lower(sci), 'bird 1') THEN 2 END AS rank FROM (
  SELECT k.key AS k, coalesce(min(n.sci), k.key) AS sci, coalesce(nullif(arg_min(n.common, n.sci), ''), min(n.sci), k.key) AS name, max(k.cells) AS cells
  FROM (SELECT key, count(*) AS cells FROM kp GROUP BY key) k LEFT JOIN names n ON n.key = k.key GROUP BY k.key)) WHERE rank IS NOT NULL ORDER BY rank, cells DESC, k LIMIT 6"""))
def t02(spark, sf):
    labelled, _ = b.labelled(spark, sf)
    index = documents.species_index(labelled, b.names(spark, sf))
    return species_view.match_species(index, " Bird 1").select("k", "name", "cells", "rank")


def _weights(spark, sf):
    """Records per species, month and cell as whole weights."""
    labelled, _ = b.labelled(spark, sf)
    lat, lng = grid.whole_lat(), grid.whole_lng()
    placed = labelled.select("key", "cell", lat.alias("lat0"), lng.alias("lng0"), "c")
    return placed.select("key", "cell", "lat0", "lng0", months.month_rows("c[i] > 0", month="i", w="c[i]"))


@query("w09_quantile_picks", ref.by_key("""
SELECT w.key, CAST(w.month - 1 AS INTEGER) AS month, CAST(q.i AS INTEGER) AS pick, w.cell FROM (
  SELECT l.key, l.month, l.cell, l.c, sum(l.c) OVER (PARTITION BY l.key, l.month ORDER BY h.d, l.cell) AS cum, sum(l.c) OVER (PARTITION BY l.key, l.month) AS total
  FROM kl l JOIN h8 h ON h.cell = l.cell WHERE l.c > 0) w, (SELECT unnest(range(0, 40)) AS i) q
WHERE (2 * q.i + 1) * w.total <= 80 * w.cum AND (2 * q.i + 1) * w.total > 80 * (w.cum - w.c)""", HILBERT))
def w09(spark, sf):
    return flow.quantile_picks(_weights(spark, sf), 40).select("key", "month", "pick", "cell")


@query("w10_filled_months", ref.by_key("""
SELECT key, CAST(month - 1 AS INTEGER) AS month, CAST((s - 1) % 12 AS INTEGER) AS shown FROM (
  SELECT key, month, mm, max(CASE WHEN w > 0 THEN mm END) OVER (PARTITION BY key ORDER BY mm) AS s FROM (SELECT key, month, month + 12 * d AS mm, w FROM (SELECT key, month, sum(c) AS w FROM kl GROUP BY ALL), (VALUES (0), (1)) v(d)))
WHERE mm > 12"""))
def w10(spark, sf):
    return flow.filled_months(_weights(spark, sf))


_SIGMA = 0.45 * 4
GAUSS = f"""
ws AS (SELECT l.key, l.lat0, l.lng0, least(1, 0.2 + 0.8 * (l.r / k.peak)) AS v FROM rl l JOIN (SELECT key, max(r) AS peak FROM rl GROUP BY key) k ON k.key = l.key WHERE l.month = 5 AND l.u > 0),
tx AS (SELECT key, (lng0 + 180) * 4 + i AS x, (90 - (lat0 + 1)) * 4 + j AS y, v FROM ws, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j)),
gk AS (SELECT o, exp(-(o * o) / (2 * {_SIGMA!r} * {_SIGMA!r})) / sum(exp(-(o * o) / (2 * {_SIGMA!r} * {_SIGMA!r}))) OVER () AS k FROM (SELECT unnest(range(-5, 6)) AS o)),
b1 AS (SELECT key, (x - o + 1440) % 1440 AS x, y, sum(v * k) AS v FROM tx, gk GROUP BY ALL),
b2 AS (SELECT key, x, t.y AS y, sum(v * k) AS v FROM b1, gk, LATERAL (SELECT unnest(CASE WHEN b1.y = 0 THEN range(0, 6) WHEN b1.y = 719 THEN range(714, 720) ELSE [b1.y - o] END) AS y) t
  WHERE t.y >= 0 AND t.y < 720 AND least(719, greatest(0, t.y + o)) = b1.y GROUP BY ALL)"""


@query("w12_smoothed_cells", ref.ranged("SELECT key, CAST(x AS INTEGER) AS tx, CAST(y AS INTEGER) AS ty, CAST(floor(least(1, v) * 255 + 0.5) AS INTEGER) AS byte FROM b2 WHERE floor(least(1, v) * 255 + 0.5) > 0", GAUSS))
def w12(spark, sf):
    wash = species_view.wash_values(_ranged(spark, sf), 4)
    texels = raster.smooth_cells(wash, ("key",))
    byte = F.floor(F.least(F.col("value"), F.lit(1.0)) * 255 + 0.5).cast("int")
    return texels.select("key", "tx", "ty", byte.alias("byte")).where("byte > 0")


SURFACE = """
ws AS (SELECT l.key, l.lat0, l.lng0, least(1, greatest(0, 0.2 + 0.8 * (l.r / k.peak))) AS v FROM rl l JOIN (SELECT key, max(r) AS peak FROM rl GROUP BY key) k ON k.key = l.key WHERE l.month = 5 AND l.u > 0),
ex AS (SELECT key, lat_min, lat_min + nrow AS lat_top, lng_min, nrow, ncol, ln(tan(pi() / 4 + radians(lat_min + nrow) / 2)) AS yt, ln(tan(pi() / 4 + radians(lat_min) / 2)) AS yb FROM (
  SELECT key, lat_min, lng_min, CAST(round(lat_top - lat_min) AS INTEGER) AS nrow, CAST(round(lng_max - lng_min) AS INTEGER) AS ncol FROM (
    SELECT key, greatest(-85, min(lat0) - 1) AS lat_min, least(85, max(lat0) + 2) AS lat_top, min(lng0) - 1 AS lng_min, max(lng0) + 2 AS lng_max FROM ws GROUP BY key))),
py AS (SELECT *, least(greatest((degrees(atan(exp(yt + (p + 0.5) / (nrow * 8) * (yb - yt)))) * 2 - 90 - lat_min) - 0.5, 0), nrow - 1) AS vv FROM (SELECT *, CAST(unnest(range(0, nrow * 8)) AS INTEGER) AS p FROM ex)),
yw AS (SELECT key, p, lat_min, lng_min, ncol, r, CASE WHEN r = floor(vv) THEN 1 - s ELSE s END AS wy FROM (SELECT *, (vv - floor(vv)) * (vv - floor(vv)) * (3 - 2 * (vv - floor(vv))) AS s FROM py), LATERAL (SELECT unnest([floor(vv), floor(vv) + 1]) AS r)),
xw AS (SELECT w.key, w.p, w.wy, w.ncol, ws.lng0 - w.lng_min AS c, ws.v FROM yw w JOIN ws ON ws.key = w.key AND ws.lat0 - w.lat_min = w.r WHERE w.wy > 0),
pp AS (SELECT key, x, p, sum(v * wy * CASE WHEN c = floor(uu) THEN 1 - s ELSE s END) AS a FROM (
  SELECT *, (uu - floor(uu)) * (uu - floor(uu)) * (3 - 2 * (uu - floor(uu))) AS s FROM (
    SELECT *, least(greatest((x + 0.5) / 8 - 0.5, 0), ncol - 1) AS uu FROM (SELECT *, CAST(unnest(range(CAST(greatest(0, (c - 1) * 8) AS BIGINT), CAST(least(ncol, c + 2) * 8 AS BIGINT))) AS INTEGER) AS x FROM xw))
  WHERE c = floor(uu) OR c = floor(uu) + 1) GROUP BY ALL)"""


@query("r05_smooth_surface", ref.ranged("SELECT key, x AS px, p AS py, CAST(floor(a * 255 + 0.5) AS INTEGER) AS alpha FROM pp WHERE floor(a * 255 + 0.5) > 0", SURFACE))
def r05(spark, sf):
    wash = species_view.wash_values(_ranged(spark, sf), 4)
    return raster.smooth_surface(wash, ("key",)).select("key", "px", "py", "alpha")
