"""Common table expressions of the checking SQL.

Written in long form (one row per species, cell and month, islands by row_number), which shares
nothing with the vector and bit-set form of the engine.
"""

from __future__ import annotations

RECORDS = """
line AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_partkey % 40 AS INTEGER) AS sp,
         CAST(month(l_shipdate) AS INTEGER) AS month, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST((l_suppkey * 7919) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - 90 AS lat,
         CAST((l_suppkey * 104729) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180 AS lng,
         l_returnflag, l_discount, l_tax
  FROM lineitem),
rec AS (
  SELECT l_orderkey, l_linenumber, sp, month, year, lat, lng,
         CASE WHEN sp % 10 <> 9 THEN 'Species ' || sp END AS sci,
         CASE WHEN sp % 10 <> 9 THEN 'Q' || sp END AS specieskey,
         CASE WHEN sp % 10 <> 9 THEN 'Family ' || (sp % 6) END AS family,
         CASE WHEN l_linenumber = 7 THEN 'Mammalia' ELSE 'Aves' END AS class,
         CASE WHEN l_returnflag = 'R' THEN 'ABSENT' ELSE 'PRESENT' END AS status,
         l_discount < CAST(0.1 AS DOUBLE) AS has_coordinate, l_tax > CAST(0.07 AS DOUBLE) AS has_issue,
         CAST(l_suppkey % 25 AS INTEGER) AS nation,
         greatest(-90, least(89, CAST(floor(lat) AS INTEGER))) AS lat0,
         greatest(-180, least(179, CAST(floor(lng) AS INTEGER))) AS lng0
  FROM line
  WHERE (month + sp * 5) % 12 < CASE sp % 4 WHEN 1 THEN 6 WHEN 2 THEN 2 ELSE 12 END),
mon AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month),
counts AS (
  SELECT sci, specieskey, family, month, lat0, lng0, count(*) AS n FROM rec GROUP BY ALL),
masked AS (
  SELECT CASE WHEN sci IN ('Species 3', 'Species 12') THEN NULL ELSE sci END AS sci,
         CASE WHEN sci IN ('Species 3', 'Species 12') THEN NULL ELSE specieskey END AS specieskey,
         CASE WHEN sci IN ('Species 3', 'Species 12') THEN NULL ELSE family END AS family,
         month, lat0, lng0, lat0 || '_' || lng0 AS cell, n
  FROM counts),
cells AS (SELECT DISTINCT cell, lat0, lng0 FROM masked),
effort AS (
  SELECT c.cell, c.lat0, c.lng0, m.month, CAST(coalesce(sum(x.n), 0) AS BIGINT) AS t
  FROM cells c CROSS JOIN mon m LEFT JOIN masked x ON x.cell = c.cell AND x.month = m.month
  GROUP BY ALL),
names AS (
  SELECT 'Species ' || sp AS sci, CAST(CASE WHEN sp = 8 THEN 1004 ELSE 1000 + sp END AS VARCHAR) AS key,
         CASE WHEN sp % 5 <> 0 THEN 'Bird ' || sp ELSE '' END AS common,
         CASE WHEN sp % 3 <> 0 THEN 'Family ' || (sp % 6) ELSE '' END AS family
  FROM (SELECT DISTINCT CAST(p_partkey % 40 AS INTEGER) AS sp FROM part)
  WHERE sp % 7 <> 0 AND sp % 10 <> 9),
keyed AS (
  SELECT coalesce(nm.key, x.sci) AS key, x.cell, x.month, sum(x.n) AS n
  FROM masked x LEFT JOIN names nm ON nm.sci = x.sci WHERE x.sci IS NOT NULL GROUP BY ALL)
"""


def labels(prefix: str, key: str, source: str) -> str:
    """Long rows ``<prefix>l`` and labels ``<prefix>p`` of (key, cell) from ``source`` (key, cell, month, n)."""
    return f"""
{prefix}g AS (SELECT DISTINCT {key}, cell FROM {source} WHERE {key} IS NOT NULL),
{prefix}c AS (
  SELECT g.{key}, g.cell, e.lat0, e.lng0, e.month, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS c, e.t
  FROM {prefix}g g JOIN effort e ON e.cell = g.cell
  LEFT JOIN {source} s ON s.{key} = g.{key} AND s.cell = g.cell AND s.month = e.month
  GROUP BY ALL),
{prefix}r AS (SELECT *, CASE WHEN t > 0 THEN CAST(c AS DOUBLE) / CAST(t AS DOUBLE) ELSE 0 END AS r FROM {prefix}c),
{prefix}k AS (SELECT *, max(r) OVER (PARTITION BY {key}, cell) AS peak FROM {prefix}r),
{prefix}m AS (
  SELECT *, (c > 0 AND peak > 0 AND r >= CAST(0.2 AS DOUBLE) * peak) AS present, t >= 30 AS surveyed FROM {prefix}k),
{prefix}i AS (
  SELECT {key}, cell, mm - row_number() OVER (PARTITION BY {key}, cell ORDER BY mm) AS g
  FROM (SELECT {key}, cell, month + 12 * d AS mm FROM {prefix}m, (VALUES (0), (1)) AS v(d) WHERE present)),
{prefix}n AS (
  SELECT {key}, cell, least(12, max(n)) AS run FROM (SELECT {key}, cell, g, count(*) AS n FROM {prefix}i GROUP BY ALL) GROUP BY ALL),
{prefix}p AS (
  SELECT a.*, CASE WHEN a.surveyed_months < 6 OR a.records < 5 THEN 'uncertain' WHEN a.gaps <= 1 THEN 'resident'
    WHEN a.months_present <= 4 AND coalesce(n.run, 0) BETWEEN 1 AND 2 THEN 'passage' ELSE 'seasonal' END AS p
  FROM (SELECT {key}, cell, lat0, lng0, CAST(sum(c) AS BIGINT) AS records, count(*) FILTER (WHERE present) AS months_present,
          count(*) FILTER (WHERE surveyed) AS surveyed_months, count(*) FILTER (WHERE surveyed AND NOT present) AS gaps
        FROM {prefix}m GROUP BY ALL) a
  LEFT JOIN {prefix}n n ON n.{key} = a.{key} AND n.cell = a.cell),
{prefix}l AS (
  SELECT m.*, p.p FROM {prefix}m m JOIN {prefix}p p ON p.{key} = m.{key} AND p.cell = m.cell)"""


BY_SCI = labels("s", "sci", "masked")
BY_KEY = labels("k", "key", "keyed")

# Rates rounded as published, and the same in whole units of 1e-4.
RANGED = """
rl AS (SELECT key, cell, lat0, lng0, month, p, round(r, 4) AS r, CAST(round(round(r, 4) * 10000) AS BIGINT) AS u FROM kl)"""

SHARD_CASE = """CASE
  WHEN lat0 >= 0 AND lat0 < 40 AND lng0 >= 60 AND lng0 < 100 THEN 'south-asia'
  WHEN lat0 < 38 AND lng0 >= -30 AND lng0 < 60 THEN 'africa'
  WHEN lat0 >= 38 AND lng0 >= -30 AND lng0 < 60 THEN 'europe'
  WHEN lat0 >= 0 AND lng0 >= 100 OR lat0 >= 40 AND lng0 >= 60 AND lng0 < 100 THEN 'east-asia'
  WHEN lng0 < -30 THEN 'americas'
  WHEN lat0 < 0 AND lng0 >= 60 THEN 'oceania' END"""

REGION_BOXES = """
boxes(ord, name, lat0, lat1, lng0, lng1) AS (VALUES
  (1, 'the Himalaya and Tibet', 27, 40, 75, 100), (2, 'South Asia', 5, 37, 60, 98),
  (3, 'Southeast Asia', -11, 28, 92, 141), (4, 'Siberia and the Russian Far East', 50, 78, 60, 180),
  (5, 'East Asia', 20, 55, 100, 146), (6, 'Central Asia', 35, 55, 46, 100),
  (7, 'the Middle East', 12, 42, 34, 63), (8, 'Europe', 35, 72, -25, 46),
  (9, 'North Africa', 15, 37, -18, 34), (10, 'East Africa', -12, 15, 28, 52),
  (11, 'southern Africa', -36, -12, 10, 42), (12, 'West and Central Africa', -12, 15, -18, 28),
  (13, 'Australia', -45, -10, 110, 155), (14, 'North America', 15, 75, -170, -50),
  (15, 'South America', -56, 15, -82, -34), (16, 'the Indian Ocean', -40, 25, 40, 110)),
regioned AS (
  SELECT c.cell, CASE WHEN c.lat0 >= 0 AND c.lat0 < 40 AND c.lng0 >= 60 AND c.lng0 < 100 THEN 'India'
    ELSE coalesce((SELECT arg_min(b.name, b.ord) FROM boxes b WHERE c.lat0 + 0.5 >= b.lat0 AND c.lat0 + 0.5 < b.lat1
      AND c.lng0 + 0.5 >= b.lng0 AND c.lng0 + 0.5 < b.lng1), 'elsewhere') END AS region
  FROM cells c)"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n" + body


def occ(body: str, *more: str) -> str:
    return sql(body, RECORDS, *more)


def by_sci(body: str, *more: str) -> str:
    return sql(body, RECORDS, BY_SCI, *more)


def by_key(body: str, *more: str) -> str:
    return sql(body, RECORDS, BY_KEY, *more)


def ranged(body: str, *more: str) -> str:
    return sql(body, RECORDS, BY_KEY, RANGED, *more)


def pivot(value: str, prefix: str, month: str = "month", cast: str = "BIGINT") -> str:
    """Twelve conditional sums ``<prefix>01`` .. ``<prefix>12``."""
    return ", ".join(
        f"CAST(coalesce(sum({value}) FILTER (WHERE {month} = {m}), 0) AS {cast}) AS {prefix}{m:02d}" for m in range(1, 13)
    )


BITS = 16


def _morton(offset: int) -> str:
    return " + ".join(f"((((p_partkey >> {2 * i + offset}) & 1)) << {i})" for i in range(BITS))


PIXELS = f"""
px AS (
  SELECT p_partkey, CAST({_morton(0)} + 262144 AS INTEGER) AS gx, CAST({_morton(1)} + 32768 AS INTEGER) AS gy,
         CAST(p_size % 12 AS INTEGER) AS cls, CASE WHEN p_size % 10 <> 0 THEN p_retailprice % 100 END AS tree,
         p_retailprice AS elev
  FROM part)"""


def halved(name: str, source: str) -> str:
    """Next coarser level of (gx, gy, cls, tree, elev), mode by ranked counts."""
    return f"""
{name}_n AS (SELECT gx // 2 AS gx, gy // 2 AS gy, cls, count(*) AS n FROM {source} GROUP BY ALL),
{name}_m AS (
  SELECT gx, gy, coalesce(min(cls) FILTER (WHERE rk = 1 AND cls > 0), 0) AS cls
  FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY (cls = 0), n DESC, cls) AS rk FROM {name}_n) GROUP BY ALL),
{name} AS (
  SELECT m.gx, m.gy, CAST(m.cls AS INTEGER) AS cls, a.tree, a.elev FROM {name}_m m
  JOIN (SELECT gx // 2 AS gx, gy // 2 AS gy, avg(tree) AS tree, avg(elev) AS elev FROM {source} GROUP BY ALL) a
  ON a.gx = m.gx AND a.gy = m.gy)"""


def pixels(body: str, *more: str) -> str:
    return sql(body, PIXELS, *more)


PLACES = """
pl AS (
  SELECT c_name AS name,
         CAST(((c_custkey * 31 + 7) * 104729) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180 AS lng,
         CAST(((c_custkey * 17 + 3) * 7919) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - 90 AS lat,
         CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS population,
         CASE WHEN c_custkey % 50 = 0 THEN 'PPLC' WHEN c_custkey % 10 = 1 THEN 'PPLA' WHEN c_custkey % 10 = 2 THEN 'PPLG' ELSE 'PPL' END AS code,
         CASE WHEN c_custkey % 50 = 0 THEN 0 WHEN c_custkey % 10 IN (1, 2) THEN 1 ELSE 2 END AS kind,
         n_name AS country, c_mktsegment AS admin_code
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def places(body: str, *more: str) -> str:
    return sql(body, PLACES, *more)


def tile_x(lng: str, z: int) -> str:
    return f"CAST(greatest(0, least({2 ** (z + 1) - 1}, floor(({lng} + 180) / {180.0 / 2 ** z!r}))) AS INTEGER)"


def tile_y(lat: str, z: int) -> str:
    return f"CAST(greatest(0, least({2 ** z - 1}, floor((90 - {lat}) / {180.0 / 2 ** z!r}))) AS INTEGER)"
