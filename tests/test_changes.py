"""Roll-up of changed tiles, world levels, land in boxes, boxes as data, and search on postings."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from phenogrid.operators import boxes, occupancy, rollup, search_index, species_view, tileset
from phenogrid.sources import sinks

PX = 2


def tile(x, y, *values):
    """Four pixels of a tile, row by row."""
    return [(2 * x + i % 2, 2 * y + i // 2, v) for i, v in enumerate(values)]


def levels_of(rows):
    return {(r["z"], r["gx"], r["gy"]): r["r"] for r in rows.collect()}


def pyramid(spark, tiles, top=3, bottom=0):
    base = spark.createDataFrame([(top, *p) for t in tiles for p in t], "z int, gx int, gy int, r int")
    full = rollup.changed_levels(base, rollup.tiles_in(base, PX), top, bottom, PX, ("r",))
    return base.unionByName(full.select(*base.columns))


def test_means_round_to_even_and_missing_children_are_black(spark):
    got = levels_of(pyramid(spark, [tile(0, 0, 1, 2, 3, 4), tile(1, 1, 7, 8, 7, 8)], 3, 2))
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, 0, 0): 2, (2, 1, 0): 0, (2, 0, 1): 0, (2, 1, 1): 8}


@pytest.mark.parametrize("seed", range(3))
def test_only_what_is_above_a_change_is_made_anew(spark, seed):
    rng = random.Random(seed)
    old = {(x, y): [rng.randrange(256) for _ in range(4)] for x in range(8) for y in range(4) if rng.random() < 0.6}
    new = dict(old)
    changed = set()
    for x, y in rng.sample([(x, y) for x in range(8) for y in range(4)], 4):
        changed.add((x, y))
        if (x, y) in new and rng.random() < 0.5:
            del new[x, y]
        else:
            new[x, y] = [rng.randrange(256) for _ in range(4)]
    before, want = (pyramid(spark, [tile(x, y, *v) for (x, y), v in t.items()]) for t in (old, new))
    mixed = want.where("z = 3").unionByName(before.where("z < 3"))
    tiles = spark.createDataFrame(sorted(changed), "x int, y int")
    rebuilt = rollup.changed_levels(mixed, tiles, 3, 0, PX, ("r",))
    above = {(3 - i, x >> i, y >> i) for x, y in changed for i in (1, 2, 3)}
    assert {(r["z"], r["x"], r["y"]) for r in rebuilt.withColumns(rollup.tile_of(PX)).collect()} <= above
    assert levels_of(rollup.replaced(mixed, tiles, rebuilt, 3, 0, PX)) == levels_of(want)


def test_changed_levels_read_tiles_of_one_level(spark):
    path = tempfile.mkdtemp(prefix="levels-") + "/l"
    pyramid(spark, [tile(0, 0, 1, 2, 3, 4)]).write.partitionBy("z").parquet(path)
    held = spark.read.schema("gx int, gy int, r int, z int").parquet(path)
    plan = rollup.under(held.where(F.col("z") == 2), spark.createDataFrame([(0, 0)], "x int, y int"), PX)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(z" in plan and "LeftSemi" in plan


def test_world_tiles_without_land_stay(spark):
    detail = spark.createDataFrame([(*p, 50.0) for p in tile(0, 0, 0, 0, 0, 0) + tile(4, 0, 3, 3, 0, 3)], "gx int, gy int, cls int, tree double")
    world = spark.createDataFrame([(1, 0, 0, 5, 9.0), (1, 4, 0, 6, 9.0), (1, 5, 1, 6, 9.0), (0, 0, 0, 7, 9.0)], "z int, gx int, gy int, cls int, tree double")
    got = {(r["z"], r["gx"], r["gy"]): (r["cls"], r["tree"], r["rewritten"]) for r in rollup.world_levels(detail, world, 1, 0, PX).collect()}
    assert got == {(1, 0, 0): (5, 9.0, False), (1, 4, 0): (3, 50.0, True), (1, 5, 1): (6, 9.0, True), (0, 0, 0): (5, 9.0, True), (0, 2, 0): (3, 30.0, True)}


def test_land_in_boxes_goes_down_the_tree(spark):
    mask = spark.createDataFrame([(3, 1), (40, 20)], "gx int, gy int")
    table = occupancy.occupancy(mask, 48, 24, 5, 0)
    assert occupancy.whole_levels(48, 24) == 3
    for z in range(6):
        plan = {(r["x"], r["y"]) for r in tileset.land_tile_plan(mask, 48, 24, z, 0).collect()}
        assert {(r["x"], r["y"]) for r in table.where(f"held AND z = {z}").collect()} == plan
    around = spark.createDataFrame([("all", -180.0, -90.0, 180.0, 90.0), ("west", -180.0, 0.0, -90.0, 90.0), ("sea", 0.0, 60.0, 10.0, 70.0)], "id string, west double, south double, east double, north double")
    got = occupancy.in_boxes(around, table, 5).collect()
    whole = {(r["z"], r["x"], r["y"]) for r in got if r["id"] == "all"}
    assert whole == {(r["z"], r["x"], r["y"]) for r in table.where("held").collect()}
    assert {(r["z"], r["x"], r["y"]) for r in got if r["id"] == "west"} == {t for t in whole if t[1] < 2 ** t[0] // 2 or t[0] == 0 and t[1] == 0 if t[2] < max(1, 2 ** t[0] // 2)}
    assert {r["z"] for r in got if r["id"] == "sea"} <= {0, 1, 2} and all(r["pos"] == r["y"] * 2 ** (r["z"] + 1) + r["x"] for r in got)


def test_boxes_of_any_size(spark):
    rng = random.Random(5)
    areas = []
    for i in range(300):
        side, lat, lng = rng.choice([0.0, 1e-5, 0.3, 4.0, 90.0, 400.0]), rng.uniform(-95, 90), rng.uniform(-185, 180)
        areas.append((i, f"b{i}", lat, lat + side, lng, lng + side * rng.choice([0.2, 1, 3])))
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)] + [(200 + i, a[2], a[4]) for i, a in enumerate(areas)] + [(600, None, 1.0), (601, areas[3][3], areas[3][5])]
    p, a = spark.createDataFrame(points, "id long, lat double, lng double"), spark.createDataFrame(areas, "ord long, name string, lat0 double, lat1 double, lng0 double, lng1 double")
    want = {i: next((n for _, n, s, e, w, x in areas if lat is not None and s <= lat < e and w <= lng < x), None) for i, lat, lng in points}
    assert {r["id"]: r["name"] for r in boxes.first_box(p, a, "id", "ord", "name").collect()} == want
    assert boxes.box_cells(a).groupBy("ord").count().agg(F.max("count")).first()[0] <= 9
    assert {r["name"] for r in boxes.first_box(p, a.limit(0), "id", "ord", "name").collect()} == {None}


SPECIES = [("1", "Barn Owl", "Tyto alba", 5), ("2", "Owlet Moth", "Noctua", 9), ("3", "Grey-owl thing", "Strix x", 9), ("4", "Great Grey Owl", "Strix nebulosa", 2), ("5", "o", "aa", 1), ("6", "ÉTOILE du Nord", "stella", 1), ("7", "aaaa aaab", "owl", 7)]


def test_search_on_postings_equals_a_scan(spark):
    index = spark.createDataFrame(SPECIES, "k string, name string, sci string, cells long")
    path = tempfile.mkdtemp(prefix="postings-") + "/p"
    search_index.write(index, path)
    for q in ("owl", "OWL ", "o", "ow", "grey", "grey o", "aaab", "aaa", "é", "étoile", "strix", "", "  ", "nothing", "y-o", "\U0010ffff", "퟿"):
        want = [(r["k"], r["rank"]) for r in species_view.match_species(index, q).collect()]
        assert [(r["k"], r["rank"]) for r in search_index.search(spark, path, q).collect()] == want, q
    plan = search_index.candidates(spark, path, "owl")._jdf.queryExecution().toString()
    assert "EqualTo(kind,0), GreaterThanOrEqual(text,owl), LessThan(text,owm)" in plan and "In(text, [owl])" in plan or "EqualTo(text,owl)" in plan


def test_tiles_along_the_curve_are_compact(spark):
    grid = spark.range(64 * 64).select(F.lit(6).alias("z"), (F.col("id") % 64).cast("int").alias("gx"), F.floor(F.col("id") / 64).cast("int").alias("gy"), F.lit(1).alias("cls"))
    path = tempfile.mkdtemp(prefix="tiles-") + "/t"
    sinks.write_tiles(grid, path, files=16)
    spans = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1")).collect()
    assert len(spans) >= 12
    hit = sum(r["x0"] < 16 and r["y0"] < 16 for r in spans)  # rows of tiles would need a quarter of the files and read all of their width
    assert hit <= len(spans) // 4 and sum(r["x1"] - r["x0"] for r in spans) < 40 * len(spans)


def test_boxes_over_each_other_leave_few_pieces(spark):
    def areas(n):
        at = spark.range(n)
        lat, lng = F.rand(1) * 160 - 90, F.rand(2) * 330 - 180
        return at.select(F.col("id").alias("_order"), F.col("id").cast("string").alias("_value"), lat.alias("lat0"), lng.alias("lng0")).selectExpr("*", "lat0 + 20 AS lat1", "lng0 + 30 AS lng1")

    few, many = (boxes.foremost(areas(n)) for n in (500, 8000))
    held = many.groupBy("_g", "_x", "_y").count()
    assert held.agg(F.avg("count")).first()[0] < 6 and many.count() < 3 * few.count()
    points = spark.range(300).select("id", (F.rand(3) * 180 - 90).alias("lat"), (F.rand(4) * 360 - 180).alias("lng")).localCheckpoint()
    every = areas(2000).localCheckpoint()
    want = {r["id"]: r["v"] for r in points.join(every, F.expr(boxes.INSIDE), "left").groupBy("id").agg(F.min_by("_value", "_order").alias("v")).collect()}
    assert {r["id"]: r["_value"] for r in boxes.first_box(points, every, "id", "_order", "_value").collect()} == want
    nowhere = every.where("_order < 0")
    assert {r["_value"] for r in boxes.first_box(points, nowhere, "id", "_order", "_value").collect()} == {None}


def test_postings_are_lean_and_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(search_index, "SPECIES_PER_TASK", 2)
    index = spark.createDataFrame(SPECIES, "k string, name string, sci string, cells long").coalesce(1)
    path = tempfile.mkdtemp(prefix="postings-") + "/p"
    search_index.write(index, path)
    assert search_index.postings(index).columns == ["kind", "text", "k", "cells"]
    assert search_index.split_by(index, 1, search_index.SPECIES_PER_TASK, "k").rdd.getNumPartitions() == 4
    got = search_index.candidates(spark, path, "owl").collect()
    assert {(r["k"], r["name"], r["sci"], r["cells"], r["rank"]) for r in got} == {
        ("1", "Barn Owl", "Tyto alba", 5, 1), ("2", "Owlet Moth", "Noctua", 9, 0), ("3", "Grey-owl thing", "Strix x", 9, 2), ("4", "Great Grey Owl", "Strix nebulosa", 2, 1), ("7", "aaaa aaab", "owl", 7, 0)}
