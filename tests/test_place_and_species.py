"""Place and species questions on the small literal inputs."""

import math

from pyspark.sql import functions as F

from phenogrid.functions import geo, grid
from phenogrid.operators import drill, flow, place_view, species_view
from phenogrid.rules import DrillRules, TierRules

ON = {"bulbul": (30, range(1, 13)), "falcon": (20, (10, 11)), "wagtail": (10, (10, 11, 12, 1, 2, 3)), "cuckoo": (5, range(6, 11)), "goose": (4, (11, 12, 1))}
LABELS = {"bulbul": "resident", "falcon": "passage", "wagtail": "seasonal", "cuckoo": "seasonal", "goose": "seasonal"}


def place(spark):
    rows = []
    for key, (n, on) in ON.items():
        c = [n if m in on else 0 for m in range(1, 13)]
        rows.append((key, "26_94", c, [100] * 12, sum(1 << (m - 1) for m in on), LABELS[key]))
    return spark.createDataFrame(rows, "key string, cell string, c array<bigint>, t array<bigint>, m int, p string")


def doing(spark, month):
    return {r["key"]: r["doing"] for r in place_view.listed_rows(place(spark)).where(F.col("month") == month).collect()}


def test_october(spark):
    assert doing(spark, 10) == {"bulbul": "resident", "falcon": "passing", "wagtail": "arriving", "cuckoo": "leaving"}


def test_january(spark):
    got = doing(spark, 1)
    assert (got["goose"], got["wagtail"]) == ("leaving", "staying") and len(got) == 3


def test_summary(spark):
    effort = spark.createDataFrame([("26_94", [100] * 12)], "cell string, t array<bigint>")
    rows = {r["month"]: r for r in place_view.place_summary(place(spark), effort).collect()}
    assert (rows[10]["total"], rows[10]["moving"], rows[10]["records"], rows[10]["thin"]) == (4, 3, 100, False)
    assert rows[1]["total"] == 3
    thin = place_view.place_summary(place(spark), effort, TierRules(thin_records=101)).first()
    assert thin["thin"]


def test_tiers(spark):
    cases = [(2, 2, "rarely"), (40, 100, "often"), (10, 100, "sometimes"), (4, 100, "rarely")]
    for i, (count, top, want) in enumerate(cases):
        rows = [("a", f"{i}_0", [count] * 12, [200] * 12, 4095, "resident"), ("top", f"{i}_0", [top] * 12, [200] * 12, 4095, "resident")]
        frame = spark.createDataFrame(rows, "key string, cell string, c array<bigint>, t array<bigint>, m int, p string")
        got = place_view.tiered_rows(frame).where("key = 'a' and month = 3").first()
        assert got["reported"] == want and got["top"] == max(count, top)


def test_chips_and_order(spark):
    rows = place_view.listed_rows(place(spark)).where("month = 10")
    chips = place_view.chip_counts(rows).first()
    assert (chips["n_moving"], chips["n_all"], chips["n_resident"]) == (3, 4, 1)
    order = [r["key"] for r in place_view.ordered_rows(rows, "all").orderBy("pos").collect()]
    assert order == ["wagtail", "falcon", "cuckoo", "bulbul"]
    page = place_view.ordered_page(rows, "all", 3).collect()
    assert len(page) == 3 and {r["more"] for r in page} == {1}


def ranged(spark, cells, p="seasonal"):
    rows = [("k", cell, int(cell.split("_")[0]), int(cell.split("_")[1]), p, [round(w * 10000) for w in r], [float(w) for w in r]) for cell, r in cells.items()]
    return spark.createDataFrame(rows, "key string, cell string, lat0 int, lng0 int, p string, u array<bigint>, r array<double>")


def on(weights):
    return [weights.get(m, 0) for m in range(1, 13)]


def test_species_summary(spark):
    frame = ranged(spark, {
        "50_120": on(dict.fromkeys((5, 6, 7, 8), 1)), "-24_28": on(dict.fromkeys((11, 12, 1, 2), 1)), "26_94": on({10: 2}),
    })
    row = species_view.species_summary(frame).first()
    assert row["peak_month"] == 9 and row["behaviour"] == "migratory" and row["total_cells"] == 3
    assert abs(row["shift_deg"] - 74) < 0.5
    assert row["cells"] == [1, 1, 0, 0, 1, 1, 1, 1, 0, 1, 1, 1]


def test_journey(spark):
    frame = ranged(spark, {
        "48_120": on(dict.fromkeys((5, 6, 7, 8), 1)), "25_93": on({10: 2, 11: 2}), "-25_28": on(dict.fromkeys((12, 1, 2, 3), 1)),
    })
    dominant = species_view.dominant_regions(species_view.region_months(frame, "cell = '25_93'"))
    legs = species_view.journey_legs(dominant)
    got = [(r["region"], r["from_month"], r["to_month"]) for r in legs.orderBy("leg").collect()]
    assert got == [("southern Africa", 11, 2), ("East Asia", 4, 7), ("India", 9, 10)]
    home = species_view.home_summary(dominant, legs, 5).first()
    assert (home["home_months"], home["home_peak"], home["regions"], home["region_now"]) == (2, 9, 3, "East Asia")


def test_one_region_all_year_is_one_leg(spark):
    dominant = species_view.dominant_regions(species_view.region_months(ranged(spark, {"48_120": [1] * 12}), "false"))
    got = [(r["from_month"], r["to_month"], r["region"]) for r in species_view.journey_legs(dominant).collect()]
    assert got == [(0, 11, "East Asia")]


def test_species_search(spark):
    index = spark.createDataFrame(
        [("1", "Falco amurensis", "Amur Falcon", 5), ("2", "Falco tinnunculus", "Common Kestrel", 9), ("3", "Micro falco", "Tiny", 2), ("4", "Anser", "Goose", 50), ("5", "X", "Unfalconly", 7)],
        "k string, sci string, name string, cells long",
    )
    got = [(r["k"], r["rank"]) for r in species_view.match_species(index, " FALCO ").orderBy("rank", F.desc("cells")).collect()]
    assert got == [("2", 0), ("1", 0), ("5", 2), ("3", 2)]
    assert species_view.match_species(index, "  ").count() == 0


def plain_hilbert(n, x, y):
    d, s = 0, n // 2
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if ry == 0:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        s //= 2
    return d


def test_hilbert_is_a_walk_over_the_grid(spark):
    n = 16
    grid_points = spark.range(n * n).selectExpr(f"cast(id % {n} as int) x", f"cast(id div {n} as int) y")
    rows = grid_points.withColumn("d", grid.hilbert_index(n, "x", "y")).collect()
    order = {r["d"]: (r["x"], r["y"]) for r in rows}
    assert sorted(order) == list(range(n * n))
    assert all(abs(order[i][0] - order[i + 1][0]) + abs(order[i][1] - order[i + 1][1]) == 1 for i in range(n * n - 1))
    assert all(d == plain_hilbert(n, x, y) for d, (x, y) in order.items())


def test_quantile_picks_brute_force(spark):
    weights = [("a", 0, f"{i}_{i * 3 % 40}", i, i * 3 % 40, (i * 7) % 5 + 1) for i in range(30)] + [("b", 4, "5_5", 5, 5, 3)]
    frame = spark.createDataFrame(weights, "key string, month int, cell string, lat0 int, lng0 int, w long")
    n = 17
    got = {(r["key"], r["pick"]): r["cell"] for r in flow.quantile_picks(frame, n).collect()}
    placed = {r["cell"]: r["place"] for r in flow.hilbert_order(frame).collect()}
    assert len(got) == 2 * n
    mine = sorted((w for w in weights if w[0] == "a"), key=lambda w: (placed[w[2]], w[2]))
    total = sum(w[5] for w in mine)
    for i in range(n):
        run = 0
        for w in mine:
            run += w[5]
            if run * 2 * n >= (2 * i + 1) * total:
                break
        assert got["a", i] == w[2] and got["b", i] == "5_5"


def test_drill_down_brute_force(spark):
    rows = []
    for i in range(400):
        lat, lng = (i * 37) % 180 - 90, (i * 101) % 360 - 180
        rows.append(("A", i % 12 + 1, lat, lng, (i * 13) % 30 + 1))
    rows += [("B", 5, 10, 10, 9), ("B", 5, 40, 40, 12)]
    counts = spark.createDataFrame(rows, "sci string, month int, lat0 int, lng0 int, n long")
    rules = DrillRules(box_records=40, box_share=0.01)
    got = {(r["sci"], r["cell"]): r["records"] for r in drill.drill_down(counts, rules).collect()}
    for sci in "AB":
        mine = [r for r in rows if r[0] == sci]
        for size in (20, 5):
            boxes = {}
            for _, _, lat, lng, n in mine:
                box = ((lat + 90) // size, (lng + 180) // size)
                boxes[box] = boxes.get(box, 0) + n
            floor = max(40, 0.01 * sum(boxes.values()))
            mine = [r for r in mine if boxes[(r[2] + 90) // size, (r[3] + 180) // size] >= floor]
        want = {}
        for _, _, lat, lng, n in mine:
            want[sci, f"{lat}_{lng}"] = want.get((sci, f"{lat}_{lng}"), 0) + n
        assert {k: v for k, v in got.items() if k[0] == sci} == want
    assert got


def test_drill_thresholds(spark):
    counts = spark.createDataFrame([("A", 1, 0, 0, 12), ("A", 1, 20, 20, 9)], "sci string, month int, lat0 int, lng0 int, n long")
    assert [r["cell"] for r in drill.drill_down(counts).collect()] == ["0_0"]


def test_compass(spark):
    rows = spark.createDataFrame([(0.0, -1.0), (-1.0, 0.0), (1.0, 1.0)], "u double, v double")
    got = [(r[0], r[1]) for r in rows.select(geo.blows_from(F.col("u"), F.col("v")), geo.flows_towards(F.col("u"), F.col("v"))).collect()]
    assert got == [("north", "south"), ("east", "west"), ("south-west", "north-east")]
