"""Counts file to tables to documents on the small fixture; replacing a shard; idempotence."""

import tempfile

import pytest
from pyspark.sql import functions as F

from phenogrid.functions import months
from phenogrid.operators import counting, documents
from phenogrid.plans import world
from phenogrid.sources import files, sinks

SENSITIVE = ("Strix arcana",)

WINTER = {1: 12, 2: 9, 12: 15}


def shard_file(spark):
    """Two cells of the first shard and one of the next: a resident wader, a winter duck, an owl nobody may see."""
    rows = []
    for month in range(1, 13):
        rows.append(("S7", "Vanellus ripae", "Charadriidae", month, 21.0, 88.0, 30 + month))
        rows.append(("S9", "Strix arcana", "Strigidae", month, 21.0, 88.0, 2))
        rows.append(("", "", "", month, 21.0, 88.0, 200))
        rows.append(("", "", "", month, 33.0, 64.0, 60))
        rows.append(("S7", "Vanellus ripae", "Charadriidae", month, 21.0, 59.0, 1000))
    rows += [("S8", "Anas hiemis", "Anatidae", month, 21.0, 88.0, n) for month, n in WINTER.items()]
    return write_tsv(spark, rows)


def write_tsv(spark, rows):
    path = tempfile.mkdtemp(prefix="tsv-") + "/counts"
    schema = "specieskey string, species string, family string, month int, lat0 double, lng0 double, n long"
    sinks.write_counts_tsv(spark.createDataFrame(rows, schema), path)
    return path


@pytest.fixture(scope="module")
def built(spark):
    tables = tempfile.mkdtemp(prefix="tables-")
    return tables, world.world_shard(spark, shard_file(spark), "south-asia", tables, SENSITIVE)


def names(spark):
    rows = [("Vanellus ripae", "701", "Bank Plover", "Charadriidae"), ("Anas hiemis", "802", "Winter Duck", "Anatidae")]
    return spark.createDataFrame(rows, "sci string, key string, common string, family string")


def sensitive(spark):
    return spark.createDataFrame([(s,) for s in SENSITIVE], "sci string")


def bundle(spark, tables):
    pairs, effort = world.shard_tables(spark, tables)
    return world.world_build(pairs, effort, names(spark), sensitive(spark), store=tempfile.mkdtemp(prefix="store-"))


WADER = sum(30 + m for m in range(1, 13))


def test_metrics_count_what_is_masked(built):
    row = built[1].first()
    assert row.asDict() == {
        "shard": "south-asia", "rows": 12 * 4 + 3, "records": WADER + 12 * (2 + 200 + 60) + sum(WINTER.values()), "pairs": 2, "species": 2, "cells": 2,
    }


def test_tables_hold_effort_but_no_owl(spark, built):
    pairs, effort = world.shard_tables(spark, built[0])
    assert {r["sci"]: r["c"] for r in pairs.collect()} == {
        "Vanellus ripae": [30 + m for m in range(1, 13)], "Anas hiemis": [WINTER.get(m, 0) for m in range(1, 13)],
    }
    assert {r["cell"]: r["t"] for r in effort.collect()} == {
        "21_88": [232 + m + WINTER.get(m, 0) for m in range(1, 13)], "33_64": [60] * 12,
    }


def test_documents(spark, built):
    made = bundle(spark, built[0])
    cells = {r["id"]: {s["k"]: (s["p"], [i for i, on in enumerate(s["m"], 1) if on]) for s in r["species"]} for r in made.cells.collect()}
    assert cells == {"21_88": {"701": ("resident", list(range(1, 13))), "802": ("seasonal", [1, 2, 12])}, "33_64": {}}
    index = {r["id"]: (r["richness"], set(r["coverage"])) for r in made.cell_index.collect()}
    assert index == {"21_88": ([2, 2] + [1] * 9 + [2], {"some"}), "33_64": ([0] * 12, {"some"})}
    duck = made.species.where("k = '802'").first()["cells"]["21_88"]["r"]
    assert duck == [round(WINTER.get(m, 0) / (232 + m + WINTER.get(m, 0)), 4) for m in range(1, 13)]
    assert {r["k"]: (r["name"], r["family"], r["cells"]) for r in made.species_index.collect()} == {"701": ("Bank Plover", "Charadriidae", 1), "802": ("Winter Duck", "Anatidae", 1)}
    assert {r["id"] for r in made.manifest.where("status = 'loaded'").collect()} == {"south-asia"}
    meta = made.meta.first()
    assert (meta["coverage"], meta["datasets"]) == ("South Asia", [])


def test_a_shard_replaces_only_itself_and_may_become_empty(spark):
    tables = tempfile.mkdtemp(prefix="tables-")
    world.world_shard(spark, shard_file(spark), "south-asia", tables, SENSITIVE)
    before = sorted(map(str, files.shard_table(spark, f"{tables}/pairs").collect()))
    europe = write_tsv(spark, [("S8", "Anas hiemis", "Anatidae", m, 47.0, 3.0, 11) for m in range(1, 13)])
    world.world_shard(spark, europe, "europe", tables, SENSITIVE)
    world.world_shard(spark, europe, "europe", tables, SENSITIVE)
    assert {r["id"] for r in bundle(spark, tables).cells.collect()} == {"21_88", "33_64", "47_3"}
    unnamed = write_tsv(spark, [("", "", "", 5, 47.0, 3.0, 4)])
    world.world_shard(spark, unnamed, "europe", tables, SENSITIVE)
    assert sorted(map(str, files.shard_table(spark, f"{tables}/pairs").collect())) == before
    world.world_shard(spark, write_tsv(spark, [("", "", "", 5, 1.0, 3.0, 4)]), "europe", tables, SENSITIVE)
    assert {r["shard"] for r in files.shard_table(spark, f"{tables}/totals").collect()} == {"south-asia"}


def states(changes):
    return {(r["kind"], r["id"]): r["state"] for r in changes.collect()}


def test_publish_in_place(spark, built):
    root = tempfile.mkdtemp(prefix="site-")
    made = bundle(spark, built[0])
    first = world.publish(spark, made, root)
    assert set(states(first).values()) == {"added"} and all(r["bytes"] > 0 for r in first.collect())
    again = world.publish(spark, made, root)
    assert set(states(again).values()) == {"unchanged"} and again.where("bytes IS NOT NULL").count() == 0
    pairs, effort = world.shard_tables(spark, built[0])
    other = world.world_build(pairs.where("sci = 'Anas hiemis'"), effort.where("cell = '21_88'"), names(spark), sensitive(spark), store=tempfile.mkdtemp(prefix="store-"))
    found = states(world.publish(spark, other, root))
    assert {k: v for k, v in found.items() if k[0] in ("cells", "species")} == {
        ("cells", "21_88"): "changed", ("cells", "33_64"): "removed", ("species", "701"): "removed", ("species", "802"): "unchanged",
    }
    held = world.published(spark, root, "cells", "id string, species array<struct<k:string>>").collect()
    assert [(r["id"], [s["k"] for s in r["species"]]) for r in held] == [("21_88", ["802"])]
    assert [r["k"] for r in world.published(spark, root, "species_index", files.INDEX_SCHEMA).collect()] == ["802"]


def test_dense_ids_follow_the_order_of_keys(spark):
    keys = [f"Species {i}" for i in range(0, 400, 3)] + ["Species 3", "Zosterops"]
    got = {r["k"]: r["id"] for r in documents.dense_ids(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(set(keys)))}


def test_unnamed_species_keep_their_name(spark, built):
    pairs, effort = world.shard_tables(spark, built[0])
    none = names(spark).where("false")
    keys = {r["k"] for r in world.world_build(pairs, effort, none, sensitive(spark)).species.collect()}
    assert keys == {"Vanellus ripae", "Anas hiemis"}


def test_resolve_names_fallbacks(spark):
    wanted = spark.createDataFrame([("Vanellus ripae", "S7", "F"), ("Corvus ignotus", "77X", "Corvidae"), ("Passer nullius", None, None)], "sci string, specieskey string, family string")
    empty = names(spark).where("false")
    rows = {r["sci"]: r for r in world.naming.resolve_names(wanted, empty, names(spark), empty).collect()}
    assert rows["Vanellus ripae"]["key"] == "701" and not rows["Vanellus ripae"]["unmatched"]
    assert (rows["Corvus ignotus"]["key"], rows["Corvus ignotus"]["family"], rows["Corvus ignotus"]["unmatched"]) == ("77X", "Corvidae", True)
    assert rows["Passer nullius"]["key"] == "Passer nullius"


def test_sensitive_names_are_refused():
    with pytest.raises(counting.SensitiveSpeciesError, match="Panthera tigris"):
        counting.refuse_sensitive(["Anser indicus", "Panthera tigris"])


def test_records_to_shard_counts(spark):
    rows = [
        (28.5, 77.5, "Aves", "PRESENT", True, False, 2015, 3, "A b", "K", "F"), (28.9, 77.1, "Aves", "PRESENT", True, False, 2026, 3, "A b", "K", "F"),
        (28.5, 77.5, "Aves", "PRESENT", True, False, 2009, 3, "A b", "K", "F"), (28.5, 77.5, "Mammalia", "PRESENT", True, False, 2015, 3, "A b", "K", "F"),
        (28.5, 77.5, "Aves", "PRESENT", True, True, 2015, 3, "A b", "K", "F"), (28.5, 77.5, "Aves", "PRESENT", True, False, 2015, None, "A b", "K", "F"),
        (28.5, 77.5, "Aves", "PRESENT", True, False, 2015, 3, None, None, "F"), (28.5, 77.5, "Aves", "PRESENT", True, False, 2015, 3, "Panthera tigris", "K", "F"),
        (50.0, 77.5, "Aves", "PRESENT", True, False, 2015, 3, "A b", "K", "F"),
    ]
    schema = "lat double, lng double, class string, status string, has_coordinate boolean, has_issue boolean, year int, month int, sci string, specieskey string, family string"
    got = world.shard_counts(spark.createDataFrame(rows, schema), "south-asia")
    assert sorted((r["sci"] or "", r["lat0"], r["lng0"], r["n"]) for r in got.collect()) == [("", 28, 77, 1), ("A b", 28, 77, 2)]


def test_flagship_plan_scans_once(spark, sf_dir):
    import __spark_entry__ as entry

    frame = entry.queries()["e03_presence"](spark, sf_dir)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
    assert "l_extendedprice" not in plan


def test_dense_months(spark):
    frame = spark.createDataFrame([("a", 0, 9), ("a", 3, 2), ("a", 13, 5), ("a", 12, 1)], "cell string, month int, n long")
    row = counting.dense_months(frame, ["cell"]).first()
    assert row["c"] == [0, 0, 2] + [0] * 8 + [1]
    assert frame.groupBy("cell").agg(F.count("*")).count() == 1 and months.FULL_YEAR == 4095
