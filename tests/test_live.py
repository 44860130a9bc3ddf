"""Versioned stores, bucketed shards, and sites that follow them."""

import tempfile

import pytest
from pyspark.sql import functions as F

from phenogrid.operators import counting
from phenogrid.plans import live, world
from phenogrid.sources import buckets, shard_store, snapshots

GRIDDED = "shard string, sci string, cell string, specieskey string, family string, c array<bigint>"
KEYED = "k string, v int"


def folder(name):
    return tempfile.mkdtemp(prefix=f"{name}-")


def rows(spark, *cells):
    """(shard, sci, cell, n): n records in every month."""
    return spark.createDataFrame([(shard, sci, cell, None, None, [n] * 12) for shard, sci, cell, n in cells], GRIDDED)


def keyed(spark, *pairs):
    return spark.createDataFrame(list(pairs), KEYED)


def held(spark, root):
    return {r["k"]: r["v"] for r in snapshots.read(spark, snapshots.latest(spark, root), "t", ["k"], KEYED, 3).collect()}


def test_latest_layer_wins_until_it_is_merged(spark):
    root = folder("layers")
    now = snapshots.commit(spark, snapshots.latest(spark, root), {"t": [snapshots.write_base(keyed(spark, ("a", 1), ("b", 2), ("c", 3)), root, "t", ["k"], 3)]})
    for changed, gone in (((("b", 20), ("d", 4)), ("a",)), ((("a", 11), ("d", 40)), ("c",))):
        layer = snapshots.write_changes(keyed(spark, *changed), keyed(spark, *[(k, 0) for k in gone]), root, "t", ["k"])
        now = snapshots.commit(spark, now, {"t": [*now.tables["t"], layer]}, {"last": layer})
    want = {"a": 11, "b": 20, "d": 40}
    assert held(spark, root) == want and now.notes["last"] == now.tables["t"][-1]
    assert {r["k"]: r["v"] for r in snapshots.read(spark, snapshots.at_version(spark, root, 2), "t", ["k"], KEYED, 3).collect()} == {"b": 20, "c": 3, "d": 4}
    merged = snapshots.compact(spark, root, {"t": (["k"], KEYED)}, 3)
    assert held(spark, root) == want and len(merged.tables["t"]) == 1
    assert len(snapshots.vacuum(spark, root, keep=1)) == 3 and held(spark, root) == want
    assert snapshots.compact(spark, root, {"t": (["k"], KEYED)}, 3) == merged


def test_of_two_writers_one_fails(spark):
    root = folder("conflict")
    parent = snapshots.latest(spark, root)
    snapshots.commit(spark, parent, {"t": ["layers/x"]})
    with pytest.raises(snapshots.ConflictError):
        snapshots.commit(spark, parent, {"t": ["layers/y"]})
    assert snapshots.latest(spark, root).tables == {"t": ("layers/x",)}


def test_a_read_of_one_column_reads_no_other(spark):
    root = folder("columns")
    snapshots.commit(spark, snapshots.latest(spark, root), {"t": [snapshots.write_base(keyed(spark, ("a", 1)), root, "t", ["k"], 3)]})
    plan = snapshots.read(spark, snapshots.latest(spark, root), "t", ["k"], KEYED, 3, [])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<k:string,gone:boolean>" in plan


def test_one_key_is_found_in_one_bucket(spark):
    root = folder("bucket")
    snapshots.commit(spark, snapshots.latest(spark, root), {"t": [snapshots.write_base(keyed(spark, *[(str(i), i) for i in range(50)]), root, "t", ["k"], 8)]})
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell
    try:
        found = snapshots.read(spark, snapshots.latest(spark, root), "t", ["k"], KEYED, 8).where("k = '7'")
        assert "SelectedBucketsCount: 1 out of 8" in found._jdf.queryExecution().toString() and found.first()["v"] == 7
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


FIRST = (("asia", "x", "1_1", 40), ("asia", "y", "1_1", 9), ("asia", "x", "2_2", 3), ("asia", None, "2_2", 70), ("europe", "x", "50_1", 12), ("europe", None, "50_1", 50), ("europe", "z", "51_1", 8))


@pytest.fixture
def tables(spark):
    root = folder("shards")
    shard_store.replace(spark, root, rows(spark, *FIRST), ["asia", "europe"])
    return root


def shape(spark, now):
    pairs = {(r["shard"], r["sci"], r["cell"]): r["c"][0] for r in shard_store.pairs(spark, now).collect()}
    return pairs, {(r["shard"], r["cell"]): r["t"][0] for r in shard_store.effort(spark, now).collect()}


def test_pairs_and_effort_switch_together(spark, tables):
    before = snapshots.latest(spark, tables)
    old = shape(spark, before)
    assert old[1] == {("asia", "1_1"): 49, ("asia", "2_2"): 73, ("europe", "50_1"): 62, ("europe", "51_1"): 8}

    def die():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        shard_store.replace(spark, tables, rows(spark, ("europe", "x", "50_1", 1)), ["europe"], before_commit=die)
    assert shape(spark, snapshots.latest(spark, tables)) == old
    after = shard_store.replace(spark, tables, rows(spark, ("europe", "x", "50_1", 1)), ["europe"])
    assert shape(spark, after)[0] == {k: v for k, v in old[0].items() if k[0] == "asia"} | {("europe", "x", "50_1"): 1}
    assert shape(spark, before) == old and live.changed_shards(before, after) == ["europe"]
    gone = shard_store.replace(spark, tables, rows(spark).where("false"), ["europe"])
    assert shard_store.shards_of(gone) == ["asia"] and {r["shard"] for r in shard_store.metrics(spark, gone).collect()} == {"asia"}
    with pytest.raises(ValueError, match="africa"):
        shard_store.replace(spark, tables, rows(spark, ("africa", "x", "1_1", 1)), ["asia"])


def test_species_of_all_shards_from_sketches(spark, tables):
    row = shard_store.species_in_all(shard_store.metrics(spark, snapshots.latest(spark, tables))).first()
    assert (row["estimate"], row["in_shards"]) == (3, 4)


def names(spark):
    return spark.createDataFrame([("x", "K1", "Ex", "F"), ("y", "K2", "Why", "F")], "sci string, key string, common string, family string")


def settings(spark, sensitive=()):
    return live.Settings(names(spark), spark.createDataFrame([(s,) for s in sensitive], "sci string"))


def test_species_cells_meet_their_effort_without_a_shuffle(spark, tables):
    now = snapshots.latest(spark, tables)
    path = folder("names") + "/n"
    names(spark).write.parquet(path)
    known = spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")  # the names fit, the effort doesn't
    try:
        made = world.label(shard_store.pairs(spark, now), counting.merge_effort(shard_store.effort(spark, now)), known, known.where("false").select("sci"))
        listed = made.groupBy("cell").agg(F.collect_list("key"))
        plan = listed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "SortMergeJoin [cell" in plan
    assert "Exchange hashpartitioning(cell" not in plan and "Exchange hashpartitioning(key" not in plan


def documents_of(spark, site):
    return {kind: sorted(r[body] for r in world.stored_bodies(spark, snapshots.latest(spark, site), name).collect()) for name, what in world.SETS.items() for kind, body in what.kinds.items()}


def test_refresh_equals_a_full_build_and_touches_only_what_changed(spark, tables):
    site = folder("site")
    live.build(spark, tables, site, settings(spark))
    assert live.refresh(spark, tables, site, settings(spark)).count() == 0
    base = snapshots.latest(spark, site)
    # One cell of x changes, a cell is new, z goes with its cell.
    shard_store.replace(spark, tables, rows(spark, ("europe", "x", "50_1", 13), ("europe", None, "50_1", 50), ("europe", "y", "52_1", 6)), ["europe"])
    states = {(r["kind"], r["id"]): r["state"] for r in live.refresh(spark, tables, site, settings(spark)).collect()}
    assert {k: v for k, v in states.items() if k[0] in ("cells", "species")} == {
        ("cells", "50_1"): "changed", ("cells", "51_1"): "removed", ("cells", "52_1"): "added", ("species", "K1"): "changed", ("species", "K2"): "changed", ("species", "z"): "removed",
    }
    now = snapshots.latest(spark, site)
    assert all(now.tables[t][0] == base.tables[t][0] and len(now.tables[t]) == 2 for t in ("labelled", "cells", "species"))
    assert {r["cell"] for r in snapshots.changes(spark, now, "labelled", live.LABELLED).collect()} == {"50_1", "51_1", "52_1"}
    whole = folder("whole")
    live.build(spark, tables, whole, settings(spark))
    assert documents_of(spark, site) == documents_of(spark, whole)
    assert now.tables["meta"] == base.tables["meta"] and now.tables["coverage"] != base.tables["coverage"]


def test_many_refreshes_are_merged(spark, tables, monkeypatch):
    monkeypatch.setattr(world, "MOST_LAYERS", 2)
    site, whole = folder("site"), folder("whole")
    live.build(spark, tables, site, settings(spark))
    for n in (20, 30):
        shard_store.replace(spark, tables, rows(spark, ("asia", "x", "1_1", n), ("asia", None, "3_3", n)), ["asia"])
        live.refresh(spark, tables, site, settings(spark))
    assert all(len(snapshots.latest(spark, site).tables[t]) == 1 for t in ("labelled", "cells", "species"))
    live.build(spark, tables, whole, settings(spark))
    assert documents_of(spark, site) == documents_of(spark, whole)


def test_other_names_or_sensitive_species_mean_a_full_build(spark, tables):
    site = folder("site")
    live.build(spark, tables, site, settings(spark))
    states = {(r["kind"], r["id"]): r["state"] for r in live.refresh(spark, tables, site, settings(spark, ["y"])).collect()}
    assert states[("species", "K2")] == "removed" and states[("cells", "1_1")] == "changed" and states[("cells", "50_1")] == "unchanged"


def test_a_refresh_reads_the_keys_that_changed(spark, tables):
    site = folder("site")
    live.build(spark, tables, site, settings(spark))
    before = snapshots.latest(spark, tables)
    after = shard_store.replace(spark, tables, rows(spark, ("europe", "x", "50_1", 13)), ["europe"])
    cells = live.dirty_cells(spark, before, after)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "shard=asia" not in plan and plan.count("PartitionFilters") == 4 and "Exchange hashpartitioning(sci" not in plan
    assert sorted(r["cell"] for r in cells.collect()) == ["50_1", "51_1"]
    plan = shard_store.pairs(spark, after).join(cells, "cell", "left_semi")._jdf.queryExecution().toString()
    assert "LeftSemi" in plan


def test_buckets_need_one_shuffle_at_most(spark):
    path = folder("b") + "/x"
    buckets.write(keyed(spark, ("a", 1), ("b", 2)), path, "k", 4, ["k"])
    again = buckets.table(spark, path, "k", 4, ["k"], KEYED)
    assert again.groupBy("k").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert sorted(map(tuple, again.collect())) == [("a", 1), ("b", 2)]


def test_metrics_copy_no_rows(spark):
    rows = [("a", s, c, [1] + [0] * 11) for s in ("x", "y", None) for c in ("1_1", "2_2")] + [("b", None, "1_1", [0] * 12), ("b", "x", None, [2] * 12)]
    made = shard_store.metrics_of(spark.createDataFrame(rows, "shard string, sci string, cell string, c array<bigint>"))
    assert "Expand" not in made._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[:5] for r in made.collect()} == {("a", 6, 2, 4, 2), ("b", 24, 1, 1, 1)}


def test_builds_share_one_reading_of_the_records(spark, sf_dir):
    from phenogrid.catalog import published

    for rows in published.shard_rows(spark, sf_dir):
        assert not any("lineitem" in f for f in rows.inputFiles())
