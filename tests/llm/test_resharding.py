"""Resharding: the flow, the law of equal bytes, and what the files hold."""

import itertools
import random
import zlib
from collections import defaultdict

from phenogrid.llm import resharding
from phenogrid.llm.queries import QUERIES
from phenogrid.session import new_path


def test_flow_is_least(spark):
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 4) for _ in range(n)]
        demand = resharding.equal_capacities(sum(supply), m)
        price = {(i, j): rng.randint(0, 5) for i in range(n) for j in range(m)}
        flow = resharding.min_cost_flow(supply, demand, lambda i, j, p=price: p[i, j])
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(m)] == demand
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        slots = [j for j, d in enumerate(demand) for _ in range(d)]
        least = min((sum(price[i, j] for i, j in zip(units, order, strict=True)) for order in set(itertools.permutations(slots))), default=0)
        assert sum(price[k] * v for k, v in flow.items()) == least


def test_only_the_surplus_moves():
    flow = resharding.min_cost_flow([10, 30, 20], resharding.equal_capacities(60, 4), lambda i, j: int(i != j))
    assert sum(v for (i, j), v in flow.items() if i != j) == 15 + 5


def test_documents(spark, sf_dir, texts):
    shards = defaultdict(list)
    for r in QUERIES["op3_resharding"](spark, sf_dir).collect():
        text = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "bytes", None)
        shards[r.shard].append(r)
    assert sorted(r.doc_id for rows in shards.values() for r in rows) == sorted(texts)
    assert set(shards) == set(range(24))
    sizes = [sum(r["size"] for r in rows) for rows in shards.values()]
    assert max(sizes) - min(sizes) <= max(len(t.encode()) + 8 for t in texts.values())
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards.values())


def test_skewed_sizes_come_out_even(spark):
    """Texts with a long tail: shards differ by next to nothing, because documents of every size may change places."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "x" * min(300_000, int(200 * rng.paretovariate(1.1)))) for i in range(8000)], "doc_id long, text string")
    shards = resharding.reshard(docs, resharding.hash_layout(20), 24, new_path(spark, "shards"))
    sizes = [r["bytes"] for r in resharding.listed(shards).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "bytes").collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 64


def test_unchanged_shards_are_not_written(spark, documents, sf_dir):
    import os

    path = new_path(spark, "shards")
    first = resharding.reshard(documents, resharding.hash_layout(4), 6, path)
    plan, _, moved = resharding.plan(documents, resharding.hash_layout(4), 6)
    assert moved and plan.affected(6) == set(range(6)) and first.count() == documents.count()
    assert sorted(d for d in os.listdir(path) if d.startswith("shard=")) == [f"shard={k}" for k in range(6)]


def test_odd_rows(spark, odd, empty):
    out = resharding.reshard(odd, resharding.hash_layout(2), 3, new_path(spark, "shards"))
    assert out.select("document.*").columns == odd.columns
    assert sorted(map(str, out.select("document.*").collect())) == sorted(map(str, odd.collect()))
    listed = resharding.listed(out).collect()
    by_id = defaultdict(set)
    for r in listed:
        by_id[r.doc_id].add(r.shard)
    assert len(listed) == odd.count() and all(len(s) == 1 for s in by_id.values())
    assert resharding.listed(resharding.reshard(empty, resharding.hash_layout(2), 3, new_path(spark, "shards"))).count() == 0
