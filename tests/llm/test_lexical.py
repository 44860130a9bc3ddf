"""Ranked lexical search against a plain scorer; the trees with small leaves and chunks, without Spark."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from phenogrid.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(items, docs, k=20):
    found = [(doc_id, c) for doc_id, text in docs if (c := terms(text))]
    total, length = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in found:
            m = 100 - 25 + 25 * c.total() * total // length
            score = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms(text).items() if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def answer(items, docs, **settings):
    return sorted((tuple(r) for r in lexical.search(items, docs, **settings).collect()), key=str)


def frame(spark, rows, id):
    return spark.createDataFrame(rows, f"{id} long, text string").repartition(3)


def test_whole_table(spark, documents, texts, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = answer(items, documents)
    assert got == brute([tuple(r) for r in items.select("item_id", "text").collect()], list(texts.items()))
    assert answer(items, documents, k=3) == [r for r in got if r[1] <= 3]


def test_ties_repeats_and_missing_ids(spark):
    docs = [(i, "alpha beta gamma") for i in (9, 5, 7, None, 5, 2)] + [(11, "alpha beta"), (12, ""), (13, None), (14, "!! ?"), (None, "delta Alpha"), (15, "nothing of it 123")]
    items = [(1, "alpha"), (1, "alpha beta beta"), (2, "ALPHA, delta; Delta"), (3, None), (4, ""), (5, "unheard"), (None, "123 gamma")]
    for k in (2, 20):
        assert answer(frame(spark, items, "item_id"), frame(spark, docs, "doc_id"), k=k) == brute(items, docs, k)


def test_terms_are_bytes_of_the_rule(spark):
    text = "Ärger ärger ÄRGER straße x y z'z 9a_b-c\x7fd\x00e\U0001f600f İi"
    assert {k.decode(): v for k, v in lexical.term_counts(text).items()} == dict(terms(text))
    long = ("word" * 10 + " other, ") * 100_000 + "x" * 3_000_000
    assert {k.decode(): v for k, v in lexical.term_counts(long).items()} == dict(terms(long))


def test_a_term_in_every_document_is_worth_nothing(spark):
    docs = [(i, "the") for i in range(2000)] + [(5000, "the end")]
    items = [(1, "the"), (2, "end the")]
    assert answer(frame(spark, items, "item_id"), frame(spark, docs, "doc_id"), k=5) == brute(items, docs, 5)


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha zeta", "x", 1)], "item_id long, text string, item string, score int")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert answer(items, odd) == brute([(1, "alpha zeta")], rows)
    assert answer(items, empty) == [] and answer(items.limit(0), odd) == []


def test_words_that_share_a_hash_start_a_new_pass(spark, monkeypatch):
    seeds = []
    whole = lexical._filter
    monkeypatch.setattr(lexical, "_filter", lambda t: seeds.append(1) or whole(t))
    kind = type(spark.range(0))
    first = kind.isEmpty
    monkeypatch.setattr(kind, "isEmpty", lambda self: len(seeds) > 1 and first(self))
    docs, items = [(1, "alpha beta"), (2, "beta")], [(1, "alpha beta")]
    assert answer(frame(spark, items, "item_id"), frame(spark, docs, "doc_id")) == brute(items, docs)
    assert len(seeds) == 2


@pytest.mark.parametrize("seed", range(8))
def test_trees_rule_out_nothing_that_counts(monkeypatch, seed):
    rng = random.Random(seed)
    for name, value in {"CHUNK": rng.choice([7, 40, 300]), "DOC_LEAF": rng.choice([1, 3, 8]), "ITEM_LEAF": rng.choice([1, 2, 5]), "FAN": rng.choice([2, 3])}.items():
        monkeypatch.setattr(lexical, name, value)
    hashes = np.array(sorted(rng.sample(range(-(10**9), 10**9), 40)))
    weights = np.array([rng.choice([3, 50, 900]) for _ in hashes])
    triples = sorted({(i * 10, rng.randrange(40)) for i in range(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))})
    items, cols = (np.array(x) for x in zip(*triples, strict=True))
    count = np.array([rng.randint(1, 3) for _ in triples])
    block = lexical.Block.of(items, hashes[cols], weights[cols], count)
    docs, total, length, k = [], 300, 9000, rng.choice([1, 4])
    for d in range(total):
        used = sorted(rng.sample(range(40), rng.randint(1, 5)))
        docs.append((None if rng.random() < 0.05 else d // 2, rng.randint(1, 60), used, [rng.randint(1, 3) for _ in used]))

    def batch(part):
        columns = list(zip(*part, strict=True))
        lists = [pa.array([np.array(hashes[u] if which == 2 else u, np.int64).tobytes() for u in columns[which]], pa.binary()) for which in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    def scores(item):
        mine = {c: w for i, c, w in zip(items, cols, weights[cols] * count, strict=True) if i == item}
        rows = [(sum(int(mine.get(u, 0)) * (10**9 * f // (1000 * f + 12 * (75 + 25 * n * total // length))) for u, f in zip(used, tfs, strict=True)), d is None, d or 0) for d, n, used, tfs in docs]
        return sorted(((-s, m, d) for s, m, d in rows if s > 0))[:k]

    floors = np.zeros(len(block.items), np.int64)
    if seed % 2:  # the true k-th scores are the highest floors that may be given
        floors = np.array([-x[-1][0] if len(x := scores(i)) == k else 0 for i in block.items], np.int64)
    got = pa.Table.from_batches(lexical._search(iter([batch(docs[:50]), batch(docs[50:])]), block, floors, k, total, length)).to_pylist()
    for item in block.items:
        mine = sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["item"] == item)
        assert mine == scores(item)


def test_bounds_are_used():
    """Documents that share no heavy term with the items are not scored."""
    scored = []
    block = lexical.Block.of(np.arange(16), np.arange(16) // 8, np.full(16, 1000), np.ones(16, np.int64))
    best = lexical.Best(16, 1, np.zeros(16, np.int64))
    add = best.add
    best.add = lambda items, scores, *rest: scored.append(scores.size) or add(items, scores, *rest)
    n = 512
    lexical._search_chunk(block, best, list(range(n)), np.full(n, 30), np.ones(n, np.int64), np.repeat([0, 1], n // 2), np.ones(n, np.int64), n, 30 * n)
    assert sum(scored) <= 16 * n // 2 and best.ids[:8].max() < n // 2 <= best.ids[8:].min()
