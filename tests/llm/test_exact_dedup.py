"""Exact dedup against brute force, with real and with colliding hashes."""

import hashlib
import re
from collections import defaultdict

from phenogrid.llm import exact_dedup
from pyspark.sql import functions as F


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def answer(docs, **settings):
    rows = exact_dedup.decide(docs, **settings).collect()
    return rows, sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str)


def test_equals_brute_force(documents, texts):
    rows, got = answer(documents)
    assert got == brute(texts.items())
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows) and any(r.group_size > 1 for r in rows)


def test_colliding_hashes_are_told_apart(documents, texts):
    _, got = answer(documents, digest=lambda c: F.substring(F.unhex(F.md5(c)), 1, 1))
    assert got == brute(texts.items())


def test_white_space_is_ascii_only(spark):
    docs = spark.createDataFrame([(1, "a\t\x0b b"), (2, "a b"), (3, "a\u00a0b"), (4, " a b"), (5, "  a b"), (6, "a\x1cb")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.decide(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_odd_rows(odd, empty):
    rows, got = answer(odd)
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    left = exact_dedup.exact_dedup(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 5, 7, 8, 9, -4], key=str)
    assert answer(empty)[1] == [] and exact_dedup.exact_dedup(empty).count() == 0


def test_plan_is_native(documents):
    plan = exact_dedup.decide(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
