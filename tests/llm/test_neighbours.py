"""Nearest neighbours against brute force."""

import math

import numpy as np
from phenogrid.llm import neighbours
from phenogrid.llm.common import table
from pyspark.sql import functions as F

def every_50():
    return F.col("vec_id") % 50 == 0


def brute(vectors, k):
    good = {}
    for i, v in vectors:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(good.get(i, v), v)
    out = []
    for q, v in good.items():
        if q % 50 == 0:
            near = sorted((-neighbours.cosines(np.array([v], float), np.array([w], float))[0], c) for c, w in good.items() if c != q and len(w) == len(v))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(near[:k])]
    return sorted(out)


def answer(frame, **settings):
    return sorted(tuple(r) for r in neighbours.nearest(frame, every_50(), **settings).collect())


def test_equals_brute_force_in_any_blocks(spark, sf_dir):
    frame = table(spark, sf_dir, "embeddings")
    want = brute([tuple(r) for r in frame.select("vec_id", "embedding").collect()], 5)
    assert answer(frame) == want
    assert answer(frame, per_query=3, per_block=40) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (50, [-1.0, 5.0]), (100, [1.0, 2.0, 3.0]), (150, None)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, vector string, dim int")
    assert answer(frame) == brute(rows, 5)
    assert answer(frame, k=1)[0] == (0, 1, 1, 1.0)
    assert answer(frame.limit(0)) == []


def test_copies_tie_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    common = [float(x) for x in rng.normal(size=64)]
    rows = [(i, common if i % 3 else [float(x) for x in rng.normal(size=64)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = answer(frame, per_block=37)
    assert got == brute([(r.vec_id, r.embedding) for r in frame.collect()], 5)
    assert [r[2] for r in got if r[0] == 50] == [1, 2, 4, 5, 7]


def test_bounds_hold():
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(40, 64)), rng.normal(size=(60, 64))
    (a, s, e), (b, t, f) = neighbours.quantised(left), neighbours.quantised(right)
    near = neighbours.products(a, b) * s[:, None] * t[None, :]
    true = (left / np.linalg.norm(left, axis=1)[:, None]) @ (right / np.linalg.norm(right, axis=1)[:, None]).T
    assert (np.abs(near - true) <= e[:, None] + (1 + e)[:, None] * f[None, :] + 1e-9).all()
