"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, float recomputation of what survives.

Queries and candidates are dealt into blocks by the hash of their id, and every pair of blocks is a tile that one task
computes. Vectors are scaled to length one and rounded to int8; a tile's product of codes gives every cosine up to a
known error. A pair survives if its upper bound reaches the k-th best lower bound of its query in the tile. Survivors are
recomputed in double precision from the original vectors, each tile keeps a heap of k for each query, and the heaps of a
query are merged. Nothing is approximate in the result.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows without
an id. Rows that repeat an id are one vector, the smallest. Vectors of different length are never neighbours. Equal
scores go to the smaller id. With fewer than k candidates all are returned; with none, the query has no rows. Columns other
than the id and the vector are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import ship, stored

#: Rows of a tile's two sides.
QUERIES_PER_BLOCK, VECTORS_PER_BLOCK = 1024, 4096

FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, and the length of each rounding error."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All products of int8 rows. Floating point holds them exactly: single precision up to 1040 components."""
    kind = np.float32 if left.shape[1] <= 1040 else np.float64
    return (left.astype(kind) @ right.astype(kind).T).astype(np.float64)


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each row pair; sums run in order of the components, so equal vectors have equal scores."""
    dot = np.add.accumulate(left * right, axis=1)[:, -1]
    norms = np.add.accumulate(left * left, axis=1)[:, -1] * np.add.accumulate(right * right, axis=1)[:, -1]
    return np.clip(dot / np.sqrt(norms), -1.0, 1.0)


def tile(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query among the tile's vectors."""
    rows = []
    if len(queries) and len(vectors):
        left, right = (np.stack(x["vector"].to_numpy()).astype(np.float64) for x in (queries, vectors))
        q_ids, v_ids = queries["vec_id"].to_numpy(), vectors["vec_id"].to_numpy()
        (q_codes, q_scale, q_error), (v_codes, v_scale, v_error) = quantised(left), quantised(right)
        near = products(q_codes, v_codes) * q_scale[:, None] * v_scale[None, :]
        # |u.v - u'.v'| <= |u - u'| |v| + |u'| |v - v'|, and a little for the arithmetic.
        bound = q_error[:, None] + (1 + q_error)[:, None] * v_error[None, :] + 1e-9
        own = q_ids[:, None] == v_ids[None, :]
        low = np.where(own, -np.inf, near - bound)
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(q_ids), -np.inf)
        for q in range(len(q_ids)):
            alive = np.flatnonzero((near[q] + bound[q] >= kth[q]) & ~own[q])
            if not len(alive):
                continue
            scores = cosines(np.broadcast_to(left[q], (len(alive), left.shape[1])), right[alive])
            best = heapq.nsmallest(k, zip((-scores).tolist(), v_ids[alive].tolist(), strict=True))
            rows += [(int(q_ids[q]), v, -s) for s, v in best]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", per_query: int = QUERIES_PER_BLOCK, per_block: int = VECTORS_PER_BLOCK) -> DataFrame:
    """For each row that ``queries`` selects (a condition on ``vec_id``), its k nearest other rows: query_id, rank, vec_id, score."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = stored(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("q")).first()
    blocks, q_blocks = max(1, -(-counts["n"] // per_block)), max(1, -(-counts["q"] // per_query))
    hashed = F.xxhash64("vec_id")
    left = rows.where(queries).select("dim", F.pmod(hashed, F.lit(q_blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"), "vec_id", "vector")
    right = rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), F.pmod(hashed, F.lit(blocks)).cast("int").alias("c"), "vec_id", "vector")
    tiles = left.groupBy("dim", "q", "c").cogroup(right.groupBy("dim", "q", "c")).applyInPandas(lambda a, b: tile(a, b, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
