"""Ranked lexical search by dual trees, exact to the last unit.

Documents and items become sparse vectors over terms: a document's coordinate is what the term's occurrences are worth
there, an item's is the term's weight times its repeats, and the score is their product, all in whole numbers. Items form
a tree of up to ITEMS a block, documents one tree for every CHUNK of them inside a task; neighbours in a tree share their
heaviest term. A node holds the maximum of every coordinate below it, so the product of two nodes bounds the score of every
pair below them. Where it is less than the weakest k-th score among the node's items, the whole batch of pairs is left out:
no document there can enter any of these items' lists. What is left at the leaves is scored in full.

The steps: (1) terms of the items, and a filter of FILTER_BITS bits that tells most other terms apart; (2) one pass over
the texts, which writes the vectors of filtered terms and, per task, the numbers of documents and terms and the documents
per term; (3) weights by a join of those with the items' terms; (4) per block of items a first search among one document
in FLOOR_SHARE, whose k-th scores are lower bounds of the true ones, then the search among all with these as floors; (5) the
lists of the tasks are merged. A block of items, its floors and the filter are all that goes through the driver.

Terms travel as 64-bit hashes. Each task also writes the words behind its hashes; if two words in play share a hash, the
pass is repeated with another seed.

Edge cases: null and empty texts have no terms; they are neither counted nor found. Documents without doc_id take part and
stand behind others of equal score. Rows that repeat a doc_id are documents of their own, rows that repeat an item_id items
of their own. An item without terms, or with none that a document has, gets no rows, nor do scores of 0, where every
document holds the term. Very long texts are cut into terms a slice at a time. Empty tables give no rows. Only the id and
the text of either table are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import ship, stored

#: Items a block, on average; documents a tree; documents and items a leaf; children a node.
ITEMS, CHUNK, DOC_LEAF, ITEM_LEAF, FAN = 256, 2048, 8, 1, 8
#: The floors come from one document in so many.
FLOOR_SHARE = 32
FILTER_BITS = 1 << 22
#: Bytes of a text that are cut into terms at once, hashes a task remembers, terms after which it writes its counts.
SLICE, REMEMBERED, COUNTED = 1 << 20, 1 << 18, 1 << 17

#: Digits, letters and all bytes of other code points are term characters; A-Z are lowered, the rest become spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

PASS = "doc_id long, n long, terms binary, tfs binary, docs long, length long, words array<binary>, hashes array<long>, counts array<long>"


def term_counts(text: str) -> Counter:
    """Occurrences of each term."""
    body = text.encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    found: Counter = Counter()
    at = 0
    while at < len(body):
        end = body.find(b" ", at + SLICE) if at + SLICE < len(body) else -1
        end = len(body) if end < 0 else end
        found.update(body[at:end].split())
        at = end
    return found


def hash_of(term: bytes, seed: int) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(term, seed)
    return h - (1 << 64) if h >> 63 else h


# ---------------------------------------------------------------- vectors


def _documents(batches: Iterator[pa.RecordBatch], passing: bytes, seed: int) -> Iterator[pa.RecordBatch]:
    """A row per document with filtered terms; rows with the counts of the task so far, the last at its end."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary()), ("docs", pa.int64()), ("length", pa.int64()), ("words", pa.list_(pa.binary())), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
    known: dict[bytes, int | None] = {}
    df: Counter = Counter()
    docs = length = 0

    def counted() -> pa.RecordBatch:
        words = list(df)
        none = [pa.nulls(1, f.type) for f in schema][:4]
        lists = [pa.array([x], f.type) for x, f in zip((docs, length, words, [hash_of(w, seed) for w in words], list(df.values())), list(schema)[4:], strict=True)]
        return pa.RecordBatch.from_arrays([*none, *lists], schema=schema)

    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            found = term_counts(text.as_py())
            if not found:
                continue
            n = found.total()
            docs, length = docs + 1, length + n
            terms, tfs = [], []
            for word, tf in found.items():
                try:
                    h = known[word]
                except KeyError:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    h = hash_of(word, seed)
                    h = known[word] = h if passing[(h & FILTER_BITS - 1) >> 3] >> (h & 7) & 1 else None
                if h is not None:
                    terms.append(h)
                    tfs.append(tf)
                    df[word] += 1
            if terms:
                rows.append((doc_id, n, np.array(terms, np.int64).tobytes(), np.array(tfs, np.int64).tobytes()))
        if rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(rows), f.type) for f in list(schema)[4:])], schema=schema)
        if len(df) >= COUNTED:
            yield counted()
            df.clear()
            docs = length = 0
    if docs or df:
        yield counted()


def _item_terms(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
            found = term_counts(text.as_py())
            words = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(words), pa.int64()), pa.array(words, pa.binary()), pa.array([hash_of(w, seed) for w in words], pa.int64()), pa.array(list(found.values()), pa.int64())],
                names=["item", "word", "hash", "count"],
            )


def _filter(terms: DataFrame) -> bytes:
    """Which of FILTER_BITS places a term of the items has, a bit each: so many bits, whatever the items."""
    bit = terms.select(F.col("hash").bitwiseAND(FILTER_BITS - 1).alias("bit"))
    maps = bit.groupBy(F.shiftright("bit", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("map")).collect()
    passing = bytearray(FILTER_BITS // 8)
    for r in maps:
        passing[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = r["map"]
    return bytes(passing)


def vectors(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms of the items (item, word, hash, count), vectors of the documents, and documents per term (word, hash, df)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in range(64):
        terms = stored(items.mapInArrow(lambda b, seed=seed: _item_terms(b, seed), "item long, word binary, hash long, count long"), "lexical-items")
        passing = docs.sparkSession.sparkContext.broadcast(_filter(terms))
        found = stored(texts.mapInArrow(lambda b, seed=seed, passing=passing: _documents(b, passing.value, seed), PASS), "lexical-vectors")
        pairs = found.where("words IS NOT NULL").select(F.explode(F.arrays_zip("words", "hashes", "counts")).alias("t"))
        df = stored(pairs.groupBy(F.col("t.words").alias("word"), F.col("t.hashes").alias("hash")).agg(F.sum("t.counts").alias("df")), "lexical-df")
        shared = df.select("hash", "word").union(terms.select("hash", "word")).distinct().groupBy("hash").count().where("count > 1")
        if shared.isEmpty():
            return terms, found, df
    raise RuntimeError("words share 64-bit hashes under every seed")


# ---------------------------------------------------------------- trees


Level = tuple[int, np.ndarray]


def _levels(vectors: np.ndarray, leaf: int) -> list[Level]:
    """From the root down to the leaves: vectors below a node, and each node's coordinate maxima."""
    at = [(leaf, np.maximum.reduceat(vectors, np.arange(0, len(vectors), leaf), axis=0))]
    while len(at[0][1]) > 1:
        span, nodes = at[0]
        at.insert(0, (span * FAN, np.maximum.reduceat(nodes, np.arange(0, len(nodes), FAN), axis=0)))
    return at


def _by_heaviest(rows: np.ndarray, cols: np.ndarray, worth: np.ndarray, n: int) -> np.ndarray:
    """Order of the rows by their heaviest coordinate, then the next: rows that share them become neighbours."""
    order = np.lexsort((cols, -worth, rows))
    start = np.searchsorted(rows[order], np.arange(n))
    size = np.bincount(rows, minlength=n)
    keys = [np.where(size > i, cols[order[np.minimum(start + i, len(order) - 1)]], -1) for i in range(3)]
    return np.lexsort(keys[::-1])


@dataclass(frozen=True)
class Block:
    """Vectors of a block of items, by ``rows`` (index of the item), ``cols`` (index of the hash) and ``values``."""

    items: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(item: np.ndarray, hash_: np.ndarray, weight: np.ndarray, count: np.ndarray) -> Block:
        items, rows = np.unique(item, return_inverse=True)
        hashes, first, cols = np.unique(hash_, return_index=True, return_inverse=True)
        order = _by_heaviest(rows, cols, weight * count, len(items))
        return Block(items[order], hashes, weight[first], np.argsort(order)[rows], cols, weight * count)

    @property
    def exact_in_doubles(self) -> bool:
        """Worths stay below a million, so sums below 2^53 are whole numbers that doubles hold."""
        return bool(np.bincount(self.rows, self.values.astype(np.float64)).max(initial=0) * 1e6 < 2**53)

    def dense(self, cols: np.ndarray) -> np.ndarray:
        """The block's vectors over some columns."""
        at = np.full(len(self.hashes), -1)
        at[cols] = np.arange(len(cols))
        here = at[self.cols] >= 0
        out = np.zeros((len(self.items), len(cols)), np.float64 if self.exact_in_doubles else np.int64)
        out[self.rows[here], at[self.cols[here]]] = self.values[here]
        return out


class Best:
    """The k best documents of each item so far; equal scores go to the smaller doc_id."""

    def __init__(self, items: int, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors
        self.scores = np.zeros((items, k), np.int64)
        self.missing, self.ids = np.ones((items, k), bool), np.full((items, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """The score a document needs at least: equal ones may have a smaller id."""
        return np.maximum(np.maximum(self.floors, self.scores[:, -1]), 1)

    def add(self, items: np.ndarray, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        """Scores of documents (columns) for some items (rows)."""
        scores = np.where(scores >= self.least()[items][:, None], scores, 0).astype(np.int64)
        some = scores.any(axis=1)
        items, scores = items[some], scores[some]
        if not len(items):
            return
        all_scores = np.concatenate([self.scores[items], scores], axis=1)
        all_missing = np.concatenate([self.missing[items], np.broadcast_to(missing, scores.shape)], axis=1)
        all_ids = np.concatenate([self.ids[items], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, all_missing, -all_scores), axis=-1)[:, : self.k]
        for held, every in ((self.scores, all_scores), (self.missing, all_missing), (self.ids, all_ids)):
            held[items] = np.take_along_axis(every, order, axis=1)


def _bounds(queries: list[Level], documents: list[Level], needed: np.ndarray) -> np.ndarray:
    """Bounds of the pairs of leaves, -1 where a pair of nodes at or above them is ruled out.

    Both trees are gone down together; the root of the shallower one waits for the other. ``needed`` is the score that each
    item asks for, and a node of items asks for the least of theirs.
    """
    deep = max(len(queries), len(documents))
    queries, documents = ([tree[0]] * (deep - len(tree)) + tree for tree in (queries, documents))
    alive = np.ones((1, 1), bool)
    for (span, q), (_, d) in zip(queries, documents, strict=True):
        for axis, nodes in enumerate((len(q), len(d))):
            if nodes != alive.shape[axis]:
                alive = np.repeat(alive, FAN, axis=axis).take(np.arange(nodes), axis=axis)
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        bound = np.full(alive.shape, -1.0)
        # A little is added for sums beyond what doubles hold exactly.
        bound[np.ix_(rows, cols)] = (q[rows] @ d[cols].T) * (1 + 1e-9)
        alive &= bound >= np.minimum.reduceat(needed, np.arange(0, len(needed), span))[:, None]
    return np.where(alive, bound, -1.0)


def _search_chunk(block: Block, best: Best, doc_ids: list, n: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, tfs: np.ndarray, total: int, length: int) -> None:
    """Enter a chunk's documents into the lists of the block's items."""
    cols = np.minimum(np.searchsorted(block.hashes, hashes), len(block.hashes) - 1)
    ours = block.hashes[cols] == hashes
    rows, cols, tfs = np.repeat(np.arange(len(n)), sizes)[ours], cols[ours], tfs[ours]
    if not len(rows):
        return
    norm = np.array([75 + 25 * int(x) * total // length for x in n], np.int64)
    worth = 1_000_000_000 * tfs // (1000 * tfs + 12 * norm[rows])
    # Only the documents and the columns that occur here, in the order of the tree.
    present, rows = np.unique(rows, return_inverse=True)
    order = _by_heaviest(rows, cols, worth * block.weights[cols], len(present))
    rows = np.argsort(order)[rows]
    documents = present[order]
    here, cols = np.unique(cols, return_inverse=True)
    queries = block.dense(here)
    leaves = -(-len(documents) // DOC_LEAF)
    top = np.zeros((leaves, len(here)))
    np.maximum.at(top, (rows // DOC_LEAF, cols), worth.astype(np.float64))
    by_leaf = np.argsort(rows // DOC_LEAF, kind="stable")
    ends = np.searchsorted((rows // DOC_LEAF)[by_leaf], np.arange(leaves + 1))
    missing = np.array([doc_ids[i] is None for i in documents])
    ids = np.array([np.iinfo(np.int64).max if doc_ids[i] is None else doc_ids[i] for i in documents], np.int64)
    bounds = _bounds(_levels(queries.astype(np.float64, copy=False), ITEM_LEAF), _levels(top, 1), best.least())
    starts = np.arange(0, len(block.items), ITEM_LEAF)
    for leaf in np.argsort(-bounds.max(axis=0), kind="stable"):  # the best first, so that more is asked for at the rest
        alive = bounds[:, leaf] >= np.minimum.reduceat(best.least(), starts)
        if not alive.any():
            continue
        items = np.flatnonzero(np.repeat(alive, ITEM_LEAF)[: len(block.items)])
        at = by_leaf[ends[leaf] : ends[leaf + 1]]
        first = leaf * DOC_LEAF
        last = min(first + DOC_LEAF, len(documents))
        used, narrow = np.unique(cols[at], return_inverse=True)
        matrix = np.zeros((last - first, len(used)), queries.dtype)
        matrix[rows[at] - first, narrow] = worth[at]
        best.add(items, queries[np.ix_(items, used)] @ matrix.T, missing[first:last], ids[first:last])


def _search(batches: Iterator[pa.RecordBatch], block: Block, floors: np.ndarray, k: int, total: int, length: int) -> Iterator[pa.RecordBatch]:
    """The lists of one task: item, doc_id, score."""
    best = Best(len(block.items), k, floors)
    held: list[pa.RecordBatch] = []

    def enter(rows: pa.Table) -> None:
        terms, tfs = rows.column("terms").to_pylist(), rows.column("tfs").to_pylist()
        sizes = np.array([len(x) // 8 for x in terms])
        _search_chunk(block, best, rows.column("doc_id").to_pylist(), rows.column("n").to_numpy(), sizes, np.frombuffer(b"".join(terms), np.int64), np.frombuffer(b"".join(tfs), np.int64), total, length)

    for batch in batches:
        held.append(batch)
        while sum(len(b) for b in held) >= CHUNK:
            whole = pa.Table.from_batches(held)
            enter(whole.slice(0, CHUNK))
            held = whole.slice(CHUNK).to_batches()
    if held and sum(len(b) for b in held):
        enter(pa.Table.from_batches(held))
    items, ranks = np.nonzero(best.scores >= np.maximum(floors, 1)[:, None])
    ids = pa.array(best.ids[items, ranks], mask=best.missing[items, ranks])
    yield pa.RecordBatch.from_arrays([pa.array(block.items[items], pa.int64()), ids, pa.array(best.scores[items, ranks], pa.int64())], names=["item", "doc_id", "score"])


FOUND = "item long, doc_id long, score long"


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    ship(spark)
    named = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.coalesce("text", F.lit("")).alias("text")), "lexical-names")
    terms, found, df = vectors(docs, named.select("item", "text"))
    size = found.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("total"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    total, length = size["total"], size["length"]
    weight = F.floor(1000 * F.log((2.0 * F.lit(total) + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("weight")
    blocks = max(1, -(-named.count() // ITEMS))
    weighted = stored(
        terms.join(df.select("word", "df"), "word").select(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), "item", "hash", weight, "count").where("weight > 0"), "lexical-weights"
    )
    rows = found.where("terms IS NOT NULL").select("doc_id", "n", "terms", "tfs")
    lists = []
    for number in range(blocks):
        held = weighted.where(F.col("block") == number).select("item", "hash", "weight", "count").toPandas()
        if not len(held):
            continue
        block = Block.of(*(held[c].to_numpy() for c in ("item", "hash", "weight", "count")))

        def run(of: DataFrame, floors: np.ndarray, block: Block = block) -> DataFrame:
            return of.mapInArrow(lambda b: _search(b, block, floors, k, total, length), FOUND)

        few = rows.where(F.pmod(F.xxhash64("doc_id", "terms"), F.lit(FLOOR_SHARE)) == 0)
        kth = {r["item"]: r["score"] for r in _merged(run(few, np.zeros(len(block.items), np.int64)), k).where(F.col("rank") == k).select("item", "score").collect()}
        lists.append(stored(run(rows, np.array([kth.get(int(i), 0) for i in block.items], np.int64)), "lexical-lists"))
    merged = spark.createDataFrame([], FOUND)
    for part in lists:
        merged = merged.unionByName(part)
    return _merged(merged, k).join(named.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
