"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles keeps both its smallest and its largest value, so half the hash evaluations give a
signature of the same length, and min and max of one permutation vary against each other, which lowers the variance.
Bands of ``rows`` values, all minima or all maxima, are bucket keys. With 25 groups of 5 permutations there are 50 bands; two
sets of similarity 0.8 share none with probability (1 - 0.8^5)^50, about 2e-9, and more similar ones far less.

Links are confirmed on full shingle sets. Documents of equal sets are one class, and only classes meet in buckets. A bucket
never lists its pairs: a few pivots are tried first, confirmed links make components, and only in buckets whose members are
still in different components all are compared, in tiles that hand on no more links than join components. What is left
out is connected already.

Edge cases: a text without words, or null, has no shingles and links with nothing, not even another one. Fewer words than
a shingle make one shingle of all. A null doc_id ranks behind all others and is reported as null. Rows that repeat a
doc_id are judged each by its own text; those that repeat the text too are one document. Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import LAST_NODE, carried, salt_of, salted_groups, ship, stored
from phenogrid.llm.graph import components
from phenogrid.llm.shingles import mixed, shingle_set

SIGNED = "node long, known boolean, n_shingles long, klass binary, bands array<long>"

#: Pivots of a bucket, and how many a member is compared with at first.
PIVOTS, TRIALS = 4, 3

#: Members up to which a bucket is paired, and members of a lane of a larger one.
PAIRED, LANE = 16, 512


@dataclass(frozen=True)
class Bands:
    groups: int = 25
    rows: int = 5
    seed: int = 7

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers and masks: x -> (x ^ mask) * multiplier runs through all 64-bit numbers."""
        rng = np.random.default_rng(self.seed)
        n = self.groups * self.rows
        return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)


def min_max(shingles: np.ndarray, multipliers: np.ndarray, masks: np.ndarray, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each permutation over a non-empty set."""
    low, high = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(masks), np.uint64)
    for start in range(0, len(shingles), chunk):
        values = (shingles[start : start + chunk, None] ^ masks) * multipliers
        low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, bands: Bands) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    values = np.concatenate([low.reshape(bands.groups, bands.rows), high.reshape(bands.groups, bands.rows)])
    keys = np.arange(1, len(values) + 1, dtype=np.uint64)
    for column in values.T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return keys.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame], size: int, bands: Bands) -> Iterator[pd.DataFrame]:
    multipliers, masks = bands.permutations()
    for batch in batches:
        rows = []
        for node, known, text in zip(batch["node"], batch["known"], batch["text"], strict=True):
            shingles = shingle_set(text, size)
            if len(shingles):
                keys = band_keys(*min_max(shingles, multipliers, masks), bands)
                rows.append((node, known, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), keys))
            else:
                rows.append((node, known, 0, None, None))
        yield pd.DataFrame(rows, columns=["node", "known", "n_shingles", "klass", "bands"])


def _own_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a column __node, and the nodes (node, doc_id) of further texts under a doc_id that has one already.

    Such a text, and a row without doc_id, has a number from the far end, fixed in a stored copy; all others have doc_id.
    """
    body = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = docs.where("doc_id IS NOT NULL").select("doc_id", body.alias("__body"))
    mixed = stored(ids.groupBy("doc_id").agg(F.min("__body").alias("low"), F.max("__body").alias("high")).where("low < high").select("doc_id", "low"), "mixed-ids")
    if mixed.isEmpty():
        if docs.where("doc_id IS NULL").isEmpty():
            return docs.withColumn("__node", F.col("doc_id")), None
        return stored(docs.withColumn("__node", F.coalesce("doc_id", F.lit(LAST_NODE) - F.monotonically_increasing_id())), "rows"), None
    others = ids.join(mixed.hint("merge"), "doc_id").where("__body <> low").select("doc_id", "__body").distinct()
    others = stored(others.withColumn("__other", F.lit(LAST_NODE - (1 << 61)) - F.monotonically_increasing_id()), "further-texts")
    numbered = docs.withColumns({"__body": body, "__last": F.lit(LAST_NODE) - F.monotonically_increasing_id()}).join(others.hint("merge"), ["doc_id", "__body"], "left")
    rows = stored(numbered.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce("__other", "doc_id", "__last").alias("__node")), "rows")
    return rows, others.select(F.col("__other").alias("node"), "doc_id")


def _shingle_sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Full shingle sets of the wanted nodes (node, shingles), stored. Other texts are not cut again."""
    texts = rows.select("node", "text").join(wanted.hint("merge"), "node", "left_semi")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(t, size).view(np.int64) for t in batch["text"]]})

    return stored(texts.mapInPandas(cut, "node long, shingles array<long>"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough.

    A node with many partners is handed out in salted copies, one per part of its partners.
    """
    salted = pairs.withColumn("salt", salt_of("b"))
    left = salted.select("a", "salt").distinct().join(sets.withColumnsRenamed({"node": "a", "shingles": "left"}).hint("merge"), "a")
    right = salted.join(sets.withColumnsRenamed({"node": "b", "shingles": "right"}).hint("merge"), "b")
    both = right.join(left.hint("merge"), ["a", "salt"])
    shared = F.size(F.array_intersect("left", "right"))
    return both.where(100 * shared >= percent * (F.size("left") + F.size("right") - shared)).select("a", "b").distinct()


def tile_links(members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between members of different components in one tile of a bucket, only as many as join components.

    Intersections of all pairs are one matrix product over the shingles that occur twice or more.
    """
    links, i, j = [], members["i"].iloc[0], members["j"].iloc[0]
    members = members.sort_values("node").reset_index(drop=True)
    sizes = np.array([len(x) for x in members["shingles"]])
    numbers, counts = np.unique(np.concatenate(members["shingles"].to_list()), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(members)), sizes)
    common = counts[numbers] > 1
    column = (np.cumsum(counts > 1) - 1)[numbers[common]]
    owner, width = owner[common], int((counts > 1).sum())
    left, right = np.flatnonzero(members["lane"] == i), np.flatnonzero(members["lane"] == j)
    shared = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, width, 4096):
        here = (column >= start) & (column < start + 4096)
        block = np.zeros((len(members), min(4096, width - start)), np.float32)
        block[owner[here], column[here] - start] = 1
        shared += block[left] @ block[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    component, parent = members["component"].to_numpy(), {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    node = members["node"].to_numpy()
    for x, y in zip(*np.nonzero(100 * shared >= percent * union), strict=True):
        a, b = root(component[left[x]]), root(component[right[y]])
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((min(node[left[x]], node[right[y]]), max(node[left[x]], node[right[y]])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _rest(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets whose members are in different components still.

    Members of a small bucket are paired. A larger one is cut into lanes, and each pair of lanes is a tile with the
    members' full sets: a task never holds more than two lanes, and hands on only links that join components.
    """
    sized = entries.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    split = stored(entries.join(sized.where("low < high").select("band", "members").hint("merge"), "band"), "split")
    small = split.where(F.col("members") <= PAIRED)
    other = small.select("band", F.col("node").alias("a"), F.col("n_shingles").alias("size"), F.col("component").alias("other"))
    apart = (F.col("a") < F.col("node")) & (F.col("component") != F.col("other")) & _similar_size(F.col("size"), F.col("n_shingles"), percent)
    pairs = small.join(other.hint("merge"), "band").where(apart).select("a", F.col("node").alias("b")).distinct()
    lanes = F.ceil(F.col("members") / LANE).cast("int")
    lane = F.pmod(F.xxhash64("node"), lanes).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("lanes") - 1), lambda x: F.struct(F.least(x, F.col("lane")).alias("i"), F.greatest(x, F.col("lane")).alias("j")))
    large = split.where(F.col("members") > PAIRED).select("band", "node", "component", lanes.alias("lanes"), lane.alias("lane"))
    placed = large.select("band", "node", "component", "lane", F.explode(tiles).alias("tile")).select("band", "node", "component", "lane", "tile.*")
    held = placed.join(sets.hint("merge"), "node")
    tiled = held.groupBy("band", "i", "j").applyInPandas(lambda pdf: tile_links(pdf, percent), "a long, b long")
    return _confirm(stored(pairs, "pairs"), sets, percent).union(tiled).distinct()


def _similar_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _trials(entries: DataFrame, percent: int) -> DataFrame:
    """Each member with the pivots that share most buckets with it, at most ``TRIALS``.

    A bucket's pivots are the smallest members of each hash class.
    """
    order = F.struct("node", "n_shingles")
    lane = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    pivots = stored(entries.groupBy("band", lane.alias("lane")).agg(F.min(order).alias("p"), F.count("*").alias("n")), "pivots")
    pivots = pivots.select("band", F.col("p.node").alias("a"), F.col("p.n_shingles").alias("size"))
    met = entries.join(pivots.hint("merge"), "band").where((F.col("node") > F.col("a")) & _similar_size(F.col("size"), F.col("n_shingles"), percent))
    counts = met.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TRIALS).select("a", "b")


def _judged(docs: DataFrame, others: DataFrame | None, size: int, percent: int, bands: Bands) -> DataFrame:
    """node, known, n_shingles, doc_id, component_id, kept for rows with a column __node."""
    rows = docs.select(F.col("__node").alias("node"), F.col("doc_id").isNotNull().alias("known"), "text")
    signed = stored(rows.mapInPandas(lambda b: _sign(b, size, bands), SIGNED), "signed").withColumn("salt", salt_of("node"))
    copies = stored(salted_groups(signed.where("klass IS NOT NULL"), ["klass"], F.col("node")), "copies")
    first = signed.where("klass IS NOT NULL").join(copies.select("klass", "salt", "first").hint("merge"), ["klass", "salt"], "left").where("first IS NULL OR first = node")
    entries = stored(first.select("node", "n_shingles", F.explode("bands").alias("band")), "entries")
    crowded = stored(entries.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band"), "crowded")
    entries = stored(entries.join(crowded.hint("merge"), "band", "left_semi").withColumn("component", F.col("node")), "entries")
    sets = _shingle_sets(rows, entries.select("node").distinct(), size)
    links = stored(_confirm(stored(_trials(entries, percent), "pairs"), sets, percent), "links")
    labels = components(links)
    named = labels.withColumnRenamed("component", "found")
    entries = entries.join(named.hint("merge"), "node", "left").withColumn("component", F.coalesce("found", "component")).drop("found")
    more = stored(_rest(entries, sets, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    grouped = copies.join(labels.withColumnRenamed("node", "first").hint("merge"), "first", "left").select("klass", "salt", F.coalesce("component", "first").alias("of_class"))
    found = signed.join(grouped.hint("merge"), ["klass", "salt"], "left").join(labels.hint("merge"), "node", "left")
    component = F.coalesce("of_class", "component", "node")
    found = found.select("node", "known", "n_shingles", component.alias("component"))
    if others is None:
        real = F.col("component") <= F.lit(LAST_NODE) - F.lit(1 << 62)
        return found.select("node", "n_shingles", F.when(F.col("known"), F.col("node")).alias("doc_id"), F.when(real | F.col("known"), F.col("component")).alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))
    # Further texts rank behind all ids as nodes, so the smallest doc_id of a component is looked for among its rows.
    named = found.join(others.hint("merge"), "node", "left").withColumn("doc_id", F.coalesce("doc_id", F.when(F.col("known"), F.col("node"))))
    named = stored(named, "named").withColumn("salt", salt_of("node"))
    best = salted_groups(named, ["component"], F.struct(~F.col("known"), "doc_id", "node")).select("component", "salt", F.col("first.node").alias("best"), F.col("first.doc_id").alias("best_id"))
    chosen = named.join(best.hint("merge"), ["component", "salt"], "left")
    alone = F.col("best").isNull()
    return chosen.select("node", "n_shingles", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("component_id"), (alone | (F.col("node") == F.col("best"))).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: Bands | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Linked when the sets' similarity is percent or more."""
    ship(docs.sparkSession)
    rows, others = _own_nodes(docs.select("doc_id", "text"))
    return _judged(rows, others, size, percent, bands or Bands()).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: the smallest doc_id of each component, or one of its rows if none has an id."""
    ship(docs.sparkSession)
    rows, others = _own_nodes(carried(docs))
    gone = stored(_judged(rows.drop("row"), others, size, percent, Bands()).where("NOT kept").select(F.col("node").alias("__node")).distinct(), "near-gone")
    return rows.join(gone.hint("merge"), "__node", "left_anti").select("row.*")
