"""Resharding by minimum-cost flow: old shards give, new shards take, and as few bytes as possible move.

Every old shard is a row of blocks (a block is a hash class of doc_ids, so equal ids stay together). Block sizes and the
new capacities make a small flow problem; its solution says how many bytes go from where to where. Laid along the blocks,
most of a flow is whole blocks; where it ends inside a block, that block's documents are dealt out one by one, small ones
last. A bounded list of such documents, some of every size, is then moved or swapped until no exchange brings the sizes
closer: large ones close large gaps, and differences of similar ones the rest. Only shards that gain or lose are written
anew.

Sizes are UTF-8 bytes of the text plus 8; a null text has none. Edge cases: all rows of a doc_id go to the same shard, also
those of the null id. Empty texts count 8. A document larger than a capacity makes its shard larger than the others. An
empty table gives empty shards. Other columns, whatever their names, are carried in the struct column ``document``.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import stored

#: Blocks of an old shard. The driver sees one row per block.
BLOCKS = 64

#: Documents of each shard and power of two in size that the last exchange may choose from. The driver sees these too, at
#: most so many times 40 a shard.
EXCHANGE = 64


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def hash_layout(shards: int) -> Column:
    """A layout by the hash of doc_id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")


def block_of(blocks: int = BLOCKS) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.lit(blocks)).cast("int")


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def min_cost_flow(supply: list[int], demand: list[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, all supplied and at least cost, by successive shortest paths.

    The graph has as many nodes as there are shards, whatever the data.
    """
    give, take = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    price = {(i, j): cost(i, j) for i in range(len(give)) for j in range(len(take))}
    while any(give):
        far = [0 if left else None for left in give]  # distance of old shards that can still give
        near: list[int | None] = [None] * len(take)
        via_old: list[int | None] = [None] * len(give)
        via_new: list[int | None] = [None] * len(take)
        changed = True
        while changed:
            changed = False
            for (i, j), c in price.items():
                if far[i] is not None and (near[j] is None or far[i] + c < near[j]):
                    near[j], via_new[j], changed = far[i] + c, i, True
                if flow[i, j] and near[j] is not None and (far[i] is None or near[j] - c < far[i]):
                    far[i], via_old[i], changed = near[j] - c, j, True
        j = min((j for j in range(len(take)) if take[j] and near[j] is not None), key=lambda j: near[j])
        path, amount, end = [], take[j], j
        while True:
            i = via_new[j]
            path.append((i, j, 1))
            if via_old[i] is None:
                amount = min(amount, give[i])
                break
            j = via_old[i]
            path.append((i, j, -1))
            amount = min(amount, flow[i, j])
        for a, b, sign in path:
            flow[a, b] += sign * amount
        give[i] -= amount
        take[end] -= amount
    return {k: v for k, v in flow.items() if v}


@dataclass(frozen=True)
class Plan:
    """Whole blocks with their new shard, and cut blocks with the byte ranges that go to each new shard."""

    whole: list[tuple[int, int, int]]
    cuts: list[tuple[int, int, int, int, int]]
    flow: dict[tuple[int, int], int]

    def affected(self, shards: int) -> set[int]:
        """Shards that gain or lose by the flow."""
        moved = {k for k in self.flow if k[0] != k[1]}
        return {i for i, _ in moved if i < shards} | {j for _, j in moved}


def lay_out(blocks: dict[tuple[int, int], int], flow: dict[tuple[int, int], int]) -> Plan:
    """Lay each old shard's flows along its blocks: what stays first, then the others in order of the new shard."""
    whole, cuts = [], []
    for old in sorted({i for i, _ in blocks}):
        parts = sorted(((j != old, j, n) for (i, j), n in flow.items() if i == old))
        edges, at = [], 0
        for _, j, n in parts:
            edges.append((at, at + n, j))
            at += n
        at = 0
        for (_, block), n in sorted((k, n) for k, n in blocks.items() if k[0] == old):
            inside = [(max(lo, at) - at, min(hi, at + n) - at, j) for lo, hi, j in edges if lo < at + n and at < hi]
            if len(inside) == 1:
                whole.append((old, block, inside[0][2]))
            else:
                cuts += [(old, block, lo, hi, j) for lo, hi, j in inside]
            at += n
    return Plan(whole, cuts, flow)


def _best(held: list[list[tuple[int, int]]], over: list[int], i: int, j: int) -> tuple[int, int, int, int | None] | None:
    """The document of shard i, and for a swap one of shard j, that evens out two shards best; None if none does."""
    gap = (over[i] - over[j]) / 2
    if gap < 1 or not held[i]:
        return None
    give, back = np.array([s for s, _ in held[i]]), np.array([0, *(s for s, _ in held[j])])
    after = np.minimum(np.searchsorted(back, give - gap), len(back) - 1)  # the two that are nearest to what should come back
    found = np.stack([np.maximum(after - 1, 0), after])
    miss = np.abs(give - back[found] - gap)
    side, a = np.unravel_index(int(np.argmin(miss)), miss.shape)
    b = int(found[side, a])
    return (i, j, int(a), b - 1 if b else None) if miss[side, a] < gap else None


def exchange(sizes: list[int], wanted: list[int], pool: list[tuple[int, int, int]]) -> dict[int, int]:
    """Moves and swaps of single documents (id, size, shard) that bring ``sizes`` closer to ``wanted``: id -> new shard.

    Each round takes the fullest and the emptiest shards that a document, or a pair, can even out. Every round brings two
    shards closer together, so there is a last one.
    """
    over = [a - b for a, b in zip(sizes, wanted, strict=True)]
    held = [sorted((size, id_) for id_, size, shard in pool if shard == k) for k in range(len(sizes))]
    moved: dict[int, int] = {}
    while True:
        order = sorted(range(len(over)), key=over.__getitem__)
        found = next((f for i in reversed(order) for j in order if over[i] > over[j] if (f := _best(held, over, i, j))), None)
        if found is None:
            return moved
        i, j, a, b = found
        out = held[i].pop(a)
        back = held[j].pop(b) if b is not None else None
        for shard, document in ((j, out), (i, back)):
            if document:
                insort(held[shard], document)
                moved[document[1]] = shard
        step = out[0] - (back[0] if back else 0)
        over[i] -= step
        over[j] += step


def plan(docs: DataFrame, old: Column, shards: int, blocks: int = BLOCKS) -> tuple[Plan, DataFrame, dict[int, tuple[int, int]]]:
    """The plan, the new shard of every document in a cut block (doc_id, size, shard), and single documents that change
    places: doc_id -> the shard they leave and the one they go to."""
    rows = docs.select("doc_id", size_of(docs["text"]).alias("size"), old.alias("old"), block_of(blocks).alias("block"))
    sums = {(r["old"], r["block"]): r["size"] for r in rows.groupBy("old", "block").agg(F.sum("size").alias("size")).collect()}
    supply = [0] * (max((i for i, _ in sums), default=-1) + 1)
    for (i, _), n in sums.items():
        supply[i] += n
    wanted = equal_capacities(sum(supply), shards)
    made = lay_out(sums, min_cost_flow(supply, wanted, lambda i, j: int(i != j)))
    spark = docs.sparkSession
    cuts = spark.createDataFrame(made.cuts, "old int, block int, low long, high long, shard int")
    loose = rows.join(F.broadcast(cuts.select("old", "block").distinct()), ["old", "block"], "left_semi").groupBy("old", "block", "doc_id").agg(F.sum("size").alias("size"))
    along = Window.partitionBy("old", "block").orderBy(F.desc("size"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = loose.withColumn("middle", F.sum("size").over(along) - F.col("size") / 2)
    near = (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high"))
    dealt = stored(placed.join(F.broadcast(cuts), ["old", "block"]).where(near).select("doc_id", "size", "shard"), "dealt")
    found = dict(dealt.groupBy("shard").agg(F.sum("size")).collect())
    sizes = [found.get(j, 0) for j in range(shards)]
    for i, block, j in made.whole:
        sizes[j] += sums[i, block]
    whole = spark.createDataFrame(made.whole, "old int, block int, shard int")
    every = rows.join(F.broadcast(whole), ["old", "block"]).select("doc_id", "size", "shard").unionByName(dealt).where("doc_id IS NOT NULL")
    some = Window.partitionBy("shard", "power").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = every.withColumn("power", F.floor(F.log2("size"))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= EXCHANGE).select("doc_id")
    pool = every.join(F.broadcast(stored(few.distinct(), "exchange")), "doc_id", "left_semi").groupBy("doc_id", "shard").agg(F.sum("size").alias("size")).select("doc_id", "size", "shard").collect()
    home = {r["doc_id"]: r["shard"] for r in pool}
    return made, dealt, {i: (home[i], j) for i, j in exchange(sizes, wanted, [tuple(r) for r in pool]).items()}


def reshard(docs: DataFrame, old: Column, shards: int, path: str, blocks: int = BLOCKS) -> DataFrame:
    """Write the new shards to ``path`` (folders ``shard=n``) and return them: document, old, block, shard.

    Shards that neither gain nor lose are not written; their rows come from ``docs`` as they were.
    """
    made, dealt, moved = plan(docs, old, shards, blocks)
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), old.alias("old"), block_of(blocks).alias("block"))
    whole = spark.createDataFrame(made.whole, "old int, block int, shard int")
    settled = rows.join(F.broadcast(whole), ["old", "block"])
    open_rows = rows.join(F.broadcast(whole), ["old", "block"], "left_anti")
    single = open_rows.join(dealt.hint("merge"), open_rows["document.doc_id"].eqNullSafe(dealt["doc_id"])).select("old", "block", "document", "shard")
    laid = settled.select("old", "block", "document", "shard").unionByName(single)
    changes = spark.createDataFrame([(i, to) for i, (_, to) in moved.items()], "doc_id long, changed int")
    target = laid.join(F.broadcast(changes), laid["document.doc_id"] == changes["doc_id"], "left").select("old", "block", "document", F.coalesce("changed", "shard").alias("shard"))
    affected = made.affected(shards).union(*moved.values())
    same = target.where(~F.col("shard").isin(*affected)) if affected else target
    if not affected:
        return same
    # Each shard is written by as many tasks as its share of the session's partitions.
    tasks = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    parts = F.pmod(F.xxhash64("document.doc_id", "document.text"), F.lit(tasks))
    changed = target.where(F.col("shard").isin(*affected)).withColumn("part", parts).repartition("shard", "part").drop("part")
    changed.sortWithinPartitions("shard", "old", "block", "document.doc_id").write.partitionBy("shard").parquet(path)
    schema = target.select("old", "block", "document", "shard").schema
    written = spark.read.schema(schema).parquet(path)
    return written if len(affected) == shards else written.unionByName(same)


def listed(shards: DataFrame) -> DataFrame:
    """Every document with its shard and its slot there, read from the shards.

    Slots are counted inside a block and offset by the blocks before it, so no task numbers a whole shard.
    """
    text = F.coalesce(F.col("document.text"), F.lit(""))
    rows = shards.select(
        F.col("document.doc_id").alias("doc_id"), size_of(F.col("document.text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "old", "block",
    )
    counts = rows.groupBy("shard", "old", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "old", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "old", "block").orderBy("doc_id", "text_crc32")
    placed = rows.withColumn("slot", F.row_number().over(inside) - 1).join(bases, ["shard", "old", "block"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("slot")).alias("slot"))
