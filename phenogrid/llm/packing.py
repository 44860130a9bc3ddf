"""Mixture-controlled packing: every window is filled from the source queues in target proportions.

Each source is a queue of its documents' tokens. Deficit round-robin gives a queue its share of a window as credit; what a
queue gets beyond or below its credit is carried into the next window. Every token is packed once, and every window but the
very last is full.

Targets are weights of sources, relative to each other; a source without one weighs its own share of the tokens. Without
any, the mixture is that of the corpus, and all queues run dry together. With targets, queues run dry at different times:
a dry queue's share goes to those that are left, in proportion to their weights, until all is packed. So the windows hold
the targets as long as every queue lasts, and what is left over at the end follows from the rule alone.

Windows are filled in independent partitions of ``WINDOWS`` windows. Where a queue stands when a partition begins follows
from totals and weights alone: its cumulated share of the tokens before, rounded so that all queues together fill whole
windows. The fraction lost by rounding is the deficit that the partition inherits from the one before. So a partition
needs no result of another, and holds the same number of tokens however large a source is.

Edge cases: a null text counts as empty and has only its end id; a null source counts as the empty one. A source gets a
queue of its own if it fills two tokens of every partition, which at most half as many sources as a partition has tokens
can do; smaller ones share one queue, in which the documents of each are spread evenly. Equal credits are served in the
order of the queues, largest source first. Rows that repeat a doc_id are packed as often as they occur, rows without doc_id
under a null id. A long document continues from window to window. An empty table gives no pieces. Columns other than
doc_id, text and source are not read, so none can clash; without a source column there is one queue.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from heapq import heapify, heappop, heapreplace
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import ship, stored
from phenogrid.llm.tokens import default_vocabulary, encoder

#: Tokens of a window, and windows of a partition.
WINDOW, WINDOWS = 2048, 256

#: Tokens of a partition that a queue of its own fills at least.
LEAST_TOKENS = 2

#: Weights are whole numbers of this size for the whole corpus.
SCALE = 10**12

#: A queue is served when its credit has grown to so many tokens, so that documents aren't cut into crumbs.
LEAST_PIECE = 32

TOKENS = "doc_id string, small string, queue int, part int, local long, n long, ids binary"
SLICES = "partition long, queue int, at long, doc_id string, start long, length long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int, ids binary"


class Schedule:
    """Where each queue stands at each partition, from its tokens and its weight, in whole numbers."""

    def __init__(self, totals: Sequence[int], span: int, weights: Sequence[int] | None = None):
        self.totals, self.span, self.total = list(totals), span, sum(totals)
        self.weights = list(totals) if weights is None else [w if n else 0 for n, w in zip(totals, weights, strict=True)]
        # Queues in the order in which they run dry, and what is cumulated before each.
        self.order = sorted(range(len(self.totals)), key=lambda q: Fraction(self.totals[q], self.weights[q] or 1)) if weights is not None else list(range(len(self.totals)))
        self.rank = {q: k for k, q in enumerate(self.order)}
        self.before = [0, *accumulate(self.totals[q] for q in self.order)]
        self.weighed = [0, *accumulate(self.weights[q] for q in self.order)]
        self.even = weights is None

    def _dry(self, done: int) -> int:
        """How many queues are dry when so many tokens are packed."""
        if self.even:
            return len(self.order) if done >= self.total else 0

        def is_dry(k: int) -> bool:
            n, w = self.totals[self.order[k]], self.weights[self.order[k]]
            return done * w >= self.before[k] * w + n * (self.weighed[-1] - self.weighed[k])

        return bisect_left(range(len(self.order)), True, key=lambda k: not is_dry(k))

    def _cumulated(self, k: int, done: int, dry: int) -> tuple[int, int]:
        """Tokens of the first k queues among those packed, as a whole number and its remainder, in parts of what still weighs."""
        if k <= dry:
            return self.before[k], 0
        return divmod(self.before[dry] * self._rest(dry) + (self.weighed[k] - self.weighed[dry]) * (done - self.before[dry]), self._rest(dry))

    def _rest(self, dry: int) -> int:
        return max(1, self.weighed[-1] - self.weighed[dry])

    def taken(self, queue: int, partition: int) -> int:
        """Tokens of a queue that partitions before this one hold. Over all queues they add up to whole partitions."""
        done = min(partition * self.span, self.total)
        if self.even:  # one division each, as nothing runs dry before the end
            return self.before[queue + 1] * done // self.total - self.before[queue] * done // self.total
        k, dry = self.rank[queue], self._dry(done)
        return self._cumulated(k + 1, done, dry)[0] - self._cumulated(k, done, dry)[0]

    def owed(self, queue: int, partition: int) -> float:
        """What rounding left of a queue's share before a partition."""
        done = min(partition * self.span, self.total)
        k, dry = self.rank[queue], self._dry(done)
        return (self._cumulated(k + 1, done, dry)[1] - self._cumulated(k, done, dry)[1]) / self._rest(dry)

    def partition_of(self, queue: int, position: int) -> int:
        """The partition that holds a queue's token."""
        if self.even:
            p = position * self.total // (self.totals[queue] * self.span)
            while self.taken(queue, p + 1) <= position:
                p += 1
            while self.taken(queue, p) > position:
                p -= 1
            return p
        return bisect_right(range(-(-self.total // self.span) + 1), position, key=lambda p: self.taken(queue, p)) - 1


def _queues(docs: DataFrame, column: str | None, span: int) -> tuple[DataFrame, list[str]]:
    """Documents with their queue number, and the sources with a queue of their own.

    At most span / LEAST_TOKENS sources have one and reach the driver.
    """
    source = F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit("")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), source.alias("__source"))
    sums = rows.groupBy("__source").agg(F.sum(F.octet_length("text") + 1).cast("long").alias("bytes"))
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    own = sums.where(F.col("bytes") * span >= LEAST_TOKENS * total).orderBy(F.desc("bytes"), "__source").collect()
    numbered = docs.sparkSession.createDataFrame([(r["__source"], k) for k, r in enumerate(own)], "__source string, queue int")
    placed = rows.join(F.broadcast(numbered), "__source", "left").select("doc_id", "text", F.when(F.col("queue").isNull(), F.col("__source")).alias("small"), F.coalesce("queue", F.lit(len(own))).alias("queue"))
    return placed, [r["__source"] for r in own]


def _encode(batches: Iterator[pd.DataFrame], vocabulary: str, end_id: int) -> Iterator[pd.DataFrame]:
    """Ids of whole texts and where each document starts among its task's tokens of the queue."""
    part, enc, filled = TaskContext.get().partitionId(), encoder(vocabulary), {}
    end = np.array([end_id], enc.dtype).tobytes()
    for batch in batches:
        rows = []
        for doc_id, ids, small, queue in zip(batch["doc_id"], enc.encode_all(batch["text"]), batch["small"], batch["queue"], strict=True):
            ids += end
            n = len(ids) // enc.dtype.itemsize
            local = filled.get(queue, 0)
            filled[queue] = local + n
            rows.append((doc_id, small, queue, part, local, n, ids))
        yield pd.DataFrame(rows, columns=["doc_id", "small", "queue", "part", "local", "n", "ids"])


def _interleaved(tokens: DataFrame, queue: int, span: int) -> DataFrame:
    """Tokens with the small sources' queue in order of how much of its source comes before a document, from a phase of the source.

    Parts of that queue are then equal ranges of this share, as many as it fills partitions.
    """
    columns, tail = tokens.columns, tokens.where(F.col("queue") == queue)
    source, order = Window.partitionBy("small"), Window.partitionBy("small").orderBy("part", "local")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    phase = F.pmod(F.xxhash64("small"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    total = tail.agg(F.sum("n")).first()[0] or 0
    spots = tail.select("small", "part", "local", "n").withColumn("share", (before + phase * F.col("n")) / F.sum("n").over(source))
    lanes = max(1, -(-total // span))
    spots = spots.withColumn("lane", F.least(F.floor(F.col("share") * lanes), F.lit(lanes - 1)).cast("int"))
    inside = Window.partitionBy("lane").orderBy("share", "small", "part", "local").rowsBetween(Window.unboundedPreceding, -1)
    spots = stored(spots.select("part", "local", "lane", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("place")), "interleaved")
    dealt = tail.join(spots.hint("merge"), ["part", "local"]).withColumns({"part": F.col("lane"), "local": F.col("place")})
    return tokens.where(F.col("queue") != queue).select(*columns).unionByName(dealt.select(*columns))


def _slice(batches: Iterator[pd.DataFrame], plan: Schedule, width: int) -> Iterator[pd.DataFrame]:
    """Documents cut where partitions meet."""
    for batch in batches:
        rows = []
        for doc_id, queue, at, n, ids in zip(batch["doc_id"], batch["queue"], batch["at"], batch["n"], batch["ids"], strict=True):
            start = 0
            while start < n:
                p = plan.partition_of(queue, at + start)
                length = min(n - start, plan.taken(queue, p + 1) - at - start)
                rows.append((p, queue, at + start, doc_id, start, length, n, ids[start * width : (start + length) * width]))
                start += length
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SLICES.split(", ")])


def fill(slices: pd.DataFrame, plan: Schedule, partition: int, window: int, dtype: np.dtype, with_ids: bool = True, least: int = LEAST_PIECE) -> pd.DataFrame:
    """Windows of one partition by deficit round-robin. ``slices`` are its parts of documents, at most a partition's tokens."""
    queues: dict[int, list] = {}
    for row in slices.sort_values(["queue", "at"]).itertuples(index=False):
        queues.setdefault(row.queue, []).append(row)
    order = sorted(queues)
    places = range(len(order))
    credit = [plan.owed(q, partition) for q in order]
    left = [sum(r.length for r in queues[q]) for q in order]
    weights = [plan.weights[q] for q in order]
    held = [queues[q] for q in order]
    cursor = [(0, 0)] * len(order)  # slice, ids of it that are packed
    wide: list[memoryview | None] = [None] * len(order)
    width = dtype.itemsize
    sequence, rows, turn = partition * (plan.span // window), [], 0
    remaining, weighing = sum(left), sum(weights)
    offset = 0

    def serve(i: int, take: int) -> None:
        nonlocal offset, weighing
        left[i] -= take
        credit[i] -= take
        if not left[i]:
            weighing -= weights[i]
        k, used = cursor[i]
        while take:
            r = held[i][k]
            length = r.length
            if not used:  # once for all pieces of the slice
                wide[i] = memoryview(np.frombuffer(r.ids, dtype).astype("<u4").tobytes())
            n = min(take, length - used)
            ids = r.ids[used * width : (used + n) * width] if with_ids else None
            rows.append((r.doc_id, r.start + used, n, zlib.crc32(wide[i][4 * used : 4 * (used + n)]), r.doc_tokens, sequence, offset, order[i], ids))
            offset, take, used = offset + n, take - n, used + n
            if used == length:
                k, used = k + 1, 0
        cursor[i] = (k, used)

    while remaining:
        space = min(window, remaining)
        offset, share = 0, window / weighing
        for i in places:
            if left[i]:
                credit[i] += weights[i] * share
        for some in (range(turn, len(order)), range(turn)):
            for i in some:
                if credit[i] >= 1 and ((take := min(int(credit[i]), left[i], space - offset)) >= least or 0 < take == left[i]):
                    serve(i, take)
        if offset < space:  # credit that was too small to serve: the largest goes ahead, and owes it
            ahead = [(-credit[i], i) for i in places if left[i]]
            heapify(ahead)
            while offset < space:
                _, i = ahead[0]
                serve(i, min(max(least, int(credit[i])), left[i], space - offset))
                heapreplace(ahead, (-credit[i], i)) if left[i] else heappop(ahead)
        remaining -= space
        sequence, turn = sequence + 1, (turn + 1) % len(order)
    doc_ids, *numbers, pieces = zip(*rows, strict=True)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
    columns = {name: np.array(values, np.int64) for name, values in zip(names, numbers, strict=True)}
    named = pd.array([None if x is None else int(x) for x in doc_ids], "Int64")
    return pd.DataFrame({"doc_id": named, **columns, "queue": columns["queue"].astype(np.int32), "ids": list(pieces)})


def pack(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, window: int = WINDOW, windows: int = WINDOWS, source: str | None = "source", with_ids: bool = True,
    targets: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence, and, if wanted, the ids themselves.

    ``targets`` are weights of sources as text, relative to each other and to the shares of the sources that have none.
    """
    ship(docs.sparkSession)
    vocabulary, span = vocabulary or default_vocabulary(), window * windows
    column = source if source in docs.columns else None
    rows, own = _queues(docs, column, span)
    count = len(own) + 1
    tokens = stored(rows.mapInPandas(lambda b: _encode(b, vocabulary, end_id), TOKENS), "tokens")
    if not tokens.where(F.col("queue") == count - 1).isEmpty():
        tokens = _interleaved(tokens, count - 1, span)
    sums = stored(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "token-sums")
    found = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    totals = [found.get(q, 0) for q in range(count)]
    total = sum(totals)
    if not total:
        return docs.sparkSession.createDataFrame([], PIECES)
    weights = None if targets is None else [max(1, round(targets.get(own[q], totals[q] / total) * SCALE)) if q < len(own) else max(1, totals[q] * SCALE // total) for q in range(count)]
    # Where rounding could run backwards, with under two tokens a partition, a queue follows at the end of the largest.
    weigh = totals if weights is None else weights
    big, whole = max(range(count), key=lambda q: (weigh[q] if totals[q] else 0)), sum(w for w, n in zip(weigh, totals, strict=True) if n)
    shift = [0] * count
    for q in range(count):
        if q != big and 0 < totals[q] and weigh[q] * span < LEAST_TOKENS * whole and total > span:
            shift[q], totals[big], totals[q] = totals[big], totals[big] + totals[q], 0
    plan = Schedule(totals, span, weights)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(bases, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("local")).alias("at"), "n", "ids")
    dtype = encoder(vocabulary).dtype
    moved = {q: shift[q] for q in range(count) if shift[q]}
    if moved:
        by = F.coalesce(*[F.when(F.col("queue") == q, F.lit(n)) for q, n in moved.items()], F.lit(0))
        placed = placed.withColumn("_by", by).withColumns({"queue": F.when(F.col("_by") > 0, F.lit(big)).otherwise(F.col("queue")), "at": F.col("at") + F.col("_by")}).drop("_by")
    slices = placed.mapInPandas(lambda b: _slice(b, plan, dtype.itemsize), SLICES)
    return slices.groupBy("partition").applyInPandas(lambda key, pdf: fill(pdf, plan, int(key[0]), window, dtype, with_ids), PIECES)


def sequences(pieces: DataFrame, width: int = 2, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Whole sequences: sequence_id, length, padded (the window, or for a short last one the next power of two), ids.

    A sequence has at most ``window`` pieces.
    """
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
    power = F.pow(F.lit(2), F.ceil(F.log2("length"))).cast("int")
    padded = F.when(F.col("length") == window, F.lit(window)).otherwise(power)
    one = F.lit(pad_id.to_bytes(width, "little"))
    body = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    pad = F.aggregate(F.array_repeat(F.lit(0), (padded - F.col("length")).cast("int")), F.lit(b""), lambda acc, _: F.concat(acc, one))
    return parts.select("sequence_id", "length", padded.alias("padded"), F.concat(body, pad).alias("ids"))
