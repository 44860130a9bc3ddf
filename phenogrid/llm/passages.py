"""Passages that repeat across documents, by compact windows.

A text is the sequence of its five-word shingles. Under a hash function, the smallest value of a stretch stands for all of
its subsequences that contain it: one compact window (l, c, r) says that every subsequence from within [l, c] to within
[c, r] has the min-hash found at c. Splitting at c again and again (a Cartesian tree, as deep as stretches stay long enough)
covers all subsequences of at least the wanted length with about 2n / length windows. A passage that stands in two texts
gives both a window with the same value under every hash function, a near copy under most.

Texts of equal words are one class: only the first has windows, the others are reported as copies of it and with what it
shares with documents before it.

Windows with equal values meet in a star: the first document that has the value against each other one, so a passage of
any number of documents gives as many pairs. If one of them fails verification, the others of the value meet again without
the first: their windows are made anew over the shingles that the first lacks, so what two of them share beyond it gives
them a common value. This is repeated until no value is left that fails; each round is a star over what is left. The windows' intervals of a pair that enough hash functions share are joined
into regions, and the words inside decide: a passage is reported if it is long enough and its shingle set is at least 80
percent similar to that of the passage in the first document.

Edge cases: texts with fewer words than a passage, empty and null ones have no windows. A passage that repeats only inside
one document is not reported. Rows without doc_id take part and are reported as null. Rows that repeat a doc_id are one
document. Very long texts are windowed whole; ties between equal shingles split near the middle, so no text nests deeply.
Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import LAST_NODE, discard, nodes, salt_of, salted_groups, ship, stored
from phenogrid.llm.shingles import lowered, mixed, sequences_of, word_spans, words_of

SHINGLE = 5

#: Hash functions, and how many of them must share windows around a place.
HASHES, ENOUGH = 5, 1

FOUND = "node long, start long, end long, first_node long, first_start long, first_end long, similarity double"

#: What verification returns beside passages: members of a value, whether they were found, and their windows without the first.
AGAIN = "old long, settled boolean, key long, span long, need long, gone array<long>"

#: A window that may be made anew: its value has more than two members.
MORE = 8

ENTRIES = "functions array<int>, spans array<long>, needs array<long>, gones array<array<long>>"
PARTS = ["first_node", "node", "salt", "functions", "spans", "needs", "gones", "part", "at"]


#: Above every hash, for places that take no part.
TOP = np.uint64((1 << 64) - 1)


def low_places(values: np.ndarray, least: int) -> np.ndarray:
    """Places that may hold the smallest value of a stretch of ``least`` values or more: those that are smallest from there
    over half of such a stretch, forwards or backwards, as every stretch around a place has half of ``least`` on one side."""
    n, half = len(values), least // 2
    low, size = np.concatenate([values, np.full(half, TOP)]), 1
    while size <= half:
        step = min(size, half + 1 - size)
        low, size = np.minimum(low[:-step], low[step:]), size + step
    may = values == low
    if half < n:
        may[half:] |= values[half:] == low[: n - half]
    return np.flatnonzero(may)


def lowest(places: np.ndarray, padded: np.ndarray, lo: np.ndarray, hi: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """For each stretch [lo, hi) the one of some places with the smallest value, -1 if it has none.

    ``padded`` are the values of the places, and TOP. Of equal ones it is that next to half of ``twice``, the first of two
    that are as near.
    """
    out = np.full(len(lo), -1)
    first, end = np.searchsorted(places, lo), np.searchsorted(places, hi)
    some = np.flatnonzero(first < end)
    if not len(some):
        return out
    first, end = first[some], end[some]
    low = np.minimum.reduceat(padded, np.stack([first, end], axis=1).ravel())[::2]
    of, at = spread(first, end)
    equal = np.flatnonzero(padded[at] == low[of])
    c, of = places[at[equal]], of[equal]
    if len(c) > len(some):
        order = np.lexsort((c, np.abs(2 * c - twice[some][of]), of))
        c = c[order][np.searchsorted(of, np.arange(len(some)))]
    out[some] = c
    return out


def spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some stretches [first, end), one stretch after the other, and which stretch each is of."""
    sizes = end - first
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) + (first - (np.cumsum(sizes) - sizes))[of]


def compact_windows(values: np.ndarray, least: int, bounds: np.ndarray | None = None) -> np.ndarray:
    """Windows (l, c, r), a row each, that cover every subsequence of at least ``least`` values of each text.

    ``bounds`` are where the texts meet that ``values`` holds one after the other. All stretches of a depth of the tree are
    split at once.
    """
    bounds = np.array([0, len(values)]) if bounds is None else bounds
    lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    places, out = low_places(values, least), [np.zeros((0, 3), np.int64)]
    padded = np.append(values[places], TOP)
    while True:
        long = hi - lo >= least
        lo, hi = lo[long], hi[long]
        if not len(lo):
            return np.concatenate(out)
        c = lowest(places, padded, lo, hi, lo + hi)
        out.append(np.stack([lo, c, hi - 1], axis=1))
        lo, hi = np.stack([lo, c + 1], axis=1).ravel(), np.stack([c, hi], axis=1).ravel()


#: What the hash functions differ by, more of them than are ever used.
_SALTS = np.array([0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1 for k in range(8)], np.uint64)


def hashed(sequence: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Values of a function; of several, a row each."""
    return mixed(sequence ^ _SALTS[k])


def key_of(values: np.ndarray, k: int) -> np.ndarray:
    return (values & ~np.uint64(7) | np.uint64(k)).view(np.int64)


def _windows(batches: Iterator[pd.DataFrame], least: int, hashes: int) -> Iterator[pd.DataFrame]:
    """key (hash function in its low bits), node, span (l and r)."""
    for batch in batches:
        # Every node that gets here has the words of a passage.
        sequences = sequences_of([lowered(text) for text in batch["text"]], SHINGLE)
        nodes_, every = batch["node"].to_numpy(np.int64), np.concatenate([np.zeros(0, np.uint64), *sequences])
        bounds = np.cumsum([0, *(len(s) for s in sequences)])
        del sequences
        for k in range(hashes if len(nodes_) else 0):
            values = hashed(every, k)
            found = compact_windows(values, least, bounds)
            text = np.searchsorted(bounds, found[:, 0], side="right") - 1
            at = bounds[text]
            yield pd.DataFrame({"key": key_of(values[found[:, 1]], k), "node": nodes_[text], "span": (found[:, 0] - at) << 32 | (found[:, 2] - at)})


def regions(spans: list[tuple[int, int, int]], enough: int) -> list[tuple[int, int]]:
    """Stretches that windows (hash function, l, r) of enough different functions cover."""
    if enough <= 1:
        out = []
        for lo, hi in sorted((lo, hi) for _, lo, hi in spans):
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], hi + 1))
            else:
                out.append((lo, hi + 1))
        return out
    events = sorted([(lo, 0, k) for k, lo, _ in spans] + [(hi + 1, 1, k) for k, _, hi in spans])
    depth: dict[int, int] = {}
    out, start = [], None
    for at, kind, k in events:
        depth[k] = depth.get(k, 0) + (1 if kind == 0 else -1)
        covered = sum(n > 0 for n in depth.values()) >= enough
        if covered and start is None:
            start = at
        elif not covered and start is not None:
            if out and out[-1][1] == start:
                start = out.pop()[0]
            out.append((start, at))
            start = None
    return out


def edges_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of marked places: where each starts and where it ends (exclusive)."""
    padded = np.zeros(len(marked) + 2, bool)
    padded[1:-1] = marked
    edges = (padded[1:] != padded[:-1]).nonzero()[0]
    return edges[::2], edges[1::2]


def dense(hits: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Maximal stretches that start and end with a hit and keep at least ``share`` hits, also seen from either end."""
    found: list[list] = []  # start, end, sum before, sum after
    total = 0.0
    starts, ends = edges_of(hits)
    last = 0
    if share >= 1:
        return list(zip(starts.tolist(), ends.tolist(), strict=True))
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        before = total - share * (lo - last)
        total = before + (1 - share) * (hi - lo)
        last = hi
        run = [lo, hi, before, total]
        while True:
            left = next((k for k in range(len(found) - 1, -1, -1) if found[k][2] < run[2]), None)
            if left is None or found[left][3] >= run[3]:
                found.append(run)
                break
            run = [found[left][0], run[1], found[left][2], run[3]]
            del found[left:]
    return [(lo, hi) for lo, hi, _, _ in found]


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order; sorting is faster than the hash table of ``np.unique`` for few values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class First:
    """The shingles of a first document, sorted once for all its pairs."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.order = np.argsort(values, kind="stable")
        self.sorted = values[self.order]

    def has(self, others: np.ndarray) -> np.ndarray:
        """Which of the others it has."""
        if not len(self.sorted):
            return np.zeros(len(others), bool)
        return self.sorted[np.minimum(np.searchsorted(self.sorted, others), len(self.sorted) - 1)] == others

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Which of its places hold one of some distinct shingles."""
        lo, hi = np.searchsorted(self.sorted, wanted), np.searchsorted(self.sorted, wanted, side="right")
        sizes = hi - lo
        out = np.zeros(len(self.values), bool)
        out[self.order[np.arange(sizes.sum()) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)]] = True
        return out


def compare(left: First, right: np.ndarray, hits: np.ndarray, areas: list[tuple[int, int]], least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Passages of ``right`` inside the areas with their like in ``left``: start, end, first start, first end (in words), similarity.

    ``hits`` are the places of ``right`` that ``left`` has. A stretch that is dense enough in them but not similar enough as
    a whole is searched for denser ones, at last for runs without a miss.
    """
    out = []
    shares = [percent / 100, (100 + percent) / 200, 1.0]
    open_parts = [(lo, hi, 0) for lo, hi in areas]
    while open_parts:
        lo, hi, level = open_parts.pop()
        share = shares[level]
        for a, b in dense(hits[lo:hi], share):
            if b - a < least:
                continue
            passage = distinct(right[lo + a : lo + b])
            best = None
            for x, y in dense(left.places(passage), share):
                if y - x < least:
                    continue
                other = distinct(left.values[x:y])
                shared = len(np.intersect1d(passage, other, assume_unique=True))
                similarity = shared / (len(passage) + len(other) - shared)
                if similarity >= shares[0] and (best is None or similarity > best[2]):
                    best = (x, y, similarity)
            if best:
                out.append((lo + a, lo + b + SHINGLE - 1, best[0], best[1] + SHINGLE - 1, best[2]))
            elif level + 1 < len(shares):
                open_parts.append((lo + a, lo + b, level + 1))
    return sorted(out)


def lists_of(column: pa.ListArray) -> list[np.ndarray]:
    """Numbers of each list of a column; a list that is null has none."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Entries of a column of lists, and the row of each; a list that is null has none."""
    ends = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(ends)), column.values.slice(ends[0], ends[-1] - ends[0])


def runs_in(marked: np.ndarray, lo: np.ndarray, hi: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of marked places in each of some windows [lo, hi], first and last plus ``add`` in one number, and how many."""
    starts, ends = edges_of(marked)
    first, end = np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi, side="right")
    of, run = spread(first, np.maximum(first, end))
    a, b = np.maximum(starts[run], lo[of]) + add[of], np.minimum(ends[run] - 1, hi[of]) + add[of]
    return a << 32 | b, np.bincount(of, minlength=len(lo))


def runs_of(marked: np.ndarray, at: int) -> list[int]:
    """Stretches of marked places, first and last in one number."""
    return runs_in(marked, np.array([0]), np.array([len(marked) - 1]), np.array([at]))[0].tolist()


def inside(runs: np.ndarray, at: int, n: int) -> np.ndarray:
    """Which of ``n`` places from ``at`` on lie in one of some stretches as ``runs_of`` gives them."""
    starts, ends = np.maximum((runs >> 32) - at, 0), np.minimum((runs & 0xFFFFFFFF) + (1 - at), n)
    met = starts < ends
    steps = np.zeros(n + 1, np.int8)
    steps[starts[met]] += 1
    steps[ends[met]] -= 1
    return np.cumsum(steps[:n], dtype=np.int8).view(bool)


def windows_without(rest: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: tuple[np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (of, l, c, r), smallest values below TOP, that cover every subsequence of each stretch [lo, hi] around its
    ``need`` of ``least`` values, and the stretches (of, l, r) in which such a subsequence has no such value."""
    places = low_places(rest, least)
    places = places[rest[places] != TOP]
    padded, of = np.append(rest[places], TOP), np.arange(len(lo))
    made, same = [np.zeros((0, 4), np.int64)], [np.zeros((0, 3), np.int64)]
    low, high = need
    while True:
        long = hi - lo + 1 >= least
        lo, hi, low, high, of = lo[long], hi[long], low[long], high[long], of[long]
        if not len(of):
            return np.concatenate(made), np.concatenate(same)
        c = lowest(places, padded, lo, hi + 1, low + high)
        none = c < 0
        same.append(np.stack([of, lo, hi], axis=1)[none])
        made.append(np.stack([of, lo, c, hi], axis=1)[~none])
        left, right = ~none & (c < low), ~none & (c > high)
        more = left | right
        lo, hi, low, high, of = np.where(left, c + 1, lo)[more], np.where(right, c - 1, hi)[more], low[more], high[more], of[more]


#: Places of windows with marks of their own that are laid out at once, or one window.
LAID = 1 << 19


class Again:
    """Rows of AGAIN of a batch: the windows of its pairs, made anew over the shingles that the first document lacks.

    The texts of the batch lie one after the other, a place that takes no part between them; windows with marks of their own,
    which earlier rounds left, are laid out in the same way. All windows of a function are remade at once. A member that wasn't
    found although the first has all of a stretch's shingles, elsewhere, keeps its value there.
    """

    def __init__(self, batch: pa.RecordBatch, sequences: list[np.ndarray], hits: list[np.ndarray | None], passed: list[list], least: int):
        self.least, self.columns = least, []
        row, functions = flat(batch.column("functions"))
        functions, spans, needs = (c.to_numpy(zero_copy_only=False) for c in (functions, *(flat(batch.column(c))[1] for c in ("spans", "needs"))))
        more = np.flatnonzero(functions & MORE)
        if not len(more):
            return
        # Only texts with such windows are laid out.
        rows, which = np.unique(row[more], return_inverse=True)
        rows = rows.tolist()
        bases = np.cumsum([0, *(len(sequences[i]) + 1 for i in rows)])
        every, lost, found = np.zeros(bases[-1], np.uint64), np.zeros(bases[-1], bool), np.zeros(bases[-1], bool)
        for base, i in zip(bases.tolist(), rows, strict=False):
            every[base : base + len(sequences[i])] = sequences[i]
            lost[base : base + len(sequences[i])] = hits[i]
            for start, end in passed[i]:
                found[base + start : base + end - SHINGLE + 1] = True
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        at = column("at")[rows].astype(np.int64)
        base, node = (bases[:-1] - at)[which], column("node")[rows].astype(np.int64)[which]
        functions, spans, needs = functions[more] & 7, spans[more].astype(np.int64), needs[more].astype(np.int64)
        lo, hi = (spans >> 32) + base, (spans & 0xFFFFFFFF) + base
        need = np.where(needs < 0, -1, (needs >> 32) + base), np.where(needs < 0, -1, (needs & 0xFFFFFFFF) + base)
        gone = flat(batch.column("gones"))[1].take(pa.array(more))
        of, runs = flat(gone)
        runs, own = runs.to_numpy(zero_copy_only=False), gone.is_valid().to_numpy(zero_copy_only=False)
        gaps, nothing = bases[1:] - 1, np.zeros(len(every), bool)
        for k in np.unique(functions).tolist():
            values = hashed(every, k)
            values[gaps] = TOP
            plain = np.flatnonzero((functions == k) & ~own)
            if len(plain):
                self.add(k, node[plain], values, lost, nothing, found, lo[plain], hi[plain], (need[0][plain], need[1][plain]), base[plain])
            chosen = np.flatnonzero((functions == k) & own)
            sizes = hi[chosen] - lo[chosen] + 2
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // LAID)) + 1
            for part in np.split(chosen, cuts) if len(chosen) else ():
                sizes = hi[part] - lo[part] + 2
                starts = np.cumsum(sizes) - sizes
                shift = starts - lo[part]
                _, place = spread(lo[part], hi[part] + 2)
                place[starts + sizes - 1] = gaps[0]
                laid = values[place]
                # The stretches of each window that earlier rounds took, as far as they lie in it.
                index = np.full(len(own), -1)
                index[part] = np.arange(len(part))
                mine = np.flatnonzero(index[of] >= 0)
                to = index[of[mine]]
                a = np.maximum((runs[mine] >> 32) + base[part][to], lo[part][to])
                b = np.minimum((runs[mine] & 0xFFFFFFFF) + base[part][to], hi[part][to])
                met = a <= b
                before = inside(((a + shift[to]) << 32 | (b + shift[to]))[met], 0, len(laid))
                laid[before] = TOP
                moved = tuple(np.where(n[part] < 0, -1, n[part] + shift) for n in need)
                self.add(k, node[part], laid, lost[place] | before, before, found[place], lo[part] + shift, hi[part] + shift, moved, base[part] + shift)

    def add(self, k: int, node: np.ndarray, values: np.ndarray, lost: np.ndarray, before: np.ndarray, found: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: tuple[np.ndarray, np.ndarray], base: np.ndarray) -> None:
        """Rows for windows [lo, hi] of a function over some places: those ``lost`` to the first document, now or ``before``,
        and those in passages that were found. A place less ``base`` is the word of its text."""
        free = need[0] < 0
        places = low_places(values, self.least)
        c = lowest(places, np.append(values[places], TOP), lo, hi + 1, np.where(free, lo + hi, need[0] + need[1]))
        old, settled = key_of(values[c], k), found[c]
        around = np.where(free, c, np.minimum(need[0], c)), np.where(free, c, np.maximum(need[1], c))
        rest = np.where(lost, TOP, values)
        made, same = windows_without(rest, lo, hi, around, self.least)
        pack = lambda a, b, i: (a - base[i]) << 32 | (b - base[i])
        i, a, m, b = made.T
        runs, sizes = runs_in(lost, lo, hi, -base)
        self._rows(node[i], old[i], settled[i], key_of(rest[m], k), pack(a, b, i), pack(around[0][i], around[1][i], i), runs, sizes, i)
        i, a, b = same[~settled[same[:, 0]]].T
        runs, sizes = runs_in(before, lo, hi, -base)
        self._rows(node[i], old[i], settled[i], old[i], pack(a, b, i), np.where(free[i], -1, pack(need[0][i], need[1][i], i)), runs, sizes, i)
        bare = ~settled
        bare[made[:, 0]] = bare[same[:, 0]] = False
        i = np.flatnonzero(bare)
        self._rows(node[i], old[i], settled[i], None, None, None, runs, sizes, None)

    def _rows(self, node: np.ndarray, old: np.ndarray, settled: np.ndarray, key: np.ndarray | None, span: np.ndarray | None, need: np.ndarray | None, runs: np.ndarray, sizes: np.ndarray, of: np.ndarray | None) -> None:
        n = len(node)
        longs = [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (key, span, need)]
        if of is None:
            gone = pa.nulls(n, pa.list_(pa.int64()))
        else:
            ends = np.cumsum(sizes)
            _, at = spread((ends - sizes)[of], ends[of])
            gone = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[of])]), pa.int32()), pa.array(runs[at], pa.int64()))
        self.columns.append([pa.array(node, pa.int64()), pa.array(old, pa.int64()), pa.array(settled, pa.bool_()), *longs, gone])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for columns in self.columns:
            if len(columns[0]):
                yield _rows(dict(zip(("node", "old", "settled", "key", "span", "need", "gone"), columns, strict=True)), len(columns[0]))


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [words_of(text) for text in batch["text"]]
        yield pd.DataFrame({"node": batch["node"], "klass": [xxhash.xxh3_128_digest(b" ".join(w)) for w in texts], "words": [len(w) for w in texts]})


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with only that part of the later text that their windows span, and the word it begins at; first texts whole."""
    held, data, starts, ends = None, b"", [], []  # rows come in order of the node
    for batch in batches:
        parts, firsts, texts = [], [], batch.column("text")
        columns = (batch.column(c).to_pylist() for c in ("holder", "node"))
        for i, (node, of, spans) in enumerate(zip(*columns, lists_of(batch.column("spans")), strict=True)):
            if node != held:
                held, data = node, texts[i].as_py().lower()
                starts, ends = word_spans(data)
            if of is None:
                parts.append(data)
                firsts.append(0)
                continue
            lo, hi = int(spans.min() >> 32), int((spans & 0xFFFFFFFF).max())
            parts.append(data[starts[lo] : ends[min(hi + SHINGLE, len(ends)) - 1]])
            firsts.append(lo)
        made = {"part": pa.array(parts, pa.binary()), "at": pa.array(firsts, pa.int64())}
        yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in PARTS], PARTS)


#: Columns of what verification returns, passages and rows of AGAIN in one table.
VERIFIED = [c.split()[0] for c in f"{FOUND}, {AGAIN}".split(", ")]
VERIFIED_TYPES = pa.schema(list(zip(VERIFIED, [*[pa.int64()] * 6, pa.float64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.list_(pa.int64())], strict=True)))


def _rows(columns: dict[str, Sequence], n: int) -> pa.RecordBatch:
    """Rows of what verification returns, from some of its columns."""
    arrays = [pa.nulls(n, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in VERIFIED_TYPES]
    return pa.RecordBatch.from_arrays(arrays, schema=VERIFIED_TYPES)


def _verify(batches: Iterator[pa.RecordBatch], least: int, percent: int, enough: int) -> Iterator[pa.RecordBatch]:
    """Passages, and rows of AGAIN."""
    left = First(np.zeros(0, np.uint64))  # the first document's text comes before its pairs
    for batch in batches:
        found, hits, passed = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("first_node", "node", "at")]
        lists = [lists_of(batch.column(c)) for c in ("functions", "spans")]
        sequences = sequences_of(batch.column("part").to_pylist(), SHINGLE)
        for right, first_node, node, at, functions, spans in zip(sequences, *columns, *lists, strict=True):
            if node is None:
                left = First(right)
                hits.append(None)
                passed.append([])
                continue
            hits.append(left.has(right))
            places = zip((functions & 7).tolist(), ((spans >> 32) - at).tolist(), ((spans & 0xFFFFFFFF) - at).tolist(), strict=True)
            passages = compare(left, right, hits[-1], regions(list(places), enough), least, percent)
            passed.append([(s, e) for s, e, *_ in passages])
            found += [(node, at + s, at + e, first_node, fs, fe, sim) for s, e, fs, fe, sim in passages]
        yield _rows(dict(zip(VERIFIED[:7], zip(*found, strict=True), strict=True)) if found else {}, len(found))
        yield from Again(batch, sequences, hits, passed, least).batches()


def _first_reports(found: DataFrame, words: int, percent: int) -> DataFrame:
    """Without passages that are, but for less than a passage and the share that may differ, reported against an earlier document."""
    row = F.struct("first_node", "start", (-F.col("end")).alias("order"), "end", "first_start", "first_end", "similarity")
    by_node = found.groupBy("node").agg(F.sort_array(F.collect_set(row)).alias("all"))

    def known(kept: Column, r: Column) -> Column:
        length = r["end"] - r["start"]
        bare = lambda k: length - F.greatest(F.lit(0), F.least(k["end"], r["end"]) - F.greatest(k["start"], r["start"]))
        return F.exists(kept, lambda k: (bare(k) < words) & (100 * bare(k) <= (100 - percent) * length))

    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda kept, r: F.when(known(kept, r), kept).otherwise(F.array_append(kept, r)))
    return by_node.select("node", F.explode(kept).alias("r")).select("node", *(f"r.{c}" for c in found.columns if c != "node"))


def _texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One text per node, and its class. Texts are stored anew only if nodes repeat."""
    make = lambda texts: stored(texts.mapInPandas(_classes, "node long, klass binary, words long"), "classes")
    classes = make(rows)
    if classes.groupBy("node").count().where("count > 1").isEmpty():
        return rows, classes
    texts = stored(rows.groupBy("node").agg(F.min("text").alias("text")), "texts")
    return texts, make(texts)


def _copies(classes: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Later members of each class (node, first, salt, words), and the nodes that have windows."""
    classes = classes.where(F.col("words") >= words).withColumn("salt", salt_of("node"))
    groups = salted_groups(classes, ["klass"], F.col("node")).select("klass", "salt", "first")
    placed = stored(classes.join(groups.hint("merge"), ["klass", "salt"], "left").select("node", "salt", "words", "first"), "copies")
    return placed.where("first <> node"), placed.where("first IS NULL OR first = node").select("node")


def _with_copies(found: DataFrame, copies: DataFrame) -> DataFrame:
    """Passages of copies: the whole text, and those of the first of their class."""
    whole = copies.select("node", F.lit(0).cast("long").alias("start"), F.col("words").alias("end"), F.col("first").alias("first_node"), F.lit(0).cast("long").alias("first_start"), F.col("words").alias("first_end"), F.lit(1.0).alias("similarity"))
    parts = found.withColumnRenamed("node", "first").join(copies.select("first", "salt").distinct().hint("merge"), "first")
    same = copies.select("node", "first", "salt").join(parts.hint("merge"), ["first", "salt"]).select(*found.columns)
    return found.unionByName(whole).unionByName(same)


def _checked(pairs: DataFrame, texts: DataFrame, least: int, percent: int, enough: int) -> DataFrame:
    """Passages of the pairs, and rows of AGAIN, stored; the pairs go. A first document is handed out once per 64 or so of
    its pairs."""
    salted = pairs.withColumn("salt", salt_of("node"))
    many = salted_groups(salted, ["first_node"], F.col("node")).select("first_node", "salt", "n")
    parts = F.ceil(F.coalesce("n", F.lit(1)) / 64).cast("int")
    salted = salted.join(many.hint("merge"), ["first_node", "salt"], "left").withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("n")
    salted = stored(salted, "salted")
    discard(pairs)
    asked = salted.select(F.col("first_node").alias("holder"), "first_node", "salt").distinct()
    asked = salted.withColumn("holder", F.col("node")).unionByName(asked, allowMissingColumns=True)
    schema = f"first_node long, node long, salt int, {ENTRIES}, part binary, at long"
    both = asked.join(texts.withColumnRenamed("node", "holder").hint("merge"), "holder").select("holder", "first_node", "node", "salt", "functions", "spans", "needs", "gones", F.col("text").cast("binary").alias("text")).mapInArrow(_stretches, schema)
    dealt = both.repartition("first_node", "salt").sortWithinPartitions("first_node", "salt", F.col("node").asc_nulls_first())
    checked = stored(dealt.mapInArrow(lambda b: _verify(b, least, percent, enough), f"{FOUND}, {AGAIN}"), "checked")
    discard(salted)
    return checked


def _left_over(checked: DataFrame) -> DataFrame:
    """Windows without the first document, of values with a member that wasn't found."""
    rows = checked.where("old IS NOT NULL").withColumn("salt", salt_of("node"))
    failed = rows.groupBy("old", "salt").agg(F.min("settled").alias("settled"))
    failed = failed.groupBy("old").agg(F.min("settled").alias("settled"), F.collect_list("salt").alias("salts")).where("NOT settled")
    failed = failed.select("old", F.explode("salts").alias("salt"))
    return rows.where("key IS NOT NULL").join(failed.hint("merge"), ["old", "salt"]).select("key", "node", "span", "need", "gone")


def repeated_passages(docs: DataFrame, words: int = 50, percent: int = 80, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """One row per passage of ``words`` words or more that an earlier document (smaller doc_id) also has:
    doc_id, start, end (words, end exclusive), first_id, first_start, first_end, similarity."""
    if words < SHINGLE:
        raise ValueError(f"a passage has at least {SHINGLE} words")
    ship(docs.sparkSession)
    least = words - SHINGLE + 1
    texts, classes = _texts(nodes(docs).select("node", "text"))
    copies, own = _copies(classes, words)
    windows = stored(texts.join(own.hint("merge"), "node", "left_semi").mapInPandas(lambda b: _windows(b, least, hashes), "key long, node long, span long"), "windows")
    found, held = None, windows
    windows = windows.withColumns({"need": F.lit(-1).cast("long"), "gone": F.lit(None).cast("array<long>")})
    while True:
        members = F.count("*").alias("members")
        shared = stored(windows.groupBy("key").agg(F.min("node").alias("first_node"), F.max("node").alias("last"), members).where("first_node < last").drop("last"), "shared-keys")
        if found is not None and shared.isEmpty():
            break
        # A task holds the shared keys of its part, one row each; the windows, many times as many, needn't be sorted.
        met = windows.join(shared.hint("shuffle_hash"), "key").where("node <> first_node")
        function = (F.col("key").bitwiseAND(7) + F.when(F.col("members") > 2, F.lit(MORE)).otherwise(F.lit(0))).cast("int").alias("function")
        gather = F.collect_list if found is None else F.collect_set  # a text's first windows differ, remade ones may not
        pairs = met.groupBy("first_node", "node").agg(gather(F.struct(function, "span", "need", "gone")).alias("entries"))
        pairs = pairs.where(F.size(F.array_distinct(F.transform("entries.function", lambda f: f.bitwiseAND(7)))) >= enough)
        lists = [F.col(f"entries.{one}").alias(many) for one, many in (("function", "functions"), ("span", "spans"), ("need", "needs"), ("gone", "gones"))]
        pairs = stored(pairs.select("first_node", "node", *lists), "pairs")
        discard(held, shared)
        if found is not None:  # the texts of later rounds are among those of the pairs of this one
            asked = pairs.select("node").unionByName(pairs.select(F.col("first_node").alias("node"))).distinct()
            texts = stored(texts.join(asked.hint("merge"), "node", "left_semi"), "texts")
        checked = _checked(pairs, texts, least, percent, enough)
        passages = checked.where("old IS NULL").select(*(c.split()[0] for c in FOUND.split(", ")))
        found = passages if found is None else found.unionByName(passages)
        windows = held = stored(_left_over(checked), "windows")
    found = stored(_first_reports(found, words, percent), "passages")
    named = {c: F.when(F.col(c) <= LAST_NODE - (1 << 62), F.col(c)) for c in ("node", "first_node")}
    return _with_copies(found, copies).select(named["node"].alias("doc_id"), "start", "end", named["first_node"].alias("first_id"), "first_start", "first_end", "similarity")
