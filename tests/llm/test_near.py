"""Near-duplicates, passages and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from phenogrid.llm import graph, near_dedup, passages
from phenogrid.llm.common import stored
from phenogrid.llm.queries import QUERIES
from phenogrid.llm.shingles import shingle_set

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets_of(texts, size):
    out = {}
    for doc_id, text in texts.items():
        words = WORD.findall((text or "").encode().lower())
        out[doc_id] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}
    return out


def brute(texts, size, percent=80):
    sets, holders, parent = sets_of(texts, size), defaultdict(list), {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc_id in sorted(sets):
        counts = Counter(e for s in sets[doc_id] for e in holders[s])
        for other, n in counts.items():
            if 100 * n >= percent * (len(sets[doc_id]) + len(sets[other]) - n):
                a, b = sorted((root(doc_id), root(other)))
                parent[b] = a
        for s in sets[doc_id]:
            holders[s].append(doc_id)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in texts}


def answer(docs, **settings):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, **settings).collect()}


def test_documents(spark, sf_dir, texts):
    rows = QUERIES["op4_near_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute(texts, 4) and len(rows) == len(texts)


def test_a_large_group_of_edited_copies(spark):
    """Links near the threshold, a group far larger than a bucket's trials, and chains."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9999)}"
        texts[i] = " ".join(words)
    for i in range(150, 200):
        texts[i] = " ".join(f"u{rng.randrange(50)}" for _ in range(40))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert answer(docs, size=4) == brute(texts, 4)


def test_buckets_in_many_lanes(spark, monkeypatch):
    """A group whose members are mostly too different to link, so that its buckets are compared in tiles."""
    monkeypatch.setattr(near_dedup, "LANE", 15)
    monkeypatch.setattr(near_dedup, "PAIRED", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(2, 4)):
            words[rng.randrange(len(words))] = f"v{i}x{rng.randrange(9)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts, 4)
    assert answer(docs, size=4) == want and len({c for _, c, _ in want.values()}) > 5


def test_odd_rows(odd, empty):
    rows = near_dedup.near_duplicates(odd, size=4).collect()
    assert len(rows) == odd.count()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert got[3] == {(0, 3, True)} and got[5] == {(3, 5, True)} and got[7] == {(4, 7, True)} and got[8] == {(1, 8, True)}
    assert got[None] == {(3, 5, False), (0, None, True)}
    assert near_dedup.drop_near_duplicates(odd).columns == odd.columns
    assert near_dedup.near_duplicates(empty).count() == 0


def test_repeated_ids_with_different_texts_and_copies_without_ids(spark):
    rng = random.Random(5)
    some = lambda: [f"x{rng.randrange(10**9)}" for _ in range(80)]
    text, edited = (lambda words: " ".join(words)), (lambda words, k: " ".join([*words[:-1], f"e{k}"]))
    one, two, three, four = some(), some(), some(), some()
    rows = [(3, text(one)), (7, edited(one, 1)), (7, text(two)), (9, edited(two, 2)), (None, edited(two, 3))]
    rows += [(7, text(three)), (8, edited(three, 4)), *((None, edited(four, k)) for k in range(5)), (None, None), (None, None)]
    for part in (rows, [r for r in rows if r[0] != 7]):
        docs = spark.createDataFrame(part, "doc_id long, text string").repartition(3)
        kept = [(r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs).collect()]
        four_kept = [r for r in kept if r[0] is None and r[1] and r[1].startswith(four[0])]
        assert len(four_kept) == 1 and kept.count((None, None)) == 2
        want = {(3, text(one)), (7, text(two)), (7, text(three))} if part is rows else {(3, text(one)), (9, edited(two, 2)), (8, edited(three, 4))}
        assert {r for r in kept if r[0] is not None} == want and len(kept) == 6
    judged = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows[:5], "doc_id long, text string")).collect()}
    assert judged == {(3, 3, True), (7, 3, False), (7, 7, True), (9, 7, False), (None, 7, False)}


def test_estimate_is_unbiased():
    bands, rng = near_dedup.Bands(groups=40, rows=5), np.random.default_rng(1)
    numbers = rng.integers(0, 1 << 63, 1000, np.uint64)
    one, two = numbers[:900], numbers[100:]
    multipliers, masks = bands.permutations()
    (a, b), (c, d) = near_dedup.min_max(one, multipliers, masks), near_dedup.min_max(two, multipliers, masks)
    assert abs(np.mean(np.concatenate([a == c, b == d])) - 0.8) < 0.06


def test_shingles_of_short_texts():
    assert len(shingle_set("A b", 4)) == 1 and (shingle_set("A b", 4) == shingle_set(" a  B ", 4)).all()
    assert len(shingle_set(None, 4)) == 0 and len(shingle_set("a b c d e", 4)) == 2 and len(shingle_set("a a a a a a", 4)) == 1


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(300, 299), (300, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 7} | {k: 7 for k in range(200, 260)} | {299: 299, 300: 299}


def test_compact_windows_cover_every_stretch_once():
    rng = np.random.default_rng(4)
    for n, top in ((60, 1 << 60), (60, 4), (9, 2)):
        values, least = rng.integers(0, top, n, np.uint64), 5
        windows = passages.compact_windows(values, least)
        for i in range(n):
            for j in range(i + least - 1, n):
                inside = [w for w in windows if w[0] <= i <= w[1] <= j <= w[2]]
                assert len(inside) == 1 and values[inside[0][1]] == values[i : j + 1].min()


def repeats(texts, n=51):
    """Documents with a run of n words that another document has too."""
    seen, out = {}, set()
    for doc_id, text in texts.items():
        words = WORD.findall((text or "").encode().lower())
        for i in range(len(words) - n + 1):
            other = seen.setdefault(tuple(words[i : i + n]), doc_id)
            if other != doc_id:
                out |= {doc_id, other}
    return out


def test_passages(spark, sf_dir, texts):
    rows = QUERIES["op8_repeated_passages"](spark, sf_dir).collect()
    found = {r.doc_id for r in rows} | {r.first_id for r in rows}
    assert repeats(texts) <= found
    for r in rows:
        parts = [" ".join(texts[d].encode().lower().decode().split()[a:b]) for d, a, b in ((r.doc_id, r.start, r.end), (r.first_id, r.first_start, r.first_end))]
        one, two = (sets_of({0: p}, 5)[0] for p in parts)
        assert r.end - r.start >= 50 and len(one & two) >= 0.8 * len(one | two) and r.first_id < r.doc_id


def test_passages_in_hot_and_clean_documents(spark):
    rng = random.Random(6)
    word = lambda: f"x{rng.randrange(5000)}"
    shared = [f"s{i}" for i in range(60)]
    texts = {i: " ".join([word() for _ in range(80)] + (shared if i < 120 else []) + [word() for _ in range(80)]) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in rows} == set(range(1, 120)) and {r.first_id for r in rows} == {0}
    assert all(r.start <= 80 and r.end >= 140 and r.end - r.start < 70 for r in rows)


def test_passages_of_pairs_that_share_one_hash_function(spark):
    """Near copies of one window at similarity 0.8 or a little more: every pair that shares a window is verified."""
    rng, texts, sure = random.Random(12), {}, set()
    for i in range(1200):
        words = [f"p{i}x{k}" for k in range(55)]
        edited = list(words)
        edited[26] = f"q{i}"  # five of 51 shingles: similarity 46 / 56
        for d, part in ((2 * i, words), (2 * i + 1, edited)):
            texts[d] = " ".join([f"r{rng.randrange(10**9)}" for _ in range(30)] + part)
        keys = [set(next(passages._windows(iter([pd.DataFrame({"node": [d], "text": [texts[d]]})]), 46, passages.HASHES))["key"]) for d in (2 * i, 2 * i + 1)]
        if len({k & 7 for k in keys[0] & keys[1]}) == 1:
            sure.add(2 * i + 1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id for r in passages.repeated_passages(docs).collect()}
    assert sure and sure <= found


def test_runs_of_windows_and_regions():
    """Stretches of a window come from those of its text by one cut, and make the same marks again."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        marked = rng.random(rng.integers(0, 60)) < rng.choice([0, 0.2, 0.8, 1])
        at, lo = int(rng.integers(0, 1000)), int(rng.integers(0, len(marked) + 1))
        n = int(rng.integers(0, len(marked) - lo + 1))
        runs = passages.runs_of(marked, at)
        assert [i for r in runs for i in range(r >> 32, (r & 0xFFFFFFFF) + 1)] == [i + at for i in np.flatnonzero(marked)]
        assert (passages.inside(np.array(runs, np.int64), at + lo, n) == marked[lo : lo + n]).all()
        spans = [(k % 3, a, a + int(rng.integers(0, 9))) for k, a in enumerate(rng.integers(0, 60, rng.integers(0, 9)).tolist())]
        covered = {i for _, a, b in spans for i in range(a, b + 1)}
        assert {i for a, b in passages.regions(spans, 1) for i in range(a, b)} == covered
        assert all(b < c for (_, b), (c, _) in zip(passages.regions(spans, 1), passages.regions(spans, 1)[1:], strict=False))


def smallest_place(values, lo, hi, twice):
    """The place in [lo, hi] of the smallest value below TOP; of equal ones that next to half of ``twice``."""
    return min(((values[i], abs(2 * i - twice), i) for i in range(lo, hi + 1) if values[i] != passages.TOP), default=(None,) * 3)[2]


def test_compact_windows_meet_few_places():
    """Windows are found among the places that can hold the smallest value of a stretch, and are those of the whole text."""
    rng = np.random.default_rng(8)
    for top in (1 << 60, 40, 2):
        values, least, want = rng.integers(0, top, 3000, np.uint64), 46, set()
        bounds = np.array([0, 700, 720, 3000])
        parts = list(zip(bounds[:-1].tolist(), (bounds[1:] - 1).tolist(), strict=True))
        while parts:
            lo, hi = parts.pop()
            if hi - lo + 1 >= least:
                c = smallest_place(values, lo, hi, lo + hi + 1)
                want.add((lo, c, hi))
                parts += [(lo, c - 1), (c + 1, hi)]
        assert set(map(tuple, passages.compact_windows(values, least, bounds).tolist())) == want
        places = set(passages.low_places(values, least).tolist())
        assert {c for _, c, _ in want} <= places and (top < 1 << 60 or len(places) < len(values) / 8)


def remade(right, hits, passed, at, function, span, need, gone, least):
    """Rows of one window without the first document, place by place."""
    k, top = function & 7, int(passages.TOP)
    key = lambda value: int(passages.key_of(np.array([value], np.uint64), k)[0])
    values = passages.hashed(right, k).tolist()
    lo, hi = (span >> 32) - at, (span & 0xFFFFFFFF) - at
    for run in gone or ():
        for i in range((run >> 32) - at, (run & 0xFFFFFFFF) - at + 1):
            values[i] = top
    around = None if need < 0 else ((need >> 32) - at, (need & 0xFFFFFFFF) - at)
    pack = lambda a, b: (a + at) << 32 | (b + at)
    runs = lambda v: passages.runs_of(np.array([x == top for x in v[lo : hi + 1]]), lo + at)
    c = smallest_place(values, lo, hi, sum(around) if around else lo + hi)
    old, settled = key(values[c]), any(s <= c < e - passages.SHINGLE + 1 for s, e in passed)
    wide = (min(around[0], c), max(around[1], c)) if around else (c, c)
    rest, out, (a, b) = [top if hit else v for v, hit in zip(values, hits, strict=True)], [], (lo, hi)
    while b - a + 1 >= least:
        m = smallest_place(rest, a, b, sum(wide))
        if m is None:
            return out + ([] if settled else [(old, settled, old, pack(a, b), need, runs(values))])
        out.append((old, settled, key(rest[m]), pack(a, b), pack(*wide), runs(rest)))
        if wide[0] <= m <= wide[1]:
            break
        a, b = (m + 1, b) if m < wide[0] else (a, m - 1)
    return out or ([] if settled else [(old, settled, None, None, None, None)])


def test_windows_are_remade_a_batch_at_a_time(monkeypatch):
    """Windows without the first document are those found one by one; a batch takes a few passes, however many windows it has."""
    rng, least, n = np.random.default_rng(13), 46, 0
    words = lambda n, top: [b"w%d" % i for i in rng.integers(0, top, n)]
    first, rows = words(400, 10**9), []
    rows.append((1, None, 0, None, None, None, None, b" ".join(first), 0))
    for node in range(2, 40):
        top, a = (10**9, 60)[node % 2], int(rng.integers(0, 300))
        text, at = words(80, top) + first[a : a + int(rng.integers(20, 100))] + words(60, top), int(rng.integers(0, 1000))
        entries = []
        for _ in range(int(rng.integers(1, 40))):
            lo = int(rng.integers(0, len(text) - 54))
            hi = int(rng.integers(lo + 49, len(text) - 4))
            mid = lo + (hi - lo) // 2
            need = [-1, at + mid << 32 | at + mid + 2][int(rng.integers(0, 2))]
            gone = [None, [], [at + lo - min(lo, 3) << 32 | at + lo + 2, at + mid + 5 << 32 | at + mid + 7, at + hi << 32 | at + hi]][int(rng.integers(0, 3))]
            entries.append((int(rng.integers(0, 5)) | (0, passages.MORE)[rng.random() < 0.9], at + lo << 32 | at + hi, need, gone))
        rows.append((1, node, 0, *map(list, zip(*entries, strict=True)), b" ".join(text), at))
    long = pa.int64()
    types = pa.schema(list(zip(passages.PARTS, [long, long, pa.int32(), pa.list_(pa.int32()), pa.list_(long), pa.list_(long), pa.list_(pa.list_(long)), pa.binary(), long], strict=True)))
    batch = pa.RecordBatch.from_pylist([dict(zip(passages.PARTS, r, strict=True)) for r in rows], types)
    calls, real = [], passages.low_places
    monkeypatch.setattr(passages, "low_places", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(passages, "LAID", 5000)
    out = [r for b in passages._verify(iter([batch]), least, 80, 1) for r in b.to_pylist()]
    got, want, left = [], [], passages.sequences_of([rows[0][7]], 5)[0]
    for _, node, _, functions, spans, needs, gones, text, at in rows[1:]:
        right = passages.sequences_of([text], 5)[0]
        passed = [(r["start"] - at, r["end"] - at) for r in out if r["old"] is None and r["node"] == node]
        for entry in zip(functions, spans, needs, gones, strict=True):
            if entry[0] & passages.MORE:
                n += 1
                want += [(node, *r) for r in remade(right, np.isin(right, left), passed, at, *entry, least)]
        got += [tuple(r[c] for c in ("node", "old", "settled", "key", "span", "need", "gone")) for r in out if r["old"] is not None and r["node"] == node]
    assert any(r["old"] is None for r in out) and sorted(map(repr, got)) == sorted(map(repr, want))
    assert len(calls) < n / 4


def test_passages_whose_first_document_fails(spark):
    """B and C repeat a passage word for word; an earlier A has a part of it that is too short, or all of it out of order."""
    rng, texts = random.Random(21), {}
    word = lambda: f"x{rng.randrange(10**9)}"
    some = lambda n: [word() for _ in range(n)]
    for i in range(40):
        line, rest = some(49), some(9)
        texts[5 * i] = " ".join(some(40) + line + some(40))
        for k in (1, 2, 3):
            texts[5 * i + k] = " ".join(some(40) + (line + rest if k > 1 else line) + some(40))
        texts[5 * i + 4] = " ".join(some(30))
    halves = some(100)
    torn = [" ".join(some(20) + halves[lo : lo + 45] + some(20)) for lo in range(0, 60, 5)]
    texts[1000] = " ".join(torn)
    texts[1001], texts[1002] = (" ".join(some(20) + halves + some(20)) for _ in range(2))
    texts[1003] = " ".join(some(20) + halves + some(20))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {(r.first_id, r.doc_id): (r.start, r.end) for r in passages.repeated_passages(docs).collect()}
    want = {(5 * i + 2, 5 * i + 3) for i in range(40)} | {(1001, 1002), (1001, 1003)}
    assert set(rows) == want and all(rows[5 * i + 2, 5 * i + 3] == (40, 98) for i in range(40)) and rows[1001, 1002] == (20, 120)


def test_passages_of_copies(spark):
    """A copy is reported whole, and with the passage its like shares with an earlier document."""
    rng = random.Random(2)
    word = lambda: f"x{rng.randrange(10**6)}"
    shared = [word() for _ in range(70)]
    text = " ".join([word() for _ in range(60)] + shared)
    docs = spark.createDataFrame([(1, " ".join(shared + [word() for _ in range(60)])), (2, text), (3, text.upper()), (None, text)], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end, r.first_id) for r in passages.repeated_passages(docs).collect()}
    assert got == {(2, 60, 130, 1), (3, 60, 130, 1), (None, 60, 130, 1), (3, 0, 130, 2), (None, 0, 130, 2)}


def test_passages_odd_rows(odd, empty):
    assert passages.repeated_passages(odd).count() == 0
    assert passages.repeated_passages(empty).count() == 0
    twice = odd.where("doc_id = 8").selectExpr("doc_id", "text").union(odd.where("doc_id = 8").selectExpr("null", "text"))
    assert [(r.doc_id, r.start, r.end, r.first_id) for r in passages.repeated_passages(twice).collect()] == [(None, 0, 60_000, 8)]


@pytest.fixture(scope="module")
def stages(spark, documents):
    docs, out = documents, []
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, ""), f"test-{name}")
        out.append((name, docs, result))
        docs = result
    return out


def test_pipeline_stages(stages, documents):
    kept = {name: (before, after) for name, before, after in stages}
    assert all(after.columns == documents.columns for name, (_, after) in kept.items() if name != "packing")
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    words = lambda frame: {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    before, after = kept["language_id"]
    assert len(ids(after)) >= 0.97 * len(ids(before))
    before, after = kept["exact_dedup"]
    first = {}
    for doc_id, text in sorted(words(before).items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), doc_id)
    assert ids(after) == set(first.values())
    before, after = kept["near_dedup"]
    assert ids(after) == {d for d, (_, _, stays) in brute(words(before), 5).items() if stays}
    before, after = kept["secret_scan"]
    assert ids(after) == ids(before)
    assert all(new == old or "[SECRET]" in new for new, old in zip((words(after)[d] for d in ids(after)), (words(before)[d] for d in ids(after)), strict=True))
    before, after = kept["packing"]
    assert ids(after) == ids(before)


def test_pipeline_odd_and_empty(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, ""), "odd")
        assert docs.columns[0] == "doc_id"
    assert docs.count() == 0
