"""Token id files and packing: exact round trips against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from phenogrid.llm import elias_fano, id_files, packing
from phenogrid.llm.queries import QUERIES
from phenogrid.llm.tokens import Encoder, default_vocabulary, encoder
from phenogrid.session import new_path


def ids_of(text):
    return encoder(default_vocabulary()).tokenizer.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=700) | st.lists(st.integers(0, 50), max_size=700))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.uint64))
    code = elias_fano.EliasFano(elias_fano.encode(values))
    assert (code.all() == values).all()
    assert [code.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(elias_fano.encode(ends)) * 8 < 100_000 * (2.3 + np.log2(ends[-1] / 100_000))


def test_encoder_equals_library():
    rng = random.Random(4)
    bits = list("ab1 !'s\n\t\r\x1c\x85\xa0 é ") + ["<|endoftext|>", "  ", " a", "'re", "\n\n", "word"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        enc = encoder(default_vocabulary())
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == ids_of(text), repr(text)


def test_a_batch_looks_up_each_word_once(texts):
    enc, looked_up = Encoder(default_vocabulary(), remember=500), []
    inner = enc.words.look_up
    enc.words.look_up = lambda keys: looked_up.append(keys) or inner(keys)
    batches = [["one two, two. three", "three two one\ntwo", "", "!, one. two", "x" * 70 + " one"], list(texts.values())[:100], ["two one"]]
    for batch in batches:
        got = enc.encode_all(batch)
        assert [np.frombuffer(ids, enc.dtype).tolist() for ids in got] == [ids_of(text) for text in batch]
    assert len(looked_up) == len(batches) and all(len(set(keys)) == len(keys) for keys in looked_up)
    assert "x" * 70 not in enc.words.young | enc.words.old


def test_id_files(spark, sf_dir, texts):
    got = sorted(tuple(r) for r in QUERIES["op1_token_ids"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want, at = [], 0
    for doc_id in sorted(texts):
        ids = [*ids_of(texts[doc_id]), 0]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_id_files_odd_rows_and_select(spark, odd, empty):
    path = new_path(spark, "ids")
    id_files.write_ids(odd, path, segment_ids=20)
    rows = id_files.read_index(spark, path).orderBy("start").collect()
    source = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (doc_id, text) in zip(rows, source, strict=True):
        ids = [*ids_of(text), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), crc(ids))
        at += len(ids)
    for row in id_files.segments(spark, path).collect():
        segment = id_files.Segment(row)
        assert [d.tolist() for _, _, d in segment.documents()] == [segment.document(i).tolist() for i in range(row.n_docs)]
    path = new_path(spark, "ids")
    id_files.write_ids(empty, path)
    assert id_files.read_index(spark, path).count() == 0


def packed(texts, pieces, window):
    """Check the pieces of a packing of {doc_id: text}; returns tokens per sequence and queue."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for number, rows in sequences.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or (number == len(sequences) - 1 and at < window)
    assert set(documents) == set(texts)
    for doc_id, text in texts.items():
        ids, at = [*ids_of(text), 1], 0
        for r in sorted(documents[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    return sequences


def test_packing(spark, sf_dir, texts):
    packed(texts, QUERIES["op7_packing"](spark, sf_dir).collect(), 2048)


@pytest.mark.parametrize(("window", "windows"), [(256, 2), (64, 40), (1024, 1)])
def test_mixture_of_windows_and_partitions(documents, texts, window, windows):
    pieces = packing.pack(documents, window=window, windows=windows).collect()
    sequences = packed(texts, pieces, window)
    total = Counter()
    for r in pieces:
        total[r.queue] += r.length
    share = {q: n / sum(total.values()) for q, n in total.items()}
    served = Counter()
    for number in range(len(sequences) - 1):  # what a queue got so far never strays far from its share
        for r in sequences[number]:
            served[r.queue] += r.length
        assert all(abs(served[q] - share[q] * window * (number + 1)) <= window + 2 * packing.LEAST_PIECE for q in share)


@pytest.mark.parametrize("weights", [None, (1, 1, 1, 1), (7, 1, 900, 40), (10**12, 5, 3 * 10**11, 10**10)])
def test_schedule_adds_up(weights):
    plan = packing.Schedule((1000, 333, 77, 5000), 128, weights)
    last = -(-plan.total // 128)
    for p in range(last + 3):
        assert sum(plan.taken(q, p) for q in range(4)) == min(p * 128, plan.total)
    for q, n in enumerate(plan.totals):
        steps = [plan.taken(q, p) for p in range(last + 2)]
        assert steps == sorted(steps) and steps[-1] == n
        for x in range(0, n, 7):
            p = plan.partition_of(q, x)
            assert plan.taken(q, p) <= x < plan.taken(q, p + 1)


def test_targets_are_held_while_all_queues_last(spark):
    rows = [(i, f"{'one two three four five six ' * 5}{i}", "abc"[i % 3]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, window=256, windows=4, targets={"a": 6, "b": 3, "c": 1}).collect()
    sequences = packed({r[0]: r[1] for r in rows}, pieces, 256)
    lengths = Counter()
    for r in pieces:
        lengths["abc"[r.doc_id % 3]] += r.length
    served, dry = Counter(), set()
    share = lambda: {s: {"a": 6, "b": 3, "c": 1}[s] / sum(w for t, w in (("a", 6), ("b", 3), ("c", 1)) if t not in dry) for s in "abc" if s not in dry}
    for number in range(len(sequences) - 1):
        now = Counter()
        for r in sequences[number]:
            now["abc"[r.doc_id % 3]] += r.length
        served.update(now)
        done = {s for s in "abc" if served[s] == lengths[s]}
        if done == dry:  # no queue ran dry in this window
            assert all(abs(now[s] - part * 256) <= 2 * packing.LEAST_PIECE for s, part in share().items()), number
        dry = done
    assert dry >= {"a", "b"}


def test_five_thousand_sources(spark):
    """Every window takes from as many sources as pieces allow, and no source runs ahead of the others."""
    rows = [(2 * s + i, "one two three four five six seven eight nine ten " * 4, f"s{s:04}") for s in range(5000) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, with_ids=False).collect()
    sequences = packed({r[0]: r[1] for r in rows}, pieces, 2048)
    assert len({r.queue for r in pieces}) == 5000
    length, served = {}, Counter()
    for r in pieces:
        length[r.doc_id // 2] = length.get(r.doc_id // 2, 0) + r.length
    for number in range(len(sequences) - 1):
        assert len({r.doc_id // 2 for r in sequences[number]}) >= 2048 // (2 * packing.LEAST_PIECE)
        for r in sequences[number]:
            served[r.doc_id // 2] += r.length
        gone = (number + 1) / (sum(length.values()) / 2048)
        assert all(abs(served[s] - n * gone) <= 3 * packing.LEAST_PIECE for s, n in length.items())


def test_small_sources_share_a_queue(spark):
    rows = [(i, "word " * 2000, "big") for i in range(30)] + [(100 + i, "x", f"s{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, window=64, windows=2).collect()
    packed({r[0]: r[1] for r in rows}, pieces, 64)


def test_packing_odd_rows(spark, odd, empty):
    distinct = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    packed({r.doc_id: r.text or "" for r in distinct.collect()}, packing.pack(distinct).collect(), 2048)
    pieces = packing.pack(odd)
    want = sum(len(ids_of(r.text or "")) + 1 for r in odd.collect())
    assert sum(r.length for r in pieces.collect()) == want
    whole = packing.sequences(pieces).collect()
    assert sum(r.length for r in whole) == want and all(len(r.ids) == 2 * r.padded for r in whole)
    assert all(r.padded == 2048 or r.padded & (r.padded - 1) == 0 for r in whole)
    assert packing.pack(empty).count() == 0 and packing.pack(odd.drop("source")).count() >= 10


def test_packing_mixes_many_small_sources(spark, monkeypatch):
    """No source is large enough for a queue of its own, and the table is sorted by source."""
    monkeypatch.setattr(packing, "LEAST_TOKENS", 128)
    rows = [(40 * k + i, "one two three four five six seven", f"s{k:02}") for k in range(20) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    pieces = packing.pack(docs, window=256, windows=4).collect()
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, set()).add(r.doc_id // 40)
    packed({r[0]: r[1] for r in rows}, pieces, 256)
    last = max(sequences)
    assert last > 20 and all(len(sources) >= 15 for k, sources in sequences.items() if k < last)
