"""Line dedup against a plain version, with hashes that run over many ranges."""

import random
import re
import zlib

import numpy as np
import pytest
from phenogrid.llm import line_dedup
from pyspark.sql import functions as F


def key_of(line):
    bare = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def brute(rows, least=10):
    """rows: (doc_id or None, text), null ids in the order the operator gives them."""
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            first.setdefault(key_of(line), doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < least or first[key_of(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def answer(docs, **settings):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs, **settings).collect()), key=str)


@pytest.fixture
def ranges(spark):
    """Many small ranges, no merging of them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_whole_table(documents, texts):
    got = answer(documents)
    assert got == sorted(brute(sorted(texts.items())), key=str)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_hot_lines_over_many_ranges(spark, ranges, seed):
    rng = random.Random(seed)
    pool = ["a very common line of boiler plate", *(f"line number {i} of the pool" for i in range(6)), "short", ""]
    rows = [(i, "\n".join(rng.choices(pool, weights=[20, *[2] * 6, 3, 1], k=rng.randint(0, 30)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert answer(docs) == sorted(brute(rows), key=str)


def test_one_line_everywhere(spark, ranges):
    rows = [(i, "the same line in every document\n" * (1 + i % 3)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert answer(docs) == sorted(brute(rows), key=str)


def test_keys(spark):
    texts = ["ÄPFEL und Birnen", "Äpfel und birnen", " äpfel und birnen", "ÄPFEL UND BIRNEN\r", "\x0bÄPFEL und BIRNEN \t", " ÄPFEL und birnen", "123456789", "123456789 ", "1234567890", "日本語の行は十文字です", "日本語の行は十文字です\n\n", "\x1cabcdefghij", "abcdefghij"]
    rows = list(enumerate(texts))
    assert answer(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute(rows), key=str)
    assert answer(spark.createDataFrame(rows, "doc_id long, text string"), least=3) == sorted(brute(rows, 3), key=str)


def test_bitmaps(spark):
    rows = [(1, "first of the lines\nonly here and nowhere"), (2, "ab\nfirst of the lines\nONLY here and nowhere\nnew line of two")]
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc, r.n_dropped) for r in maps] == [(2, 2)]
    assert np.unpackbits(np.frombuffer(zlib.decompress(bytes(maps[0].keep)), np.uint8), bitorder="little")[:4].tolist() == [1, 0, 0, 1]


def test_documents_without_id_and_repeated_ids(spark, ranges):
    line, other = "a line that everybody holds", "another line, also shared"
    rows = [(None, f"{line}\n{other}"), (None, f"{line}\n{other}"), (None, other + "\nx"), (4, line), (4, line), (4, f"{line}\n{line}\nmore"), (9, f"{line}\nmore")]
    got = answer(spark.createDataFrame(rows, "doc_id long, text string"))
    known = [r for r in got if r[0] is not None]
    assert known == sorted(brute([r for r in rows if r[0] is not None]), key=str)
    unnamed = [r for r in got if r[0] is None]
    # One of the two texts comes first and holds ``other``; its copies are one document.
    assert sorted(r[3] for r in unnamed) in (sorted([other, other, "x"]), sorted(["", "", f"{other}\nx"]))


def test_long_texts(spark):
    rows = [(1, "a line of some length\n" * 300_000), (2, "b\na line of some length\n" * 200_000), (3, "x" * 3_000_000)]
    assert answer(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute(rows), key=str)


def test_odd_rows(odd, empty):
    got = answer(odd)
    assert len(got) == odd.count()
    # The rows of document 5 repeat each other and lose nothing; the row without id holds no line of theirs.
    assert sorted(r[3] for r in got if r[0] == 5) == ["alpha  beta\ngamma delta epsilon zeta"] * 2
    assert answer(empty) == [] and line_dedup.keep_bitmaps(empty).count() == 0
    renamed = odd.withColumnsRenamed({"kept": "keep", "hash": "who", "span": "missing"}).withColumn("n_dropped", F.lit("mine"))
    left = line_dedup.dedup_lines(renamed, keep=["keep", "who", "missing", "n_dropped", "text"])
    assert left.columns == ["doc_id", "kept", "n_lines", "n_dropped", "text"]
    assert {r.kept.n_dropped for r in left.collect()} == {"mine"}
