"""Fill-in-middle against a plain version that cuts and joins Python strings."""

import hashlib
import re

from phenogrid.llm import fill_middle
from phenogrid.llm.fill_middle import Rules


def brute(doc_id, text, rules=Rules()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pieces = ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]
    if not text or any(mark in text for mark in rules.marks) or h[2] % 100 >= rules.percent:
        return len(units), "plain", None, None, text
    p, s, m = (mark + piece for mark, piece in zip(rules.marks, (pieces[0], pieces[2], pieces[1]), strict=True))
    spm = h[3] % 100 < rules.spm_percent
    return len(units), "spm" if spm else "psm", len(pieces[0]), len(pieces[1]), (s + p if spm else p + s) + m


def same(docs, rules=Rules()):
    made = fill_middle.restored(fill_middle.fill_in_middle(docs, rules), rules).collect()
    got = sorted(((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.text) for r in made), key=str)
    assert got == sorted(((r.doc_id, brute(r.doc_id, r.text, rules), r.text or "") for r in docs.collect()), key=str)
    return made


def test_whole_table(documents):
    assert {r.form for r in same(documents)} == {"psm", "spm"}


def test_shares_seed_and_marks(documents):
    rules = Rules(prefix="[pre]", suffix="[suf]", middle="[mid]", percent=60, spm_percent=20, seed=11)
    assert {r.form for r in same(documents, rules)} == {"psm", "spm", "plain"}


def test_line_feeds_and_marks_in_texts(spark):
    texts = ["\n", "\n\n\n", "a\n", "a", "\na", "a\r\nb\n\n", "x <P> y\nz", "<S>", "a<M", "<M>b", "<", "<P\n>", "é\nüß\n日本\n", "<\n" * 9, " a\n\x0bb", ""]
    same(spark.createDataFrame([(i, t) for i, t in enumerate(texts * 6)], "doc_id long, text string").repartition(3))


def test_long_text_and_many_lines(spark):
    texts = ["abc def\n" * 700_000, "x" * 3_000_000, "\n" * 1_000_000 + "end"]
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_odd_rows(odd, empty):
    same(odd)
    assert fill_middle.fill_in_middle(empty).count() == 0
    kept = fill_middle.fill_in_middle(odd.withColumnRenamed("span", "form").withColumnRenamed("hash", "h1"), keep=["form", "h1", "kept", "text"])
    assert kept.columns == ["doc_id", "kept", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted((r.kept.text or "" for r in kept.collect())) == sorted(r.text or "" for r in odd.collect())
