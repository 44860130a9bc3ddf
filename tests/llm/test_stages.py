"""Stages under columns named like those they make, and held against plain versions."""

import pytest
from phenogrid.llm import exact_dedup, language, near_dedup, packing, secrets
from pyspark.sql import functions as F

NAMES = ["__hash", "__node", "__found", "__spans", "__random", "__language", "__body", "__other", "__last", "row", "own", "hash", "node", "language", "kept", "low", "salt", "a.b"]


@pytest.fixture(scope="module")
def named(spark):
    """Rows with every such name, copies and near copies among them, without and with repeated ids."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "ganz anderer text ohne bezug zu allem"), (None, text + " again"), (4, 'other words, password = "abc123def456" here'), (9, "")]
    schema = "doc_id long, text string, lang string, n_chars int, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "de" if t.startswith("ganz") else "en", len(t), *(f"{n}-{i}" for n in NAMES)) for i, t in rows], schema).repartition(2)


STAGES = {
    "language": lambda docs: language.keep_recognised(docs, language.train(docs)), "exact": exact_dedup.exact_dedup,
    "near": near_dedup.drop_near_duplicates, "secrets": lambda docs: secrets.redact(docs, {}),
}


@pytest.mark.parametrize("stage", STAGES)
def test_columns_of_any_name_pass_unchanged(named, stage):
    left = STAGES[stage](named)
    assert left.columns == named.columns and left.dtypes == named.dtypes
    rows = left.collect()
    assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in NAMES)
    ids = sorted((r.doc_id for r in rows), key=str)
    assert ids == {"exact": [1, 3, 4, 4, 9, None], "near": [1, 4, 4, 9], "secrets": [1, 2, 3, 4, 4, 9, None]}.get(stage, ids)
    if stage == "secrets":
        assert [r.text for r in rows if "[SECRET]" in r.text] == ["other words, [SECRET]\" here"]
        assert all(r.n_chars == len(r.text) for r in rows)


def test_redaction_equals_spans_cut_by_hand(spark, documents):
    hidden = [(10**6 + i, f'Ünd a password: "pa55word{i}" stands here, token=abc{i}def{i} AKIAABCDEFGH{i:04}IJKLMN too {"0123456789abcdef" * 2}{i}.') for i in range(20)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(hidden, "doc_id long, text string"))
    limits = secrets.thresholds(docs)
    spans = {r.doc_id: r.spans for r in secrets.with_spans(docs, limits).select("doc_id", secrets.described(F.col("__spans")).alias("spans")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in secrets.redact(docs, limits).collect():
        out, at = "", 0
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[r.doc_id].split(",") if s):
            if start >= at:
                out += texts[r.doc_id][at:start] + secrets.MARK
            at = max(at, end)
        assert r.text == out + texts[r.doc_id][at:]
        assert r.doc_id < 10**6 or r.text.count(secrets.MARK) == 4


def test_all_ids_missing(spark):
    docs = spark.createDataFrame([(None, f"text number {i % 40} of many words and more words to pack", "s") for i in range(400)], "doc_id long, text string, source string")
    assert exact_dedup.exact_dedup(docs).count() == 40
    pieces = packing.pack(docs, window=64, windows=8)
    assert sum(r.length for r in pieces.collect()) == sum(r.length for r in packing.pack(docs.repartition(3), window=64, windows=8).collect())
