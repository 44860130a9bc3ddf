"""Language ID: held-out accuracy, the fold, rejections."""

import zlib

from phenogrid.llm import language
from phenogrid.llm.queries import QUERIES


def test_held_out_accuracy_and_fold(spark, sf_dir, documents):
    rows = QUERIES["op5_language_id"](spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in documents.collect()}
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in lang}
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in unseen) >= 0.95 * len(unseen)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_the_held_out_fold_are_not_seen(spark):
    rows = [(i, f"wort und satz nummer {i} im text", "de") for i in range(60)] + [(i, f"word and phrase number {i} of text", "en") for i in range(60, 120)]
    hidden = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(hidden, "doc_id long, text string, lang string")
    assert language.train(docs.where(~language.held_out(F.col("doc_id")))).languages == ("de", "en")


def test_odd_rows(odd, empty):
    model = language.train(odd)
    assert model.languages == ("de", "en") and max(map(len, model.dictionaries)) <= 65_536
    got = {(r.doc_id, r.text): r.prediction for r in language.predicted(odd, model).collect()}
    for key, p in got.items():
        letters = any(c.isalpha() for c in key[1] or "")
        assert (p.lang_pred == "und") == (not letters)
        assert p.rejected or letters
    assert got[(8, "long " * 60_000)].lang_pred == "en" and got[(7, "das ist ein deutscher text über nichts")].lang_pred == "de"
    assert language.keep_recognised(odd, model).columns == odd.columns
    none = language.train(empty)
    assert none.languages == () and language.predicted(empty, none).count() == 0
    assert language.judge(none, "text")[0] == "und"


def test_ties_are_rejected():
    model = language.Model(("a", "b"), (b"same words in both", b"same words in both"))
    assert language.judge(model, "same words")[0] == "a" and language.judge(model, "same words")[3]


def test_sample_is_bounded(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 10) AS text", "'en' AS lang")
    model = language.train(docs, documents=16, dictionary_bytes=200)
    words = model.dictionaries[0].split(b"\n")
    assert len(model.dictionaries[0]) <= 200 and len(words) > 10  # of most sampled rows


def test_sample_is_spread_over_long_texts(spark):
    docs = spark.createDataFrame([(1, "a" * 3000 + "b" * 3000 + "c" * 3000, "en")], "doc_id long, text string, lang string")
    data = language.train(docs, dictionary_bytes=900).dictionaries[0]
    assert len(data) <= 900 and all(data.count(x) > 150 for x in (b"a", b"b", b"c"))


def brute(model, text):
    """Sizes by plain calls, a fresh compressor for each chunk."""
    import zstandard

    raw, out = text.lower().encode(), []
    for data in model.dictionaries:
        shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        chunks = [raw[i : i + model.chunk] for i in range(0, len(raw), model.chunk)]
        out.append(sum(len(zstandard.ZstdCompressor(level=model.level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress(c)) for c in chunks))
    return out


def test_answers_equal_plain_compression(documents, texts):
    model = language.train(documents)
    for r in language.predicted(documents, model).collect():
        if not any(map(str.isalpha, texts[r.doc_id])):
            assert r.prediction.lang_pred == "und"
            continue
        found = brute(model, texts[r.doc_id])
        order = sorted(range(len(found)), key=lambda k: (found[k], k))
        margin = (found[order[1]] - found[order[0]]) / found[order[1]]
        assert (r.prediction.lang_pred, r.prediction.rejected) == (model.languages[order[0]], margin < model.least_margin)


def test_one_language(spark, odd):
    model = language.train(odd.where("lang = 'de'"))
    assert {r.prediction.lang_pred for r in language.predicted(odd, model).collect()} == {"de", "und"}
