"""Language identification by compression: the language whose dictionary makes a text smallest.

Each learned language has a raw-content Zstandard dictionary of its own text. A text is lower-cased and compressed whole,
in chunks, with every dictionary; the smallest sum of sizes names the language. A prediction is rejected when the
runner-up is nearly as small.

Edge cases: a null text and one without a letter are ``und`` with score 0 and are rejected. Ties go to the language that
sorts first and are rejected. Rows without lang, or whose lang is ``und``, are not learned from. With nothing to learn
from every text is ``und``; with one language, every text with a letter is that. Repeated rows get the same answer each.
``predicted`` adds one column of a name of the caller's choice; ``keep_recognised`` carries the caller's row in a struct,
whatever its columns are called. Very long texts are compressed whole, chunk after chunk.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import carried, ship

UNKNOWN = "und"

PREDICTION = "lang_pred string, score double, margin double, rejected boolean"


@dataclass(frozen=True)
class Model:
    """What training leaves: languages in order, one dictionary each, and how to compress."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 5
    chunk: int = 4000
    least_margin: float = 0.005


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the fold that training never sees; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(labelled: DataFrame, documents: int = 256, dictionary_bytes: int = 65_536, **settings) -> Model:
    """Fit on a bounded sample of rows (doc_id, text, lang): at most ``documents`` rows of a language, and of each an equal
    part of ``dictionary_bytes`` bytes, as pieces spread over the whole text.

    The sample has the smallest hashes of the ids. One pass counts the languages; the second keeps about twice the
    wanted rows by a threshold on the hash and ranks those few.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull())
    order = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model((), (), **settings)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, float(min(1.0, (2 * documents + 64) / n)))))
    few = rows.withColumn("order", order).where(F.col("order") <= share[F.col("lang")] * (1 << 40))
    part = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, dictionary_bytes // min(documents, n))))
    few = few.select("lang", "order", "doc_id", spread(F.lower("text"), part[F.col("lang")]).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "text"))
    ranked = few.withColumn("rank", rank).where(F.col("rank") <= documents).orderBy("lang", "rank").select("lang", "text").collect()
    texts: dict[str, list[str]] = {}
    for row in ranked:
        texts.setdefault(row["lang"], []).append(row["text"])
    names = tuple(sorted(texts))
    return Model(names, tuple(_within(texts[n], dictionary_bytes) for n in names), **settings)


def spread(text: Column, chars: Column, pieces: int = 4) -> Column:
    """A short text whole; of a longer one, ``pieces`` equal stretches at equal distances from its start to its end."""
    size = F.greatest(F.lit(1), F.floor((chars - pieces) / pieces).cast("int"))
    gap = (F.length(text) - size) / F.lit(float(max(1, pieces - 1)))
    taken = F.concat_ws(" ", *[F.substr(text, F.floor(gap * i).cast("int") + 1, size) for i in range(pieces)])
    return F.when(F.length(text) < chars, text).otherwise(taken)


def _within(texts: list[str], most: int) -> bytes:
    """Whole sampled texts, one after the other, as many as fit; characters may take several bytes."""
    out = b""
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        if len(out) + len(raw) + 1 <= most:
            out += raw + b"\n"
    return out


@functools.lru_cache(maxsize=2)
def _compressors(model: Model) -> list:
    import zstandard

    out = []
    for data in model.dictionaries:
        shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(model: Model, text: str) -> list[int]:
    """Compressed bytes of the whole text under each language's dictionary."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    totals = [0] * len(model.languages)
    for start in range(0, len(raw), model.chunk):
        part = raw[start : start + model.chunk]
        for k, compressor in enumerate(_compressors(model)):
            totals[k] += len(compressor.compress(part))
    return totals


def judge(model: Model, text: str | None) -> tuple[str, float, float, bool]:
    """Language, score in 0..1, relative margin to the runner-up, and whether the answer is rejected."""
    if not model.languages or text is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0, True
    if len(model.languages) == 1:
        return model.languages[0], 1.0, 1.0, False
    found = sizes(model, text)
    first, second = sorted(range(len(found)), key=found.__getitem__)[:2]
    margin = (found[second] - found[first]) / found[second]
    score = 1.0 / sum(2.0 ** -min(1000, n - found[first]) for n in found)
    return model.languages[first], score, margin, margin < model.least_margin


def predicted(docs: DataFrame, model: Model, into: str = "prediction") -> DataFrame:
    """``docs`` with a struct column lang_pred, score, margin, rejected."""

    ship(docs.sparkSession)

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge(model, t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return docs.withColumn(into, predict.asNondeterministic()(docs["text"]))


def keep_recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is told with a clear margin, columns unchanged."""
    return predicted(carried(docs), model, "language").where(~F.col("language.rejected")).select("row.*")
