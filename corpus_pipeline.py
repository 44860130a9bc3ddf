"""From raw documents to packed training sequences.

Five stages, each over everything its predecessor kept. Every stage but the last returns the columns of ``documents``; its
result is written to the shared folder and read again, so a lost executor costs at most the stage it ran.

* ``language_id`` drops documents whose language compression can't tell: no letter, or a runner-up nearly as good.
* ``exact_dedup`` keeps the smallest doc_id of equal texts (white space runs count as one space).
* ``near_dedup`` keeps the smallest doc_id of each component of documents linked by five-word shingles, similarity 0.8.
* ``secret_scan`` drops nothing: it replaces every secret found by a mark and counts n_chars anew.
* ``packing`` encodes what is left and packs it into windows of 2048 tokens in proportion to the sources.

Edge cases are those of the operators. In short: null and empty texts have no letter and go in the first stage, rows that
repeat id and text are one document from the second on, rows without doc_id rank last and are packed under a null id, an
empty table comes out as no pieces, and further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phenogrid.llm import exact_dedup, language, near_dedup, packing, secrets
from phenogrid.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_recognised(docs, language.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.thresholds(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, end_id=1, with_ids=False).drop("ids", "queue")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secret_scan), ("packing", pack)]

#: Compression and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
