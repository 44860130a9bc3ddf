"""Species search on stored postings: a search reads the ranges of its words, not the list of species.

A posting is a piece of text, the species it leads to, and its cells. There are three kinds: the whole name and the whole
scientific name (0), every word of the name (1), and every run of one to three characters of both (2). Postings lie sorted
by kind and text, in ranges, so the statistics of the files and their row groups leave only the range that can match.
Prefixes are ranges of kinds 0 and 1. A search inside names takes the species that have all of its runs of three, then
looks at the text. Names lie beside the postings, once a species: a posting is a hundredth of a species' entries, and
the names of the few species found are joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.session import split_by

POSTINGS = "kind int, text string, k string, cells bigint"
NAMES = "k string, cells bigint, name string, sci string"
NGRAM = 3
ROWS_IN_GROUP = 1 << 20

#: Species whose postings one task makes.
SPECIES_PER_TASK = 1 << 14


def _runs(text: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.filter(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))), lambda r: F.length(r) == n)


def postings(index: DataFrame) -> DataFrame:
    """Postings of a species index (k, name, sci, cells)."""
    name, sci = F.lower("name"), F.lower("sci")
    words = F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
    inside = F.array_distinct(F.concat(*[_runs(t, n) for t in (name, sci) for n in range(1, NGRAM + 1)]))
    entry = lambda kind, texts: F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    every = F.concat(entry(0, F.array_distinct(F.array(name, sci))), entry(1, words), entry(2, inside))
    return index.select(F.explode(every).alias("p"), "k", "cells").select("p.kind", "p.text", "k", "cells")


def write(index: DataFrame, path: str) -> None:
    """Names, and postings in ranges of kind and text. The species are part of the range key, so a text that all share is many ranges."""
    index.select("k", "cells", "name", "sci").write.parquet(f"{path}/names")
    made = postings(split_by(_names(index.sparkSession, path), 1, SPECIES_PER_TASK, "k", "name", "sci"))
    made.repartitionByRange("kind", "text", "k").sortWithinPartitions("kind", "text", "k").write.option("parquet.block.size", ROWS_IN_GROUP).parquet(f"{path}/postings")


def _names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NAMES).parquet(f"{path}/names")


def _range(rows: DataFrame, kind: int, prefix: str) -> DataFrame:
    """Postings of a kind that begin with a prefix."""
    after = prefix[:-1] + chr(ord(prefix[-1]) + 1) if ord(prefix[-1]) < 0x10FFFF and not 0xD7FF <= ord(prefix[-1]) < 0xDFFF else None
    found = rows.where((F.col("kind") == kind) & (F.col("text") >= prefix))
    return found.where(F.col("text") < after) if after else found.where(F.col("text").startswith(prefix))


def _holding(rows: DataFrame, q: str) -> DataFrame:
    """Rows with the text inside one of their names."""
    return rows.where(F.lower("name").contains(q) | F.lower("sci").contains(q))


def _matches(spark: SparkSession, path: str, q: str) -> DataFrame:
    """Species that match (k, cells, rank), without their names."""
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    begins = _range(rows, 0, q).select("k", "cells", F.lit(0).alias("rank"))
    word = _range(rows, 1, q).select("k", "cells", F.lit(1).alias("rank"))
    runs = sorted({q[i : i + NGRAM] for i in range(max(1, len(q) - NGRAM + 1))})
    held = rows.where((F.col("kind") == 2) & F.col("text").isin(*runs)).groupBy("k").agg(F.count("*").alias("n"), F.first("cells").alias("cells")).where(F.col("n") == len(runs))
    if len(q) > NGRAM:  # else the run is the text itself
        held = held.join(_holding(_names(spark, path), q).select(F.col("k").alias("_k")), F.col("k").eqNullSafe(F.col("_k")))
    every = begins.unionByName(word).unionByName(held.select("k", "cells", F.lit(2).alias("rank")))
    return every.groupBy("k").agg(F.min("rank").alias("rank"), F.first("cells").alias("cells"))


def _named(found: DataFrame, spark: SparkSession, path: str, q: str) -> DataFrame:
    """Names of the species found: one that matches, where several go by the same key."""
    names = _holding(_names(spark, path), q).select(F.col("k").alias("_k"), "name", "sci")
    named = found.join(names, F.col("k").eqNullSafe(F.col("_k"))).groupBy("k").agg(*[F.first(c).alias(c) for c in ("cells", "name", "sci", "rank")])
    return named.select("k", "cells", "name", "sci", "rank")


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"{NAMES}, rank int")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Species that match (k, cells, name, sci, rank): 0 a name begins so, 1 a word does, 2 it is inside a name."""
    q = query.strip().lower()
    return _named(_matches(spark, path, q), spark, path, q) if q else _nothing(spark)


def search(spark: SparkSession, path: str, query: str, limit: int = 6) -> DataFrame:
    """The best matches: by rank, then the widest first. Only these are named."""
    q = query.strip().lower()
    if not q:
        return _nothing(spark)
    order = ["rank", F.col("cells").desc(), "k"]
    return _named(_matches(spark, path, q).orderBy(*order).limit(limit), spark, path, q).orderBy(*order)
