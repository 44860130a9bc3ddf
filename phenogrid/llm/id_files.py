"""Token ids on disk: concatenated ids with Elias-Fano coded document ends.

A file set is a table of segments and a manifest. A segment holds consecutive documents in ascending doc_id: their ids one
after the other (two bytes an id if the vocabulary allows, else four), the ends of the documents and their doc_ids, both
as Elias-Fano codes. Segments know where they start inside their part, the manifest says where each part starts, so the
parts are written at once and no count runs through them all. Spark's committer writes the tables: a task that ran twice
or was lost with its executor leaves no trace, and any file system that Spark reaches will do.

Edge cases: a null text counts as empty; an empty one has only the end id. Documents without doc_id come first. Rows that
repeat a doc_id stand next to each other in the order of their texts, and all are written. A text longer than a segment
has one to itself. An empty table gives an empty file set. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm import elias_fano
from phenogrid.llm.common import ship
from phenogrid.llm.tokens import default_vocabulary, encoder

SEGMENTS = "part int, segment int, part_start long, n_docs int, n_ids long, width int, nulls int, first_id long, doc_ids binary, ends binary, ids binary"

#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20

READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _segments(batches: Iterator[pd.DataFrame], vocabulary: str, end_id: int, segment_ids: int) -> Iterator[pd.DataFrame]:
    part, segment, start = TaskContext.get().partitionId(), 0, 0
    enc = encoder(vocabulary)
    width = enc.dtype.itemsize
    end = np.array([end_id], enc.dtype).tobytes()
    names, pieces, lengths, held = [], [], [], 0

    def close() -> pd.DataFrame:
        nonlocal segment, start, names, pieces, lengths, held
        known = [x for x in names if x is not None]
        first = known[0] if known else 0
        row = (
            part, segment, start, len(names), held, width, len(names) - len(known), first,
            elias_fano.encode(np.array([x - first for x in known], np.uint64)), elias_fano.encode(np.cumsum(lengths)), b"".join(pieces),
        )
        segment, start = segment + 1, start + held
        names, pieces, lengths, held = [], [], [], 0
        return pd.DataFrame([row], columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    for batch in batches:
        for doc_id, ids in zip(batch["doc_id"].array, enc.encode_all(batch["text"]), strict=True):
            ids += end
            names.append(None if pd.isna(doc_id) else int(doc_id))
            pieces.append(ids)
            lengths.append(len(ids) // width)
            held += lengths[-1]
            if held >= segment_ids:
                yield close()
    if names:
        yield close()


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode whole texts, end each document with ``end_id``, and write the file set to ``path``.

    Texts are dealt out by ranges of doc_id, so that parts follow each other in that order; each is encoded once.
    """
    ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # As text, a doc_id keeps all its digits where others of its batch are null.
    plain = ranged.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    plain.mapInPandas(lambda b: _segments(b, vocabulary, end_id, segment_ids), SEGMENTS).write.parquet(f"{path}/segments")
    spark = docs.sparkSession
    parts = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in parts])]).tolist()
    rows = [(r["part"], int(at)) for r, at in zip(parts, starts, strict=False)]
    spark.createDataFrame(rows, "part int, base long").coalesce(1).write.parquet(f"{path}/manifest")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``base``, the ids before their part. The manifest has one row per part, as many as write tasks."""
    manifest = spark.read.schema("part int, base long").parquet(f"{path}/manifest")
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments").join(F.broadcast(manifest), "part")


class Segment:
    """One segment: documents by index, through the select structures."""

    def __init__(self, row):
        self.row = row
        self.ends, self.names = elias_fano.EliasFano(bytes(row.ends)), elias_fano.EliasFano(bytes(row.doc_ids))
        self.ids = np.frombuffer(row.ids, f"<u{row.width}")

    def span(self, index: int) -> tuple[int, int]:
        """First and end position of a document's ids inside the segment."""
        return (self.ends.select(index - 1) if index else 0), self.ends.select(index)

    def document(self, index: int) -> np.ndarray:
        start, end = self.span(index)
        return self.ids[start:end]

    def doc_id(self, index: int) -> int | None:
        return None if index < self.row.nulls else self.row.first_id + self.names.select(index - self.row.nulls)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the whole file set, and ids of each document."""
        start = 0
        for index in range(self.row.n_docs):
            end = self.ends.select(index)
            yield self.doc_id(index), self.row.base + self.row.part_start + start, self.ids[start:end]
            start = end


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file set, with the checksum of its ids as they stand in the file."""
    ship(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                rows = [(doc_id, start, len(ids), crc32_of(ids)) for doc_id, start, ids in Segment(row).documents()]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    return segments(spark, path).mapInPandas(read, READ)
