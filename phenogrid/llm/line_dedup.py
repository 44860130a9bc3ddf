"""Line dedup: of lines that several documents hold, only those of the first document stay.

Every line of enough characters becomes a row of its hash, its document and its position. The rows are dealt out in
ranges of hash, document and position, and sorted so inside a range; one pass over a range sees the lines of a hash
together, the first document's first, and reports all lines of later documents. Because documents and positions are part
of the range key, a line that a third of all rows hold is cut into many ranges like any other rows. Only the first hash of
a range may have begun in an earlier one: its lines in the range's first document are held open, and each range says with
which hash it ends and which document began it. That is one row a range, so the list is broadcast.

What comes back is no text but a bitmap per document with a dropped line: a bit per line, set if the line stays, least
significant bit first, compressed with zlib. ``applied`` makes texts of it again.

A line's key is the line without ASCII white space at its ends, A-Z in lower case; keys are compared by MD5.

Edge cases: null counts as empty, and an empty text is one empty line. Rows that repeat a doc_id are one document, each row
with its own bitmap; of repeated rows each loses the same lines. Documents without doc_id come last, in the order of a
64-bit hash of their texts; those of equal text are one document. Lines repeated inside a document all stay or all go.
There are no further ties. A very long text costs its own size in one task at a time. An empty table gives no rows. Only
doc_id and text are read; ``applied`` carries the other columns in a struct, so no name of theirs can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.llm.common import ship, stored

#: Space and the control characters from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Keys of fewer code points are left alone.
LEAST_CHARS = 10

#: missing, doc and who name a document: whether it has no doc_id, the doc_id or 0, and the hash of its text.
LINES = ("hash", "missing", "doc", "who", "pos", "n")
MARKS = "hash binary, missing boolean, doc long, who long, pos int, n int, role string"


def line_key(line: Column) -> Column:
    """Without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() agrees with the rule on ASCII and is far faster than translate().
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


TEXT = "coalesce(text, '')"


def _name() -> list[Column]:
    """What tells a document from others: missing, doc, who."""
    return [F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.xxhash64(F.expr(TEXT)).alias("who")]


def keyed_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """A row per line whose key has at least ``least`` code points."""
    split = docs.select(*_name(), F.split(F.expr(TEXT), "\n").alias("lines"))
    rows = split.select("missing", "doc", "who", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    keys = rows.select("missing", "doc", "who", "pos", "n", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= least).select(F.unhex(F.md5("key")).alias("hash"), *LINES[1:])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes as pairs of numbers, and documents as rows of (missing, doc, who if missing)."""
    hashes = batch.column("hash").cast(pa.binary(16))
    pairs = np.frombuffer(hashes.buffers()[1], np.uint64, 2 * len(hashes), 16 * hashes.offset).reshape(-1, 2)
    missing = batch.column("missing").to_numpy(zero_copy_only=False).astype(np.int64)
    return pairs, np.stack([missing, batch.column("doc").to_numpy(), batch.column("who").to_numpy() * missing], axis=1)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a sorted range: ``drop`` for those behind the first document of their hash, ``open`` for those of the first
    document of the range's first hash, and one ``tail``: the first line that the range has of its last hash."""
    names = [*LINES, "role"]
    last_hash = first_doc = tail = None
    leading = True  # still in the first hash of the range
    for batch in batches:
        if not len(batch):
            continue
        pairs, docs = _columns(batch)
        new = np.ones(len(batch), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        new[0] = last_hash is None or bool((pairs[0] != last_hash).any())
        begins = np.flatnonzero(new)
        group = np.cumsum(new) - 1  # -1 for a hash that goes on from the batch before
        firsts = docs[begins]
        if not new[0]:
            firsts, group = np.concatenate([first_doc[None], firsts]), group + 1
        first = firsts[group]
        drop = (docs != first).any(axis=1)
        lead = np.zeros(len(batch), bool)
        if leading:
            changes = begins[1:] if last_hash is None else begins
            lead[: changes[0] if len(changes) else len(batch)] = True
            leading = not len(changes)
        for role, rows in (("drop", drop), ("open", lead & ~drop)):
            if rows.any():
                part = batch.filter(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in LINES), pa.array([role] * len(part))], names=names)
        if len(begins):
            tail = batch.slice(int(begins[-1]), 1)
        last_hash, first_doc = pairs[-1].copy(), first[-1].copy()
    if tail is not None:
        yield pa.RecordBatch.from_arrays([*(tail.column(c) for c in LINES), pa.array(["tail"])], names=names)


def dropped_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """missing, doc, who, pos, n of every line that goes."""
    ship(docs.sparkSession)
    lines = stored(keyed_lines(docs, least), "line-hashes")
    order = ["hash", "missing", "doc", "who", "pos"]
    ranges = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(*LINES)
    marks = stored(ranges.mapInArrow(_stream, MARKS), "line-marks")
    here = F.struct("missing", "doc", F.expr("IF(missing, who, 0)").alias("who"))
    # Of the ranges that end with a hash, the one where it began has its first document.
    began = marks.where("role = 'tail'").groupBy("hash").agg(F.min(here).alias("began"))
    later = marks.where("role = 'open'").join(F.broadcast(began), "hash").where(F.col("began") < here)
    return marks.where("role = 'drop'").select(*LINES[1:]).unionByName(later.select(*LINES[1:]))


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, counts = [], []
        positions = batch.column("dropped")
        for i, n in enumerate(batch.column("n").to_pylist()):
            at = positions[i].values.to_numpy()
            keep = np.ones(n, bool)
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            counts.append(n - int(keep.sum()))
        columns = [batch.column(c) for c in ("missing", "doc", "who")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["missing", "doc", "who", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """missing, doc, who, n_dropped and the compressed bitmap ``keep`` of each document that loses a line.

    A document's dropped positions are gathered into one set, part by part first, so it never outgrows the text.
    """
    gone = dropped_lines(docs, least).groupBy("missing", "doc", "who").agg(F.first("n").alias("n"), F.collect_set("pos").alias("dropped"))
    return gone.mapInArrow(_bitmap, "missing boolean, doc long, who long, n_dropped long, keep binary")


def _kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = pc.split_pattern(batch.column("text").cast(pa.large_string()), "\n")
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        stays = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        keep = batch.column("keep")
        for i in pc.indices_nonzero(pc.is_valid(keep)).to_pylist():
            bits = np.frombuffer(zlib.decompress(keep[i].as_py()), np.uint8)
            stays[ends[i] - sizes[i] : ends[i]] = np.unpackbits(bits, count=int(sizes[i]), bitorder="little")
        before = np.concatenate([[0], np.cumsum(stays)])
        offsets = before[np.concatenate([[0], ends])]
        left = pa.LargeListArray.from_arrays(pa.array(offsets), pc.list_flatten(lists).filter(pa.array(stays)))
        joined = pc.binary_join(left, pa.scalar("\n", pa.large_string())).cast(pa.string())
        names = [c for c in batch.schema.names if c not in ("text", "keep")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes), pa.array(sizes - np.diff(offsets)), joined], names=[*names, *(c.split()[0] for c in APPLIED.split(", "))])


APPLIED = "n_lines long, n_dropped long, text string"


def applied(docs: DataFrame, bitmaps: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left; the columns named in ``keep`` stand in the struct ``kept``."""
    ship(docs.sparkSession)
    kept = [F.struct(*keep).alias("kept")] if keep else []
    rows = docs.select("doc_id", *kept, *_name(), F.expr(TEXT).alias("text"))
    found = rows.join(bitmaps.select("missing", "doc", "who", "keep").hint("merge"), ["missing", "doc", "who"], "left").drop("missing", "doc", "who")
    made = T.StructType([*(f for f in found.schema.fields if f.name not in ("text", "keep")), *T._parse_datatype_string(APPLIED).fields])
    return found.mapInArrow(_kept_text, made)


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, keep: Sequence[str] = ()) -> DataFrame:
    """Every document with the lines that stay, see ``applied``. The bitmaps are stored in the shared folder in between."""
    return applied(docs, stored(keep_bitmaps(docs, least), "line-bitmaps"), keep)
