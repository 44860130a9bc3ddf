"""Fill-in-middle transformation: a document's lines are cut into prefix, middle and suffix and set in another order.

Each batch goes through Arrow kernels only: texts are split into list arrays of lines, the lists are flattened with the
index of their parent, every line gets its ordinal, the lines of a role are filtered out, gathered into lists again and
joined to pieces. No line and no text becomes a Python object.

The cuts come from hashes of the doc_id, so a document is cut alike in every run and on every partitioning. A text that
holds one of the marks stays plain: only then could its output be read in two ways, so ``restored`` gives back every text.

Edge cases: null counts as empty, and an empty text stays plain with no line. A line keeps its line feed; a last line
without one is a line too. A null doc_id is hashed as the empty text, so such documents are all cut by the same draws.
Rows that repeat a doc_id are transformed each for itself; there are no ties. Very long texts need a few times their own
size in their batch. An empty table gives no rows. Columns to keep travel in one struct, so no name of theirs can clash;
the others are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.llm.common import ship


@dataclass(frozen=True)
class Rules:
    """Marks before each piece, the share of documents to transform, and the share of those that begin with the suffix."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    percent: int = 100
    spm_percent: int = 50
    seed: int = 7

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


DRAWS = 4
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(DRAWS)]


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in parts), pa.scalar("", pa.large_string()))


def lines_of(texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lines of all texts one after the other, with the index of each one's text and its ordinal in it."""
    lists = pc.split_pattern(texts, "\n")
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    sizes = pc.list_value_length(lists).to_numpy()
    ordinals = np.arange(len(parents)) - first[parents]
    last = ordinals == sizes[parents] - 1
    ended = pc.if_else(pa.array(last), flat, _joined(flat, "\n"))
    real = ~(last & (pc.binary_length(flat).to_numpy() == 0))  # what follows the last line feed is no line
    return ended.filter(pa.array(real)), parents[real], ordinals[real]


def _piece(lines: pa.Array, parents: np.ndarray, of_role: np.ndarray, texts: int) -> pa.Array:
    """The lines of one role, joined per text."""
    offsets = np.zeros(texts + 1, np.int64)
    np.cumsum(np.bincount(parents[of_role], minlength=texts), out=offsets[1:])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), lines.filter(pa.array(of_role)))
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def _transform(batch: pa.RecordBatch, rules: Rules) -> list[pa.Array]:
    texts = batch.column("text").cast(pa.large_string())
    h = [batch.column(f"h{i + 1}").to_numpy() for i in range(DRAWS)]
    lines, parents, ordinals = lines_of(texts)
    n = np.bincount(parents, minlength=len(texts)).astype(np.int64)
    cuts = np.stack([h[0] % (n + 1), h[1] % (n + 1)])
    low, high = cuts.min(axis=0)[parents], cuts.max(axis=0)[parents]
    roles = (ordinals >= low).astype(np.int8) + (ordinals >= high)
    prefix, middle, suffix = (_piece(lines, parents, roles == role, len(texts)) for role in range(3))
    plain = (n == 0) | (h[2] % 100 >= rules.percent)
    for mark in rules.marks:
        plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain, spm = pa.array(plain), pa.array(h[3] % 100 < rules.spm_percent)
    psm_text = _joined(rules.prefix, prefix, rules.suffix, suffix, rules.middle, middle)
    spm_text = _joined(rules.suffix, suffix, rules.prefix, prefix, rules.middle, middle)
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece).cast(pa.int64())) for piece in (prefix, middle)]
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
    return [pa.array(n), form, *chars, output.cast(pa.string())]


def _cut_at(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and behind a mark that occurs once in every text."""
    halves = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(halves, 0), pc.list_element(halves, 1)


def _restore(batch: pa.RecordBatch, rules: Rules) -> list[pa.Array]:
    output, form = batch.column("output").cast(pa.large_string()), batch.column("form")
    index, back = [], []
    for name, marks in (("plain", ()), ("psm", (rules.prefix, rules.suffix, rules.middle)), ("spm", (rules.suffix, rules.prefix, rules.middle))):
        at = pc.indices_nonzero(pc.equal(form, name))
        rest, found = output.take(at), {}
        for before, mark in zip((None, *marks), (*marks, None), strict=True):
            found[before], rest = _cut_at(rest, mark) if mark else (rest, rest)
        index.append(at)
        back.append(_joined(found[rules.prefix], found[rules.middle], found[rules.suffix]) if marks else found[None])
    order = pc.array_sort_indices(pa.concat_arrays(index))
    return [pa.concat_arrays(back).take(order).cast(pa.string())]


def _mapped(rows: DataFrame, made: str, make, drop: Sequence[str]) -> DataFrame:
    """``rows`` without some columns and with those that ``make`` computes from a batch."""
    ship(rows.sparkSession)
    left = [f for f in rows.schema.fields if f.name not in drop]
    new = T._parse_datatype_string(made).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in left), *make(batch)], names=[f.name for f in (*left, *new)])

    return rows.mapInArrow(run, T.StructType([*left, *new]))


def fill_in_middle(docs: DataFrame, rules: Rules = Rules(), keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output; the columns named in ``keep`` stand in the struct ``kept``."""
    kept = [F.struct(*keep).alias("kept")] if keep else []
    rows = docs.select("doc_id", *kept, F.coalesce("text", F.lit("")).alias("text"), *draws(F.col("doc_id"), rules.seed))
    return _mapped(rows, MADE, lambda batch: _transform(batch, rules), drop=("text", *(f"h{i + 1}" for i in range(DRAWS))))


def restored(made: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Add ``text``, rebuilt from ``output`` and ``form`` alone."""
    return _mapped(made, "text string", lambda batch: _restore(batch, rules), drop=())
