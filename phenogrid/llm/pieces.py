"""Encoding and decoding with a SentencePiece BPE vocabulary by a streaming Viterbi pass.

The pass keeps, for each text position, the one piece that ends there in the best path: the piece whose neighbour to the
left stays apart from it when merges run by the vocabulary's scores. A merge result depends on adjacent pieces only, so a
path is the library's own encoding exactly when all adjacent pairs hold, and each position has one such path. The window
reaches back as far as the longest piece. When the paths of all positions in it meet at one boundary, everything before
that boundary can no longer change, and its ids are committed. At a boundary that no piece of the vocabulary spans, all
paths meet at once; what lies between two such boundaries is encoded once and remembered.

Edge cases: a null text counts as empty and has no ids. Characters outside the vocabulary become the pieces of their
UTF-8 bytes. Spaces are kept as they are; one is put in front, and taken off again by decoding. Texts are streamed, so their
length sets no limit. Rows that repeat are encoded each.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import ship

SPACE = "▁"

ENCODED = "doc_id string, n_ids long, ids binary, ids_crc32 long, decoded string"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Table(dict):
    """Answers that were found before; starts again when it holds too many."""

    def __init__(self, answer: Callable, most: int = 400_000):
        super().__init__()
        self.answer, self.most = answer, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.answer(key)
        return value


class Vocabulary:
    """Pieces, their scores, byte pieces, and which pairs of adjacent pieces hold."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        plain = [i for i in range(len(self.names)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = {self.names[i]: model.get_score(i) for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.raw = {i: bytes([b]) for b, i in self.bytes.items()}
        self.hidden = {i for i in range(len(self.names)) if model.is_control(i)}
        self.longest = max(map(len, self.ids), default=1)
        self.holds = _Table(self._holds)
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, id_ in self.ids.items():
            if self.merged(piece) == [piece]:  # others never come out of merges
                self.automaton.add_word(piece, (len(piece), id_))
        self.automaton.make_automaton()

    def _holds(self, pair: int) -> bool:
        left, right = (self.names[i] for i in divmod(pair, len(self.names)))
        return self.merged(left + right) == [left, right]

    def spelled(self, character: str) -> list[int]:
        """Ids of a character that is no piece."""
        if self.bytes:
            return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored adjacent pair, the leftmost of equals, until no pair is a piece. For short strings."""
        parts = list(text)
        scores = self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class StreamingViterbi:
    """Feed a text, take committed ids. Holds a window of positions and what is not yet committed."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.back = [0]  # length of the piece that ends at each position from the last committed boundary on
        self.tail = [-1]  # and its id; -1 where a character is no piece, and at the start

    def _boundary(self) -> int:
        """Where the paths of all positions in the window meet."""
        end, back = len(self.back) - 1, self.back
        live = set(range(max(0, end - self.v.longest + 1), end + 1))
        while len(live) > 1:  # walk the path that is furthest ahead
            top = max(live)
            live.discard(top)
            live.add(top - back[top] if top else 0)
        return live.pop()

    def _take(self, boundary: int, text: str, base: int) -> list[int]:
        """Ids of the path that ends at a boundary; positions count from there afterwards."""
        out, at, back, tail = [], boundary, self.back, self.tail
        while at:
            if tail[at] >= 0:
                out.append(tail[at])
            else:
                out += reversed(self.v.spelled(text[base + at - 1]))
            at -= back[at]
        out.reverse()
        self.back, self.tail = [0, *back[boundary + 1 :]], [tail[boundary], *tail[boundary + 1 :]]
        return out

    def run(self, text: str) -> Iterator[list[int]]:
        """Pieces that end at each position come from the automaton, longest first; exactly one holds to its left."""
        holds, size, limit = self.v.holds, len(self.v.names), 4 * self.v.longest
        back, tail, base, filled = self.back, self.tail, 0, 1
        for stop, (n, id_) in self.v.automaton.iter(text):
            end = stop + 1 - base
            if filled > end:
                continue
            while filled < end:
                back.append(1)
                tail.append(-1)
                filled += 1
            left = tail[end - n]
            if left < 0 or holds[left * size + id_]:
                back.append(n)
                tail.append(id_)
                filled += 1
                if filled > limit:
                    boundary = self._boundary()
                    yield self._take(boundary, text, base)
                    back, tail, base, filled = self.back, self.tail, base + boundary, filled - boundary
        while filled <= len(text) - base:
            back.append(1)
            tail.append(-1)
            filled += 1
        yield self._take(filled - 1, text, base)
        self.back, self.tail = [0], [-1]


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str, remember: int = 300_000):
        self.v = Vocabulary(path)
        self.dtype = np.dtype("<u2") if len(self.v.names) <= 1 << 16 else np.dtype("<u4")
        self.remember = remember
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # A word starts at each space mark that follows another character, if no piece spans that place.
        self.by_word = all(SPACE not in piece.lstrip(SPACE) for piece in self.v.ids)

    def _segment(self, text: str) -> bytes:
        return np.array([i for ids in StreamingViterbi(self.v).run(text) for i in ids], self.dtype).tobytes()

    def _known(self, word: str) -> bytes:
        """Ids of a word with the space before it; no piece spans its ends."""
        ids = self.old.get(word)
        if ids is None:
            ids = self._segment(SPACE + word)
        if len(word) <= 64:
            if len(self.young) >= self.remember:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian bytes."""
        if not text:
            return b""
        if text[0] == " " or "  " in text or SPACE in text or not self.by_word:
            marked = SPACE + text.replace(" ", SPACE)
            return b"".join(map(self._segment, _WORDS.findall(marked))) if self.by_word else self._segment(marked)
        words = text.split(" ")
        out = list(map(self.young.get, words))
        for k, ids in enumerate(out):
            if ids is None:
                out[k] = self.young.get(words[k]) or self._known(words[k])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text the ids stand for."""
        v, parts, pending = self.v, [], bytearray()
        for id_ in np.frombuffer(ids, self.dtype).tolist():
            raw = v.raw.get(id_)
            if raw is not None:
                pending += raw
                continue
            if pending:
                parts.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            if id_ not in v.hidden:
                parts.append(v.names[id_])
        if pending:
            parts.append(pending.decode("utf-8", "replace"))
        text = "".join(parts).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


#: A run of space marks and the characters up to the next mark.
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path)


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_ids, ids (little-endian), ids_crc32 (of unsigned 32-bit ids), decoded text."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = c.encode(text)
                wide = np.frombuffer(ids, c.dtype).astype("<u4")
                rows.append((doc_id, len(wide), ids, zlib.crc32(wide.tobytes()), c.decode(ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids", "ids_crc32", "decoded"])

    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInPandas(run, ENCODED).withColumn("doc_id", F.col("doc_id").cast("long"))
