"""Token ids of whole texts by a byte-level BPE vocabulary of the tokenizers library.

The vocabulary splits texts before it merges, and never joins a character that is not white space with white space after
it. So a text is cut there, each piece is encoded once, and its ids are kept for the next time the piece occurs. The ids
are those of the whole text. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Python and the vocabulary's own splitter see it, taken together.
_WHITE = r"\s\x1c-\x1f\x85"
_CUT = re.compile(rf"(?<=[^{_WHITE}])(?=[ \n])")
#: A mark cut off its word where what stands before the mark is no letter or digit: the two may be one piece.
_BAD_MARK = re.compile(r" \x00(?<=[\W_] \x00)")
_DOUBLE = re.compile(rf"[{_WHITE}][{_WHITE}]")


def _single_spaced(text: str) -> bool:
    """Whether white space is single spaces and line ends only; a plain search of substrings where the text is ASCII."""
    if text.isascii():
        return not any(pair in text for pair in ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"))
    return _DOUBLE.search(text) is None


#: Words that are encoded as one text at most.
LEARN = 20_000


def default_vocabulary() -> str:
    """Path of the public vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Memory:
    """Ids of pieces in two generations: when the young one is full it becomes the old one, and what is in use comes back."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most: int):
        self.learn, self.most = learn, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, keys: list[str]) -> list[bytes]:
        """Ids of each key. A key that stands twice and is new is learned twice."""
        out = list(map(self.young.get, keys))
        places = [i for i, ids in enumerate(out) if ids is None]
        if places:
            unknown = [keys[i] for i in places]
            fresh = list(map(self.old.get, unknown))
            gaps = [j for j, ids in enumerate(fresh) if ids is None]
            for j, ids in zip(gaps, self.learn([unknown[j] for j in gaps]) if gaps else (), strict=True):
                fresh[j] = ids
            for i, ids in zip(places, fresh, strict=True):
                out[i] = ids
            if len(self.young) + len(fresh) > self.most:
                self.old, self.young = self.young, {}
            self.young.update((k, ids) for k, ids in zip(unknown, fresh, strict=True) if len(k) <= 64)
        return out


class Encoder:
    """Ids of whole texts as little-endian bytes."""

    def __init__(self, path: str, remember: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, id_ in self.tokenizer.get_vocab().items():
            widths[id_] = len(token)  # the vocabulary writes each byte as one character
        self.widths = widths
        self.words, self.pieces = _Memory(self._learn, remember), _Memory(self._direct, remember // 6)

    def _direct(self, pieces: list[str]) -> list[bytes]:
        return [np.array(done.ids, self.dtype).tobytes() for done in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, keys: list[str]) -> list[bytes]:
        """Each starts with the white space of a cut, and none ends with white space. So they can be encoded as one text,
        whose ids meet where the pieces do."""
        pieces = [k if k[:1] == "\n" else " " + k for k in keys]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.cumsum(pc.binary_length(pa.array(pieces, pa.string())).to_numpy(), dtype=np.int64)
        cuts = ((np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1) * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, keys: list[str]) -> list[bytes]:
        """Ids of keys as ``_cut`` makes them."""
        out = [b""] * len(keys)
        words = [i for i, k in enumerate(keys) if k and k[0] != "\x00" and k[-1] != "\n"]
        for at in range(0, len(words), LEARN):
            some = words[at : at + LEARN]
            for i, ids in zip(some, self._words([keys[i] for i in some]), strict=True):
                out[i] = ids
        alone = sorted(set(range(len(keys))).difference(words))
        for i, ids in zip(alone, self._direct([keys[i][1:] if keys[i][:1] == "\x00" else keys[i] if keys[i][:1] == "\n" else " " + keys[i] for i in alone]), strict=True):
            out[i] = ids
        return out

    def _cut(self, text: str) -> str:
        """Keys with a space between them. White space stands alone in the text, so every space and line end is a cut, and keys
        leave the space out. So is the place before a mark that ends a word. A key with nothing before it, as the mark and the
        text's first one, has a zero in the place of the space."""
        spaced = text.replace("\n", " \n")
        cut = (spaced + " ").replace(". ", " \x00. ").replace(", ", " \x00, ")[:-1]
        return "\x00" + (spaced if cut.startswith(" \x00") or _BAD_MARK.search(cut) else cut)

    def _joined(self, cuts: list[str]) -> list[bytes]:
        """Ids of each list of keys. Every key of a batch is looked up once, and the ids are put together by Arrow."""
        lists = pc.split_pattern(pa.array(cuts, pa.large_string()), " ")
        keys = lists.flatten().dictionary_encode()
        ids = pa.array(self.words.look_up(keys.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(keys.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset + lists.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text. Words that no text had before are learned together."""
        out: list[bytes] = []
        later: list[int] = []
        cuts: list[str] = []
        for i, text in enumerate(texts):
            if "\x00" in text or not _single_spaced(text):
                out.append(b"".join(self.pieces.look_up(_CUT.split(text))))
            else:
                out.append(b"")
                later.append(i)
                cuts.append(self._cut(text))
        for i, ids in zip(later, self._joined(cuts) if cuts else [], strict=True):
            out[i] = ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
