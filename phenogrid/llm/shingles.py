"""Word shingles of whole texts as 64-bit hashes, for the operators that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash of each word; forgets all words when it holds too many."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text: A-Z in lower case, split at ASCII white space. bytes.split and bytes.lower do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def word_hashes(text: str | None) -> np.ndarray:
    return hashes_of(words_of(text))


def shingle_sequence(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle at each word; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = mixed(out ^ (hashes[k : n - width + 1 + k] * _FACTORS[k % 8]))
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(shingle_sequence(word_hashes(text), size))


# ---------------------------------------------------------------- words as stretches of bytes, without an object per word

_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _FACTORS[0])
_BASE = 0x9FB21C651E98DF25  # odd, so it has an inverse
_BACK = pow(_BASE, -1, 1 << 64)

#: Bytes hashed at once; a longer word is hashed alone.
SLICE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_FORTH, _AWAY = _powers(_BASE, SLICE), _powers(_BACK, SLICE)


def lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word: the words of ``bytes.split``."""
    inside = ~_WHITE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial of its bytes, from differences of running sums, mixed."""
    values, out, i = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + SLICE, side="right")))
        n = int(ends[j - 1] - first)
        forth, away = (_FORTH, _AWAY) if n <= SLICE else (_powers(_BASE, n), _AWAY)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[values[first : first + n]] * forth[:n], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - first] - sums[starts[i:j] - first]) * away[starts[i:j] - first]
        i = j
    return mixed(out)


def shingles_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle at each word, from hashes that are mixed already; a shorter text is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out += hashes[k : n - width + 1 + k] * _FACTORS[k % 8]
    return mixed(out)


def sequences_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Shingle hashes of many texts, made at once; every text has at least ``size`` words."""
    joined = b" ".join(texts)
    starts, ends = word_spans(joined)
    whole = shingles_of(span_hashes(joined, starts, ends), size)
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    return [whole[a : b - size + 1] for a, b in zip(first, first[1:], strict=False)]
