"""Vectorised word and shingle helpers used inside Arrow tasks.

Words are maximal runs of bytes other than ASCII white space (space, tab, newline, vertical tab, form feed,
carriage return), which for UTF-8 text is the same as the runs of such characters. A word's hash is a position-weighted
sum of per-byte random numbers modulo 2^64, finished with an avalanche step, so whole batches of documents are
hashed with a few numpy passes and no per-word Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Rows are taken from an Arrow batch until this many text bytes are reached; temporaries are about 30 times that.
CHUNK_BYTES = 1 << 20
# Words longer than this are hashed with a digest, so the table of position weights stays small.
LONG_WORD = 1 << 14
# Byte values of ASCII white space (fixed by the definition of a word).
SPACES = (9, 10, 11, 12, 13, 32)

U64 = np.uint64
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[list(SPACES)] = 0
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_WEIGHT = _rng.integers(1, 2 ** 63, LONG_WORD + 1, dtype=np.uint64) * U64(2) + U64(1)
_STEP = _rng.integers(1, 2 ** 63, 64, dtype=np.uint64) * U64(2) + U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit avalanche: every input bit changes about half of the output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 bytes of each row) for consecutive rows of about ``limit`` bytes; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]) \
        if len(texts) else np.zeros(0, np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, [x or b"" for x in texts.slice(first, i - first).to_pylist()]
            first, total = i, 0
        total += int(n)
    if first < len(texts):
        yield first, [x or b"" for x in texts.slice(first).to_pylist()]


class Words:
    """The words of several documents: byte ranges, owners and (on demand) hashes."""

    def __init__(self, docs: list[bytes]):
        self.docs = docs
        joined = b" ".join(docs) + b" "
        self.buf = np.frombuffer(joined, np.uint8)
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        self.doc_start = np.concatenate(([0], np.cumsum(lens + 1)))
        space = IS_SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(self.buf) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        # words [first[i], first[i + 1]) belong to document i
        self.first = np.searchsorted(self.starts, self.doc_start)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold: bool) -> np.ndarray:
        """One 64-bit hash per word; ``fold`` lower-cases A-Z first."""
        table = _FOLDED if fold else _BYTE
        out = np.empty(len(self.starts), np.uint64)
        lo = 0
        while lo < len(self.starts):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + 2 * CHUNK_BYTES)))
            out[lo:hi] = self._hash_range(table, fold, lo, hi)
            lo = hi
        return out

    def _hash_range(self, table: np.ndarray, fold: bool, lo: int, hi: int) -> np.ndarray:
        starts, ends = self.starts[lo:hi], self.ends[lo:hi]
        if (ends - starts).max() > LONG_WORD:
            out = np.empty(hi - lo, np.uint64)
            long = np.flatnonzero(ends - starts > LONG_WORD)
            for i in long:
                word = self.buf[starts[i]:ends[i]].tobytes()
                out[i] = int.from_bytes(hashlib.blake2b(_fold(word) if fold else word, digest_size=8).digest(), "little")
            prev = 0
            for i in [*long, hi - lo]:
                if i > prev:
                    out[prev:i] = self._hash_range(table, fold, lo + prev, lo + i)
                prev = i + 1
            return out
        base = starts[0]
        values = table[self.buf[base:ends[-1]]]
        span = np.diff(np.concatenate((starts, ends[-1:])))
        # spaces carry the value 0; their positions are clamped only to stay inside the table
        pos = np.minimum(np.arange(len(values)) - np.repeat(starts - base, span), LONG_WORD)
        values *= _WEIGHT[pos]
        return mix(np.add.reduceat(values, starts - base) + (ends - starts).astype(np.uint64))


def _fold(word: bytes) -> bytes:
    """Lower-case A-Z only."""
    return word.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (runs may cross documents: the caller masks those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _STEP[0]
    for j in range(1, k):
        out += words[j:j + n] * _STEP[j]
    return mix(out)


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each document, A-Z lower-cased.

    A document with 1 to k-1 words has its whole sequence as the only element; one without words has none.
    """
    words = w.hashes(fold=True)
    grams = gram_hashes(words, k)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            yield gram_hashes(words[a:b], int(b - a)) + U64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as Spark longs."""
    return x.view(np.int64)
