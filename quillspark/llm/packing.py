"""Packing documents into fixed-length token sequences: bounded-space online packing.

Each partition keeps a fixed number of open windows. A document's tokens are cut into pieces of at most ``length``; a
piece goes to the open window that it fills best (smallest remaining gap). When none fits, the fullest window is
topped up with the head of the piece and emitted full, and the rest opens in its place. What is left in the open
windows at the end of a partition is poured together into full sequences and at most one partial one; the partial
ones of all partitions are merged in a second, small step in groups of ``merge_group`` partitions, and the last rest of
a group is cut at powers of two, where a sequence needs no padding. So nothing is padded and no step gathers more than
``merge_group`` partial sequences in one task.

Token ids are those of a ``tokenizers`` byte-level BPE file at its default settings, without the special tokens of a post
processor: the file's added tokens (such as ``<|endoftext|>``) are matched in the text and give their own ids. Texts are split into that
tokenizer's units with vectorised character classes; each distinct unit is encoded once per cache lifetime with the
same vocabulary (``vocabulary``), which is several times cheaper than encoding every text; ``tests/llm`` compares the
ids with ``tokenizers`` itself.

Defined results: a null or empty text is one piece holding only the end id; repeated rows are packed one by one and
keep their order in the partition; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import trimmed

PIECES_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# White space by the Unicode property (fixed values), which the tokenizer's pattern uses.
UNICODE_SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                  0x3000)
# Contractions that stand alone in the tokenizer's pattern (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
CACHE_UNITS = 400_000
# Unit split pattern of the vocabulary, only used for single units (already split).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    """Encoder of single units from the vocabulary and merges of a byte-level BPE ``tokenizers`` file."""
    import json

    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable}
    to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def added_tokens(path: str) -> dict[bytes, int]:
    """Id of every token that is matched in the text before it is split into units."""
    import json
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    return {t["content"].encode(): t["id"] for t in added}


class Tokenizer:
    """Ids of many texts at once; keeps the ids of units seen before (bounded).

    With ``added`` the file's added tokens are matched in the texts, else they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        self.encode = _encoder(path)
        self.added = added_tokens(path) if added else {}
        self.split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")")
        self.classes = np.full(0x110000, 255, np.uint8)
        self.classes[list(UNICODE_SPACES)] = SPACE
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _class(self, points: np.ndarray) -> np.ndarray:
        out = self.classes[points]
        if (out == 255).any():
            import regex
            letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
            for p in np.unique(points[out == 255]):
                c = chr(p)
                self.classes[p] = LETTER if letter.match(c) else NUMBER if number.match(c) else OTHER
            out = self.classes[points]
        return out

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mask of the code points that begin a unit; ``first`` marks the first code point of each text."""
        kind = self._class(points)
        n = len(points)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= first
        # a run of white space leaves its last code point to what follows in the same text: a plain space joins the
        # next unit, anything else becomes a unit of its own
        space = kind == SPACE
        ends = space.copy()
        ends[:-1] &= ~space[1:] & ~first[1:]
        ends[-1:] = False
        last = np.flatnonzero(ends)
        start[last] = True
        joins = last[points[last] == 32]
        start[joins + 1] = False
        # contractions: an apostrophe that begins a unit and is followed at once by one of the endings
        quote = np.flatnonzero((points == 39) & start)
        for ending in sorted(CONTRACTIONS, key=len):
            m = quote[quote + len(ending) < n]
            for j, c in enumerate(ending, 1):
                m = m[(points[m + j] == ord(c)) & ~first[m + j]]
            start[m + 1] = False
            after = m + len(ending) + 1
            after = after[after < n]
            start[after] = True
            quote = np.setdiff1d(quote, m, assume_unique=True)
        return start

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, first id of each text and the end)."""
        if not any(token in text for token in self.added for text in texts):
            return self._ordinary(texts)
        segments = [self.split.split(text) for text in texts]        # every second segment is an added token
        which = np.array([self.added[x] if i % 2 else -1 for own in segments for i, x in enumerate(own)], np.int64)
        ids, at = self._ordinary([b"" if i % 2 else x for own in segments for i, x in enumerate(own)])
        token = np.flatnonzero(which >= 0)
        size = np.diff(at)
        size[token] = 1
        stop = np.concatenate(([0], np.cumsum(size)))
        text = np.concatenate(([0], np.cumsum([len(own) for own in segments])))
        return np.insert(ids, at[token], which[token].astype(np.uint32)), stop[text]

    def _ordinary(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(texts)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        raw = np.frombuffer(joined, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)       # first byte of every code point
        points = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(points), bool)
        at = np.searchsorted(lead, offsets[:-1])
        first[at[at < len(points)]] = True
        begin = lead[self._starts(points, first)]
        end = np.append(begin[1:], len(raw))
        hashes = self._unit_hashes(raw, begin, end)
        slot = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = slot < len(self.known)
        new[inside] = self.known[slot[inside]] != hashes[inside]
        if new.any():
            if len(self.known) > CACHE_UNITS:
                self._reset()
                new[:] = True
            self._learn(joined, hashes[new], begin[new], end[new])
            slot = np.searchsorted(self.known, hashes)
        size = self.size[slot]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[slot] - (stop - size), size) + np.arange(stop[-1])]
        unit = np.searchsorted(begin, offsets)
        return ids, np.concatenate(([0], stop))[unit]

    def _unit_hashes(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        span = end - begin
        pos = np.minimum(np.arange(len(raw)) - np.repeat(begin, span), textops.LONG_WORD)
        values = (raw.astype(np.uint64) + np.uint64(1)) * textops._WEIGHT[pos]
        values ^= values >> np.uint64(29)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        out = textops.mix(np.add.reduceat(values, begin) + span.astype(np.uint64))
        for i in np.flatnonzero(span > textops.LONG_WORD):
            import hashlib
            out[i] = int.from_bytes(hashlib.blake2b(raw[begin[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def _learn(self, joined: bytes, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        hashes, at = np.unique(hashes, return_index=True)
        encode = self.encode
        ids = [encode(joined[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(begin[at].tolist(), end[at].tolist())]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))
        start = len(self.ids) + np.concatenate(([0], np.cumsum(size)[:-1]))
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate((self.at, start))[order]
        self.size = np.concatenate((self.size, size))[order]
        self.ids = np.concatenate((self.ids, flat))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path, added=True)


class Windows:
    """Open windows of one task; a piece is (doc, start, ids crc or bytes, length, doc_tokens)."""

    def __init__(self, length: int, keep: int):
        self.length, self.keep = length, keep
        self.open: list[tuple[int, list]] = []          # (filled, pieces)
        self.full: list[list] = []

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            if len(ids) >= self.length:
                self.full.append([(doc, start, ids[:self.length], total)])
                start, ids = start + self.length, ids[self.length:]
                continue
            best = -1
            for i, (filled, _) in enumerate(self.open):
                if filled + len(ids) <= self.length and (best < 0 or filled > self.open[best][0]):
                    best = i
            if best < 0 and len(self.open) < self.keep:
                self.open.append((len(ids), [(doc, start, ids, total)]))
                return
            if best < 0:                                # none fits: top up the fullest and emit it
                best = max(range(len(self.open)), key=lambda i: self.open[i][0])
                room = self.length - self.open[best][0]
            else:
                room = len(ids)
            filled, pieces = self.open[best]
            pieces.append((doc, start, ids[:room], total))
            if filled + room == self.length:
                self.full.append(pieces)
                self.open.pop(best)
            else:
                self.open[best] = (filled + room, pieces)
            start, ids = start + room, ids[room:]

    def pour(self) -> list:
        """Pour the open windows into full ones, in order of fill; returns the pieces of the last, partial one."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open = []
        now, filled = [], 0
        for doc, start, ids, total in rest:
            while len(ids):
                room = min(len(ids), self.length - filled)
                now.append((doc, start, ids[:room], total))
                start, ids, filled = start + room, ids[room:], filled + room
                if filled == self.length:
                    self.full.append(now)
                    now, filled = [], 0
        return now


def powers_of_two(pieces: list) -> Iterator[list]:
    """Cut a partial sequence into sequences whose lengths are the powers of two of its binary form."""
    left = sum(len(p[2]) for p in pieces)
    now, filled = [], 0
    want = 1 << (left.bit_length() - 1) if left else 0
    for doc, start, ids, total in pieces:
        while len(ids):
            room = min(len(ids), want - filled)
            now.append((doc, start, ids[:room], total))
            start, ids, filled = start + room, ids[room:], filled + room
            if filled == want:
                yield now
                left -= filled
                now, filled = [], 0
                want = 1 << (left.bit_length() - 1) if left else 0


def _batch(sequences: list[tuple[int, list]], ids: bool, group: int | None = None) -> pa.RecordBatch:
    """Rows of the pieces of (sequence id, pieces); with ``ids`` the token ids ride along as bytes."""
    doc, start, length, crc, total, seq, offset, raw = ([] for _ in range(8))
    for number, pieces in sequences:
        at = 0
        for d, s, x, n in pieces:
            data = x.tobytes()
            doc.append(d), start.append(s), length.append(len(x)), crc.append(zlib.crc32(data)), total.append(n)
            seq.append(number), offset.append(at), raw.append(data if ids else None)
            at += len(x)
    long = lambda v: pa.array(v, pa.int64())
    return pa.RecordBatch.from_arrays(
        [long(doc), long(start), long(length), long(crc), long(total), long(seq), long(offset),
         pa.array(raw, pa.binary()), pa.array([group] * len(doc), pa.int64())],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "_ids", "_group"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
         end_id: int = 0, length: int = 1024, open_windows: int = 32, merge_group: int = 64,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with ``with_ids``,
    ``_ids`` (the piece's ids as little-endian unsigned 32-bit numbers)."""
    path = tokenizer_path or default_tokenizer()

    def run(batches) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = tokenizer(path)
        windows = Windows(length, open_windows)
        done = 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for first, rows in textops.chunks(batch.column(1)):
                ids, at = encode(rows)
                for i, doc in enumerate(batch.column(0).slice(first, len(rows)).to_pylist()):
                    own = np.concatenate((ids[at[i]:at[i + 1]], end))
                    windows.place(doc, 0, own, len(own))
                out = [((part << 40) + done + j, s) for j, s in enumerate(windows.full)]
                done += len(out)
                windows.full = []
                if out:
                    yield _batch(out, with_ids)
        rest = windows.pour()
        out = [((part << 40) + done + j, s) for j, s in enumerate(windows.full)]
        if out:
            yield _batch(out, with_ids)
        if rest:
            yield _batch([(part, rest)], True, part // merge_group)

    def merge(batches) -> Iterator[pa.RecordBatch]:
        """Full sequences pass; the partial ones of a group, which arrive sorted together, are poured into each other."""
        def close(group, rest):
            windows = Windows(length, 1)
            windows.open = [(0, rest)]
            last = windows.pour()
            sequences = windows.full + list(powers_of_two(last))
            return _batch([((1 << 62) + (group << 30) + j, s) for j, s in enumerate(sequences)], with_ids).select(shown)
        group, rest = None, []
        for batch in batches:
            partial = batch.column("_group").is_valid()
            whole = batch.filter(pc.invert(partial))
            if whole.num_rows:
                yield whole.select(shown)
            for r in batch.filter(partial).to_pylist():
                if group is not None and r["_group"] != group:
                    yield close(group, rest)
                    rest = []
                group = r["_group"]
                rest.append((r["doc_id"], r["start"], np.frombuffer(r["_ids"], np.uint32), r["doc_tokens"]))
        if rest:
            yield close(group, rest)

    out = PIECES_SCHEMA + (", _ids binary" if with_ids else "")
    shown = [f.split()[0] for f in out.split(", ")]
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(trimmed(run), PIECES_SCHEMA + ", _ids binary, _group long")
    # rows are small (no texts, no ids but those of one partial sequence per partition), so all of them are dealt out
    # and the tokens are computed once
    dealt = packed.repartition(F.coalesce("_group", "sequence_id"), F.col("_group").isNull())
    return dealt.sortWithinPartitions("_group", "sequence_id", "offset").mapInArrow(trimmed(merge), out)
