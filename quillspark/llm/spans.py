"""Substring dedup by sliding sentence spans.

Every run of ``span`` consecutive sentences of a document with at least ``min_words`` words is hashed, and with ``grow``
also every longer one that just reaches them (sentences trimmed, white space collapsed, A-Z lower-cased). Runs of the
whole corpus meet by hash; the first occurrence (smallest document id, then position) stays and the sentences covered by
any other occurrence are removed.

Sentences end after ``.``, ``!`` or ``?`` (with closing quotes or brackets) before white space, after the end marks of
other scripts, and at line ends, so a passage finds the same boundaries wherever it stands. Sentences of more than
``LONG_SENTENCE`` words are cut at content-defined points into parts that count as sentences: a repeat inside one sentence
is found from about 50 words on (at worst; its first and last ``2 * CUT_WINDOW`` words may stay). A character of a script
without spaces counts as a word.

Only (hash, id, position) rows are shuffled. The first occurrence per hash is a partial aggregate (minimum and count), so a
passage shared by a third of all documents reaches its task already reduced; the repeated hashes are written out, most
other rows are dropped by a Bloom filter of them, and the rest is joined in plain shuffles, which adaptive execution can
split at a frequent hash.

Defined results: a null or empty text has no sentences and stays empty; documents with fewer sentences than a span lose
nothing; a document without words is unchanged; equal rows count as one document and stay alike, other rows that
repeat a document id are documents of their own; an empty table gives no rows; extra columns
pass through unchanged (helper columns start with ``_sp_``).
"""

from __future__ import annotations

import array
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import pin, release, shuffles_dropped

# End marks and closing quotes or brackets beyond ASCII, and characters of scripts written without spaces (kana, Han, Thai,
# Lao, Tibetan, Burmese, Khmer, full-width forms); fixed values.
END_MARKS, CLOSE_MARKS = "。！？．｡।॥؟۔።፧။។։‼⁇⁈⁉", "」』）】》〉”’»"
ENDS, CLOSES = (b"|".join(c.encode() for c in x) for x in (END_MARKS, CLOSE_MARKS))
WIDE = (rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbf][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]"
        rb"|\xef[\xa4-\xab\xbc-\xbe][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}")
# A sentence with the white space after it (if any): up to an end mark before white space, or a line end.
SENTENCE = re.compile(rb"[^\n]*?[.!?][\"')\]]*(?:[ \t\r\f\v]+|(?=\n)|\Z)|[^\n]+|\n+")
# The same for texts with other marks, which end a sentence whatever follows; equal to the above where there are none.
BEYOND_ASCII = re.compile(ENDS + b"|" + CLOSES)
SENTENCE_BEYOND = re.compile(rb"[^\n]*?(?:[.!?](?:[\"')\]]|" + CLOSES + rb")*(?:[ \t\r\f\v]+|(?=\n)|\Z)|(?:" + ENDS
                             + rb")(?:[.!?\"')\]]|" + ENDS + b"|" + CLOSES + rb")*[ \t\r\f\v]*)|[^\n]+|\n+")
# First bytes of all those marks, quotes and characters.
LEADS = re.compile(b"[" + bytes(sorted({c.encode()[0] for c in END_MARKS + CLOSE_MARKS} | {0xE0, 0xE1, 0xEF, 0xF0})) + b"\xe3-\xe9]")
# What counts as a word: a character of those scripts, or a run of others between white space.
HAS_WIDE = re.compile(WIDE)
WIDE_UNIT = re.compile(WIDE + rb"|(?:(?!" + WIDE + rb")[^ \t\n\r\f\v])+")
# Sentences with more words are cut; the cuts are the smallest word hashes of every CUT_WINDOW consecutive words, so two
# copies of a passage share the cuts more than that far from its ends, and no piece is longer.
LONG_SENTENCE, CUT_WINDOW = 16, 8

# Classes of bytes: end marks, closing quotes and brackets, white space inside a line, line ends.
MARK, CLOSE, BLANK, LINE_END = 1, 2, 3, 4
KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in ((MARK, b".!?"), (CLOSE, b"\"')]"), (BLANK, b" \t\r\f\v"), (LINE_END, b"\n")):
    KINDS[list(_bytes)] = _kind

# Largest filter of repeated hashes that is built on the driver; it only saves shuffles, the join is exact.
FILTER_BITS = 1 << 24


class Parts:
    """The sentences of several texts and the parts of their long ones.

    ``first`` word, ``begin`` and ``end`` byte (in the own text) of each part, ``whole`` where a sentence ends with it; text i
    has the parts ``of[i]`` to ``of[i + 1]``. Texts are looked at together, byte by byte with array operations; only those
    with other scripts' marks are split one by one. Both rules agree where there are none.
    """

    def __init__(self, texts: list[bytes]):
        segments: list[bytes] = []                      # whole texts, or the pieces of texts split one by one
        owner: list[int] = []
        split: list[bool] = []
        for i, text in enumerate(texts):
            pieces = _pieces_beyond(text)
            segments += [text] if pieces is None else pieces
            count = 1 if pieces is None else len(pieces)
            owner += [i] * count
            split += [pieces is not None] * count
        self.words = w = textops.Words(segments)        # joined by one space each
        self._hashes = None
        owner, split = np.array(owner, np.int64), np.array(split, bool)
        seg_start, seg_end = w.doc_start[:-1], w.doc_start[1:] - 1
        size = seg_end - seg_start
        # byte of the own text at which a segment begins
        before = np.cumsum(size) - size
        text_first = np.searchsorted(owner, np.arange(len(texts)))
        offset = before - (before[np.minimum(text_first, len(before) - 1)][owner] if len(owner) else before)
        edges = _boundaries(w.buf, seg_start, seg_end)
        where = np.searchsorted(seg_start, edges, "right") - 1
        edges = edges[~split[where] | (edges == seg_start[where])]
        where = np.searchsorted(seg_start, edges, "right") - 1
        stop = np.minimum(np.append(edges[1:], len(w.buf)), seg_end[where])
        # pieces with words
        piece = np.searchsorted(edges, w.starts, "right") - 1
        at, first, count = np.unique(piece, return_index=True, return_counts=True)
        long = count > LONG_SENTENCE
        begin, end, whole = edges[at], stop[at], np.ones(len(at), bool)
        if long.any():
            run = np.repeat(np.arange(len(at)), count)
            i = np.flatnonzero((run[:-CUT_WINDOW + 1] == run[CUT_WINDOW - 1:]) & long[run[:-CUT_WINDOW + 1]])
            keys = np.lib.stride_tricks.sliding_window_view(self.hashes(), CUT_WINDOW)[i]
            more = np.unique(i + CUT_WINDOW - 1 - keys[:, ::-1].argmin(axis=1))
            more = more[first[run[more]] != more]
            order = np.argsort(np.concatenate((first, more)), kind="stable")
            same = np.concatenate((np.arange(len(at)), run[more]))[order]
            first = np.concatenate((first, more))[order]
            begin = np.concatenate((begin, w.starts[more]))[order]
            whole = np.append(same[1:] != same[:-1], True)
            end = np.where(whole, end[same], np.append(begin[1:], 0))
        self.first, self.whole = first, whole
        where = np.searchsorted(seg_start, begin, "right") - 1
        self.begin = begin - seg_start[where] + offset[where]
        self.end = end - seg_start[where] + offset[where]
        self.of = np.searchsorted(owner[where], np.arange(len(texts) + 1))

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.words.hashes(fold=True)
        return self._hashes


def _pieces_beyond(text: bytes) -> list[bytes] | None:
    """Pieces of a text that needs the rules for other scripts; None for the rest."""
    if text.isascii() or not LEADS.search(text):
        return None
    marks, wide = BEYOND_ASCII.search(text), HAS_WIDE.search(text)
    if not marks and not wide:
        return None
    pieces = (SENTENCE_BEYOND if marks else SENTENCE).findall(text)
    return [x for p in pieces for x in (cut(p) if HAS_WIDE.search(p) else (p,))] if wide else pieces


def _boundaries(buf: np.ndarray, seg_start: np.ndarray, seg_end: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin: segment starts, both ends of line ends, and after the white space that follows an end mark
    with its closing quotes or brackets. Equal to ``SENTENCE`` applied to every segment."""
    kind = KINDS[buf]
    kind[seg_end[seg_end < len(kind)]] = LINE_END           # the joining spaces
    line = kind == LINE_END
    edge = np.flatnonzero(line[1:] != line[:-1]) + 1
    mark = np.flatnonzero(kind == MARK)
    no_close = np.flatnonzero(kind != CLOSE)
    after = no_close[np.searchsorted(no_close, mark + 1)]
    after = after[kind[after] == BLANK]
    no_blank = np.flatnonzero(kind != BLANK)
    after = no_blank[np.searchsorted(no_blank, after)]
    return np.unique(np.concatenate((seg_start, edge, after)))


def sentences(text: bytes) -> list[bytes]:
    """Pieces whose concatenation is the text; pieces without words are separators."""
    p = Parts([text])
    out, done = [], 0
    for a, b in zip(p.begin.tolist(), p.end.tolist()):
        out += [text[done:a]] * (a > done) + [text[a:b]]
        done = b
    return out + [text[done:]] * (done < len(text))


def cut(piece: bytes) -> list[bytes]:
    """A sentence with characters of scripts without spaces in parts, if it is long; cuts as for plain words."""
    starts, keys = array.array("q"), array.array("L")
    for m in WIDE_UNIT.finditer(piece):
        starts.append(m.start())
        keys.append(zlib.crc32(m.group().lower()))
    if len(starts) <= LONG_SENTENCE:
        return [piece]
    windows = np.lib.stride_tricks.sliding_window_view(np.asarray(keys), CUT_WINDOW)
    last = np.arange(len(windows)) + CUT_WINDOW - 1 - windows[:, ::-1].argmin(axis=1)
    at = np.asarray(starts)[np.unique(last[last > 0])].tolist()
    return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)])]


def word_counts(w: textops.Words) -> np.ndarray:
    """What each word counts: 1, or its characters of scripts without spaces."""
    out = np.ones(len(w.starts), np.int64)
    b = w.buf
    lead = np.flatnonzero(b[:-1] >= 0xE0)
    if len(lead):
        x, y = b[lead], b[lead + 1]
        wide = np.zeros(len(b) + 1, np.int64)
        wide[lead + 1] = ((x >= 0xE3) & (x <= 0xE9) | (x == 0xE0) & (y >= 0xB8)
                          | (x == 0xE1) & ((y <= 0x82) | (y == 0x9E) | (y == 0x9F))
                          | (x == 0xEF) & ((y >= 0xA4) & (y <= 0xAB) | (y >= 0xBC) & (y <= 0xBE)) | (x == 0xF0) & (y >= 0xA0))
        wide = np.cumsum(wide)
        out = np.maximum(out, wide[w.ends] - wide[w.starts])
    return out


def span_hashes(p: Parts, span: int, min_words: int, grow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of the spans of texts; a place is the number of the text's first sentence << 16 | sentences.

    A span grows from ``span`` sentences until it has ``min_words`` words: from every first one onwards and from every end
    of a sentence backwards, so a passage loses neither its head nor its tail. Without ``grow`` only those that need not
    grow count. Spans stay inside their text.
    """
    n = len(p.first)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = p.hashes()
    count = np.diff(np.append(p.first, len(words)))
    order = np.arange(len(words), dtype=np.int64) - np.repeat(p.first, count)
    each = np.add.reduceat(textops.mix(words + order.astype(np.uint64) * textops._STEP[40]), p.first)
    each = textops.mix(each + count.astype(np.uint64))
    total = np.concatenate(([0], np.cumsum(np.add.reduceat(word_counts(p.words), p.first))))
    first, last = np.arange(n), np.arange(n) + 1
    text = np.repeat(np.arange(len(p.of) - 1), np.diff(p.of))
    low, high = p.of[text], p.of[text + 1]
    stop = np.maximum(np.searchsorted(total, total[:-1] + min_words), first + span)
    start = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, last - span)
    ahead, back = stop <= high, p.whole & (start >= low)
    size = np.concatenate(((stop - first)[ahead], (last - start)[back]))
    place = np.unique(np.concatenate((first[ahead], start[back])) << 16 | size)
    if not grow:
        place = place[place & 0xFFFF == span]
    start, size = place >> 16, place & 0xFFFF
    # differences of prefix sums of each sentence's hash times a power of an odd number, moved to power 0
    power = np.cumprod(np.full(n, textops._STEP[0], np.uint64))
    inverse = np.cumprod(np.full(n, pow(int(textops._STEP[0]), -1, 1 << 64), np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * power)))
    hashes = textops.mix((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64) * textops._STEP[1])
    return hashes, text[start], (start - low[start]) << 16 | size


SPANS = "hash long, id long, doc long, pos long, n long"


def span_rows(docs: DataFrame, id_col: str, text_col: str, span: int, min_words: int, grow: bool, wanted=None,
              counts: bool = False) -> DataFrame:
    """(hash, id, doc, pos) of every span; ``doc`` is the text's hash, ``pos`` the place in it.

    ``wanted`` (a broadcast filter) leaves out most spans whose hash is not in it; with ``counts`` every document has one
    more row, without a place, with its number ``n`` of sentences.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in textops.chunks(batch.column(1)):
                ids, own = batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts))
                parts = Parts(texts)
                hashes, text, place = span_hashes(parts, span, min_words, grow)
                if wanted is not None:
                    some = np.flatnonzero(likely(wanted.value, hashes))
                    hashes, text, place = hashes[some], text[some], place[some]
                rows, none = pa.array(text), pa.nulls(len(text), pa.int64())
                out = [[pa.array(hashes.view(np.int64)), ids.take(rows), own.take(rows), pa.array(place), none]]
                if counts:                              # their hashes only spread them
                    n = len(texts)
                    spread = textops.mix(np.arange(n, dtype=np.uint64) * textops._STEP[2] + np.asarray(own).view(np.uint64))
                    out.append([pa.array(spread.view(np.int64)), ids, own, pa.nulls(n, pa.int64()), pa.array(np.diff(parts.of))])
                for columns in out:
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SPANS.split(", ")])
    # the hash of a null text is that of none, so it is never null
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("doc"))
    return rows.mapInArrow(run, SPANS)


def _bits(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [textops.mix(hashes ^ textops._STEP[10 + j]) % np.uint64(bits) for j in range(3)]


def likely(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through: all that are in it and a few others."""
    out = np.ones(len(hashes), bool)
    for x in _bits(hashes, len(table) * 64):
        out &= (table[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1
    return out


def hash_filter(hashes: DataFrame, most_bits: int):
    """Broadcast Bloom filter of a hash column, of at most ``most_bits`` bits; tasks build parts of it that are joined by OR."""
    bits = min(most_bits, 1 << max(10, (16 * hashes.count()).bit_length()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for x in _bits(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(table, (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], names=["word", "bits"])
    found = hashes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 2,
                   min_words: int = 8, grow: bool = False, counts: bool = False) -> DataFrame:
    """(id, doc, spans): places of the non-first occurrences of repeated spans, by document.

    With ``counts`` all documents and their number of sentences, ``spans`` empty for those without.
    """
    rows = span_rows(docs, id_col, text_col, span, min_words, grow)
    place = F.struct("id", "doc", "pos")
    with shuffles_dropped(docs.sparkSession):   # the shuffle of all spans is not needed beside the later ones
        first = pin(rows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                        .filter("not first <=> last").select("hash", "first"))
    release(docs.sparkSession)
    some = span_rows(docs, id_col, text_col, span, min_words, grow, hash_filter(first.select("hash"), FILTER_BITS), counts)
    again = some.join(first, "hash", "left") if counts else some.join(first, "hash")
    later = F.when(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")), F.col("pos"))
    again = again.select("id", "doc", later.alias("pos"), "n").filter("pos is not null or n is not null")
    return again.groupBy(F.col("id").alias("_sp_id"), F.col("doc").alias("_sp_doc")) \
                .agg(F.collect_set("pos").alias("_sp_spans"), F.max("n").alias("_sp_n"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 2,
                    min_words: int = 8, counts: bool = False, grow: bool = False) -> DataFrame:
    """The documents without the sentences of repeated spans; with ``counts`` also ``n_sentences, n_removed``."""
    gone = repeated_spans(docs, id_col, text_col, span, min_words, grow, counts)
    joined = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_sp_id"])
                       & (F.xxhash64(docs[text_col]) == gone["_sp_doc"]), "left")
    columns = docs.columns
    at = columns.index(text_col)
    fields = list(docs.schema.fields)
    if counts:
        fields += [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(columns))
            texts = batch.column(at)
            size = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            lost = np.zeros(len(size), np.int64)
            kept: dict[int, str] = {}
            some = np.flatnonzero(size)
            for part in np.array_split(some, max(1, -(-len(some) // 64))):
                raws = [texts[i].as_py().encode("utf-8", "surrogatepass") for i in part.tolist()]
                parts = Parts(raws) if raws else None
                for j, (i, raw) in enumerate(zip(part.tolist(), raws)):
                    lo, hi = parts.of[j], parts.of[j + 1]
                    place = np.array(spans[i].as_py())
                    cover = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(cover, place >> 16, 1)
                    np.add.at(cover, (place >> 16) + (place & 0xFFFF), -1)
                    drop = np.cumsum(cover)[:-1] > 0
                    lost[i] = drop.sum()
                    ends = [0, *parts.end[lo:hi][drop].tolist()]
                    left = b"".join(raw[a:b] for a, b in zip(ends, [*parts.begin[lo:hi][drop].tolist(), len(raw)]))
                    kept[i] = left.decode("utf-8", "surrogatepass")
            new = pc.fill_null(texts, "")
            if kept:
                new = pa.array([kept.get(i, x) for i, x in enumerate(new.to_pylist())], batch.schema.field(at).type)
            out = [batch.column(i) if i != at else new for i in range(len(columns))]
            if counts:
                out += [batch.column(len(columns) + 1), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])
    return joined.select(*[docs[c] for c in columns], "_sp_spans", "_sp_n").mapInArrow(run, T.StructType(fields))
