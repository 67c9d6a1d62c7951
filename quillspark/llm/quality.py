"""Quality rules by compression bands.

Base rules (few words, repeated word windows) come first; the verdict of the method then asks that the zstandard
ratio (bytes / compressed bytes) of the whole text, and of most of its fixed-size chunks, lies inside a band that
depends on the length: above the band the text repeats itself, below it the text is close to random.

Defined results: a null text counts as empty; a text without words fails the base rules; rows are judged one by one,
so repeated rows get the same verdict and there are no ties; very long texts are judged in all their chunks; an empty table
gives no rows; extra columns pass through ``filter_documents``
untouched and are ignored by ``metrics``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import trimmed


@dataclass(frozen=True)
class Bands:
    """Limits by text bytes: entry i holds for lengths below ``upto[i]``, the last entry for all longer texts.

    Short texts compress little whatever they hold (frame header, no history), so their bands start lower.
    Ordinary prose in alphabetic scripts lies around 1.2 (100 bytes), 1.9 (1.5 kB) and 2.2 to 2.9 (tens of kB);
    base64 stays near 1.3 and random bytes near 1 at every length.
    """
    upto: tuple[int, ...] = (64, 128, 256, 512, 1024, 2048, 4096, 8192, 32768)
    low: tuple[float, ...] = (0.0, 0.85, 0.95, 1.15, 1.25, 1.40, 1.45, 1.50, 1.50, 1.50)
    high: tuple[float, ...] = (3.0, 2.2, 2.2, 2.4, 2.6, 2.8, 3.0, 3.2, 3.5, 4.0)
    chunk_bytes: int = 2048
    chunk_low: float = 1.40
    chunk_high: float = 3.0
    bad_chunk_share: float = 0.25
    level: int = 3

    def of(self, n_bytes: int) -> tuple[float, float]:
        i = bisect.bisect_right(self.upto, n_bytes)
        return self.low[i], self.high[i]


WINDOW = 8            # words in a repeated window
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

METRICS_SCHEMA = ("{id} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                  "base_failed boolean, kept boolean, ratio double, bad_chunk_share double")


def _repeat_words(grams: np.ndarray, n_words: int) -> int:
    """Words covered by windows whose hash occurs at least twice."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams)
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _ratios(text: bytes, bands: Bands, compressor) -> tuple[float, float]:
    """(ratio of the whole text, share of full-size chunks outside the chunk band). Chunks follow each other; if a rest remains, the
    last chunk is that of the text's last bytes, so texts of at least one chunk are covered to the end."""
    if not text:
        return 0.0, 0.0
    whole = len(text) / len(compressor.compress(text))
    bad = total = 0
    size = bands.chunk_bytes
    starts = list(range(0, len(text) - size + 1, size))
    if starts and len(text) % size:
        starts.append(len(text) - size)
    for at in starts:
        r = bands.chunk_bytes / len(compressor.compress(text[at:at + bands.chunk_bytes]))
        total += 1
        bad += not bands.chunk_low <= r <= bands.chunk_high
    return whole, bad / total if total else 0.0


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: base measures, compression measures, ``base_failed`` and ``kept``."""
    table = bytes(range(256))
    def run(batches) -> Iterator[pa.RecordBatch]:
        import zstandard
        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=True)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, rows in textops.chunks(texts):
                w = textops.Words(rows)
                counts = w.count()
                hashes = w.hashes(fold=False)
                grams = textops.gram_hashes(hashes, WINDOW)
                out: dict[str, list] = {k: [] for k in ("chars", "symbols", "dups", "repeats", "failed", "kept", "ratio", "bad")}
                for i, text in enumerate(rows):
                    n, a = int(counts[i]), int(w.first[i])
                    chars = len(text.translate(None, b" \t\n\v\f\r").decode("utf-8", "surrogatepass"))
                    repeats = _repeat_words(grams[a:max(a, a + n - WINDOW + 1)], n)
                    ratio, bad = _ratios(text, bands, compressor)
                    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
                    low, high = bands.of(len(text))
                    out["chars"].append(chars)
                    out["symbols"].append(len(text) - len(text.translate(table, SYMBOLS)))
                    out["dups"].append(_dup_lines(text))
                    out["repeats"].append(repeats)
                    out["failed"].append(failed)
                    out["kept"].append(not failed and low <= ratio <= high and bad <= bands.bad_chunk_share)
                    out["ratio"].append(ratio)
                    out["bad"].append(bad)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(rows)).cast(pa.int64()), pa.array(counts, pa.int64()),
                     *[pa.array(out[k], t) for k, t in (("chars", pa.int64()), ("symbols", pa.int64()),
                                                        ("dups", pa.int64()), ("repeats", pa.int64()),
                                                        ("failed", pa.bool_()), ("kept", pa.bool_()),
                                                        ("ratio", pa.float64()), ("bad", pa.float64()))]],
                    names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept", "ratio", "bad_chunk_share"])
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")) \
        .mapInArrow(run, METRICS_SCHEMA.format(id=id_col))


def filter_documents(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that the rules keep, with all their columns; one narrow pass, no shuffle."""
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        import zstandard
        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=True)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, rows in textops.chunks(batch.column(at)):
                w = textops.Words(rows)
                grams = textops.gram_hashes(w.hashes(fold=False), WINDOW)
                for i, (n, a) in enumerate(zip(w.count(), w.first)):
                    if n < MIN_WORDS:
                        continue
                    if 100 * _repeat_words(grams[a:max(a, a + n - WINDOW + 1)], int(n)) > MAX_REPEAT_PERCENT * n:
                        continue
                    low, high = bands.of(len(rows[i]))
                    ratio, bad = _ratios(rows[i], bands, compressor)
                    keep[first + i] = low <= ratio <= high and bad <= bands.bad_chunk_share
            yield batch.filter(pa.array(keep))
    return docs.mapInArrow(trimmed(run), docs.schema)
