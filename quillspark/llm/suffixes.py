"""Substring dedup on suffixes sampled by a difference cover.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else in the corpus. That is a
question about neighbours in the order of all suffixes cut at ``length`` bytes: a suffix has a twin exactly if an
adjacent suffix in that order has the same first ``length`` bytes. The order is built as in difference-cover suffix
sorting, with a cover modulo v instead of modulo 3, and with names that only have to tell equal from unequal:

1. *Sort sampled tuples.* D is a difference cover modulo v: for any two positions i, j some shift below v takes both to
   sampled positions (residues in D). Tuples of w = length - v + 1 bytes at the sampled positions (about 8 % of all
   positions) are named by a 64-bit fingerprint and dealt by name; a name that occurs once is settled. Two equal strings of
   ``length`` bytes share, at that shift, one equal tuple inside them, so only suffixes that begin at most v - 1
   bytes before a repeated tuple can have a twin.
2. *Recurse on names.* The suffixes left form runs. Fingerprints of their first ``length`` bytes are the new names;
   a run is cut where the name itself says so (one in ``segment`` names), so equal stretches are cut alike, and whole
   stretches are named by the text they span. Of equal stretches only the first occurrence goes on, the others are known to
   have twins: large groups of copies shrink to one.
3. *Merge the remaining suffixes and compare adjacent prefixes.* The remaining suffixes are sorted by the name of their
   first ``length`` bytes (79 bits) and neighbours are compared.

Documents with equal texts are one class with one representative; a class with copies loses everything (if it is
``length`` bytes or longer). Before rows are shuffled, names that repeat inside a batch are reduced to one row.

Defined results: a null text is empty; texts shorter than ``length`` bytes keep everything; equal rows are copies of each
other, also when they repeat a document id; an empty table gives no rows; other columns are ignored. Removing
bytes may leave incomplete UTF-8 sequences in the rest, so the rest is returned as bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import few_rows, pin, release, shared_path

U64 = np.uint64
LENGTH = 400
SEGMENT = 64            # mean suffixes of a stretch
# A suffix row's place holds its position (48 bits) and 15 further bits of its name.
PLACE_BITS, PLACE_MASK = 48, (1 << 48) - 1
WINDOW = 1 << 18        # suffixes of one document handled at a time

_rng = np.random.default_rng(977)
_TABLES = [_rng.integers(1, 2 ** 63, 256, dtype=np.uint64) for _ in range(2)]
_BASES = [U64(int(x) * 8 + 5) for x in _rng.integers(2 ** 40, 2 ** 60, 2)]


@functools.lru_cache(maxsize=8)
def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """(v, D): a perfect difference set modulo v = p^2 + p + 1 for the largest prime p that leaves tuples of a third of
    ``length`` bytes, built from the powers of a generator of GF(p^3). A larger v samples less, but its shorter tuples
    repeat more often where no string of ``length`` bytes does."""
    spare = max(1, length // 3)
    primes = [p for p in range(2, 200) if all(p % q for q in range(2, p))]
    for p in reversed(primes):
        v = p * p + p + 1
        if v > length - spare + 1:
            continue
        for a in range(p):
            for b in range(p):
                for c in range(1, p):
                    x, found = (1, 0, 0), []           # coefficients of 1, x, x^2; multiply by x, x^3 = a x^2 + b x + c
                    for i in range(v):
                        if x[2] == 0:
                            found.append(i)
                        x = (x[2] * c % p, (x[0] + x[2] * b) % p, (x[1] + x[2] * a) % p)
                    if len(found) == p + 1 and len({(i - j) % v for i in found for j in found}) == v:
                        return v, tuple(found)
    return (3, (0, 1)) if length >= 4 else (1, (0,))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least ``n`` of each; kept for the task (``WINDOW`` bounds them)."""
    if which not in _tables or len(_tables[which][0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for base in (int(_BASES[which]), pow(int(_BASES[which]), -1, 2 ** 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _tables[which] = tuple(out)
    return _tables[which]


class Rolling:
    """Fingerprints of any byte range of a piece of text (at most ``WINDOW`` + ``span`` bytes)."""

    def __init__(self, raw: np.ndarray, which: int):
        up, self.down = _powers(len(raw) + 1, which)
        values = _TABLES[which][raw] * up[:len(raw)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))

    def __call__(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return textops.mix((self.sums[start + size] - self.sums[start]) * self.down[start])


def _windows(raw: bytes, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first byte, bytes) of overlapping parts: each suffix of at least ``span`` bytes begins in exactly one part."""
    for at in range(0, max(1, len(raw) - span + 1), WINDOW):
        yield at, np.frombuffer(raw, np.uint8)[at:at + WINDOW + span - 1]


def tuple_names(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the sampled tuples of a text."""
    v, cover = difference_cover(length)
    width = length - v + 1
    at, names = [], []
    for first, part in _windows(raw, width):
        count = min(WINDOW, len(part) - width + 1)
        if count <= 0:
            continue
        # residues count from the beginning of the text
        rows = np.arange(first // v, (first + count) // v + 1) * v
        pos = (rows[:, None] + np.array(cover)).ravel() - first
        pos = pos[(pos >= 0) & (pos < count)]
        at.append(pos + first)
        names.append(Rolling(part, 0)(pos, width))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(names)


def candidate_runs(raw: bytes, repeated: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs [a, b) of suffixes that may have a twin: those up to v - 1 bytes before a repeated tuple."""
    v, _ = difference_cover(length)
    last = len(raw) - length
    at, names = tuple_names(raw, length)
    hit = at[np.isin(names, repeated)]
    if last < 0 or not len(hit):
        return []
    a = np.maximum(0, hit - v + 1)
    b = np.minimum(hit, last) + 1
    a, b = a[a < b], b[a < b]
    if not len(a):
        return []
    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
    return list(zip(a[np.concatenate(([0], cut))].tolist(), b[np.concatenate((cut - 1, [len(b) - 1]))].tolist()))


def stretches(raw: bytes, runs: list[tuple[int, int]], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per run part: (starts, ends, key1, key2, name1, name2, first): stretches of suffixes [start, end) with the
    fingerprints of the text they span, and the names of all suffixes of the part from ``first`` on."""
    for a, b in runs:
        for lo in range(a, b, WINDOW):
            hi = min(b, lo + WINDOW)
            part = np.frombuffer(raw, np.uint8)[lo:hi + length - 1]
            roll = [Rolling(part, which) for which in (0, 1)]
            every = np.arange(hi - lo)
            n1, n2 = roll[0](every, length), roll[1](every, length)
            cut = np.flatnonzero(n1 % U64(SEGMENT) == 0)
            starts = np.unique(np.concatenate(([0], cut)))
            ends = np.append(starts[1:], hi - lo)
            size = ends - starts + length - 1
            k1 = textops.mix(roll[0](starts, size) + size.astype(np.uint64))
            k2 = textops.mix(roll[1](starts, size) ^ size.astype(np.uint64))
            yield starts + lo, ends + lo, k1, k2, n1, n2, lo


def _long(x) -> pa.Array:
    x = np.asarray(x)
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _name_rows(texts: DataFrame, length: int) -> DataFrame:
    """(name, id, twice): the distinct tuple names of every text, once per task for equal texts; ``twice`` marks those
    that the text itself repeats."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, rows in textops.chunks(batch.column(1)):
                names, owner, twice = [], [], []
                for i, raw in enumerate(rows):
                    own = ids[first + i]
                    if own in seen:
                        continue
                    if len(seen) < 200_000:        # only saves rows; a text sent twice counts the same
                        seen.add(own)
                    distinct, count = np.unique(tuple_names(raw, length)[1], return_counts=True)
                    names.append(distinct)
                    owner.append(np.full(len(distinct), own))
                    twice.append(count > 1)
                if names:
                    yield pa.RecordBatch.from_arrays(
                        [_long(np.concatenate(names)), _long(np.concatenate(owner)), pa.array(np.concatenate(twice))],
                        names=["name", "id", "twice"])
    return texts.mapInArrow(run, "name long, id long, twice boolean")


def _repeated_names(rows: DataFrame) -> DataFrame:
    """(id, names): names that another text has too or the text repeats, from comparing neighbours in the order of
    names; streams, so no group is ever held."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        last = None                       # last row of the batch before and whether it was passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            name, ids, twice = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (ids[1:] != ids[:-1])
            if last is not None:
                new[0] = (name[0], ids[0]) != last[:2]
            name, ids, keep = name[new], ids[new], twice[new].copy()
            if not len(name):
                continue
            same = name[1:] == name[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            out_n, out_i = [name[:0]], [ids[:0]]
            if last is not None and name[0] == last[0]:
                keep[0] = True
                if not last[2]:
                    out_n.append(np.array([last[0]]))
                    out_i.append(np.array([last[1]]))
            out_n.append(name[keep])
            out_i.append(ids[keep])
            last = (name[-1], ids[-1], bool(keep[-1]))
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(out_n)), _long(np.concatenate(out_i))],
                                             names=["name", "id"])
    ordered = rows.repartition("name").sortWithinPartitions("name", "id")
    return ordered.mapInArrow(run, "name long, id long").groupBy("id").agg(F.collect_set("name").alias("names"))


RUNS = "runs array<struct<start:long,end:long>>"


def _with_runs(texts: DataFrame, length: int) -> DataFrame:
    """(id, raw, copies, runs) of the (id, raw, copies, names) that have suffixes which may have a twin."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            runs = [candidate_runs(batch.column(1)[i].as_py(), np.asarray(batch.column(3)[i].values).view(np.uint64), length)
                    for i in range(batch.num_rows)]
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], kind)],
                names=["id", "raw", "copies", "runs"])
            yield out.filter(pa.array([bool(r) for r in runs], pa.bool_()))
    return texts.mapInArrow(run, "id long, raw binary, copies long, " + RUNS)


def _runs(cell) -> list[tuple[int, int]]:
    return [(r["start"], r["end"]) for r in cell.as_py()]


def _stretch_rows(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, id, start): the stretches of suffixes that may have a twin, of (id, raw, runs)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_py()
                raw = batch.column(1)[i].as_py()
                for starts, _, k1, k2, *_ in stretches(raw, _runs(batch.column(2)[i]), length):
                    yield pa.RecordBatch.from_arrays([_long(k1), _long(k2), _long(np.full(len(k1), own)), _long(starts)],
                                                     names=["k1", "k2", "id", "start"])
    return texts.mapInArrow(_joined(run), "k1 long, k2 long, id long, start long")


def _joined(fn):
    """Gather small record batches into larger ones."""
    def run(batches):
        held, rows = [], 0
        for b in fn(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return run


def _suffix_rows(texts: DataFrame, length: int) -> DataFrame:
    """(key, id, place, run): suffixes still to compare (run 0, ``place`` = 15 more bits of the name and the position)
    and runs known to have twins. ``texts`` holds (id, raw, runs, later, copied): starts of stretches that are not the
    first occurrence and of those that are first of several."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, places, lens = [], [], [], []
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_py()
                raw = batch.column(1)[i].as_py()
                runs = _runs(batch.column(2)[i])
                later = set(batch.column(3)[i].as_py() or ())
                first = set(batch.column(4)[i].as_py() or ())
                for starts, ends, _, _, n1, n2, lo in stretches(raw, runs, length):
                    known = np.array([s in later or s in first for s in starts.tolist()])
                    skip = np.array([s in later for s in starts.tolist()])
                    if known.any():
                        keys.append(textops.mix(starts[known].astype(np.uint64) + U64(own & (2 ** 63 - 1))))
                        ids.append(np.full(known.sum(), own))
                        places.append(starts[known])
                        lens.append((ends - starts)[known])
                    test = np.repeat(~skip, ends - starts)
                    pos = np.flatnonzero(test)
                    if len(pos):
                        keys.append(n1[pos])
                        ids.append(np.full(len(pos), own))
                        places.append(((n2[pos] >> U64(49)).astype(np.int64) << PLACE_BITS) | (pos + lo))
                        lens.append(np.zeros(len(pos), np.int64))
                if sum(map(len, keys)) > 200_000:
                    yield _reduced(keys, ids, places, lens)
                    keys, ids, places, lens = [], [], [], []
            if keys:
                yield _reduced(keys, ids, places, lens)
    return texts.mapInArrow(run, "key long, id long, place long, run int")


def _reduced(keys: list, ids: list, places: list, lens: list) -> pa.RecordBatch:
    """One batch of rows; of suffixes with the same name in the batch one stays to be compared, the others (and, because
    it has a twin, that one too) are known."""
    key, own, place, size = (np.concatenate(x) for x in (keys, ids, places, lens))
    open_ = np.flatnonzero(size == 0)
    order = open_[np.lexsort((place[open_], key[open_]))]
    name, more = key[order], place[order] >> PLACE_BITS
    same = (name[1:] == name[:-1]) & (more[1:] == more[:-1])
    twin = np.zeros(len(order), bool)
    twin[1:] |= same
    twin[:-1] |= same
    first = np.ones(len(order), bool)
    first[1:] = ~same
    known = order[twin]
    keep = np.concatenate((np.flatnonzero(size > 0), np.sort(order[first])))    # in text order rows compress better
    # known single suffixes become runs of neighbours
    at = place[known] & PLACE_MASK
    by = np.lexsort((at, own[known]))
    at, who = at[by], own[known][by]
    begin = np.ones(len(at), bool)
    if len(at):
        begin[1:] = (at[1:] != at[:-1] + 1) | (who[1:] != who[:-1])
    b = np.flatnonzero(begin)
    length = np.diff(np.append(b, len(at)))
    return pa.RecordBatch.from_arrays(
        [_long(np.concatenate((key[keep], textops.mix(at[b].astype(np.uint64) + who[b].astype(np.uint64))))),
         _long(np.concatenate((own[keep], who[b]))), _long(np.concatenate((place[keep], at[b]))),
         pa.array(np.concatenate((size[keep], length)), pa.int32())], names=["key", "id", "place", "run"])


def _twins(rows: DataFrame) -> DataFrame:
    """(id, spans): runs of suffixes that have a twin, after comparing neighbours in the order of names."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, place, size = (np.asarray(c) for c in batch.columns)
            more = place >> PLACE_BITS
            open_ = size == 0
            same = (key[1:] == key[:-1]) & (more[1:] == more[:-1]) & open_[1:] & open_[:-1]
            keep = ~open_
            keep[1:] |= same
            keep[:-1] |= same
            out = []
            if last is not None and open_[0] and last[3] and key[0] == last[0] and more[0] == last[2] >> PLACE_BITS:
                keep[0] = True
                if not last[4]:
                    out.append((np.array([last[1]]), np.array([last[2] & PLACE_MASK]), np.array([1])))
            out.append((ids[keep], np.where(open_[keep], place[keep] & PLACE_MASK, place[keep]),
                        np.maximum(size[keep], 1)))
            last = (key[-1], ids[-1], place[-1], bool(open_[-1]), bool(keep[-1]))
            yield pa.RecordBatch.from_arrays(
                [_long(np.concatenate([o[0] for o in out])), _long(np.concatenate([o[1] for o in out])),
                 pa.array(np.concatenate([o[2] for o in out]).astype(np.int32))], names=["id", "start", "run"])
    ordered = rows.repartition("key").sortWithinPartitions("key", "run", "place")
    return (ordered.mapInArrow(run, "id long, start long, run int")
                   .groupBy("id").agg(F.collect_list(F.struct("start", "run")).alias("spans")))


def removed_runs(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) covered by the ``length``-byte prefixes of the suffixes in (start, count) spans."""
    out: list[list[int]] = []
    for start, count in sorted(spans):
        a, b = start, start + count - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _affected(texts: DataFrame, length: int) -> DataFrame:
    """(id, n_removed, n_spans, kept) from (id, raw, spans)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py()
                runs = removed_runs([(s["start"], s["run"]) for s in batch.column(2)[i].as_py()], length)
                at, kept = 0, []
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([sum(b - a for a, b in runs)], pa.int64()),
                     pa.array([len(runs)], pa.int64()), pa.array([b"".join(kept)], pa.binary())],
                    names=["id", "n_removed", "n_spans", "kept"])
    return texts.mapInArrow(_joined(run), "id long, n_removed long, n_spans long, kept binary")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     digest: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): ``kept`` are the remaining bytes; with ``digest`` the column is
    ``kept_sha256`` instead, and texts that lose nothing are not moved at all."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    none = F.lit(-2 ** 63)
    # a text's hash stands for all its copies
    rows = (docs.select(F.col(id_col).cast("long").alias("doc"), raw.alias("raw"))
                .select("doc", F.coalesce("doc", none).alias("at"), "raw", F.xxhash64("raw").alias("id"),
                        F.xxhash64("raw", F.lit(3)).alias("id2"), F.length("raw").cast("long").alias("n_bytes")))
    classes = rows.groupBy("id", "id2", "n_bytes").agg(F.count("*").alias("copies"), F.min("at").alias("at"))
    long = rows.filter(F.col("n_bytes") >= length)
    names = pin(_repeated_names(_name_rows(long.select("id", "raw"), length))
                .join(classes.select("id", "at", "copies"), "id"))
    release(spark)
    found = few_rows(long.select("at", "id", "raw"), "at", names, "at", exact=False)
    path = shared_path(spark, "suffix-texts")
    # written once: small row numbers that stay the same stand for the texts from here on
    (_with_runs(found.join(names, ["at", "id"]).select("id", "raw", "copies", "names"), length)
     .withColumn("num", F.monotonically_increasing_id()).write.parquet(path))
    texts = spark.read.parquet(path)
    del names, found
    release(spark)
    numbered = texts.select(F.col("num").alias("id"), "raw", "runs")

    cuts = _stretch_rows(numbered, length)
    firsts = (cuts.groupBy("k1", "k2").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n"))
                  .filter("n > 1").select("k1", "k2", "first"))
    is_first = F.col("first.id").eqNullSafe(F.col("id")) & F.col("first.start").eqNullSafe(F.col("start"))
    marks = pin(cuts.join(firsts, ["k1", "k2"])
                 .groupBy("id").agg(F.collect_list(F.when(~is_first, F.col("start"))).alias("later"),
                                    F.collect_list(F.when(is_first, F.col("start"))).alias("copied")))
    del cuts, firsts
    release(spark)
    left = numbered.join(marks, "id", "left").select("id", "raw", "runs", "later", "copied")
    spans = pin(_twins(_suffix_rows(left, length))).withColumnRenamed("id", "num")
    release(spark)
    # texts that occur once; the others are settled by their number of copies
    changed = _affected(texts.filter("copies = 1").join(spans, "num").select("id", "raw", "spans"), length)
    if digest:
        changed = changed.select("id", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
        base = rows.select("doc", "id", "id2", "n_bytes", F.sha2("raw", 256).alias("own"))
        empty, kept = F.sha2(F.lit(b""), 256), "kept_sha256"
    else:
        base = rows.select("doc", "id", "id2", "n_bytes", F.col("raw").alias("own"))
        empty, kept = F.lit(b""), "kept"
    # a text that occurs twice loses everything
    copied = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    # written out, so that the join starts from plain shuffles and a large group of copies can be split over tasks
    several = pin(classes.filter("copies > 1").select("id", "id2", "n_bytes", "copies"))
    out = base.join(several, ["id", "id2", "n_bytes"], "left").join(changed, "id", "left")
    return out.select(
        F.col("doc").alias(id_col), "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, empty).otherwise(F.coalesce(kept, "own")).alias(kept))
