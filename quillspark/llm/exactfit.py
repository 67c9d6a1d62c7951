"""Best-fit packing with exact complements.

Every document is tokenised once and, if longer than a sequence, cut into full pieces after a shorter first one. How many
pieces there are of each length, at most ``length`` numbers whatever the corpus, decides the whole plan:

* Exact complements. Lengths are taken from the longest down. For the gap a length leaves, the index of single lengths, of
  sums of two and of sums of three lengths (hashed by their sum, among lengths still available) gives combinations that
  fill it to the last token. A combination is consumed as often as its lengths are available, larger lengths first,
  so one step plans many sequences and uses up at least one length. Every combination is searched for, in two rounds: first
  those whose largest length fills nearly the whole gap (``LEAD``), then all others among the lengths left.
* Best fit. What no combination completes is placed from the longest down into the open sequences of the smallest gap that
  takes it, many equal sequences at a time.

All combinations are kept if best fit of the rest then needs no more sequences than best fit of everything. If it does (several middling
lengths in a gap may be missing beside long pieces), as many as possible are kept in their order, and each of the others
unless it costs a sequence: no plan has more sequences than best fit has, and of two with as many the one that keeps more is taken.

The plan is a list of patterns (lengths side by side) with multiplicities. It never holds pieces: the pieces of one
length get ranks (their own in a task, plus the number in earlier tasks), and rank r of a length finds its pattern, sequence
number and place by binary search in the plan's slots. Patterns are bounded by the number of lengths, so the plan that is
broadcast is too. A length that a third of all pieces share is ranked where the pieces lie; no group of equal lengths
meets in a task.

Token ids are those of ``packing.tokenizer`` (the file's own ids, added tokens included).

Defined results: a null or empty text is one piece holding only the end id; repeated rows and rows without an id are packed one
by one; equal lengths are taken in the order of partitions and rows; very long texts are cut as any other; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packing, textops
from .shared import pin

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
# Least share of a gap that the largest length of a combination fills in the first round.
LEAD = 0.98
# ranks of one length stay below this
RANKS = 1 << 44


class Complements:
    """Available lengths, with lookups of one to three of them by their sum."""

    def __init__(self, available: np.ndarray):
        self.available = available                          # available[l]: pieces of length l left

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.available[x] -= times

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often a combination can be taken."""
        return min(int(self.available[x]) // lengths.count(x) for x in set(lengths))

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.available[total] > 0 else None

    def pair(self, total: int, longest: int) -> tuple[int, ...] | None:
        """Two lengths of at most ``longest`` with this sum, the larger as long as possible."""
        first = np.arange(min(longest, total - 1), (total + 1) // 2 - 1, -1)
        has = (self.available[first] > 0) & (self.available[total - first] > 0)
        has &= (first * 2 != total) | (self.available[first] > 1)
        at = np.flatnonzero(has)
        return (int(first[at[0]]), total - int(first[at[0]])) if len(at) else None

    def triple(self, total: int, first: int) -> tuple[int, ...] | None:
        """Three lengths with this sum, ``first`` the largest."""
        self.available[first] -= 1
        rest = self.pair(total - first, first)
        self.available[first] += 1
        return (first, *rest) if rest else None

    def filling(self, gap: int, lead: float) -> tuple[int, ...] | None:
        """One to three lengths that fill ``gap`` exactly, the largest at least its share ``lead``, as long as possible."""
        if self.available[gap] > 0:
            return (gap,)
        least = max(1, int(lead * gap))
        for first in (np.flatnonzero(self.available[least:gap] > 0)[::-1] + least).tolist():
            if 2 * first >= gap and self.available[gap - first] > (2 * first == gap):
                return (first, gap - first)
            found = self.triple(gap, first)
            if found:
                return found
        return None


def complements(index: Complements, lead: float) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, multiplicity) of exact sequences of two to four lengths; they are taken out of ``index``."""
    length = len(index.available) - 1
    out = []
    for first in range(length - 1, 0, -1):
        while index.available[first] > 0:
            index.available[first] -= 1
            rest = index.filling(length - first, lead)
            index.available[first] += 1
            if rest is None:
                break
            whole = (first, *rest)
            times = index.times(whole)
            index.take(whole, times)
            out.append((whole, times))
    return out


def plan_patterns(counts: np.ndarray, lead: float = LEAD) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, multiplicity) of sequences that hold all pieces; ``counts[l]`` pieces have length l, the last is full."""
    length = len(counts) - 1
    full = [((length,), int(counts[length]))] if counts[length] else []
    left = counts.astype(np.int64)
    left[length] = 0
    index = Complements(left.copy())
    near = complements(index, lead)
    return full + _kept(left, near, complements(index, 0.0))


def _kept(available: np.ndarray, near: list, others: list) -> list[tuple[tuple[int, ...], int]]:
    """The plan of the fewest sequences found that keeps the most of both rounds' combinations; best fit places the rest."""
    def plan(kept: list) -> tuple[int, list]:
        index = Complements(available.copy())
        for whole, times in kept:
            index.take(whole, times)
        found = kept + _best_fit(index.available, len(available) - 1)
        return sum(times for _, times in found), found

    exact = near + others
    ends = np.cumsum([times for _, times in exact], dtype=np.int64).tolist()

    def begin(many: int) -> list:
        return [(whole, min(times, many - end + times)) for (whole, times), end in zip(exact, ends) if end - times < many]

    least, found = plan(exact)
    few, best = plan([])
    low, high = 0, sum(times for _, times in exact)         # so many of the first are kept
    first = plan(near)
    if first[0] <= few:
        (few, best), low = first, sum(times for _, times in near)
    if least <= few:
        return found
    while high - low > 1:
        middle = (low + high) // 2
        least, found = plan(begin(middle))
        if least <= few:
            few, best, low = least, found, middle
        else:
            high = middle
    kept = begin(low)
    blocks = [exact[len(kept):]]                            # the others are tried together, then in halves, down to one
    while blocks:
        block = blocks.pop()
        least, found = plan(kept + block)
        if least <= few:
            few, best, kept = least, found, kept + block
        elif len(block) > 1:
            blocks += [block[len(block) // 2:], block[:len(block) // 2]]
    return best


def _best_fit(available: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of the lengths left, placed from the longest down into the smallest gap that takes them."""
    by_gap: dict[int, dict[tuple[int, ...], int]] = {}
    for x in np.flatnonzero(available)[::-1].tolist():
        left = int(available[x])
        for gap in sorted(g for g in by_gap if g >= x):
            while left and by_gap.get(gap):
                pattern, many = by_gap[gap].popitem()
                fits = gap // x                             # equal pieces go on into the sequence they have begun
                used = min(many, left // fits)
                if used:
                    _add(by_gap, gap - fits * x, pattern + (x,) * fits, used)
                elif left:
                    _add(by_gap, gap - left * x, pattern + (x,) * left, 1)
                    used, left = 1, 0
                    fits = 0
                left -= used * fits
                if many > used:
                    by_gap[gap][pattern] = by_gap[gap].get(pattern, 0) + many - used
        fits = length // x
        if left >= fits:
            _add(by_gap, length - fits * x, (x,) * fits, left // fits)
        if left % fits:
            _add(by_gap, length - left % fits * x, (x,) * (left % fits), 1)
    return [(pattern, many) for gap in sorted(by_gap) for pattern, many in by_gap[gap].items()]


def _add(by_gap: dict, gap: int, pattern: tuple[int, ...], times: int) -> None:
    own = by_gap.setdefault(gap, {})
    own[pattern] = own.get(pattern, 0) + times


def slots(patterns: list[tuple[tuple[int, ...], int]], length: int) -> dict[str, np.ndarray]:
    """Rank ranges of the plan, sorted: pieces of a length from rank ``key % RANKS`` on go to sequence ``sequence``, the
    next rank to the next one, at ``offset``."""
    used = np.zeros(length + 1, np.int64)
    key, sequence, offset = [], [], []
    base = 0
    for pattern, times in patterns:
        at = 0
        for x in pattern:
            key.append(x * RANKS + int(used[x]))
            sequence.append(base)
            offset.append(at)
            used[x] += times
            at += x
        base += times
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return {"key": np.array(key, np.int64)[order], "sequence": np.array(sequence, np.int64)[order],
            "offset": np.array(offset, np.int64)[order]}


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, length: int, with_ids: bool) -> DataFrame:
    """One row per piece, with its task and its place among the task's pieces of that length."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode = packing.tokenizer(path)
        seen = np.zeros(length + 1, np.int64)
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            for first, texts in textops.chunks(batch.column(1)):
                ids, at = encode(texts)
                ids = ids.astype("<u4")
                own = batch.column(0).slice(first, len(texts))
                total = np.diff(at) + 1
                number = -(-total // length)
                doc = np.repeat(np.arange(len(texts)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                head = total - (number - 1) * length        # the first piece is the shorter one
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * length)
                size = np.where(piece == 0, head[doc], length)
                order = np.argsort(size, kind="stable")
                many = np.bincount(size, minlength=length + 1)
                place = np.empty(len(size), np.int64)
                place[order] = np.arange(len(size)) - np.repeat(np.cumsum(many) - many, many)
                place += seen[size]
                seen += many
                raw = [ids[a:b].tobytes() for a, b in zip((at[doc] + start).tolist(), np.minimum(at[doc] + start + size, at[doc + 1]).tolist())]
                for i in np.flatnonzero(piece == number[doc] - 1).tolist():
                    raw[i] += end
                columns = [own.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size),
                           pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(np.full(len(doc), task), pa.int32()),
                           pa.array(place)]
                names = [f.split()[0] for f in PIECES_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if with_ids else []),
                                                 names=names + (["_ids"] if with_ids else []))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
               .mapInArrow(run, PIECES_SCHEMA + (", _ids binary" if with_ids else ""))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
         end_id: int = 2, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, with ``with_ids``, ``_ids``
    (the piece's ids as little-endian unsigned 32-bit numbers)."""
    path = tokenizer_path or packing.default_tokenizer()
    cut = pin(pieces(docs, id_col, text_col, path, end_id, length, with_ids))
    many = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    many = pin(many.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = np.zeros(length + 1, np.int64)
    for row in many.groupBy("length").agg(F.sum("n").alias("n")).collect():        # at most ``length`` rows
        counts[row["length"]] = row["n"]
    plan = slots(plan_patterns(counts), length)
    shipped = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches) -> Iterator[pa.RecordBatch]:
        plan = shipped.value
        for batch in batches:
            key = batch.column("length").to_numpy() * RANKS + batch.column("rank").to_numpy()
            slot = np.searchsorted(plan["key"], key, "right") - 1
            sequence = plan["sequence"][slot] + key - plan["key"][slot]
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "rank"]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(sequence), pa.array(plan["offset"][slot])], names=shown)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["_ids"] if with_ids else [])
    shown = [*kept, "sequence_id", "offset"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*kept).schema) + ", sequence_id long, offset long"
    ranked = cut.join(many.drop("n"), ["task", "length"]).select(*kept, (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, schema)
