"""Ranked lexical search with bag deduplication.

Items are ranked against all documents by a saturating term-frequency score. Only the terms of the items matter, so a document
is restricted to them: its bag holds (term number, occurrences) of item terms, and ``m`` its length in percent of the
average, tempered. Documents with the same bag and the same m score alike for every item. They form a class, which is
scored once: copies of a text, and texts that differ only in words no item has, share it.

1. One pass over the texts counts terms, looks them up among the item terms (64-bit hashes, then the bytes are compared) and
   writes per document its number of terms and its bag, and per task the document counts of the terms.
2. Documents, terms and document counts are summed; m and the term weights follow.
3. Rows are grouped by a 64-bit hash of the bag, m and the bag itself, so equal hashes are verified on whole bags. A class keeps
   its first ``k`` documents in order of id: no other member can be among an item's first k. The limit is a ranking
   filter, applied in each task before the shuffle, so a class of a third of all rows sends k rows a task.
4. Each class is scored against all items; a task keeps of each item the first k classes by score and smallest id (documents of
   later classes come after at least k others). The kept classes are expanded to their members and ranked.

Items are searched in blocks of about ``BLOCK_TERMS`` (item, term) pairs (or one longer item), so what is broadcast and what a task keeps is
bounded however many items there are; each block reads the documents once.

Defined results: a null text has no terms and does not count as a document; repeated rows are documents of their own, with
the same id; documents without an id count in the statistics and come last among equal scores; very long
texts are read whole; equal scores are ordered by id; rows with equal item id and text are one item, of rows that
share an item id but not the text each is an item; an item without terms, or whose terms no document holds, has no result;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .shared import pin

# Fixed values of the score: length share in percent, saturation, scale of a term's part and of its weight.
LENGTH_SHARE, SATURATION, PART_SCALE, WEIGHT_SCALE = 75, 8, 10 ** 9, 1000
BLOCK_TERMS = 1 << 17
# Entries that are expanded to (class, item) parts at once.
PARTS = 1 << 21
NO_ID = np.iinfo(np.int64).max
FOUND_SCHEMA = "item long, score long, doc_id long"
BAG_SCHEMA = "doc_id long, n long, bag binary, df binary"
# Terms are runs of ASCII letters and digits and of all other than ASCII characters; A-Z are lower-cased.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(texts: list[bytes]) -> textops.Words:
    """The terms of several texts, as words of the folded bytes."""
    return textops.Words([t.translate(TABLE) for t in texts])


class Vocabulary:
    """Distinct item terms, sorted by hash; ``find`` numbers the words of texts."""

    def __init__(self, terms: list[bytes]):
        terms = sorted(set(terms))
        hashes = textops.Words([b" ".join(terms)]).hashes(fold=False) if terms else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two item terms share a 64-bit hash")
        self.terms = [terms[i] for i in order.tolist()]
        size = np.fromiter(map(len, self.terms), np.int64, len(terms))
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.bytes = np.frombuffer(b"".join(self.terms), np.uint8)

    def __len__(self) -> int:
        return len(self.terms)

    def find(self, words: textops.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word index, term number) of the words that are terms."""
        hashes = words.hashes(fold=False)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        word = np.flatnonzero(self.hashes[at] == hashes)
        term = at[word]
        size = self.end[term] - self.start[term]
        same = words.ends[word] - words.starts[word] == size
        word, term, size = word[same], term[same], size[same]
        equal = np.ones(len(word), bool)
        for lo, hi in _runs(size, textops.CHUNK_BYTES):
            n = size[lo:hi]
            first = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(first, n)
            match = words.buf[np.repeat(words.starts[word[lo:hi]], n) + step] == self.bytes[np.repeat(self.start[term[lo:hi]], n) + step]
            equal[lo:hi] = np.logical_and.reduceat(match, first) if len(n) else True
        return word[equal], term[equal]


def _runs(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes add up to about ``limit``, one entry at least."""
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


class Items:
    """The items of one block: for every term the items that hold it and how often."""

    def __init__(self, vocabulary: Vocabulary, item: np.ndarray, term: np.ndarray, times: np.ndarray, count: int):
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order], times[order]
        self.first = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        self.count = count

    def score(self, owner: np.ndarray, term: np.ndarray, value: np.ndarray, classes: int) -> np.ndarray:
        """Scores (class, item) from the classes' terms and the worth of one occurrence in an item."""
        out = np.zeros(classes * self.count, np.int64)
        many = self.first[term + 1] - self.first[term]
        for lo, hi in _runs(many, PARTS):
            n = many[lo:hi]
            at = np.repeat(self.first[term[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            cell = np.repeat(owner[lo:hi], n) * self.count + self.item[at]
            part = np.repeat(value[lo:hi], n) * self.times[at]
            if len(part) and int(part.max()) < (1 << 52) // len(part):
                out += np.bincount(cell, part, len(out)).astype(np.int64)      # sums of doubles below 2^53 are exact
            else:
                np.add.at(out, cell, part)
        return out.reshape(classes, self.count)


def _bags(vocabulary: Vocabulary, id_and_text: pa.RecordBatch, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    for first, texts in textops.chunks(id_and_text.column(1)):
        words = terms_of(texts)
        n = words.count()
        word, term = vocabulary.find(words)
        owner = np.searchsorted(words.first, word, "right") - 1
        cell, tf = np.unique(owner * len(vocabulary) + term, return_counts=True)
        owner, term = cell // len(vocabulary), cell % len(vocabulary)
        df += np.bincount(term, minlength=len(df))
        pairs = np.empty((len(cell), 2), "<u4")
        pairs[:, 0], pairs[:, 1] = term, tf
        stop = np.searchsorted(owner, np.arange(len(texts) + 1)) * 8
        raw = pairs.tobytes()
        bag = [raw[a:b] for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]
        yield pa.RecordBatch.from_arrays([id_and_text.column(0).slice(first, len(texts)), pa.array(n, pa.int64()),
                                          pa.array(bag, pa.binary()), pa.nulls(len(texts), pa.binary())],
                                         names=["doc_id", "n", "bag", "df"])


def _best(score: np.ndarray, first_id: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` best scores above 0, equal ones by smallest id."""
    some = np.flatnonzero(score > 0)
    if len(some) > k:
        least = np.partition(score[some], len(some) - k)[len(some) - k]
        some = some[score[some] >= least]
    return some[np.lexsort((first_id[some], -score[some]))][:k]


def _item_terms(batches) -> Iterator[pa.RecordBatch]:
    """(item, term, times) of every item; ``item`` is the row's number."""
    for batch in batches:
        for first, texts in textops.chunks(batch.column(1)):
            words = terms_of(texts)
            owner = np.repeat(np.arange(len(texts)), words.count())
            term = [words.buf[a:b].tobytes() for a, b in zip(words.starts.tolist(), words.ends.tolist())]
            table = pa.table({"item": batch.column(0).slice(first, len(texts)).take(pa.array(owner)), "term": pa.array(term, pa.binary())})
            table = table.group_by(["item", "term"]).aggregate([([], "count_all")]).rename_columns(["item", "term", "times"])
            yield from table.to_batches()


def _block(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): the first ``k`` documents of every item of ``rows`` (item, term, times), and some more."""
    spark = docs.sparkSession
    table = rows.toArrow()                                  # at most BLOCK_TERMS terms, or those of one item
    if not table.num_rows:
        return spark.createDataFrame([], FOUND_SCHEMA)
    terms = [bytes(t) for t in table["term"].to_pylist()]
    vocabulary = Vocabulary(terms)
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    keys, item = np.unique(table["item"].to_numpy(), return_inverse=True)
    items = Items(vocabulary, item, np.fromiter((number[t] for t in terms), np.int64, len(terms)), table["times"].to_numpy(), len(keys))
    shipped = spark.sparkContext.broadcast((vocabulary, items, keys))

    def restrict(batches) -> Iterator[pa.RecordBatch]:
        vocabulary = shipped.value[0]
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            yield from _bags(vocabulary, batch, df)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                          pa.array([df.astype("<i8").tobytes()], pa.binary())], names=["doc_id", "n", "bag", "df"])

    bags = pin(docs.mapInArrow(restrict, BAG_SCHEMA))
    totals = bags.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    df = _summed(bags.filter(F.col("df").isNotNull()).select("df"), len(vocabulary))
    weight = np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    weights = spark.sparkContext.broadcast(weight)

    own = bags.filter("n > 0 and length(bag) > 0")
    length = F.lit(100 - LENGTH_SHARE) + F.expr(f"(({LENGTH_SHARE}L * n * {n_docs}L) div {max(n_terms, 1)}L)")
    rows = own.select(F.xxhash64("bag").alias("h"), length.alias("m"), "bag", "doc_id")
    order = Window.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    classes = (rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
                   .groupBy("h", "m", "bag").agg(F.collect_list(F.coalesce("doc_id", F.lit(NO_ID))).alias("members")))

    def score(batches) -> Iterator[pa.RecordBatch]:
        _, items, keys = shipped.value
        weight = weights.value
        best: list[list[tuple]] = [[] for _ in keys]        # of each item (-score, smallest id, members)
        least = np.ones(items.count, np.int64)              # score that a class needs to be among them
        for batch in batches:
            m = batch.column(0).to_numpy()
            size = np.array([len(x) // 8 for x in batch.column(1).to_pylist()], np.int64)
            members = batch.column(2).to_pylist()
            first_id = np.array([min(x) for x in members], np.int64)
            pairs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)
            at = np.cumsum(size) - size
            for lo, hi in _runs(size + items.count, PARTS):
                part = pairs[at[lo]:at[hi - 1] + size[hi - 1]]
                owner = np.repeat(np.arange(hi - lo), size[lo:hi])
                value = weight[part[:, 0]] * ((PART_SCALE * part[:, 1]) // (1000 * part[:, 1] + SATURATION * m[lo:hi][owner]))
                scores = items.score(owner, part[:, 0], value, hi - lo)
                for i in np.flatnonzero((scores >= least).any(axis=0)).tolist():
                    top = _best(scores[:, i], first_id[lo:hi], k)
                    best[i] = sorted(best[i] + [(-int(scores[j, i]), int(first_id[lo + j]), members[lo + j]) for j in top.tolist()])[:k]
                    if len(best[i]) == k:
                        least[i] = -best[i][-1][0]
        out = [(int(keys[i]), -s, d) for i, own in enumerate(best) for s, _, found in own for d in sorted(found)]
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "score", "doc_id"])
    return classes.select("m", "bag", "members").mapInArrow(score, FOUND_SCHEMA)


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the tasks' count arrays; tasks add theirs up before one array of each reaches the driver."""
    def add(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])
    found = rows.mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(width, np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Each item's ``k`` best documents: ``item_id, rank, doc_id, score``, best first, equal scores by ascending id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    asked = pin(asked.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    terms = pin(asked.select("item", "text").mapInArrow(_item_terms, "item long, term binary, times long"))
    blocks = max(1, -(-terms.count() // block_terms))
    found = None
    for b in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else terms
        part = _block(texts, rows, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", doc_id, "score")
