"""Mixing sources to target weights.

Each source is a stream of its words in a fixed document order, packed into blocks of ``block_words`` words (the last
block of a source may be shorter). The mix is a sequence of output shards of ``shard_slots`` slots, each slot holding
one block. How many slots of a shard go to each source is a multinomial draw with the sources' shares, conditioned on
the totals over all shards (so a source's total is exact, not just expected): totals are halved over a binary tree of
shard ranges by multivariate hypergeometric draws seeded by the node, so any task can draw its own shard in
O(log shards) steps and a rerun draws the same. A source's slots are numbered through over the shards and mapped
through a pseudorandom permutation of its block indexes (a new one for every pass over the source); the blocks are
then joined by index.

Targets: shares by weight of the total size; a target stops at ``max_repeat`` times its source's size and the excess is
shared again by weight until none is above.

Defined results: a null text has size 0; documents of size 0 take 0; a null source is a source of its own, ordered
last; rows that repeat a document id, or have none, are separate documents (told apart by their text; rows equal in
source, id and text are interchangeable); equal ids are ordered by size, then text hash; very long texts fill many blocks;
an empty table gives no rows. The table of sources (one
row each) is read on the driver, nothing else is; it is a parameter table and raises beyond ``MAX_SOURCES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops
from .shared import WORD, trimmed

MAX_SOURCES = 100_000
# Rows of a bucket of a source's stream, on average, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4096, 1024


def water_fill(sizes: list[int], weights: list[float], max_repeat: float = 3.0) -> list[float]:
    """Targets by weight that sum to the total size, none above ``max_repeat`` times its source's size."""
    n = len(sizes)
    target = [0.0] * n
    free = [i for i in range(n) if sizes[i] > 0 and weights[i] > 0]
    left = float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit >= max_repeat * sizes[i]]
        if not full:
            for i in free:
                target[i] = weights[i] * unit
            break
        for i in full:
            target[i] = float(max_repeat * sizes[i])
            left -= target[i]
        free = [i for i in free if i not in set(full)]
    return target


def slot_totals(sizes: list[int], targets: list[float], block_words: int, max_repeat: float) -> list[int]:
    """Slots of each source: the target over the mean block length, at most ``max_repeat`` passes."""
    out = []
    for size, target in zip(sizes, targets):
        blocks = -(-size // block_words)
        out.append(min(int(max_repeat * blocks), round(target * blocks / size)) if size else 0)
    return out


def _split(rng: np.random.Generator, left: np.ndarray, want: int) -> np.ndarray:
    """Multivariate hypergeometric draw of ``want`` slots; above 10^9 slots (numpy's bound) the marginals are drawn one
    after the other from their normal approximation, whose relative error is below 1e-4 there."""
    total = int(left.sum())
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(left, want, method="marginals")
    out = np.zeros(len(left), np.int64)
    for s, here in enumerate(left.tolist()):
        share = here / total if total else 0.0
        spread = (want * share * (1 - share) * max(0, total - want) / max(1, total - 1)) ** 0.5
        draw = round(want * share + spread * rng.standard_normal())
        out[s] = min(here, want, max(draw, 0, want - (total - here)))
        want, total = want - int(out[s]), total - here
    return out


def shard_draw(totals: np.ndarray, shards: int, shard: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot number, count) of every source in one shard: halve the totals down the tree of shard ranges."""
    lo, hi = 0, shards
    first, left = np.zeros(len(totals), np.int64), totals.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        node = np.random.default_rng([seed, lo, hi])
        want = min(int(left.sum()), (mid - lo) * slots)
        part = _split(node, left, want)
        if shard < mid:
            left, hi = part, mid
        else:
            first, left, lo = first + part, left - part, mid
    return first, left


def permuted(index: np.ndarray, n: int, seed: int, source: int, turn: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 (balanced Feistel network, walked until inside the range)."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, source, turn]).integers(1, 2 ** 62, 4, dtype=np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in keys:
            f = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) & mask
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def source_table(sized: DataFrame, weight_cycle: tuple[float, ...], max_repeat: float, block_words: int) -> list[dict]:
    """One entry per source: number by code point (null last), size, weight, target, slots."""
    rows = sized.groupBy("_mx_source").agg(F.sum("_mx_size").alias("size"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r["size"]) for r in rows]
    weights = [float(weight_cycle[i % len(weight_cycle)]) for i in range(len(rows))]
    targets = water_fill(sizes, weights, max_repeat)
    slots = slot_totals(sizes, targets, block_words, max_repeat)
    return [{"source": r[0], "number": i, "size": sizes[i], "weight": weights[i], "target": targets[i],
             "slots": slots[i], "blocks": -(-sizes[i] // block_words), "rows": r["rows"]} for i, r in enumerate(rows)]


# The slots grow out of a small range inside tasks, so the optimiser underrates their size and would broadcast them:
# joins with them ask for a merge join.
def slots_table(spark: SparkSession, sources: list[dict], shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, number, block): which block fills each slot, drawn shard by shard inside tasks."""
    totals = np.array([s["slots"] for s in sources], np.int64)
    blocks = [s["blocks"] for s in sources]
    total = int(totals.sum())
    shards = max(1, -(-total // shard_slots))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, count = shard_draw(totals, shards, shard, shard_slots, seed)
                number = np.repeat(np.arange(len(totals)), count)
                block = np.empty(len(number), np.int64)
                at = 0
                for s in np.flatnonzero(count):
                    run_no = np.arange(first[s], first[s] + count[s])
                    turn = run_no // blocks[s]
                    for t in np.unique(turn):
                        m = turn == t
                        block[at:at + count[s]][m] = permuted(run_no[m] % blocks[s], blocks[s], seed, int(s), int(t))
                    at += count[s]
                order = np.random.default_rng([seed, 7, shard]).permutation(len(number))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(number), shard), pa.int64()), pa.array(np.arange(len(number)), pa.int64()),
                     pa.array(number[order], pa.int64()), pa.array(block[order], pa.int64())],
                    names=["shard", "slot", "number", "block"])
    return spark.range(shards).mapInArrow(run, "shard long, slot long, number long, block long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight_cycle: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, block_words: int = 64,
        shard_slots: int = 4096, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots).

    documents: ``id, _mx_text, _mx_row, _mx_source, _mx_size, number, source_size, target`` - one row per input row, told apart by
    id, text hash and, where both are equal, a number;
    pieces: ``id, _mx_text, _mx_row, _mx_source, number, block, from_word, to_word`` - the words of a document that lie in a block;
    slots: ``shard, slot, number, block`` - the mix; join it to the pieces on (number, block).
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col(id_col).alias("_mx_id"), F.col(source_col).cast("string").alias("_mx_source"),
                       size.alias("_mx_size"), F.xxhash64(text_col).alias("_mx_text"))
    sources = source_table(base, weight_cycle, max_repeat, block_words)
    buckets = max([LEAST_BUCKETS] + [-(-s["rows"] // BUCKET_ROWS) for s in sources])
    schema = "_mx_name string, number long, source_size long, target double"
    names = spark.createDataFrame([(s["source"], s["number"], s["size"], s["target"]) for s in sources], schema)
    # one row per source, at most MAX_SOURCES (checked above), so the hot source is not dealt to one task
    sized = base.join(F.broadcast(names), base["_mx_source"].eqNullSafe(names["_mx_name"]), "left").drop("_mx_name")
    # a source's stream is ordered by (bucket, id, size, text): bucket sums give every bucket its start, so no window sees
    # more than one bucket of a source; buckets follow id and text, so rows that share an id (or have none) spread
    sized = sized.withColumn("_mx_bucket", F.pmod(F.xxhash64("_mx_id", "_mx_text"), F.lit(buckets)))
    starts = (sized.groupBy("number", "_mx_bucket").agg(F.sum("_mx_size").alias("_mx_sum"))
                   .withColumn("_mx_start", F.sum("_mx_sum").over(
                       Window.partitionBy("number").orderBy("_mx_bucket").rowsBetween(Window.unboundedPreceding, -1)))
                   .select("number", "_mx_bucket", F.coalesce("_mx_start", F.lit(0)).alias("_mx_start")))
    w = Window.partitionBy("number", "_mx_bucket").orderBy("_mx_id", "_mx_size", "_mx_text")
    placed = (sized.join(starts, ["number", "_mx_bucket"])
                   .withColumn("_mx_from", F.col("_mx_start") + F.sum("_mx_size").over(
                       w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_mx_size"))
                   .withColumn("_mx_row", F.row_number().over(Window.partitionBy("number", "_mx_bucket", "_mx_id", "_mx_text")
                                                              .orderBy("_mx_size"))))
    documents = placed.select(F.col("_mx_id").alias(id_col), "_mx_text", "_mx_row", "_mx_source", "_mx_size", "number",
                              "source_size", "target", "_mx_from")
    b = F.lit(block_words)
    pieces = (placed.filter("_mx_size > 0")
                    .withColumn("block", F.explode(F.sequence(
                        F.floor(F.col("_mx_from") / b), F.floor((F.col("_mx_from") + F.col("_mx_size") - 1) / b))))
                    .select(F.col("_mx_id").alias(id_col), "_mx_text", "_mx_row", "_mx_source", "number", "block",
                            F.greatest(F.lit(0), F.col("block") * b - F.col("_mx_from")).alias("from_word"),
                            F.least(F.col("_mx_size"), (F.col("block") + 1) * b - F.col("_mx_from")).alias("to_word")))
    return documents, pieces, slots_table(spark, sources, shard_slots, seed)


def taken_words(documents: DataFrame, pieces: DataFrame, slots: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``documents`` with ``taken``: the words of each document that the mix holds, repeats counted."""
    uses = slots.groupBy("number", "block").agg(F.count("*").alias("_mx_uses"))
    taken = (pieces.join(uses.hint("merge"), ["number", "block"])
                   .groupBy(F.col("number").alias("_mx_n"), F.col(id_col).alias("_mx_i"), F.col("_mx_text").alias("_mx_t"),
                            F.col("_mx_row").alias("_mx_r"))
                   .agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("_mx_uses")).alias("_mx_taken")))
    on = ((documents["number"] == taken["_mx_n"]) & documents[id_col].eqNullSafe(taken["_mx_i"])
          & (documents["_mx_text"] == taken["_mx_t"]) & (documents["_mx_row"] == taken["_mx_r"]))
    return documents.join(taken, on, "left").withColumn("taken", F.coalesce("_mx_taken", F.lit(0)).cast("long")) \
        .drop("_mx_n", "_mx_i", "_mx_t", "_mx_r", "_mx_taken", "_mx_text")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The mix as documents: copy r (0, 1, ...) of a document holds, in order, its blocks that the mix uses more than r
    times, so over all copies each word stands as often as the mix takes it. Other columns are repeated as they are."""
    _, pieces, slots = mix(docs, id_col, text_col, source_col, **options)
    uses = slots.groupBy("number", "block").agg(F.count("*").alias("_mx_uses"))
    spans = (pieces.join(uses.hint("merge"), ["number", "block"])
                   .groupBy(F.col(id_col).alias("_mx_i"), F.col("_mx_text").alias("_mx_t"), "_mx_source", F.col("_mx_row").alias("_mx_r"))
                   .agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word", "_mx_uses"))).alias("_mx_spans")))
    # rows equal in source, id and text are interchangeable, so they may be numbered anew
    same = Window.partitionBy("_mx_s", id_col, "_mx_text").orderBy("_mx_s")
    numbered = docs.withColumns({"_mx_text": F.xxhash64(text_col), "_mx_s": F.col(source_col).cast("string")}) \
                   .withColumn("_mx_row", F.row_number().over(same))
    joined = numbered.join(spans, numbered[id_col].eqNullSafe(spans["_mx_i"]) & (numbered["_mx_text"] == spans["_mx_t"])
                           & numbered["_mx_s"].eqNullSafe(spans["_mx_source"]) & (numbered["_mx_row"] == spans["_mx_r"]))
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, texts = [], []
            for i, (spans_, text) in enumerate(zip(batch.column(len(columns)), batch.column(at))):
                for part in _copies((text.as_py() or "").encode(), spans_.as_py()):
                    take.append(i)
                    texts.append(part)
            take = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(take) if i != at else pa.array(texts, batch.schema.field(at).type)
                 for i in range(len(columns))], names=columns)
    return joined.select(*[numbered[c] for c in columns], "_mx_spans").mapInArrow(trimmed(run), docs.schema)


def _copies(text: bytes, spans: list[dict]) -> Iterator[str]:
    """Text of each copy: the bytes from a span's first word to just before the word after its last one."""
    starts = textops.Words([text]).starts
    for copy in range(max((s["_mx_uses"] for s in spans), default=0)):
        parts = []
        for s in spans:
            if s["_mx_uses"] > copy:
                a = starts[s["from_word"]] if s["from_word"] else 0
                b = starts[s["to_word"]] if s["to_word"] < len(starts) else len(text)
                parts.append(text[a:b])
        yield b"".join(parts).decode()
