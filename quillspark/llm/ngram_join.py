"""N-gram Jaccard join by parity sketches.

Every document is the set of hashes of its k-word shingles. Two sets A, B with Jaccard similarity of at least
``num/den`` differ in at most d(|A|, |B|) = floor((|A| + |B|) (den - num) / (den + num)) elements. A parity sketch is a
bit array in which every element flips the bit its hash points at; the Hamming distance of two sketches is never above
the size of the symmetric difference, because each differing element flips one bit.

* Pigeonhole join. A wide sketch is cut into ``k`` blocks (k a power of two chosen per size band, k > d). Within a band
  two linked sets agree in at least k - d whole blocks. A block travels as the XOR of its elements' hashes. As d + 1
  agreeing blocks are more than needed, every document leaves out its k - 1 - d weakest blocks: empty ones first, then
  those whose content is most frequent in the corpus. The order depends on the content alone, so both documents of
  a linked pair leave out the same blocks, and the strongest block they agree in is always kept by both: no link is
  lost, and passages shared by many documents hardly make candidates.
* Size bands. The band of a pair is that of its smaller set; a document whose linked partners can lie in the band
  below sends its blocks for both.
* Verify. Candidates first compare a compact bit sketch (Hamming distance against d), then the sets themselves.

Documents with equal sets are one class and only classes are compared. Of the classes that share a block
three leaders are compared with all others; what they leave apart from the first leader's component is compared with the
whole block inside the join condition. So a group of near copies costs a few rows per member instead of all pairs, and
yet every possible link between different components of a block is examined.

Defined results: documents with a null text, an empty text or no words have an empty set, no links and their own id as
component; a null id takes part and yields a null component only if all ids of its component are null; rows that
repeat a document are equal sets; an empty table gives no rows; columns beyond id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .shared import WORD, few_rows, pin, trimmed

U64 = np.uint64
SLACK = 1.15            # blocks per band: at least this many times d + 1
EMPTY = U64(0x5851F42D4C957F2D)


def max_difference(a: int, b: int, num: int, den: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (den - num) // (den + num)


def band_blocks(size: int, num: int, den: int) -> int:
    """log2 of the number of blocks for pairs whose smaller set has this size."""
    d = max_difference(size, size * den // num, num, den)
    return max(0, int(np.ceil(np.log2(SLACK * (d + 1)))))


def bands_of(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(log2 of blocks, largest difference) of the bands in which a set of this size looks for partners."""
    own = band_blocks(size, num, den)
    out = [(own, min((1 << own) - 1, max_difference(size, size * den // num, num, den)))]
    least = -(-size * num // den)
    low = band_blocks(least, num, den)
    while low < own:
        out.append((low, min((1 << low) - 1, max_difference(size, size, num, den))))
        low += 1
    return out


def block_keys(hashes: np.ndarray, log_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, is empty) of every block of a sorted hash array; the low 6 bits of a key hold ``log_blocks``."""
    n = 1 << log_blocks
    block = np.arange(n, dtype=np.uint64)
    if log_blocks:
        first = np.searchsorted(hashes, block << U64(64 - log_blocks))
    else:
        first = np.zeros(1, np.int64)
    size = np.diff(np.append(first, len(hashes)))
    full = size > 0
    content = np.full(n, EMPTY, np.uint64)
    content[full] = np.bitwise_xor.reduceat(hashes, first[full])
    key = textops.mix(content ^ textops.mix(block + U64(n)))
    return (key & ~U64(63)) | U64(log_blocks), ~full


def bit_sketch(hashes: np.ndarray, log_blocks: int) -> np.ndarray:
    """Parity sketch of 4 bits per block (at least 64), as longs."""
    bits = max(64, 4 << log_blocks)
    parity = np.bincount((hashes & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums that stand for a set."""
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(textops.mix(hashes + U64(0x9E3779B97F4A7C15))) if len(hashes) else U64(0)
        b = textops.mix(hashes ^ U64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64) if len(hashes) else U64(0)
    return int(np.int64(np.uint64(a).view(np.int64))), int(np.uint64(b).view(np.int64))


def _sets(batches, k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        for first, rows in textops.chunks(batch.column(1)):
            w = textops.Words(rows)
            yield batch.column(0).slice(first, len(rows)).to_pylist(), list(textops.shingle_sets(w, k))


def set_infos(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, text_hash, n, f1, f2, bands) of (id, text, text_hash) rows: set size, fingerprints and how many frequent blocks may
    be left out in each band."""
    def rows_of(batches):
        for batch in batches:
            for first, rows in textops.chunks(batch.column(1)):
                yield batch.slice(first, len(rows)), textops.shingle_sets(textops.Words(rows), k)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch, sets in rows_of(batches):
            n, f1, f2, skips = [], [], [], []
            for s in sets:
                a, b = fingerprint(s)
                n.append(len(s)), f1.append(a), f2.append(b)
                own = []
                if len(s):
                    for log_blocks, d in bands_of(len(s), num, den):
                        empty = int(block_keys(s, log_blocks)[1].sum()) if log_blocks else 0
                        own.append({"band": log_blocks, "skip": max(0, (1 << log_blocks) - 1 - d - empty)})
                skips.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.array(skips, pa.list_(pa.struct([("band", pa.int32()), ("skip", pa.int32())])))],
                names=["id", "text_hash", "n", "f1", "f2", "bands"])
    return docs.mapInArrow(trimmed(run), "id long, text_hash long, n long, f1 long, f2 long, bands array<struct<band:int,skip:int>>")


def set_blocks(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, f1): the blocks of every distinct set (once per task), without the empty ones that may be left out."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, k):
            keys, owners = [], []
            for s in sets:
                if not len(s):
                    continue
                f1 = fingerprint(s)[0]
                if f1 in seen:
                    continue
                if len(seen) < 200_000:     # only saves rows; a set sent twice counts the same
                    seen.add(f1)
                for log_blocks, d in bands_of(len(s), num, den):
                    key, empty = block_keys(s, log_blocks)
                    over = np.flatnonzero(empty)[(1 << log_blocks) - 1 - d:]
                    keep = ~empty
                    keep[over] = True
                    key = key[keep]
                    keys.append(key)
                    owners.append(np.full(len(key), f1, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(textops.signed(np.concatenate(keys))), pa.array(np.concatenate(owners))],
                    names=["key", "f1"])
    return docs.mapInArrow(trimmed(run), "key long, f1 long")


def set_cards(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(f1, band, sketch, elements) of every document given; elements only with its first band."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, k):
            f1, band, sketch, elements = [], [], [], []
            for s in sets:
                own = fingerprint(s)[0]
                if not len(s) or own in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(own)
                for i, (log_blocks, _) in enumerate(bands_of(len(s), num, den)):
                    f1.append(own), band.append(log_blocks)
                    sketch.append(bit_sketch(s, log_blocks))
                    elements.append(textops.signed(s) if i == 0 else None)
            if f1:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f1, pa.int64()), pa.array(band, pa.int32()), pa.array(sketch, pa.list_(pa.int64())),
                     pa.array(elements, pa.list_(pa.int64()))], names=["f1", "band", "sketch", "elements"])
    return docs.mapInArrow(trimmed(run), "f1 long, band int, sketch array<long>, elements array<long>")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): smallest node reachable over (a, b); hash-to-min, each round one shuffle of the edges left.

    Every node points at the smallest node it knows; in a round each node tells all its neighbours its smallest
    neighbour, which shortens chains by half. Ends when nothing changes.
    """
    state = pin(edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
                .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
                .groupBy("node").agg(F.min("to").alias("to"))
                .select("node", F.least("node", "to").alias("label")))
    links = edges
    for _ in range(max_rounds):
        # replace both ends by their labels; what is left joins different labels
        la, lb = state.select(F.col("node").alias("a"), F.col("label").alias("la")), \
            state.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        left = (links.join(la, "a").join(lb, "b").filter("la != lb")
                     .select(F.greatest("la", "lb").alias("node"), F.least("la", "lb").alias("to")))
        hooks = left.groupBy("node").agg(F.min("to").alias("to"))
        # a label that was hooked moves on, and every node follows its label once more (pointer jumping)
        jump = state.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = (state.join(hooks.withColumnRenamed("node", "label"), "label", "left")
                      .select("node", F.least("label", F.coalesce("to", "label")).alias("label"),
                              F.col("to").isNotNull().alias("hooked"))
                      .join(jump, F.col("label") == F.col("at"), "left")
                      .select("node", F.least("label", F.coalesce("further", "label")).alias("label"),
                              (F.col("hooked") | (F.coalesce("further", "label") != F.col("label"))).alias("moved")))
        moved = pin(moved)
        changed = moved.filter("moved").limit(1).count()
        state = moved.drop("moved")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return state


def _close(pairs: DataFrame, cards: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose sets are similar."""
    sets = cards.filter("elements is not null").select("f1", "elements")
    both = (pairs.join(sets.select(F.col("f1").alias("b"), F.col("elements").alias("eb")), "b")
                 .join(sets.select(F.col("f1").alias("a"), F.col("elements").alias("ea")), "a"))
    shared = F.size(F.array_intersect("ea", "eb"))
    return (both.withColumn("both", shared.cast("long"))
                .filter(F.col("both") * den >= num * (F.col("na") + F.col("nb") - F.col("both")))
                .select("a", "b"))


def hamming(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def allowed(na: str, nb: str, num: int, den: int):
    return F.floor((F.col(na) + F.col(nb)) * (den - num) / F.lit(den + num))


def _size_ok(na: str, nb: str, num: int, den: int):
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num)


def _near(x: DataFrame, y: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b, na, nb), a < b, of members (key, f1, n, label, sketch) of the same block that may be linked:
    other components, matching sizes, sketches within the allowed distance. The tests are part of the join."""
    x = x.select("key", *[F.col(c).alias(f"{c}_x") for c in ("f1", "n", "label", "sketch")])
    y = y.select("key", *[F.col(c).alias(f"{c}_y") for c in ("f1", "n", "label", "sketch")])
    near = x.join(y, "key").filter((F.col("label_x") != F.col("label_y")) & _size_ok("n_x", "n_y", num, den)
                                   & (hamming("sketch_x", "sketch_y") <= allowed("n_x", "n_y", num, den)))
    swap = F.col("f1_x") > F.col("f1_y")
    return near.select(F.least("f1_x", "f1_y").alias("a"), F.greatest("f1_x", "f1_y").alias("b"),
                       F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("na"),
                       F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("nb")).distinct()


def shared_blocks(blocks: DataFrame) -> DataFrame:
    """(key, f1) of the blocks that at least two different sets share; neighbours in key order are compared in a stream,
    so no group is ever held and the blocks are shuffled once."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        last = None                       # last row of the batch before and whether it was passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            key, f1 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (f1[1:] != f1[:-1])
            if last is not None:
                new[0] = (key[0], f1[0]) != last[:2]
            key, f1 = key[new], f1[new]
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            keep = np.zeros(len(key), bool)
            keep[1:] |= same
            keep[:-1] |= same
            out = [(key[keep], f1[keep])]
            if last is not None and key[0] == last[0]:
                if not keep[0]:
                    out.insert(0, (key[:1], f1[:1]))
                    keep[0] = True
                if not last[2]:
                    out.insert(0, (np.array([last[0]]), np.array([last[1]])))
            last = (key[-1], f1[-1], bool(keep[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])),
                                              pa.array(np.concatenate([o[1] for o in out]))], names=["key", "f1"])
    return blocks.repartition("key").sortWithinPartitions("key", "f1").mapInArrow(trimmed(run), "key long, f1 long")


def candidates(infos: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, band, f1, n): classes under every block they share with another class and did not leave out."""
    hits = pin(shared_blocks(blocks))
    freq = hits.groupBy("key").agg(F.count("*").alias("freq"))
    skip = (infos.filter("n > 0").select("f1", "n", F.explode("bands").alias("s"))
                 .groupBy("f1", F.col("s.band").alias("band")).agg(F.max("n").alias("n"), F.max("s.skip").alias("skip")))
    w = Window.partitionBy("f1", "band").orderBy(F.col("freq").desc(), "key")
    return (hits.join(freq, "key")
                .withColumn("band", F.col("key").bitwiseAND(F.lit(63)).cast("int"))
                .join(skip, ["f1", "band"])
                .withColumn("rank", F.row_number().over(w)).filter("rank > skip")
                .select("key", "band", "f1", "n"))


def link_classes(docs: DataFrame, infos: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """(node, label) of the classes (f1) that have links, None if there are none."""
    cand = pin(candidates(infos, set_blocks(docs, k, num, den)))
    names = cand.select("f1").distinct()
    ids = infos.filter("n > 0").join(names, "f1", "left_semi").groupBy("f1").agg(F.min("id").alias("wanted"))
    cards = pin(set_cards(few_rows(docs, "id", ids, "wanted"), k, num, den))
    members = pin(cand.join(cards.select("f1", "band", "sketch"), ["f1", "band"]))
    # three leaders of a block, chosen by different orders, meet all its members
    other = F.xxhash64("f1")
    lead = members.groupBy("key").agg(F.min("f1").alias("lead"), F.max("f1").alias("last"), F.min(other).alias("third"),
                                      F.count("*").alias("size")).filter("size > 1")
    leaders = (members.join(lead, "key").filter((F.col("f1") == F.col("lead")) | (F.col("f1") == F.col("last"))
                                                | (other == F.col("third"))).select(*members.columns))
    alone = lambda df: df.withColumn("label", F.col("f1"))
    first = pin(_near(alone(leaders), alone(members), num, den))
    found = pin(_close(first, cards, num, den))
    if found.isEmpty():
        labels, named = None, alone(members)
    else:
        labels = components(found)
        named = (members.join(labels.withColumnRenamed("node", "f1"), "f1", "left")
                        .withColumn("label", F.coalesce("label", "f1")))
    # members that are still apart from their block's first leader meet all others of the block
    named = pin(named)
    main = named.join(lead.select("key", F.col("lead").alias("f1")), ["key", "f1"]).select("key", F.col("label").alias("main"))
    split = named.join(main, "key")
    apart = split.filter("label != main").drop("main")
    open_ = named.join(apart.select("key").distinct(), "key", "left_semi")
    rest = pin(_near(apart, open_, num, den).join(first.select("a", "b"), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = pin(_close(rest, cards, num, den))
        if not more.isEmpty():
            labels = components(found.unionByName(more))
    return labels


def classes(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, num: int, den: int) -> DataFrame:
    """(id, text_hash, n, label) per row: set size and class of linked sets; rows with equal sets share a label."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    infos = pin(set_infos(rows, shingle_words, num, den))
    labels = link_classes(rows, infos, shingle_words, num, den)
    own = infos.withColumn("label", F.lit(None).cast("long")) if labels is None else \
        infos.join(labels.withColumnRenamed("node", "f1"), "f1", "left")
    return own.select("id", "text_hash", "n", F.coalesce("label", "f1").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id): classes of documents whose sets are linked at ``num/den`` or more."""
    own = classes(docs, id_col, text_col, shingle_words, num, den)
    # written out, so that the join starts from plain shuffles and a large component can be split over tasks
    names = pin(own.filter("n > 0").groupBy(F.col("label").alias("name")).agg(F.min("id").alias("component")))
    return (own.join(names, (F.col("n") > 0) & (F.col("label") == F.col("name")), "left")
               .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                       F.coalesce("component", "id").alias("component_id")))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                         num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of near duplicates: the smallest id (null last), of its rows the smallest text hash, of rows equal
    in both the one with the smallest hash over all columns (any one, if they are equal in all). Rows without words all
    stay."""
    own = classes(docs, id_col, text_col, shingle_words, num, den)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "text_hash"))
    best = own.filter("n > 0").groupBy("label").agg(first.alias("first")).select(
        *[F.col(f"first.{c}").alias(f"_nj_{c}") for c in ("none", "id", "text_hash")])
    key = ["_nj_none", "_nj_id", "_nj_text_hash"]
    words = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    id_ = docs[id_col].cast("long")
    plain = [c for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    order = F.xxhash64(*plain)
    some = docs.filter(words).withColumns({"_nj_none": id_.isNull(), "_nj_id": F.coalesce(id_, F.lit(0)), "_nj_text_hash": F.xxhash64(text_col),
                                           "_nj_order": order})
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_nj_order"))
    chosen = some.join(best, key, "left_semi").withColumn("_nj_place", place).filter("_nj_place = 1").select(*docs.columns)
    return docs.filter(~words).unionByName(chosen)
