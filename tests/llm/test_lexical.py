"""Ranked search against scores computed one document and item at a time."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import lexical

from .helpers import awkward_rows, docs_frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def by_hand(docs, items, k=10):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, len(t), Counter(t)) for d, t in bags if t]
    total = sum(n for _, n, _ in bags)
    df = Counter(t for *_, bag in bags for t in bag)
    out = []
    for item, text in set(items):
        asked, scored = Counter(terms(text)), []
        for d, n, bag in bags:
            m = 25 + (75 * n * len(bags)) // total
            s = sum(c * math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * m))
                    for t, c in asked.items() if t in bag)
            if s > 0:
                scored.append((-s, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def table(rng, n, vocabulary):
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(f"t{x}" for x in rng.choices(range(vocabulary), weights, k=rng.randint(0, 60)))) for i in range(n)]


def test_ranks_equal_brute_force(spark):
    rng = random.Random(1)
    docs = table(rng, 400, 300)
    items = [(i, t) for i, t in table(rng, 25, 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame(items, ITEMS)
    want = by_hand(docs, items)
    assert found(lexical.search(df, asked)) == want
    assert found(lexical.search(df, asked, block_terms=60)) == want        # several blocks of items
    assert found(lexical.search(df, asked, k=3)) == by_hand(docs, items, 3)


def test_copies_are_one_class_and_all_ranked(spark):
    """A third of all texts are copies, others have the same item terms and length; ranks expand them by id."""
    docs = [(i, "Alpha beta gamma x1") for i in range(200, 0, -1)] + [(1000 + i, f"alpha BETA gamma y{i}") for i in range(100)]
    docs += [(5000 + i, "other words entirely here now") for i in range(200)] + [(7, "Alpha beta gamma x1"), (4000, "alpha alpha beta, gamma")]
    items = [(1, "alpha beta"), (2, "gamma"), (3, "nothing known"), (1, "alpha beta"), (1, "now now"), (None, "alpha"), (4, None), (5, " -- ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = found(lexical.search(df, spark.createDataFrame(items, ITEMS)))
    assert got == by_hand(docs, items)


def test_awkward_documents(spark):
    rows = awkward_rows() + [(20, "w1 w2 w3 É é ÅNGSTRÖM a-b_c", "en", "s", 1), (21, "É\x00w1\x7fw2", "en", "s", 1)]
    items = [(1, "w1 w2 W3 w17 w250"), (2, "é"), (3, "É ångström x" + "x" * 49_999), (4, "a b c"), (5, rows[8][1][:4000])]
    df = docs_frame(spark, rows, clash=True)
    asked = spark.createDataFrame(items, ITEMS)
    for name in ("item", "term", "times", "h", "m", "bag", "score", "rank"):
        df, asked = df.withColumn(name, F.lit(1)), asked.withColumn(name, F.lit(1))
    assert found(lexical.search(df, asked)) == by_hand([(r[0], r[1]) for r in rows], items)
    assert lexical.search(df.limit(0), asked).count() == 0 and lexical.search(df, asked.limit(0)).count() == 0
    assert lexical.search(df.withColumn("text", F.lit(None).cast("string")), asked).count() == 0


def test_equal_hashes_are_not_enough():
    """A word with a term's hash but other bytes is not that term."""
    v = lexical.Vocabulary([b"alpha", b"beta"])
    words = lexical.terms_of([b"Alpha, gamma beta alphabet"])
    fake = words.hashes(fold=False)
    fake[1] = v.hashes[0]
    words.hashes = lambda fold: fake
    word, term = v.find(words)
    assert word.tolist() == [0, 2] and [v.terms[t] for t in term.tolist()] == [b"alpha", b"beta"]


def test_large_scores_stay_exact():
    v = lexical.Vocabulary([b"a", b"b"])
    items = lexical.Items(v, np.array([0, 0]), np.array([0, 1]), np.array([1, 1]), 1)
    value = np.array([2 ** 53, 1, 3], np.int64)
    assert items.score(np.array([0, 0, 1]), np.array([0, 1, 1]), value, 2).ravel().tolist() == [2 ** 53 + 1, 3]
