"""The n-gram Jaccard join against all pairs compared one by one."""

import random

import numpy as np
import pytest

from quillspark.llm import ngram_join, textops

from .helpers import CLASHING, awkward_rows, docs_frame, near_copies, words


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, num, den):
    """(id, n, component) of every row."""
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, groups, docs_per_group, passage=True):
    rng = random.Random(seed)
    shared = words(rng, 60)
    rows, number = [], 0
    for g in range(groups):
        base = words(rng, rng.choice([3, 8, 30, 120, 400]))
        if passage and g % 2:
            base += shared
        for _ in range(rng.randint(1, docs_per_group)):
            edits = int(len(base) * rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))
            rows.append((number, " ".join(near_copies(rng, base, edits)), "en", "s", 1))
            number += 1
    rng.shuffle(rows)
    return rows


def run(spark, rows, k, num, den, clash=False):
    out = ngram_join.near_duplicates(docs_frame(spark, rows, clash), shingle_words=k, num=num, den=den).collect()
    return sorted((tuple(r) for r in out), key=str)


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_matches_all_pairs(spark, k, num):
    rows = corpus(k, 40, 9)
    assert run(spark, rows, k, num, 100) == brute(rows, k, num, 100)


def test_large_group_of_near_copies_and_a_common_passage(spark):
    rng = random.Random(3)
    base, passage = words(rng, 150), words(rng, 40)
    rows = [(i, " ".join(near_copies(rng, base, rng.choice([2, 3, 4]))), "en", "s", 1) for i in range(150)]
    rows += [(1000 + i, " ".join(words(rng, 60) + passage + words(rng, 60)), "en", "s", 1) for i in range(150)]
    assert run(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_awkward_rows(spark):
    rows = [r for r in awkward_rows()]
    assert run(spark, rows, 4, 85, 100, clash=True) == brute(rows, 4, 85, 100)
    assert run(spark, [], 4, 85, 100) == []


def test_hamming_distance_bounds_the_symmetric_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2 ** 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.8], rng.integers(0, 2 ** 63, 20, dtype=np.uint64))))
        x, y = ngram_join.bit_sketch(a, 6), ngram_join.bit_sketch(b, 6)
        distance = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert distance <= len(np.setxor1d(a, b))


def test_linked_sets_keep_a_common_block():
    """Pigeonhole with left-out blocks: sets at the limit always share a block that both keep."""
    rng = np.random.default_rng(2)
    for size in (1, 5, 6, 7, 20, 60, 300, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))
            drop = rng.integers(0, max(1, int(0.15 * len(a))) + 1)
            b = np.sort(rng.permutation(a)[drop:])
            common = len(np.intersect1d(a, b))
            if not len(b) or 100 * common < 85 * (len(a) + len(b) - common):
                continue
            kept = []
            freq = {}
            for s in (a, b):
                for band, d in ngram_join.bands_of(len(s), 85, 100):
                    key, empty = ngram_join.block_keys(s, band)
                    for x in key[~empty]:
                        freq[int(x)] = freq.get(int(x), 0) + 1
            for s in (a, b):
                own = set()
                for band, d in ngram_join.bands_of(len(s), 85, 100):
                    key, empty = ngram_join.block_keys(s, band)
                    order = sorted(range(len(key)), key=lambda i: (not empty[i], -freq.get(int(key[i]), 0), int(key[i])))
                    own |= {int(key[i]) for i in order[(1 << band) - 1 - d:]}
                kept.append(own)
            assert kept[0] & kept[1]


def test_representatives_keep_all_columns(spark):
    rows = corpus(9, 10, 5)
    df = docs_frame(spark, rows, clash=True)
    out = ngram_join.keep_representatives(df, shingle_words=5, num=80, den=100)
    assert out.columns == df.columns and set(CLASHING) <= set(out.columns)
    expected = {c for _, _, c in brute(rows, 5, 80, 100)}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(expected)


def test_word_hashes_follow_the_definition():
    w = textops.Words(["Ab\x0bcd  ÄB x".encode(), b"", b"ab cd"])
    assert w.count().tolist() == [3, 0, 2]
    h = w.hashes(fold=True)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_one_row_of_each_group_stays(spark):
    """Rows that repeat an id, share it with other texts, or have none: one row a group, whatever else the id carries."""
    rng = random.Random(9)
    t1, t2, t3 = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(1, t1), (1, t1), (1, t1), (5, t1), (7, t2), (7, t1), (None, t3), (None, t3), (9, t3 + " end"), (None, t2), (3, ""), (3, None), (None, " ")]
    out = ngram_join.keep_representatives(docs_frame(spark, [(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], clash=True))
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, t1), (7, t2), (9, t3 + " end"), (3, ""), (3, None), (None, " ")], key=str)
