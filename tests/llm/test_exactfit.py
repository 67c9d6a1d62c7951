"""Exact-fit packing: round trip against the tokenizer, and plans against counts, bounds and brute force."""

import random
import zlib

import numpy as np
import pytest

from quillspark.llm import exactfit

from .helpers import awkward_rows, docs_frame, sentence_text


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [1024, 16])
def test_round_trip(spark, reference, length):
    rng = random.Random(4)
    rows = awkward_rows() + [(100 + i, sentence_text(rng, rng.randint(1, 30)), "en", "s", 1) for i in range(60)]
    rows += [(300 + i, "the same few words", "en", "s", 1) for i in range(50)] + [(400, "a <|endoftext|> b", "en", "s", 1)]
    df = docs_frame(spark, rows, clash=True, parts=5)
    got = exactfit.pack(df, length=length, with_ids=True).collect()
    docs, sequences = {}, {}
    for p in got:
        ids = np.frombuffer(p["_ids"], "<u4").tolist()
        assert len(ids) == p["length"] <= length and zlib.crc32(bytes(p["_ids"])) == p["ids_crc32"]
        docs.setdefault(p["doc_id"], []).append((p["piece"], p["start"], ids))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    want = {}
    for doc, text, *_ in rows:
        want.setdefault(doc, []).append([*reference(text or ""), 2])
    assert sorted(docs, key=str) == sorted(want, key=str)
    for doc, texts in want.items():
        parts = sorted(docs[doc])
        if len(texts) == 1:
            assert [x for _, _, ids in parts for x in ids] == texts[0]
            assert [n for n, _, _ in parts] == list(range(len(parts)))
            assert [s for _, s, _ in parts] == np.cumsum([0] + [len(x) for *_, x in parts[:-1]]).tolist()
            assert all(len(x) == length for n, _, x in parts if n > 0) and len(parts) == -(-len(texts[0]) // length)
        else:
            assert sum(len(x) for *_, x in parts) == sum(map(len, texts))
    total = sum(len(x) for t in want.values() for x in t)
    assert -(-total // length) <= len(sequences) <= best_fit_count([len(x) for *_, x in sum(docs.values(), [])], length)
    assert exactfit.pack(df.limit(0), length=length).collect() == []


def best_fit_count(sizes, length):
    gaps = []
    for x in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= x]
        gap = min(fits, default=length)
        if fits:
            gaps.remove(gap)
        gaps.append(gap - x)
    return len(gaps)


def fewest(sizes, length):
    """Least number of sequences by trying all placements."""
    best = len(sizes)
    def place(rest, room):
        nonlocal best
        if len(room) >= best:
            return
        if not rest:
            best = len(room)
            return
        x, *rest = rest
        for i, r in enumerate(room):
            if r >= x and r not in room[:i]:
                place(rest, room[:i] + [r - x] + room[i + 1:])
        place(rest, room + [length - x])
    place(sorted(sizes, reverse=True), [])
    return best


def plan_of(sizes, length):
    counts = np.bincount(sizes, minlength=length + 1)
    plan = exactfit.plan_patterns(counts)
    used = np.zeros(length + 1, np.int64)
    for pattern, times in plan:
        assert times > 0 and sum(pattern) <= length
        for x in pattern:
            used[x] += times
    assert (used == counts).all()
    return sum(times for _, times in plan)


def test_plans_hold_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(150):
        length = int(rng.integers(2, 40))
        sizes = rng.integers(1, length + 1, int(rng.integers(1, 60)))
        assert -(-sizes.sum() // length) <= plan_of(sizes, length) <= best_fit_count(sizes.tolist(), length)
    extra = [plan_of(s, 12) - fewest(s.tolist(), 12) for s in (rng.integers(1, 13, 9) for _ in range(60))]
    assert min(extra) == 0 and sum(extra) <= 3
    assert plan_of(np.zeros(0, np.int64), 8) == 0


def test_exact_combinations():
    """One, two and three lengths complete a long one; counts decide how often; nothing is left over."""
    for rest in ((100,), (99, 1), (98, 1, 1)):
        sizes = np.array(([924] + list(rest)) * 7000)
        assert plan_of(sizes, 1024) == 7000
    index = exactfit.Complements(np.bincount([5, 5, 3, 2, 1, 1]))
    assert index.filling(5, 0.98) == (5,) and index.filling(4, 0.5) == (3, 1)
    assert exactfit.Complements(np.bincount([5, 5, 0], minlength=11)).filling(10, 0.5) == (5, 5)
    assert exactfit.Complements(np.bincount([5], minlength=11)).filling(10, 0.5) is None
    assert exactfit.Complements(np.bincount([8, 1, 1], minlength=11)).filling(10, 0.8) == (8, 1, 1)


def test_large_counts_take_few_patterns():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 10 ** 9, 1025)
    counts[0] = 0                                           # every piece holds a token
    plan = exactfit.plan_patterns(counts)
    assert len(plan) < 4 * 1024
    slots = exactfit.slots(plan, 1024)
    assert (np.diff(slots["key"]) > 0).all() and slots["key"][0] >= exactfit.RANKS


def exact_ones(plan, length):
    return sum(times for pattern, times in plan if len(pattern) > 1 and sum(pattern) == length)


def test_combinations_of_middling_lengths_are_taken():
    """23 stays alone; 12, 10, 3 and 12, 7, 6 fill two sequences, though none of their lengths nearly fills the gap of the first."""
    for many in (1, 1000):
        sizes = np.array([25, 23, 12, 12, 10, 7, 6, 3] * many)
        assert plan_of(sizes, 25) == 4 * many
        assert exact_ones(exactfit.plan_patterns(np.bincount(sizes)), 25) == 2 * many


def test_every_combination_is_kept_unless_it_costs_a_sequence():
    rng = np.random.default_rng(3)
    whole = more = 0
    for _ in range(40):
        length = int(rng.integers(12, 200))
        counts = np.bincount(rng.integers(1, int(rng.integers(length // 2, length)), int(rng.integers(20, 400))), minlength=length + 1)
        index = exactfit.Complements(counts.copy())
        found = exactfit.complements(index, exactfit.LEAD) + exactfit.complements(index, 0.0)
        every = found + exactfit._best_fit(index.available, length)
        near = exactfit.Complements(counts.copy())
        first = exactfit.complements(near, exactfit.LEAD)
        first += exactfit._best_fit(near.available, length)
        plain = exactfit._best_fit(counts.copy(), length)
        plan = exactfit.plan_patterns(counts)
        fewest = min(sum(t for _, t in p) for p in (every, first, plain))
        assert sum(t for _, t in plan) <= fewest
        if sum(t for _, t in every) == fewest:
            whole += 1
            assert plan == every
        more += exact_ones(plan, length) > max(exact_ones(first, length), exact_ones(plain, length))
    assert whole > 10 and more > 10
