"""Conversation trie against a dictionary of prefixes, and the parentheses against a stack."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import trie

from .helpers import CLASHING

TURNS = "conv_id long, turn long, role string, text string"


def by_hand(convs: dict) -> list[tuple]:
    members: dict[tuple, list] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below: dict[tuple, tuple] = {}
    out = []
    for node in sorted(members, key=len, reverse=True):
        kids = [below[k] for k in members if k and k[:-1] == node]
        leaves = sum(x[0] for x in kids) or 1
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved += sum(x[1] for x in kids)
        below[node] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), leaves,
                    saved, hashlib.sha256(ends.encode()).hexdigest() if ends else None))
    return sorted(out, key=repr)


def found(nodes) -> list[tuple]:
    return sorted((tuple(r) for r in nodes.collect()), key=repr)


def logged(spark, convs: dict, clash: bool = False):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    for i, name in enumerate(CLASHING + ["path", "seq", "ends", "shard"] if clash else []):
        df = df.withColumn(name, F.lit(i))
    return trie.conversations(df)


def random_convs(rng: random.Random, n: int) -> dict:
    convs = {}
    for c in range(n):
        turns = [(rng.choice("ua"), rng.choice(["x", "yy", "zzé", ""])) for _ in range(rng.choice([1, 2, 3, 5, 8]))]
        if c > 5 and rng.random() < 0.5:
            other = convs[rng.randrange(c)]
            turns = other[:rng.randint(0, len(other))] + turns[:2]
        convs[c] = list(convs[3]) if c > 5 and rng.random() < 0.3 else turns
    return convs


def test_parentheses():
    rng = random.Random(3)
    for n in (1, 2, 31, 32, 33, 700, 5000):
        bits, depth, opened = [], 0, 0
        while opened < n or depth:
            up = opened < n and (depth == 0 or rng.random() < (0.5 if n < 1000 else 0.52))
            bits.append(int(up))
            depth += 1 if up else -1
            opened += up
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        p = trie.Parens(np.array(bits, np.uint8))
        opens = np.flatnonzero(p.bits)
        assert p.findclose(opens).tolist() == [want[i] for i in opens.tolist()]
        for i in opens[:50].tolist():
            assert p.pairs[want[i] + 1] - p.pairs[i] == sum(bits[j] and not bits[j + 1] for j in range(i, want[i]))


@pytest.mark.parametrize("shard_turns", [1 << 18, 40, 1])
def test_trie_equals_prefix_dictionary(spark, shard_turns):
    """Shards of one entry, of some and of all give the same nodes: spines merge."""
    convs = random_convs(random.Random(shard_turns), 150)
    assert found(trie.prefix_trie(logged(spark, convs), shard_turns)) == by_hand(convs)
    if shard_turns == 40:
        assert found(trie.prefix_trie(logged(spark, convs), shard_turns, few_nodes=0)) == by_hand(convs)


def test_hot_conversation_and_long_conversation(spark):
    """A third of the log is one conversation, a third shares a first turn, one conversation is long."""
    convs = {c: [("u", "same"), ("a", "answer")] for c in range(60)}
    convs |= {c: [("u", "same"), ("a", f"other {c}")] for c in range(60, 120)}
    convs |= {c: [("u", f"own {c}")] for c in range(120, 160)}
    convs[160] = [("u", f"turn {i}") for i in range(3000)]
    convs[161] = convs[160][:1500] + [("u", "leaves")]
    df = spark.createDataFrame([(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)], TURNS)
    by_chain = [n for n in found(trie.prefix_trie(trie.conversations(df), 1000))]
    small = {c: t for c, t in convs.items() if c < 160}
    short = [n for n in by_hand(small) if n[1] > 0]
    assert [n for n in by_chain if n[0] < 160 and n[1] > 0] == short
    long = sorted((n for n in by_chain if n[0] >= 160), key=lambda n: (n[1], n[0]))
    assert len(long) == 3001 and [n[3] for n in long[:1500]] == [2] * 1500 and long[-1][1] == 3000
    assert long[0][6] == sum(len(f"turn {i}") for i in range(1500)) and long[0][5] == 2
    root = next(n for n in by_chain if n[1] == 0)
    assert root[:5] == (0, 0, None, 162, 1 + 40 + 1) and root[5] == 1 + 60 + 40 + 2


def test_awkward_turns(spark):
    """Null ids out, null role and text empty, null turn first, repeated rows turns of their own, clashing names."""
    rows = [(None, 0, "u", "x"), (1, 1, "u", "b"), (1, None, None, "a"), (1, 1, "u", "b"), (2, 5, "", "a"), (2, 6, "u", "b"), (2, 7, "u", None),
            (3, 0, "", "a"), (3, 1, "u", "b"), (3, 2, "u", ""), (-4, 0, "ua", "b"), (-5, 0, "u", "ab")]
    convs = {1: [("", "a"), ("u", "b"), ("u", "b")], 2: [("", "a"), ("u", "b"), ("u", "")], 3: [("", "a"), ("u", "b"), ("u", "")],
             -4: [("ua", "b")], -5: [("u", "ab")]}
    df = spark.createDataFrame(rows, TURNS)
    for i, name in enumerate(CLASHING + ["path", "seq", "ends", "shard", "turns"]):
        df = df.withColumn(name, F.lit(i))
    assert found(trie.prefix_trie(trie.conversations(df))) == by_hand(convs)
    assert trie.prefix_trie(trie.conversations(df.limit(0))).collect() == []
    turnless = trie.conversations(df).withColumn("turns", F.when(F.col("id") < 0, F.slice("turns", 1, 0)).otherwise(F.col("turns")))
    assert found(trie.prefix_trie(turnless)) == by_hand(convs | {-4: [], -5: []})
