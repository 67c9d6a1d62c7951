"""Chat formatting with cumulative-snapshot collapse.

Loggers often store a conversation again after every turn, so most logged conversations are prefixes of longer ones.
Rolling hashes over the turns give every prefix of every conversation a fingerprint; a conversation whose whole
fingerprint is a proper prefix fingerprint of another one is dropped by an anti-join, equal conversations keep the
smallest id, and only what is left (the maximal conversations) is rendered.

The rolling hash of a turn covers the hash before it, the role and the text (128 bits, two seeds), so it is computed by
one ordered pass over a conversation's turns. Prefix fingerprints and whole fingerprints are made distinct before
the anti-join, so a first turn or a conversation that a third of the log shares is one row there.

A conversation is the unit of work (its rendering is one string), so its turns meet in one task; nothing larger does.

Defined results: turns without a conversation id belong to no conversation and are left out; null roles and texts
are compared as null (not equal to empty) and rendered as ``user`` and an empty text; turns are ordered by turn number, nulls
first, equal numbers by role and text; rows that repeat a turn are turns of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rendered format: marker around the role, end of a turn.
TURN_START, ROLE_END, TURN_END = "<|", "|>\n", "\n<|end|>\n"
DEFAULT_ROLE = "user"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(id, turns): the ordered turns of each conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return (turns.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
                 .agg(F.array_sort(F.collect_list(turn), _by_turn).alias("turns")))


def _by_turn(a: Column, b: Column) -> Column:
    """Order of two turns: number (null first), role, text."""
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        out = (F.when(x.isNull() & y.isNull(), out).when(x.isNull(), F.lit(-1)).when(y.isNull(), F.lit(1))
                .when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(out))
    return out


def prefix_hashes(turns: Column) -> Column:
    """Array of (h1, h2) after every turn."""
    def step(seen, t):
        last = F.element_at(seen, -1)
        facts = [F.coalesce(t["role"], F.lit("")), t["role"].isNull(), F.coalesce(t["text"], F.lit("")), t["text"].isNull()]
        return F.concat(seen, F.array(F.struct(F.xxhash64(last["h1"], *facts).alias("h1"),
                                               F.xxhash64(last["h2"], F.lit(1), *facts).alias("h2"))))
    seed = F.array(F.struct(F.lit(17).cast("long").alias("h1"), F.lit(29).cast("long").alias("h2")))
    hashes = F.aggregate(turns, seed, step)
    return F.slice(hashes, 2, F.size(hashes) - 1)


def render(turns: Column) -> Column:
    parts = F.transform(turns, lambda t: F.concat(F.lit(TURN_START), F.coalesce(t["role"], F.lit(DEFAULT_ROLE)),
                                                  F.lit(ROLE_END), F.coalesce(t["text"], F.lit("")), F.lit(TURN_END)))
    return F.array_join(parts, "")


def collapse(turns: DataFrame, **columns) -> DataFrame:
    """(id, n_turns, n_logged, rendered) of the maximal conversations; ``n_logged`` counts the equal ones."""
    hashed = conversations(turns, **columns).withColumn("hashes", prefix_hashes(F.col("turns")))
    whole = hashed.select("id", "turns", F.element_at("hashes", -1).alias("whole"),
                          F.slice("hashes", 1, F.size("hashes") - 1).alias("before"))
    firsts = whole.groupBy("whole").agg(F.min("id").alias("id"), F.count("*").alias("n_logged"))
    prefixes = whole.select(F.explode("before").alias("whole")).distinct()
    maximal = firsts.join(prefixes, "whole", "left_anti").select("id", "n_logged")
    return (whole.join(maximal, "id")
                 .select("id", F.size("turns").cast("long").alias("n_turns"), "n_logged",
                         render(F.col("turns")).alias("rendered")))
