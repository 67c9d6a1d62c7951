"""Folds, bins and samples.

Stratified folds (D1) are assigned to rows. Rows with the same combination of strata are dealt round robin, which is exact but
for less than one round a combination. Those remainders are placed one by one, rarest stratum first, where the fold lacks
most, and then moved and swapped while that evens out the deviations of all marginals. Remainders that are more than
``GREEDY_ROWS`` are placed in groups of that size inside Spark; one group is held back and evens out what the others
left over. The driver and a task hold at most one group.

Quantile edges (D3) are exact order statistics, found by counting: a histogram over the leading bits of the values, then of the
bins that hold a wanted rank over their next bits, until the bins hold one value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .ensemble import collect_small
from .positions import attach_positions

# Continuous labels are stratified by this many quantile bins (at most); a value that holds at least 1 / N_STRATA of
# the rows keeps a stratum of its own, so discrete scores are balanced value by value.
N_STRATA = 200
# Remainder rows that are placed together.
GREEDY_ROWS = 50_000
# Rows of each side that are looked at for a swap between two folds.
SWAP_ROWS = 64
# Deviations are evened out by their squares, then by a higher power, which weighs the largest ones.
POWERS = (2, 8)
# Swaps after that while a cell is off by more than one row, and random pairs looked at for each.
STEPS, PAIRS = 600, 20_000


def _lowest(rows: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The ``SWAP_ROWS`` rows of lowest cost, the earlier of equal ones."""
    return rows[np.argsort(cost, kind="stable")[:SWAP_ROWS]]


class Marginals:
    """Deviation of every (stratum, fold) count from its share, and placement of rows that lowers it.

    ``cells[i]`` numbers the strata of row i over all labels; the last column is one stratum that all rows share (fold size).
    """

    def __init__(self, target: np.ndarray, n_splits: int):
        self.folds = n_splits
        self.lack = np.repeat(target[:, None] / n_splits, n_splits, axis=1)     # rows a fold still wants of a stratum

    def add(self, cells: np.ndarray, fold: np.ndarray) -> None:
        for column in cells.T:
            np.subtract.at(self.lack, (column, fold), 1)

    def place(self, cells: np.ndarray) -> np.ndarray:
        """Folds of rows, rarest stratum first; rows are taken in the given order where equally rare."""
        n = len(cells)
        size = np.bincount(cells.ravel(), minlength=len(self.lack))
        rare = size[cells[:, :-1]].min(axis=1) if cells.shape[1] > 1 else np.zeros(n)
        fold = np.empty(n, np.int64)
        for i in np.argsort(rare, kind="stable").tolist():
            own = cells[i]
            f = int(np.argmax(self.lack[own].sum(axis=0)))
            fold[i] = f
            self.lack[own, f] -= 1
        for power in POWERS:
            self._even_out(cells, fold, power)
        return self._search(cells, fold)

    def _even_out(self, cells: np.ndarray, fold: np.ndarray, power: int) -> None:
        """Move rows, or swap two of different folds, while the sum of the deviations to an even ``power`` falls."""
        n = len(cells)
        while n:
            less = (self.lack - 1) ** power - self.lack ** power    # change of a cell that gets a row
            more = (self.lack + 1) ** power - self.lack ** power    # ... and that loses one
            gets = less[cells].sum(axis=1)                          # (row, fold)
            leaves = more[cells, fold[:, None]].sum(axis=1)
            cost = gets + leaves[:, None]
            cost[np.arange(n), fold] = np.inf
            i, f = divmod(int(np.argmin(cost)), self.folds)
            if cost[i, f] < -1e-6:
                self._move(cells, fold, i, f)
                continue
            best = (-1e-6, None, None)
            for a in range(self.folds):
                of_a = np.flatnonzero(fold == a)
                for b in range(a + 1, self.folds):
                    of_b = np.flatnonzero(fold == b)
                    x, y = _lowest(of_a, cost[of_a, b]), _lowest(of_b, cost[of_b, a])
                    # strata that both have do not change
                    same = cells[x][:, None, :] == cells[y][None, :, :]
                    stays = (less[:, a] + less[:, b] + more[:, a] + more[:, b])[cells[x]]
                    both = cost[x, b][:, None] + cost[y, a][None, :] - (same * stays[:, None, :]).sum(axis=2)
                    if both.size and both.min() < best[0]:
                        p, q = divmod(int(np.argmin(both)), len(y))
                        best = (float(both[p, q]), int(x[p]), int(y[q]))
            if best[1] is None:
                return
            _, x, y = best
            a, b = int(fold[x]), int(fold[y])
            self._move(cells, fold, x, b)
            self._move(cells, fold, y, a)

    def _search(self, cells: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Swaps, the best of many random pairs even if it is worse, not twice the same rows soon, while a cell is off by more
        than a row; what was best stays."""
        rng = np.random.default_rng(len(cells))
        n, power = len(cells), 4
        best = float(np.abs(self.lack).max())
        kept = self.lack.copy(), fold.copy()
        rest = np.zeros(n, np.int64)
        for step in range(STEPS if n > 1 else 0):
            if best <= 1 + 1e-9:
                break
            less = (self.lack - 1) ** power - self.lack ** power
            more = (self.lack + 1) ** power - self.lack ** power
            i, j = rng.integers(0, n, (2, PAIRS))
            good = np.flatnonzero((fold[i] != fold[j]) & (rest[i] <= step) & (rest[j] <= step))
            if not len(good):
                continue
            i, j = i[good], j[good]
            a, b = fold[i], fold[j]
            x, y = cells[i], cells[j]
            change = less[x, b[:, None]] + more[x, a[:, None]] + less[y, a[:, None]] + more[y, b[:, None]]
            at = int(np.argmin(np.where(x != y, change, 0.0).sum(axis=1)))      # strata that both have do not change
            p, q, a, b = int(i[at]), int(j[at]), int(a[at]), int(b[at])
            self._move(cells, fold, p, b)
            self._move(cells, fold, q, a)
            rest[[p, q]] = step + 1 + rng.integers(5, 15, 2)
            worst = float(np.abs(self.lack).max())
            if worst < best - 1e-9:
                best, kept = worst, (self.lack.copy(), fold.copy())
        self.lack = kept[0]
        return kept[1]

    def _move(self, cells: np.ndarray, fold: np.ndarray, i: int, f: int) -> None:
        self.lack[cells[i], fold[i]] += 1
        self.lack[cells[i], f] -= 1
        fold[i] = f


def _edges_up_to(edges: Column, x: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= x))


def strata(df: DataFrame, label_cols: list[str]) -> list[Column]:
    """Stratum of every label as a string: the value itself, or for floating-point labels the quantile bin (the edges of
    all such columns come from one aggregate with a sketch of fixed size)."""
    continuous = [f.name for f in df.schema.fields if f.name in label_cols and f.dataType.typeName() in ("double", "float")]
    edges = {}
    if continuous:
        probs = [i / N_STRATA for i in range(N_STRATA + 1)]
        row = df.select(*[F.percentile_approx(F.nanvl(c, F.lit(None).cast("double")), probs, 10_000).alias(c)
                          for c in continuous]).first()
        edges = {c: sorted(set(row[c] or [])) for c in continuous}
    out = []
    for c in label_cols:
        if c in edges:
            known = F.array(*[F.lit(float(e)) for e in edges[c]]) if edges[c] else F.array().cast("array<double>")
            bin_ = _edges_up_to(known, F.col(c))
            out.append(F.when(F.col(c).isNull(), F.lit(None)).when(F.isnan(c), F.lit("nan")).otherwise(bin_.cast("string")))
        else:
            out.append(F.col(c).cast("string"))
    return out


def stratified_folds(df: DataFrame, label_cols: list[str], id_col: str = "text_id", n_splits: int = 5,
                     seed: int = 42, fold_col: str = "fold", greedy_rows: int = GREEDY_ROWS) -> DataFrame:
    """Multilabel-stratified K folds; the marginals are the (label column, stratum) counts of the folds.

    Rows that share an id get the same fold (strata of the smallest one). Row order is by a seeded hash of the id, so the folds do
    not depend on partitioning. Only ids and strata are shuffled; the folds are joined back by id.
    """
    spark = df.sparkSession
    own = F.array(*[F.coalesce(c, F.lit("null")) for c in strata(df, label_cols)])
    rows = df.select(F.col(id_col).alias("_id"), own.alias("_s")).groupBy("_id").agg(F.min("_s").alias("_s"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_id")))
    placed = attach_positions(rows, ["_h", "_id"], ["_s"], pos_col="_pos")
    placed = placed.join(rows.groupBy("_s").agg(F.count("*").alias("_m")), "_s")
    whole = F.col("_m") - F.col("_m") % n_splits
    placed = pin(placed.withColumn("_rest", F.col("_pos") >= whole))
    # a combination's rounds begin at a fold of their own
    dealt = placed.filter("not _rest").select("_id", F.pmod(F.col("_pos") + F.xxhash64(F.lit(seed), "_s"), F.lit(n_splits)).cast("int").alias("_f"))
    rest = placed.filter("_rest").select("_id", "_h", "_s")
    groups = -(-rest.count() // greedy_rows)
    cells = F.explode(F.transform("_s", lambda s, i: F.struct(i.alias("l"), s.alias("v"))))
    names = [tuple(r) for r in collect_small(placed.select(cells.alias("c")).select("c.l", "c.v").groupBy("l", "v").count().orderBy("l", "v"),
                                             len(label_cols) * 100_000)]
    number = {(l, v): i for i, (l, v, _) in enumerate(names)}

    def coded(s: list) -> np.ndarray:
        return np.array([[*(number[l, v] for l, v in enumerate(x)), len(number)] for x in s], np.int64).reshape(len(s), len(label_cols) + 1)

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "_id"])
        code = coded(pdf["_s"].tolist())
        marginals = Marginals(np.bincount(code.ravel(), minlength=len(number) + 1), n_splits)
        return pd.DataFrame({"_id": pdf["_id"], "_s": pdf["_s"], "_f": marginals.place(code).astype(np.int32)})
    key = F.pmod(F.xxhash64(F.lit(seed + 1), "_id"), F.lit(max(groups, 1)))
    id_type = df.schema[id_col].dataType.simpleString()
    parts = [dealt]
    done = None
    if groups > 1:
        done = pin(rest.filter(key > 0).withColumn("_g", key).groupBy("_g").applyInPandas(of_group, f"_id {id_type}, _s array<string>, _f int"))
        parts.append(done.select("_id", "_f"))
    last = rest.filter(key == 0).orderBy("_h", "_id").collect()     # about ``greedy_rows`` at most
    code = coded([r["_s"] for r in last])
    target = np.bincount(code.ravel(), minlength=len(number) + 1).astype(float)
    marginals = Marginals(target, n_splits)
    if done is not None:                                    # what the other groups have too many of, this one leaves out
        over = done.select("_f", cells.alias("c")).groupBy("_f", F.col("c.l").alias("l"), F.col("c.v").alias("v")).count().collect()
        got = np.zeros_like(marginals.lack)
        for f, l, v, n in over:
            got[number[l, v], f] = n
        got[-1] = [sum(n for f, l, _, n in over if f == k and l == 0) for k in range(n_splits)]
        marginals.lack += got.mean(axis=1, keepdims=True) - got
    fold = marginals.place(code)
    table = spark.createDataFrame([(r["_id"], int(f)) for r, f in zip(last, fold)], f"_id {id_type}, _f int")
    for p in [*parts[1:], table]:
        dealt = dealt.unionByName(p)
    return df.drop(fold_col).join(dealt.withColumnRenamed("_f", fold_col), F.col(id_col).eqNullSafe(F.col("_id")), "left").drop("_id")


# Bits of a value that one round of counting decides.
RANK_BITS = 12


def _keys(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; the two zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _value(key: int) -> float:
    key = np.int64(key)
    return float((key ^ ((key >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def _bin_counts(ranges: list[tuple[int, int]], bits: int):
    """Per task, for the bins of disjoint ascending key ranges: rows, smallest and largest key."""
    lows, highs = np.array(ranges, np.int64).T
    shift = np.array([max(0, (high - low).bit_length() - bits) for low, high in ranges], np.uint64)

    def run(batches):
        for pdf in batches:
            key = _keys(pdf["x"].to_numpy(np.float64))
            which = np.searchsorted(lows, key, "right") - 1
            inside = (which >= 0) & (key <= highs[which])
            key, which = key[inside], which[inside]
            bin_ = ((key.view(np.uint64) - lows[which].view(np.uint64)) >> shift[which]).astype(np.int64)
            cell = (which << bits) + bin_
            order = np.lexsort((key, cell))
            cell, key = cell[order], key[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(cell)) - 1 if len(cell) else first
            yield pd.DataFrame({"cell": cell[first], "n": last - first + 1, "low": key[first], "high": key[last]})
    return run


def order_statistics(df: DataFrame, col: str, ranks: list[int], bits: int = RANK_BITS) -> dict[int, float]:
    """The values at 0-based ``ranks`` of a column in ascending order (nulls and NaN left out), exactly.

    Doubles are compared as 64-bit integers in the same order. A round counts the rows of every bin of the ranges that still hold a
    wanted rank, with the smallest and largest value of each bin; a bin of one value is an answer, others are the ranges of
    the next round. A round decides ``bits`` bits, so there are at most 64 / ``bits`` whatever the values. Only counts
    are shuffled, at most 2^``bits`` per range and batch; values need not fit anywhere at once and equal values cost nothing.
    """
    x = F.col(col).cast("double")
    rows = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    n, lo, hi = rows.select(F.count("x"), F.min("x"), F.max("x")).first()
    ranks = sorted({r for r in ranks if 0 <= r < n})
    found: dict[int, float] = {}
    low_key, high_key = (int(_keys(np.array([v]))[0]) for v in (lo, hi)) if ranks else (0, 0)
    ranges = [(low_key, high_key, 0, n)] if ranks else []   # (smallest, largest, rows below, rows inside)
    while ranges:
        open_: list[tuple] = []
        for low, high, below, inside in ranges:
            wanted = [r for r in ranks if below <= r < below + inside]
            if low == high:
                found.update({r: _value(low) for r in wanted})
            elif wanted:
                open_.append((low, high, below))
        ranges = []
        if not open_:
            break
        counted = rows.mapInPandas(_bin_counts([r[:2] for r in open_], bits), "cell long, n long, low long, high long") \
            .groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        below = [b for _, _, b in open_]
        for r in sorted(collect_small(counted, len(open_) << bits), key=lambda r: r["cell"]):
            i = r["cell"] >> bits
            ranges.append((r["low"], r["high"], below[i], r["n"]))
            below[i] += r["n"]
    return found


def quantile_edges(df: DataFrame, col: str, q: int = 50) -> list[float]:
    """Distinct exact quantile edges (linear interpolation, as pandas), q + 1 numbers at most."""
    n = df.select(F.count(F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double")))).first()[0]
    if not n:
        return []
    places = [i / q * (n - 1) for i in range(q + 1)]
    values = order_statistics(df, col, [r for p in places for r in (math.floor(p), math.ceil(p))])
    edges = []
    for p in places:
        a, b = values[math.floor(p)], values[math.ceil(p)]
        edges.append(a if a == b else a + (b - a) * (p - math.floor(p)))
    return sorted(set(edges))


def qcut_bins(df: DataFrame, col: str, q: int = 50, out: str | None = None) -> DataFrame:
    """D3: ``pd.qcut(x, q, labels=False, duplicates='drop')``: bin = number of inner edges strictly below x; null and NaN have none.

    The bin is a sum of native comparisons against the literal edges (stays in whole-stage codegen).
    """
    out = out or f"{col}_bin"
    edges = quantile_edges(df, col, q)
    x = F.col(col).cast("double")
    below = F.lit(0)
    for e in edges[1:-1]:
        below = below + F.when(F.lit(e) < x, 1).otherwise(0)
    return df.withColumn(out, F.when(x.isNotNull() & ~F.isnan(x), below).cast("int"))


def fold_split(df: DataFrame, k: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, valid) for fold k; a missing fold counts as train; no fold column → everything is valid."""
    if fold_col not in df.columns:
        return df.limit(0), df
    valid = df.filter(F.col(fold_col) == k)
    train = df.filter(~F.col(fold_col).eqNullSafe(F.lit(k)))
    return train, valid


def split_label(k: int, fold_col: str = "fold") -> Column:
    return F.when(F.col(fold_col).eqNullSafe(F.lit(k)), F.lit("valid")).otherwise(F.lit("train"))


def sample_n(df: DataFrame, n: int, seed: int, id_col: str = "text_id") -> DataFrame:
    """Exactly n rows, repeatable: the n smallest seeded digests (distributed top-k, not a global sort)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)).cast("binary")), F.col(id_col)).limit(n)


def head_n(df: DataFrame, n: int, id_col: str = "text_id") -> DataFrame:
    """First n rows in id order (top-k)."""
    return df.orderBy(id_col).limit(n)
