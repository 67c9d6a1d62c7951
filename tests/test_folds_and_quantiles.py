"""Row-level stratification and exact quantiles."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import folds as D


def worst(pdf, labels, k):
    """Largest distance of a (label, value, fold) count from its share."""
    out = np.abs(np.bincount(pdf["fold"], minlength=k) - len(pdf) / k).max()
    for c in labels:
        for _, g in pdf.groupby(pdf[c].astype(object).where(pdf[c].notna(), "none")):
            out = max(out, np.abs(np.bincount(g["fold"], minlength=k) - len(g) / k).max())
    return out


def table(spark, rng, n, values=9):
    rows = [(f"t{i}", *[rng.choices(range(values), [1 / (v + 1) ** 2 for v in range(values)])[0] / 2 for _ in range(4)], rng.choice(["a", "b", None])) for i in range(n)]
    return spark.createDataFrame(rows, "text_id string, a double, b double, c double, d double, s string").repartition(5)


@pytest.mark.parametrize("n,k", [(60, 5), (700, 5), (700, 3), (3, 5), (0, 5)])
def test_marginals_within_one_row(spark, n, k):
    df = table(spark, random.Random(n), n)
    labels = ["a", "b", "c", "d", "s"]
    out = D.stratified_folds(df, labels, n_splits=k).toPandas()
    assert len(out) == n and set(out.columns) == {*df.columns, "fold"} and out["fold"].notna().all()
    assert worst(out, labels, k) <= (1 if n != 3 else 0.9)
    again = D.stratified_folds(df.repartition(11), labels, n_splits=k).toPandas()
    assert dict(zip(out.text_id, out.fold)) == dict(zip(again.text_id, again.fold))
    if n == 700:
        other = D.stratified_folds(df, labels, n_splits=k, seed=1).toPandas()
        assert dict(zip(out.text_id, out.fold)) != dict(zip(other.text_id, other.fold))


def test_groups_of_remainders_even_out(spark):
    """More remainders than one group holds: placed group by group, and the group held back makes up for the rest."""
    df = table(spark, random.Random(5), 2500, values=30)
    out = D.stratified_folds(df, ["a", "b", "c", "d"], greedy_rows=400).toPandas()
    assert len(out) == 2500 and worst(out, ["a", "b", "c", "d"], 5) <= 3


def test_hot_combination_and_shared_ids(spark):
    """A combination of half of all rows is dealt in rounds; rows of one id stay together; null ids have a fold."""
    rows = [(f"h{i}", 1.0, "x") for i in range(501)] + [(f"t{i}", float(i % 7), "y") for i in range(490)] + [("h3", 5.0, "z"), (None, 2.0, "y")]
    df = spark.createDataFrame(rows, "text_id string, a double, s string")
    out = D.stratified_folds(df, ["a", "s"]).toPandas()
    assert len(out) == len(rows) and out["fold"].notna().all()
    assert out[out.text_id == "h3"]["fold"].nunique() == 1
    hot = np.bincount(out[(out.a == 1.0) & (out.s == "x")]["fold"], minlength=5)
    assert hot.max() - hot.min() <= 2


def test_labels_of_many_values(spark):
    """Integers and strings with more values than strata are labels of their own."""
    df = spark.range(1000).select(F.col("id").cast("string").alias("text_id"), (F.col("id") % 450).cast("int").alias("n"), F.concat(F.lit("v"), F.col("id") % 300).alias("s"))
    out = D.stratified_folds(df, ["n", "s"]).toPandas()
    assert worst(out, ["n", "s"], 5) <= 1


def exact(x, ranks):
    x = sorted(v for v in x if v is not None and not math.isnan(v))
    return {r: x[r] for r in ranks if 0 <= r < len(x)}


@pytest.mark.parametrize("kind", ["uniform", "heavy", "ties", "extreme", "one", "none"])
def test_order_statistics(spark, kind):
    rng = random.Random(kind)
    x = {"uniform": [rng.uniform(-5, 5) for _ in range(3000)], "heavy": [math.exp(rng.uniform(-600, 600)) * rng.choice([1, -1]) for _ in range(2000)],
         "ties": [rng.choice([0.0, 1.0, 1.0, 2.5]) for _ in range(3000)] + [None, float("nan")],
         "extreme": [1.7e308, -1.7e308, 5e-324, 0.0, -0.0, float("inf"), float("-inf"), float("inf"), 1.0, math.nextafter(1, 2)] * 3,
         "one": [3.0], "none": [None, float("nan")]}[kind]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    ranks = sorted({0, 1, 7, len(x) // 3, len(x) // 2, len(x) - 3, len(x) - 1, len(x) + 5})
    for bits in (D.RANK_BITS, 7) if kind in ("heavy", "extreme") else (D.RANK_BITS,):
        assert D.order_statistics(df, "x", ranks, bits) == exact(x, ranks)


def test_quantile_bins_of_many_distinct_values(spark):
    """A million different doubles: edges and bins as numpy's, no map of values."""
    df = spark.range(1_000_000).select(F.exp(F.rand(7) * 20 - 10).alias("x"))
    values = df.toPandas()["x"].to_numpy()
    edges = D.quantile_edges(df, "x", 50)
    want = np.quantile(values, np.arange(51) / 50)
    assert np.allclose(edges, want, rtol=1e-12, atol=0)
    got = D.qcut_bins(df, "x", 50).groupBy("x_bin").count().toPandas().set_index("x_bin")["count"]
    ours = pd.Series(np.searchsorted(np.array(edges)[1:-1], values, "left")).value_counts()
    assert got.sort_index().tolist() == ours.sort_index().tolist() and len(got) == 50


def test_qcut_equals_pandas(spark):
    rng = random.Random(3)
    x = [rng.choice([round(rng.gauss(0, 3), 1), None, 2.0]) for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    got = [r["x_bin"] for r in D.qcut_bins(df, "x", 20).orderBy("i").collect()]
    want = pd.qcut(pd.Series(x, dtype=float), 20, labels=False, duplicates="drop")
    assert [g is None for g in got] == want.isna().tolist()
    assert [g for g in got if g is not None] == want.dropna().astype(int).tolist()
