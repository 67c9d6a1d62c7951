"""Leave-one-fold-out ridge from moments against dense solves on the training rows themselves."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import ridge
from quillspark.operators import scoring as SC
from quillspark.targets import TARGETS

N = 40          # features


def table(spark, rng, n, folds=5, prefix="t", missing=0.0):
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(["Alpha", "beta", "gamma,", "delta!", "x1", "y2", "z3"]) + str(rng.randrange(6)) for _ in range(rng.randint(0, 30)))
        y = [None if rng.random() < missing / 2 else float("nan") if rng.random() < missing / 2 else rng.randint(2, 10) / 2 for _ in TARGETS]
        rows.append((f"{prefix}{i}", None if i == 7 else text, rng.randrange(folds) if i % 11 else None, rng.choice([0.5, 1.0, 2.0]), *y))
    schema = "text_id string, full_text string, fold int, wt double, " + ", ".join(f"{t} double" for t in TARGETS)
    return spark.createDataFrame(rows, schema).repartition(4)


def dense(df):
    rows = df.select("text_id", "fold", "wt", *TARGETS, ridge.term_places(F.col("full_text"), N).alias("p")).collect()
    x = np.array([np.bincount(r["p"], minlength=N) for r in rows], float)
    y = np.array([[np.nan if r[t] is None else r[t] for t in TARGETS] for r in rows])
    return [r["text_id"] for r in rows], [r["fold"] for r in rows], np.array([r["wt"] for r in rows]), x, y


def dense_model(x, y, w, reg):
    """Augmented least squares on the rows: no moments, no normal equations."""
    idf = np.log((len(x) + 1) / ((x > 0).sum(axis=0) + 1))
    out = []
    for t in range(y.shape[1]):
        ok = ~np.isnan(y[:, t])
        xt, yt, wt = x[ok] * idf, y[ok, t], w[ok] / w[ok].sum()
        mean = wt @ xt
        sd = np.sqrt(wt @ (xt - mean) ** 2)
        live = sd > 1e-6
        z = (xt[:, live] - mean[live]) / sd[live]
        a = np.vstack([np.sqrt(wt)[:, None] * z, np.sqrt(reg) * np.eye(live.sum())])
        b = np.concatenate([np.sqrt(wt) * (yt - wt @ yt), np.zeros(live.sum())])
        beta = np.zeros(x.shape[1])
        beta[live] = np.linalg.lstsq(a, b, rcond=None)[0] / sd[live]
        out.append(lambda q, beta=beta, mean=mean, top=wt @ yt: top + (q * idf - mean) @ beta)
    return lambda q: np.stack([f(q) for f in out], axis=1)


@pytest.mark.parametrize("missing,weighted,extra", [(0.0, False, None), (0.3, True, "fold_model"), (0.2, False, "all")])
def test_predictions_equal_dense_fits(spark, missing, weighted, extra):
    rng = random.Random(repr((missing, weighted)))
    df = table(spark, rng, 160, missing=missing)
    more = table(spark, rng, 80, prefix="x").withColumnRenamed("fold", "fold_model") if extra else None
    oof, other = SC.fold_fit_oof(df, num_features=N, reg=0.3, weight_col="wt" if weighted else None, extra_train=more,
                                 extra_fold_col="fold_model" if extra == "fold_model" else None, score_also=df)
    got = {r["text_id"]: [r[f"pred_{t}"] for t in TARGETS] for r in oof.collect()}
    also = {(r["text_id"], r["fold_model"]): [r[f"pred_{t}"] for t in TARGETS] for r in other.collect()}
    ids, fold, w, x, y = dense(df)
    w = w if weighted else np.ones(len(w))
    fold = np.array([-1 if f is None else f for f in fold])
    assert set(got) == {i for i, f in zip(ids, fold) if f >= 0} and len(also) == 5 * len(ids)
    for k in range(5):
        train = [x[fold != k]], [y[fold != k]], [w[fold != k]]
        if extra:
            _, model, we, xe, ye = dense(more.withColumnRenamed("fold_model", "fold"))
            own = np.array([extra == "all" or m == k for m in model])
            for part, e in zip(train, (xe, ye, we if weighted else np.ones(len(we)))):
                part.append(e[own])
        want = dense_model(*(np.concatenate(p) for p in train), 0.3)(x)
        for i, name in enumerate(ids):
            assert np.allclose(also[name, k], want[i], atol=1e-7)
            if fold[i] == k:
                assert np.allclose(got[name], want[i], atol=1e-7)


def test_moments_are_exact_however_rows_are_split(spark, monkeypatch):
    df = table(spark, random.Random(5), 90)
    rows = df.select(F.coalesce(F.col("fold").cast("string"), F.lit("none")).alias("grp"), ridge.term_places(F.col("full_text"), N).alias("places"),
                     F.array(*TARGETS).alias("y"), F.lit(1.0).alias("w"))
    a, b = ridge.moments(rows, N), ridge.moments(rows.repartition(13), N)
    assert a.gram.keys() == b.gram.keys() and len(a.docs) == 6
    for key in a.gram:
        assert (a.gram[key] == b.gram[key]).all()           # counts and half points: sums are exact
    z = {r["grp"]: 0 for r in rows.select("grp").distinct().collect()}
    assert set(z) == set(a.docs)
    with pytest.raises(ValueError, match="not a parameter table"):
        monkeypatch.setattr(ridge, "DRIVER_BYTES", 60_000)
        ridge.moments(rows, N)


def test_one_pass_over_the_rows(spark):
    """The number of jobs does not grow with folds times targets, and a fold without training rows is an error."""
    df = table(spark, random.Random(6), 60, folds=3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ridge", "ridge")
    SC.fold_fit_oof(df, n_folds=3, num_features=N)
    few = len(tracker.getJobIdsForGroup("ridge"))
    spark.sparkContext.setJobGroup("ridge10", "ridge10")
    SC.fold_fit_oof(df, n_folds=10, num_features=N)
    assert len(tracker.getJobIdsForGroup("ridge10")) == few
    spark.sparkContext.setJobGroup("", "")
    with pytest.raises(ValueError, match="no training rows"):
        SC.fold_fit_oof(df.filter("fold = 1"), num_features=N)


def test_memory_of_moments_does_not_follow_the_batch():
    """A batch four times as large needs little more than its own rows; dense counts of all its rows would need 16 kB a row."""
    rng = np.random.default_rng(5)
    n, width = 512, 512

    def peak(rows):
        places = pa.array(rng.integers(0, width, (rows, 3)).astype(np.int32).tolist(), pa.list_(pa.int32()))
        y = pa.array(rng.normal(size=(rows, len(TARGETS))).tolist(), pa.list_(pa.float64()))
        batch = pa.RecordBatch.from_arrays([pa.array([f"g{i % 2}" for i in range(rows)]), places, y, pa.array(np.ones(rows))],
                                           names=["grp", "places", "y", "w"])
        tracemalloc.start()
        out = sum(b.num_rows for b in ridge._partial_moments(n, len(TARGETS))(iter([batch])))
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, size
    small, large = peak(2_000), peak(8_000)
    assert small[0] == large[0] and large[1] - small[1] < 10 << 20
