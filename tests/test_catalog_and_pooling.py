"""The whole catalogue in one pass against one ensemble at a time, and vector aggregates against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import ensemble as G
from quillspark.operators import pooling as P
from quillspark.targets import TARGETS

CATALOG = "ensemble_id string, kind string, source string, destination string, fold_source string, model_id string, target string, w double"
MODELS = ["a", "b", "c", "d"]


def catalog(spark, rng):
    rows = []
    for i in range(9):
        models = rng.sample(MODELS, rng.randint(1, 4))
        facts = (f"e{i}", G.KINDS[i % 3], ("p", "q")[i % 2], f"out{i}", G.FOLD_SOURCES[i % 4 == 2])
        rows += [(*facts, m, t, rng.uniform(0.1, 2)) for m in models for t in TARGETS]
    return spark.createDataFrame(rows, CATALOG)


def predictions(spark, rng, n):
    rows = [(m, f, f"t{i}", t, rng.uniform(0, 6)) for m in MODELS for f in range(3) for i in range(n) for t in TARGETS]
    rows = [r if rng.random() > 0.03 else (*r[:4], None) for r in rows if rng.random() > 0.05]      # gaps and nulls
    rows += rng.sample(rows, 5)                                                                      # duplicates
    return spark.createDataFrame(rows, "model_id string, fold int, text_id string, target string, pred double")


def near(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


def test_whole_catalogue_equals_single_ensembles(spark):
    rng = random.Random(1)
    cat = catalog(spark, rng)
    sources = {"p": predictions(spark, rng, 25), "q": predictions(spark, rng, 10).filter("model_id != 'd' or text_id < 't5'")}
    whole = G.blend_catalog(cat, sources, ["fold", "text_id"], n_folds=3).cache()
    assert whole.columns == ["ensemble_id", "destination", "fold", "text_id", *TARGETS]
    for i in range(9):
        one = G.route_catalog(cat, f"e{i}", sources, ["fold", "text_id"], n_folds=3).select("destination", "fold", "text_id", *TARGETS)
        got = whole.filter(F.col("ensemble_id") == f"e{i}").drop("ensemble_id")
        assert near(got.collect()) == near(one.collect()) and got.count() > 0


def test_one_exchange_for_all_ensembles(spark):
    rng = random.Random(2)
    cat = catalog(spark, rng).filter("source = 'p'")
    plan = G.blend_catalog(cat, {"p": predictions(spark, rng, 4)}, ["fold", "text_id"])._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition") == 1


def test_catalogue_errors(spark):
    ok = ("e", "modelwise", "p", "out", "own", "a")
    preds = {"p": predictions(spark, random.Random(3), 2)}
    full = [(*ok, t, 1.0) for t in TARGETS]
    for rows, error in [(full + [("e", "columnwise", "p", "out", "own", "b", TARGETS[0], 1.0)], ValueError), (full + full[:1], ValueError), (full[1:], ValueError),
                        ([("e", "x", *r[2:]) for r in full], ValueError), ([(*r[:2], "z", *r[3:]) for r in full], KeyError),
                        ([(*r[:4], "last", *r[5:]) for r in full], ValueError), ([], ValueError)]:
        with pytest.raises(error):
            G.blend_catalog(spark.createDataFrame(rows, CATALOG), preds, ["fold", "text_id"])


def test_vector_aggregates(spark):
    rng = np.random.default_rng(4)
    rows = []
    for doc, n in ((1, 400), (2, 3), (3, 5), (4, 1)):
        for i in range(n):
            v = [float(x) for x in np.round(rng.normal(size=5), 3)]
            if i % 4 == 1:
                v[1] = None
            rows.append((doc, int(i % 2), i, 0 if doc == 3 or i % 3 == 0 else 1, v))
    rows.append((2, 1, 9, 1, None))
    df = spark.createDataFrame(rows, "doc_id long, layer int, pos int, mask int, vec array<float>").repartition(7)
    got = {name: {(r["doc_id"], r["dim"]): r["value"] for r in out.collect()} for name, out in
           (("mean", P.pool_mean(df, 1)), ("max", P.pool_max(df, 1)), ("min", P.pool_min(df, 1)), ("gem", P.pool_gem(df, 1)), ("both", P.pool_meanmax(df, 1)))}
    docs = {d: [(m, v) for x, lay, _, m, v in rows if x == d and lay == 1 and v] for d in (1, 2, 3)}
    assert {k[0] for k in got["mean"]} == {1, 2, 3} and len(got["both"]) == 30
    for d, tokens in docs.items():
        m = np.array([t[0] for t in tokens], float)
        v = np.array([[np.nan if x is None else np.float32(x) for x in t[1]] for t in tokens], float)
        kept = np.where(m[:, None] == 1, v, np.nan)
        for j in range(5):
            own = kept[:, j][~np.isnan(kept[:, j])]
            gone = len(own) < len(tokens)
            mean = own.sum() / max(m.sum(), 1e-9)
            top = max([*own, *([-1e4] if gone else [])])
            low = min([*own, *([1e4] if gone else [])])
            gem = ((np.maximum(own, 1e-6) ** 3).sum() / max(m.sum(), 1e-6)) ** (1 / 3)
            assert abs(got["mean"][d, j] - mean) < 1e-9 and abs(got["both"][d, j] - mean) < 1e-9
            assert abs(got["max"][d, j] - top) < 1e-9 and abs(got["both"][d, j + 5] - top) < 1e-9
            assert abs(got["min"][d, j] - low) < 1e-9 and abs(got["gem"][d, j] - gem) < 2e-6      # a null counts as the least value


def test_one_row_a_document_is_shuffled(spark):
    """The exchange below the final aggregate carries vectors, not components."""
    df = spark.range(1000).select((F.col("id") % 10).alias("doc_id"), F.lit(1).alias("layer"), F.lit(1).alias("mask"), F.array(*[F.lit(float(i)) for i in range(8)]).alias("vec"))
    plan = P.pool_mean(df, 1)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    below = plan[plan.index("Exchange"):]
    assert "Generate" not in below and plan.count("Exchange") == 1 and "partial_" in below
