"""Stored models: two kinds that read the text differently, scored by a registry within a memory bound."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import models as M
from quillspark.operators import scoring as SC
from quillspark.plans import fixtures as fx
from quillspark.sources.tables import Tables
from quillspark.targets import TARGETS

from .conftest import SF_SMALL

N = 64


@pytest.fixture(scope="module")
def stored(spark):
    cur = fx.current_population(Tables(spark, SF_SMALL)).select("text_id", "full_text", "fold", *TARGETS)
    folds = {kind: M.fit_model(cur, kind, N, reg=0.5) for kind in ("terms", "grams")}
    return cur, folds, {kind: M.save_model(spark, f, kind) for kind, f in folds.items()}


def test_own_fold_scores_equal_the_fold_fits(spark, stored):
    """The stored term model gives each row what the leave-one-fold-out fit predicts for it."""
    cur, _, paths = stored
    want = {r["text_id"]: [r[f"pred_{t}"] for t in TARGETS] for r in SC.fold_fit_oof(cur, num_features=N, reg=0.5)[0].collect()}
    got = {r["text_id"]: [r[t] for t in TARGETS] for r in M.score_stored(cur, {"m": paths["terms"]}, fold_col="fold").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)


def test_registry_scores_equal_dense_products(spark, stored):
    """Both kinds, fold means and single folds, against numpy on the features of each text."""
    cur, folds, paths = stored
    rows = cur.unionByName(spark.createDataFrame([("none", None, 1), ("empty", "", 2), ("x", "a", None)], "text_id string, full_text string, fold int"), True)
    mean = {(r["model_id"], r["text_id"]): [r[t] for t in TARGETS] for r in M.score_stored(rows, paths).collect()}
    single = {(r["model_id"], r["text_id"], r["fold_model"]): [r[t] for t in TARGETS] for r in M.score_stored(rows, paths, mean=False).collect()}
    n = rows.count()
    assert len(mean) == 2 * n and len(single) == 10 * n
    for kind, features in M.FEATURES.items():
        for r in rows.select("text_id", features(F.col("full_text"), N).alias("p")).collect():
            x = np.concatenate(([1.0], np.bincount(np.array(r["p"], int), minlength=N)))
            want = [x @ m for m in folds[kind]]
            assert np.allclose(mean[kind, r["text_id"]], np.mean(want, axis=0), atol=1e-9)
            assert all(np.allclose(single[kind, r["text_id"], k], want[k], atol=1e-9) for k in range(5))
    own = {r["text_id"]: r["fold_model"] for r in M.score_stored(rows, {"g": paths["grams"]}, fold_col="fold").collect()}
    assert own["empty"] == 2 and "x" not in own


def test_memory_holds_no_more_than_the_bound(spark, stored, tmp_path):
    _, folds, _ = stored
    paths = {}
    for i in range(5):
        paths[f"m{i}"] = M.save_model(spark, folds["terms"], "terms", f"{tmp_path}/m{i}")
    size = sum(m.nbytes for m in folds["terms"])
    for most, reads in ((2 * size, 15), (10 * size, 5), (0, 15)):
        models = M.Models(paths, most)
        for _ in range(3):
            for name in sorted(paths):
                assert all((a == b).all() for a, b in zip(models.get(name), folds["terms"]))
        assert models.reads == reads and models.peak <= max(most, size)


def test_models_are_shipped_file_by_file(spark, stored, tmp_path, monkeypatch):
    """Folders can be shipped in local mode only; models whose folders have the same name are told apart."""
    cur, folds, _ = stored
    first = M.save_model(spark, folds["terms"], "terms", f"{tmp_path}/a b/m")
    second = M.save_model(spark, [m + 1 for m in folds["terms"]], "terms", f"{tmp_path}/c%d/m")
    spark.read.parquet(second).repartition(3).write.parquet(f"{tmp_path}/parts/m")
    sent = []
    add = spark.sparkContext.addFile
    monkeypatch.setattr(spark.sparkContext, "addFile", lambda path, recursive=False: (sent.append((path, recursive)), add(path, recursive)))
    rows = cur.limit(20)
    for _ in range(2):
        got = {}
        for r in M.score_stored(rows, {"first": first, "second": second, "parts": f"{tmp_path}/parts/m"}, mean=False).collect():
            got.setdefault(r["model_id"], {})[r["text_id"], r["fold_model"]] = np.array([r[t] for t in TARGETS])
        assert all(got["first"].keys() == got[n].keys() and len(got[n]) == 100 for n in got)
        assert not any(np.allclose(x, got["second"][k]) for k, x in got["first"].items())
        assert all((x == got["parts"][k]).all() for k, x in got["second"].items())
    assert len(sent) == len(set(sent)) >= 3 and all(path.endswith(".parquet") and not recursive for path, recursive in sent)


def test_trigrams(spark):
    rows = spark.createDataFrame([("abcd",), ("A",), ("",), (None,)], "t string").select("t", M.gram_places(F.col("t"), 1 << 20).alias("p")).collect()
    assert [len(r["p"]) for r in rows] == [4, 1, 1, 1] and rows[2]["p"] == rows[3]["p"]


def test_trigrams_of_a_long_text_take_time_in_proportion(spark):
    """One text of 200,000 characters; counting up to every place again would take minutes."""
    text = "aé日𝒳 B\n" * 28_600
    rows = spark.createDataFrame([(text,)], "t string")
    begin = time.time()
    got = rows.select(M.gram_places(F.col("t"), 1 << 20).alias("p")).first()["p"]
    assert time.time() - begin < 20
    padded = f" {text.lower()} "
    distinct = sorted({padded[i:i + 3] for i in range(len(padded) - 2)})
    place = {r["g"]: r["p"] for r in spark.createDataFrame([(g,) for g in distinct], "g string")
             .select("g", F.pmod(F.xxhash64("g"), F.lit(1 << 20)).cast("int").alias("p")).collect()}
    assert got == [place[padded[i:i + 3]] for i in range(len(padded) - 2)]


def test_trigrams_are_those_of_the_lower_cased_text(spark):
    texts = ["", "a", "ab", "İIß", "a\nb\r\n", "𝒳𝒴", "\u2028x\x00y", "e\u0301É", " ", "   ", "日本 GO", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["p"] for r in rows.select("i", M.gram_places(F.col("t"), 1 << 30).alias("p")).collect()}
    lower = {r["i"]: f" {r['l']} " for r in rows.select("i", F.lower(F.coalesce("t", F.lit(""))).alias("l")).collect()}
    grams = {i: [t[k:k + 3] for k in range(max(1, len(t) - 2))] for i, t in lower.items()}
    place = {r["g"]: r["p"] for r in spark.createDataFrame([(g,) for g in {g for x in grams.values() for g in x}], "g string")
             .select("g", F.pmod(F.xxhash64("g"), F.lit(1 << 30)).cast("int").alias("p")).collect()}
    assert got == {i: [place[g] for g in x] for i, x in grams.items()}


def test_a_batch_is_scored_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, N, n).tolist() for n in (0, 5, 40, 1, 0, 7, 3, 0)]
    model = rng.normal(size=(N + 1, len(TARGETS)))
    places = pa.array([[9], *rows], pa.list_(pa.int32())).slice(1)
    want = [model[0] + sum((model[p + 1] for p in r), np.zeros(len(TARGETS))) for r in rows]
    for most in (1, 8, 1 << 20):
        monkeypatch.setattr(M, "SCORED", most)
        assert np.allclose(M.apply_model(model, places), want, atol=1e-12)


def test_dense_and_single_sums_agree(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, N, n).tolist() for n in (90, 0, 700, 64, 1, 2000)]
    places = pa.array([[3, 4], *rows], pa.list_(pa.int32())).slice(1)
    models = [rng.normal(size=(N + 1, len(TARGETS))) for _ in range(5)]
    want = [[m[0] + sum((m[p + 1] for p in r), np.zeros(len(TARGETS))) for r in rows] for m in models]
    for share in (0, 8, 1 << 20):
        monkeypatch.setattr(M, "DENSE", share)
        for most in (1, 100, 1 << 20):
            monkeypatch.setattr(M, "SCORED", most)
            assert np.allclose(M.apply_models(models, places), want, atol=1e-10)
    models[2][5, 1] = np.nan                                # feature 4
    monkeypatch.setattr(M, "DENSE", 8)
    has = [4 in r for r in rows]
    assert any(has) and not all(has) and np.isnan(M.apply_models(models, places)[2][:, 1]).tolist() == has
    assert [x.shape for x in M.apply_models(models, places.slice(0, 0))] == [(0, len(TARGETS))] * 5


def test_unknown_kinds_are_errors(spark, stored):
    with pytest.raises(ValueError):
        M.save_model(spark, stored[1]["terms"], "sums")
