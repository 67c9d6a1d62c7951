"""Invariants for the rows-only keys and hand-made goldens for the traps listed in FIXTURES.md §3."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import tokens as K
from quillspark.operators import batching as B
from quillspark.operators import ensemble as G
from quillspark.operators import folds as D
from quillspark.operators import metrics as M
from quillspark.operators import positions as POS
from quillspark.operators import scoring as SC
from quillspark.operators import weights as H
from quillspark.plans import fixtures as fx
from quillspark.sources.tables import Tables, read_csv, write_csv
from quillspark.session import scratch_path
from quillspark.targets import TARGETS, clip_score

from .conftest import SF_CHECK, SF_SMALL


# --- text goldens -----------------------------------------------------------------------------------------------

def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first()["o"]


def test_repair_goldens(spark):
    assert _one(spark, "caf" + "Ã©", X.repair_encoding) == "café"
    assert _one(spark, "it’s", X.repair_encoding) == "it\\u2019s"
    assert _one(spark, "Ω", X.repair_encoding) == "\\u03a9"
    assert _one(spark, "a\x81b", X.repair_encoding) == "a\x81b"  # undefined in cp1252: kept
    assert _one(spark, "plain ascii", X.repair_encoding) == "plain ascii"
    assert _one(spark, "crème brûlée", X.repair_encoding) == "crème brûlée"


def test_repair_fixed_point_rule():
    """Texts outside MAY_NEED_REPAIR are fixed points of the codec chain (the native short-cut is exact)."""
    import random
    import re
    rng = random.Random(0)
    pat = re.compile("[\x80-\xbfĀ-\U0010ffff]")
    alphabet = [chr(c) for c in range(32, 127)] + [chr(c) for c in range(0xC0, 0x100)] + ["\n"]
    for _ in range(2000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert not pat.search(s)
        assert X.repair_encoding_py(s) == s


def test_placeholder_goldens(spark):
    assert _one(spark, "BROTHER_NAME", X.canon_placeholders) == "BR[OTHER_NAME]"
    assert _one(spark, "PROEPR_NAME", X.canon_placeholders) == "[PROPER_NAME]"
    once = _one(spark, "STUDENT_NAME", X.canon_placeholders)
    assert once == "[STUDENT_NAME]"
    assert _one(spark, once, X.canon_placeholders) == "[[STUDENT_NAME]]"  # not idempotent


def test_clean_and_fold_goldens(spark):
    assert _one(spark, "Ærø ß\nGeneric_Name", lambda c: X.clean_text(c, 1)) == "AEro ss[BR][GENERIC_NAME]"
    assert _one(spark, "Ærø ß\nGeneric_Name", lambda c: X.clean_text(c, 2)) == "AEro ss\n[GENERIC_NAME]"
    assert _one(spark, "Ωmega Щука ěščřž ή", X.ascii_fold) == "Omega Shchuka escrz e"
    assert _one(spark, "中x", X.ascii_fold) == "x"  # outside the table: NFKD, then dropped (documented)
    assert _one(spark, None, lambda c: X.clean_text(c, 1)) == ""
    assert _one(spark, " a  b c ", X.reverse_words) == "c b a"
    assert _one(spark, "a,b!(c)-d  e", X.pad_punctuation) == "a , b ! ( c ) - d e"


# --- clip and blend goldens ---------------------------------------------------------------------------------------

def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(0.5,), (7.0,), (None,), (float("nan"),), (3.2,)], "p double")
    got = [r["c"] for r in df.select(clip_score("p").alias("c")).collect()]
    assert got[0] == 1.0 and got[1] == 5.0 and got[2] is None and math.isnan(got[3]) and got[4] == 3.2


def _preds(spark, rows):
    return spark.createDataFrame(rows, "model_id string, text_id string, target string, pred double")


def _w(spark, rows):
    return spark.createDataFrame(rows, "model_id string, target string, w double")


def test_blend_missing_model_is_null_even_with_zero_weight(spark):
    preds = _preds(spark, [("a", "t1", t, 2.0) for t in TARGETS] + [("b", "t2", t, 3.0) for t in TARGETS]
                   + [("a", "t2", t, 4.0) for t in TARGETS])
    w = _w(spark, [("a", t, 1.0) for t in TARGETS] + [("b", t, 0.0) for t in TARGETS])
    out = {r["text_id"]: r for r in G.blend(preds, w, ["text_id"]).collect()}
    assert out["t1"]["cohesion"] is None
    assert out["t2"]["cohesion"] == 4.0


def test_blend_single_model_and_empty(spark):
    preds = _preds(spark, [("a", "t1", t, 2.5) for t in TARGETS])
    w = _w(spark, [("a", t, 1.0) for t in TARGETS])
    assert G.blend(preds, w, ["text_id"]).first()["grammar"] == 2.5
    empty = preds.limit(0)
    assert G.blend(empty, w, ["text_id"]).count() == 0


def test_blend_duplicate_id_is_flagged_null(spark):
    preds = _preds(spark, [("a", "t1", t, 2.0) for t in TARGETS] * 2)
    w = _w(spark, [("a", t, 1.0) for t in TARGETS])
    assert G.blend(preds, w, ["text_id"]).first()["cohesion"] is None


def test_blend_equals_matrix_product(spark):
    rng = np.random.default_rng(1)
    n, m = 50, 5
    p = rng.uniform(1, 5, size=(n, m, len(TARGETS)))
    wts = rng.uniform(0, 1, size=(m, len(TARGETS)))
    rows = [(f"m{j}", f"t{i}", t, float(p[i, j, k])) for i in range(n) for j in range(m) for k, t in enumerate(TARGETS)]
    wrows = [(f"m{j}", t, float(wts[j, k])) for j in range(m) for k, t in enumerate(TARGETS)]
    got = {r["text_id"]: r for r in G.blend(_preds(spark, rows), _w(spark, wrows), ["text_id"]).collect()}
    expect = np.einsum("ijk,jk->ik", p, wts)
    for i in range(n):
        for k, t in enumerate(TARGETS):
            assert abs(got[f"t{i}"][t] - expect[i, k]) < 1e-9


def test_unknown_ensemble_id_is_an_error(spark):
    cat = fx.modelwise_weights(spark, "x").withColumn("kind", F.lit("modelwise"))
    with pytest.raises(KeyError):
        G.run_catalog(cat, "nope", _preds(spark, [("a", "t", "cohesion", 1.0)]), ["text_id"])


# --- folds, bins, samples ------------------------------------------------------------------------------------------

def test_strat_folds_invariants(spark):
    t = Tables(spark, SF_CHECK)
    e = fx.essays(t).select("text_id", *TARGETS)
    f1 = D.stratified_folds(e, TARGETS, seed=7).select("text_id", "fold")
    rows = f1.collect()
    n = e.count()
    assert len(rows) == n and len({r["text_id"] for r in rows}) == n
    sizes = np.bincount([r["fold"] for r in rows], minlength=5)
    assert sizes.max() - sizes.min() <= 2
    joined = e.join(f1, "text_id").toPandas()
    for tcol in TARGETS:
        for _, grp in joined.groupby(tcol):
            assert np.abs(np.bincount(grp["fold"], minlength=5) - round(len(grp) / 5)).max() <= 1
    # same result after repartitioning the input
    f2 = D.stratified_folds(e.repartition(3), TARGETS, seed=7).select("text_id", "fold")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, f2.collect()))


def test_qcut_constant_column_one_bin(spark):
    df = spark.createDataFrame([(i, 5) for i in range(30)], "i int, x int")
    assert {r["x_bin"] for r in D.qcut_bins(df, "x", 50).collect()} == {0}


def test_qcut_matches_pandas(spark):
    import pandas as pd
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, size=300)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "i int, x int")
    got = [r["x_bin"] for r in D.qcut_bins(df, "x", 50).orderBy("i").collect()]
    want = pd.qcut(pd.Series(x), q=50, labels=False, duplicates="drop").tolist()
    assert got == want


def test_sample_n_exact_and_repeatable(spark):
    e = fx.essays(Tables(spark, SF_CHECK)).select("text_id")
    a = [r[0] for r in D.sample_n(e, 50, seed=3).collect()]
    b = [r[0] for r in D.sample_n(e.repartition(5), 50, seed=3).collect()]
    assert len(a) == 50 and sorted(a) == sorted(b)


def test_fold_split_missing_fold_goes_to_train(spark):
    df = spark.createDataFrame([("a", 2), ("b", None), ("c", 1)], "text_id string, fold int")
    tr, va = D.fold_split(df, 2)
    assert sorted(r[0] for r in tr.collect()) == ["b", "c"]
    assert [r[0] for r in va.collect()] == ["a"]


# --- positions, batches, running scans ----------------------------------------------------------------------------

def test_positions_match_row_number_under_skew(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 7 % 101, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, id int")
    got = POS.attach_positions(df, ["o", "id"], ["g"], num_partitions=6).toPandas()
    pdf = df.toPandas().sort_values(["g", "o", "id"])
    pdf["want"] = pdf.groupby("g").cumcount()
    m = got.merge(pdf, on=["g", "o", "id"])
    assert (m["pos"] == m["want"]).all() and len(m) == 3000


def test_running_aggregates_match_pandas(spark):
    rows = [("hot" if i % 4 else "cold", i, float((i * 13) % 17)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, step int, v double")
    got = POS.running_aggregates(df, ["g"], ["step"], sums={"s": F.col("v")}, mins={"m": F.col("v")},
                                 num_partitions=5).toPandas().sort_values(["g", "step"])
    pdf = df.toPandas().sort_values(["g", "step"])
    pdf["s"] = pdf.groupby("g")["v"].cumsum()
    pdf["m"] = pdf.groupby("g")["v"].cummin()
    m = got.merge(pdf, on=["g", "step"], suffixes=("", "_want"))
    assert np.allclose(m["s"], m["s_want"]) and np.allclose(m["m"], m["m_want"])


def test_positions_plan_has_no_single_partition_exchange(spark):
    df = spark.range(1000).withColumn("o", F.col("id") % 13)
    out = POS.attach_positions(df, ["o", "id"])
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    # a single-partition exchange may only carry the per-partition chunk table (one row per partition)
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate(keys=[_pid" in lines[i + 1]


def test_batch_larger_than_table(spark):
    df = spark.createDataFrame([(f"t{i}", i) for i in range(5)], "text_id string, n int")
    ordered = B.length_order(df, "n")
    assert {r["batch_id"] for r in B.assign_batches(ordered, 16, drop_last=False).collect()} == {0}
    assert B.assign_batches(ordered, 16, drop_last=True).count() == 0


def test_mask_tokens_invariants(spark):
    e = fx.essays(Tables(spark, SF_SMALL)).select("text_id", K.regex_tokens("full_text").alias("toks"))
    ids, _ = K.encode_plus(F.col("toks"), 64)
    enc = e.select("text_id", K.token_ids(ids).alias("ids"))
    masked = enc.withColumn("m", K.mask_tokens(F.col("ids"), F.col("text_id"), 0, p=0.15)).collect()
    protected = {K.SPECIAL_IDS[K.CLS], K.SPECIAL_IDS[K.SEP], K.SPECIAL_IDS[K.PAD]}
    n = hits = 0
    for r in masked:
        for a, b in zip(r["ids"], r["m"]):
            if a in protected:
                assert a == b
            else:
                n += 1
                hits += int(b == K.SPECIAL_IDS[K.MASK])
    rate, sigma = hits / n, math.sqrt(0.15 * 0.85 / n)
    assert abs(rate - 0.15) <= 3 * sigma
    again = enc.withColumn("m", K.mask_tokens(F.col("ids"), F.col("text_id"), 0, p=0.15)).collect()
    assert [r["m"] for r in masked] == [r["m"] for r in again]


def test_best_checkpoint_ties_first_wins(spark):
    rows = [(1, 0, 1, 0.5), (1, 0, 2, 0.4), (1, 0, 3, 0.4), (1, 0, 4, 0.6)]
    df = spark.createDataFrame(rows, "run_id long, fold int, step long, loss double")
    best = F.min_by(F.struct("step", "loss"), F.struct("loss", "step"))
    r = df.groupBy("run_id", "fold").agg(best.alias("b")).first()
    assert r["b"]["step"] == 2


# --- weights ----------------------------------------------------------------------------------------------------

def test_box_least_squares_kkt_and_dense_solve():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 1))
    P = 3 + base + 0.05 * rng.normal(size=(400, 12))  # highly correlated models
    y = 3 + base[:, 0] + 0.1 * rng.normal(size=400)
    G_, b_ = P.T @ P, P.T @ y
    lb, ub = np.zeros(12), np.ones(12)
    ub[0] = 0.35
    w = H.solve_box_ls(G_, b_, lb, ub)
    assert H.kkt_violation(G_, b_, w, lb, ub) < 1e-6
    # dense check: no feasible random perturbation does better
    f = lambda v: float(np.sum((P @ v - y) ** 2))
    for _ in range(200):
        v = np.clip(w + rng.normal(scale=1e-3, size=12), lb, ub)
        assert f(v) >= f(w) - 1e-9


def test_fit_columnwise_beats_best_single_model(spark):
    t = Tables(spark, SF_SMALL)
    models = fx.MODEL_IDS
    design = H.wide_design(fx.oof_long(t), fx.essays(t), models)
    grams = H.collect_grams(H.gram_statistics(design), len(models))
    fits = H.fit_columnwise(grams, models)
    for tgt, (w, r) in fits.items():
        g = grams[tgt]
        singles = [g.rmse(np.eye(len(models))[i]) for i in range(len(models))]
        assert r <= min(singles) + 1e-12
        lb, ub = H.bounds(models)
        assert H.kkt_violation(g.G, g.b, w, lb, ub) < 1e-6
        # Gram RMSE equals the direct RMSE of the blend
    scored = design.toPandas()
    for tgt, (w, r) in fits.items():
        part = scored[scored["grp"] == tgt]
        x = part[[f"f{i}" for i in range(len(models))]].to_numpy()
        direct = math.sqrt(np.mean((x @ w - part["y"].to_numpy()) ** 2))
        assert abs(direct - r) < 1e-9


# --- scoring ----------------------------------------------------------------------------------------------------

def test_score_batch_equals_closed_form(spark):
    e = fx.essays(Tables(spark, SF_SMALL))
    scored = SC.score_batch(e.withColumn("fold_model", F.col("fold")), fx.ClosedFormScorer())
    native = e.select("text_id", *[fx.closed_form_score(F.col("full_text"), F.col("fold"), j).alias(f"n_{t}")
                                   for j, t in enumerate(TARGETS)])
    j = scored.join(native, "text_id").collect()
    assert len(j) == e.count()
    for r in j:
        for t in TARGETS:
            assert abs(r[t] - r[f"n_{t}"]) < 1e-12


def test_fold_fit_oof_no_row_scored_by_a_model_that_saw_it(spark):
    cur = fx.current_population(Tables(spark, SF_SMALL)).select("text_id", "full_text", "fold", *TARGETS)
    # every labelled row comes back exactly once, predicted by the model fitted without its own fold
    oof, _ = SC.fold_fit_oof(cur, num_features=256, reg=0.1)
    rows = oof.join(cur.select("text_id", F.col("fold").alias("true_fold")), "text_id").collect()
    assert len(rows) == cur.count()
    assert all(r["fold"] == r["true_fold"] for r in rows)
    extra = cur.select("text_id", "full_text", *TARGETS).withColumn("text_id", F.concat(F.lit("X"), "text_id")) \
        .withColumn("fold_model", (F.crc32(F.col("text_id").cast("binary")) % 5).cast("int")).withColumn("fold", F.lit(None).cast("int"))
    for k in range(5):
        seen = {r["text_id"] for r in SC.training_rows(cur, k, extra, "fold_model").collect()}
        scored = {r["text_id"] for r in rows if r["fold"] == k}
        assert scored and not scored & seen
        assert {x for x in seen if x[0] == "X"} == {r["text_id"] for r in extra.filter(F.col("fold_model") == k).collect()}


def test_changing_the_labels_of_a_fold_leaves_its_predictions(spark):
    """The model that scores a fold never saw its labels: shifting them changes nothing in that fold."""
    cur = fx.current_population(Tables(spark, SF_SMALL)).select("text_id", "full_text", "fold", *TARGETS)
    moved = cur.withColumns({t: F.when(F.col("fold") == 2, F.col(t) + 1.0).otherwise(F.col(t)) for t in TARGETS})
    a, b = [{r["text_id"]: r["pred_cohesion"] for r in SC.fold_fit_oof(x, num_features=64)[0].filter("fold = 2").collect()}
            for x in (cur, moved)]
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_self_training_round(spark):
    import __spark_entry__ as entry
    rows = entry.queries()["self_training_round"](spark, SF_SMALL).collect()
    cur = {r["text_id"]: r["fold"] for r in fx.current_population(Tables(spark, SF_SMALL)).collect()}
    n_prev = fx.essays(Tables(spark, SF_SMALL)).count() - len(cur)
    for k in range(5):
        own = [r for r in rows if r["fold_model"] == k]
        true = [r["text_id"] for r in own if r["provenance"] == "true"]
        pseudo = [r for r in own if r["provenance"] == "prev_pseudo"]
        assert sorted(true) == sorted(i for i, f in cur.items() if f != k)
        assert len(pseudo) == n_prev and not {r["text_id"] for r in pseudo} & set(cur)
        assert all(1 <= r[t] <= 5 for r in pseudo for t in TARGETS)


# --- io ---------------------------------------------------------------------------------------------------------

def test_csv_newline_and_doubled_quotes(spark):
    df = spark.createDataFrame([("a", 'he said "hi"\nnext line, ok', 1.5)], "text_id string, full_text string, x double")
    path = scratch_path(spark, "csvtest")
    write_csv(df, path)
    back = read_csv(spark, path, "text_id string, full_text string, x double").first()
    assert back["full_text"] == 'he said "hi"\nnext line, ok' and back["x"] == 1.5


def test_leaderboard_plan_stays_in_the_jvm(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["leaderboard"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def _dense_clipped(x, y, w, lb, ub):
    """Dense twin of the clipped fit: the same steps on one matrix."""
    err = lambda v: float(np.sum((np.clip(x @ v, 1, 5) - y) ** 2))
    best = err(w)
    while True:
        p = x @ w
        a = x[(p > 1) & (p < 5)]
        full = H.solve_box_ls(a.T @ a, a.T @ y[(p > 1) & (p < 5)], lb, ub) - w
        cands = [w + full / 2 ** s for s in range(31)]
        errs = [err(v) for v in cands]
        if min(errs) >= best * (1 - 1e-12):
            return w, best
        w, best = cands[int(np.argmin(errs))], min(errs)


def test_clipped_refinement_runs_to_convergence(spark):
    t = Tables(spark, SF_SMALL)
    models = fx.MODEL_IDS
    design = H.wide_design(fx.oof_long(t), fx.essays(t), models).cache()
    grams = H.collect_grams(H.gram_statistics(design), len(models))
    fits = H.fit_columnwise(grams, models)
    lb, ub = H.bounds(models)
    refined = H.refine_clipped(design, {k: w for k, (w, _) in fits.items()}, lb, ub)
    again = H.refine_clipped(design, {k: w for k, (w, _) in refined.items()}, lb, ub)
    pdf = design.toPandas()
    rng = np.random.default_rng(3)
    for tgt, (w0, _) in fits.items():
        part = pdf[pdf["grp"] == tgt]
        x = part[[f"f{i}" for i in range(len(models))]].to_numpy()
        y = part["y"].to_numpy()
        clipped = lambda v: math.sqrt(np.mean((np.clip(x @ v, 1, 5) - y) ** 2))
        w1, r1 = refined[tgt]
        assert abs(clipped(w1) - r1) < 1e-9
        assert r1 <= clipped(w0) + 1e-12
        assert np.all(w1 >= lb - 1e-12) and np.all(w1 <= ub + 1e-12)
        assert abs(again[tgt][1] - r1) < 1e-9                       # more steps change nothing
        assert abs(math.sqrt(_dense_clipped(x, y, w0, lb, ub)[1] / len(y)) - r1) < 1e-9
        for _ in range(100):                                        # no feasible step nearby is better
            assert clipped(np.clip(w1 + rng.normal(scale=1e-3, size=len(w1)), lb, ub)) >= r1 - 1e-7
    design.unpersist()


def test_incomplete_design_rows_are_counted(spark):
    t = Tables(spark, SF_SMALL)
    n = fx.essays(t).count()
    counts = H.incomplete_rows(fx.oof_long(t), fx.essays(t), fx.MODEL_IDS).collect()
    gaps = sum(1 for r in t.documents.select("doc_id").collect() if r["doc_id"] % fx.GAP_MOD == 0)
    assert all(r["n"] == n - gaps and r["n_dropped"] == gaps for r in counts) and len(counts) == len(TARGETS)


def test_stacked_fit_equals_a_dense_solve(spark):
    t = Tables(spark, SF_SMALL)
    k = len(fx.MODEL_IDS) * len(TARGETS)
    design = H.wide_design(fx.oof_long(t), fx.essays(t), fx.MODEL_IDS, features="stacked")
    grams = H.stacked_grams(design, k)
    pdf = design.toPandas()
    x = pdf[[f"f{i}" for i in range(k)]].to_numpy()
    for j, tgt in enumerate(TARGETS):
        y = pdf[f"y{j}"].to_numpy()
        assert np.allclose(grams[tgt].G, x.T @ x) and np.allclose(grams[tgt].b, x.T @ y) and grams[tgt].n == len(y)
        w = H.solve_box_ls(grams[tgt].G, grams[tgt].b, np.zeros(k), np.ones(k))
        slope = x.T @ (x @ w - y)                           # of the rows themselves
        scale = (x * x).sum() / k
        assert ((w >= 0) & (w <= 1)).all() and (np.where(w <= 0, -slope, np.where(w >= 1, slope, np.abs(slope))) <= 1e-7 * scale).all()
        assert abs(grams[tgt].rmse(w) - math.sqrt(np.mean((x @ w - y) ** 2))) < 1e-9


def test_modelwise_fit_is_a_minimum(spark):
    t = Tables(spark, SF_SMALL)
    grams = H.collect_grams(H.gram_statistics(H.wide_design(fx.oof_long(t), fx.essays(t), fx.MODEL_IDS)), len(fx.MODEL_IDS))
    w, score = H.fit_modelwise(grams, fx.MODEL_IDS, {"model2": 0.35})
    lb, ub = H.bounds(fx.MODEL_IDS, {"model2": 0.35})
    rng = np.random.default_rng(5)
    assert w[0] <= 0.35 + 1e-12
    for _ in range(200):
        v = np.clip(w + rng.normal(scale=1e-2, size=len(w)), lb, ub)
        assert np.mean([g.rmse(v) for g in grams.values()]) >= score - 1e-9


def test_weight_trials_equal_direct_scores(spark):
    t = Tables(spark, SF_SMALL)
    m = len(fx.MODEL_IDS)
    design = H.wide_design(fx.oof_long(t), fx.essays(t), fx.MODEL_IDS)
    trials = H.dirichlet_trials(spark, m, 20, seed=42)
    got = {r["trial"]: r["mcrmse"] for r in H.score_trials(H.gram_statistics(design), trials, m).collect()}
    pdf = design.toPandas()
    w = trials.toPandas().pivot(index="trial", columns="i", values="w").to_numpy()
    assert np.allclose(w.sum(axis=1), 1) and len(got) == 20
    for k in range(20):
        per = [math.sqrt(np.mean((p[[f"f{i}" for i in range(m)]].to_numpy() @ w[k] - p["y"].to_numpy()) ** 2))
               for _, p in pdf.groupby("grp")]
        assert abs(np.mean(per) - got[k]) < 1e-9


def test_mask_tokens_only_in_early_epochs(spark):
    df = spark.createDataFrame([("d", [1, 10, 11, 12, 2, 0])], "text_id string, ids array<int>")
    late = df.select(K.mask_tokens(F.col("ids"), F.col("text_id"), 5, p=1.0).alias("m")).first()["m"]
    early = df.select(K.mask_tokens(F.col("ids"), F.col("text_id"), 0, p=1.0).alias("m")).first()["m"]
    assert late == [1, 10, 11, 12, 2, 0]
    assert early == [1, 3, 3, 3, 2, 0]


def test_had_undecodable_flag(spark):
    assert _one(spark, "a\x81b", X.had_undecodable) is True
    assert _one(spark, "abc", X.had_undecodable) is False


def test_positions_with_aqe_sized_partitions(spark):
    """Default path: range partitions sized by AQE (coalesced) still give exact positions."""
    rows = [("hot" if i % 3 else f"k{i % 5}", (i * 37) % 211, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(7)
    got = POS.attach_positions(df, ["o", "id"], ["g"]).toPandas()
    pdf = df.toPandas().sort_values(["g", "o", "id"])
    pdf["want"] = pdf.groupby("g").cumcount()
    m = got.merge(pdf, on=["g", "o", "id"])
    assert (m["pos"] == m["want"]).all() and len(m) == 5000


def test_blend_plan_broadcasts_weights_and_shuffles_once(spark):
    preds = _preds(spark, [(f"m{j}", f"t{i}", t, 1.0) for i in range(20) for j in range(3) for t in TARGETS])
    w = _w(spark, [(f"m{j}", t, 0.5) for j in range(3) for t in TARGETS])
    plan = G.blend(preds, w, ["text_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1


# --- duplicates, gaps and strictness ------------------------------------------------------------------------------

def test_blend_wants_each_model_exactly_once(spark):
    w = _w(spark, [(m, t, 0.5) for m in "ab" for t in TARGETS])
    twice = [("a", "t1", t, 2.0) for t in TARGETS] * 2                                  # a twice, b missing
    both = [(m, "t2", t, 2.0) for m in "ab" for t in TARGETS]
    over = [(m, "t3", t, 2.0) for m in "aab" for t in TARGETS]
    out = {r["text_id"]: r["cohesion"] for r in G.blend(_preds(spark, twice + both + over), w, ["text_id"]).collect()}
    assert out == {"t1": None, "t2": 2.0, "t3": None}
    sw = spark.createDataFrame([(t, m, t, 0.5) for m in "ab" for t in TARGETS],
                               "target string, model_id string, source_target string, w double")
    out = {r["text_id"]: r["cohesion"] for r in G.blend_stacked(_preds(spark, twice + both + over), sw, ["text_id"]).collect()}
    assert out == {"t1": None, "t2": 2.0, "t3": None}


def test_fold_mean_wants_each_fold_once(spark):
    rows = [("m", k, "t1", "cohesion", float(k)) for k in range(5)] + [("m", 0, "t2", "cohesion", 1.0)] * 5
    df = spark.createDataFrame(rows, "model_id string, fold int, text_id string, target string, pred double")
    out = {r["text_id"]: r["pred"] for r in G.fold_mean(df, ["model_id", "text_id"]).collect()}
    assert out == {"t1": 2.0, "t2": None}


def test_each_once_beyond_one_bitmap(spark):
    df = spark.range(200).select(F.lit(1).alias("g"), F.col("id").alias("x"))
    assert df.groupBy("g").agg(G.each_once(F.col("x"), 200).alias("ok")).first()["ok"]
    bad = df.withColumn("x", F.when(F.col("x") == 199, 3).otherwise(F.col("x")))
    assert not bad.groupBy("g").agg(G.each_once(F.col("x"), 200).alias("ok")).first()["ok"]


def test_incomplete_model_is_last_on_the_leaderboard(spark):
    rows = [("full", t, 0.5, 10) for t in TARGETS] + [("part", t, 0.1, 9) for t in TARGETS[1:]]
    df = spark.createDataFrame(rows, "model_id string, target string, rmse double, n long")
    board = M.leaderboard(df).collect()
    assert [r["model_id"] for r in board] == ["full", "part"] and board[1]["mcrmse"] is None and board[0]["n"] == 10
    assert {r["model_id"]: r["mcrmse"] for r in M.mcrmse(df, ["model_id"]).collect()} == {"full": 0.5, "part": None}


def test_strict_scores_reject_nan_and_null(spark):
    ok = [("m", "cohesion", 1.0, 1.0), ("m", "cohesion", 2.0, 3.0)]
    schema = "model_id string, target string, pred double, y double"
    for bad in (float("nan"), None):
        df = spark.createDataFrame(ok + [("m", "cohesion", bad, 1.0)], schema)
        lenient = M.scores_by_target(df, ["model_id"]).first()
        assert lenient["n"] == 2 and abs(lenient["rmse"] - math.sqrt(0.5)) < 1e-12
        with pytest.raises(Exception, match="missing or NaN"):
            M.scores_by_target(df, ["model_id"], strict=True).collect()
    assert M.scores_by_target(spark.createDataFrame(ok, schema), ["model_id"], strict=True).first()["n"] == 2


def test_alignment_audit_sees_extras_duplicates_and_gaps(spark):
    from quillspark.operators import joins as J
    pop = spark.createDataFrame([("a",), ("b",), ("c",)], "text_id string")
    ids = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "x"), ("n", "a"), ("n", "b"), ("n", "c")],
                                "model_id string, text_id string")
    got = {r["model_id"]: tuple(r)[1:] for r in J.alignment_audit(ids, pop).collect()}
    assert got == {"m": (3, 2, 2, 1, 1), "n": (3, 3, 0, 0, 0)}


def test_folds_of_continuous_labels(spark):
    df = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("text_id"), (F.rand(3) * 4 + 1).alias("y"))
    out = D.stratified_folds(df, ["y"]).toPandas()
    assert len(out) == 3000 and out.groupby("fold").size().between(598, 602).all()
    assert out.groupby("fold")["y"].mean().between(2.9, 3.1).all()


def test_sample_and_shuffle_are_exact_and_repeatable(spark):
    e = fx.essays(Tables(spark, SF_SMALL)).select("text_id")
    a, b = [[r["text_id"] for r in D.sample_n(x, 50, 42).collect()] for x in (e, e.repartition(7))]
    assert a == b and len(set(a)) == 50
    p0, p1 = [{r["text_id"]: r["pos"] for r in B.shuffle_order(e, "text_id", 42, ep).collect()} for ep in (0, 1)]
    n = e.count()
    assert sorted(p0.values()) == sorted(p1.values()) == list(range(n)) and p0 != p1


def test_balanced_folds(spark):
    import __spark_entry__ as entry
    out = entry.queries()["balanced_folds"](spark, SF_CHECK).toPandas()
    share = out.groupby("fold").size() / len(out)
    assert share.between(0.17, 0.23).all()
    assert out.groupby("fold")["n_token"].median().between(out["n_token"].median() * 0.8, out["n_token"].median() * 1.25).all()


# --- store and files ------------------------------------------------------------------------------------------------

def test_store_keeps_older_runs_and_replaces_one(spark):
    from quillspark.sources import store as S
    root = scratch_path(spark, "runs-test")
    rows = lambda v: spark.createDataFrame([("m", 0, "t", "cohesion", v)], "model_id string, fold int, text_id string, target string, pred double")
    for run, v in ((1, 1.0), (2, 2.0), (1, 1.5)):
        S.write_predictions(rows(v), root, "oof", run)
    got = {r["run_ts"]: r["pred"] for r in S.read_predictions(spark, root, "oof").collect()}
    assert got == {1: 1.5, 2: 2.0}
    assert [(r["pred"], r["run_ts"]) for r in S.latest_run(S.read_predictions(spark, root)).collect()] == [(2.0, 2)]


def test_csv_with_index_column_and_other_order(spark):
    path = scratch_path(spark, "indexed")
    df = spark.createDataFrame([("0", 1.5, "a\nb", "t1")], "i string, cohesion double, full_text string, text_id string")
    write_csv(df.withColumnRenamed("i", ""), path)
    back = read_csv(spark, path, "text_id string, full_text string, cohesion double, syntax double").first()
    assert tuple(back) == ("t1", "a\nb", 1.5, None)
    assert read_csv(spark, path).columns == ["cohesion", "full_text", "text_id"]


def test_shared_folder_is_required_on_a_cluster(monkeypatch, spark):
    from quillspark import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_focal_loss_with_class_weights(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 1.0]), ([3.0, 1.0], [0.0, 1.0])], "x array<double>, t array<double>")
    got = [r["v"] for r in df.select(M.focal_row(F.col("x"), F.col("t"), 2.0, [1.0, 3.0]).alias("v")).collect()]
    for (x, _), v in zip([([1.0, 2.0], 1), ([3.0, 1.0], 1)], got):
        p = math.exp(x[1]) / sum(map(math.exp, x))
        assert abs(v + 3.0 * (1 - p) ** 2 * math.log(p)) < 1e-9


def test_masking_protects_added_markers_and_the_mask(spark):
    df = spark.createDataFrame([("d", [1, 10, 3, 30000, 2, 0])], "text_id string, ids array<int>")
    got = df.select(K.mask_tokens(F.col("ids"), F.col("text_id"), 0, p=1.0, mask_id=4, added_from=30000).alias("m")).first()["m"]
    assert got == [1, 4, 4, 30000, 2, 0]


def test_track_two_replace_uses_pseudo_rows_only(spark):
    from quillspark.operators import joins as J
    true = spark.createDataFrame([("a", 0, 1.0)], "text_id string, fold int, cohesion double")
    pseudo = spark.createDataFrame([("b", 2.0)], "text_id string, cohesion double")
    rows = J.assemble_track2(true, pseudo, 1, "replace").collect()
    assert [(r["text_id"], r["provenance"]) for r in rows] == [("b", "pseudo")]


def test_vectors_per_document(spark):
    from quillspark.operators import pooling as P
    t = spark.createDataFrame([(1, 0, 1, [1.0, 2.0]), (1, 0, 1, [3.0, 6.0]), (1, 0, 0, [9.0, 9.0])],
                              "doc_id long, layer int, mask int, vec array<double>")
    assert P.to_vectors(P.pool_mean(t)).first()["vec"] == [2.0, 4.0]
