"""Registered queries: blends, weights tables, prediction merges and key joins (G, E keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as G
from ..operators import joins as J
from ..operators import metrics as M
from ..session import scratch_path
from ..sources.store import to_long
from ..sources.tables import Tables
from ..targets import TARGETS
from . import fixtures as fx
from .registry import register, rounded
from .sqlparts import (blend_sql, columnwise_w, columnwise_weight, current_cte, essays_cte, fold_model_cte,
                       gap_filter, long_oof_cte, modelwise_w, oof_model_cte, sql_clip, sql_float)

MODELS = fx.MODEL_IDS
NORMALISED_WEIGHTS = [0.5, 0.25, 0.15, 0.35]
SPLICE = {0: "model2", 1: "model17", 2: "model21", 3: "model17", 4: "model17"}


_PSEUDO_MODELS = ",\n".join(fold_model_cte(f"m{i}", m, "essays") for i, m in enumerate(MODELS))
_prev_cols, _prev_from = blend_sql(modelwise_w, "fold, text_id", clip=False)


@register("blend_modelwise", sql=f"WITH {essays_cte()},\n{_PSEUDO_MODELS}\n"
          f"SELECT m0.fold, m0.text_id, {_prev_cols} {_prev_from}")
def blend_modelwise(spark, sf_dir):
    t = Tables(spark, sf_dir)
    preds = fx.pseudo_long(fx.essays(t))
    return rounded(G.blend(preds, fx.modelwise_weights(spark), ["fold", "text_id"]))


def _prev_pseudo(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = fx.essays(t)
    return t, e, fx.pseudo_long(e)


_PREV_SRC = "prevpop AS (SELECT * FROM essays WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
_PSEUDO_PREV = ",\n".join(fold_model_cte(f"m{i}", m, "prevpop") for i, m in enumerate(MODELS))
_cw_cols, _cw_from = blend_sql(columnwise_w, "fold, text_id", clip=True)


@register("blend_columnwise", sql=f"WITH {essays_cte()},\n{_PREV_SRC},\n{_PSEUDO_PREV}\n"
          f"SELECT m0.fold, m0.text_id, {_cw_cols}, e.full_text {_cw_from} "
          f"LEFT JOIN essays e ON e.text_id = m0.text_id")
def blend_columnwise(spark, sf_dir):
    t, e, preds = _prev_pseudo(spark, sf_dir)
    population = J.flag_known_ids(e.select("text_id"), fx.known_ids(t))
    restricted = J.restrict_population(preds, population)
    blended = G.blend(restricted, fx.columnwise_weights(spark), ["fold", "text_id"], clip=True)
    return rounded(J.attach_text(blended, e))


_cur_cols, _cur_from = blend_sql(columnwise_w, "fold, text_id", clip=True)
# every fold model k reads fold 0: k is fixed to 0 in the predictions, the output fold is the loop variable.
_CURR_SQL = (f"WITH {essays_cte()},\n{current_cte()},\n"
             + ",\n".join(oof_model_cte(f"m{i}", m, "(SELECT * REPLACE (cast(0 AS int) AS fold) FROM curr)")
                          for i, m in enumerate(MODELS))
             + f"\nSELECT cast(r.f AS int) AS fold, b.* EXCLUDE (fold) FROM (SELECT m0.fold, m0.text_id, {_cur_cols}, "
               f"e.full_text {_cur_from} LEFT JOIN essays e ON e.text_id = m0.text_id) b, range(5) r(f)")


@register("blend_current", sql=_CURR_SQL)
def blend_current(spark, sf_dir):
    """G3 with ``fold_source='zero'``: fold 0's pseudo labels feed all five outputs (as the reference did)."""
    t = Tables(spark, sf_dir)
    cur = fx.current_population(t)
    preds = G.fold_source(fx.pseudo_long(cur.select("doc_id", "text_id", *TARGETS)), "zero")
    blended = G.blend(preds, fx.columnwise_weights(spark), ["fold", "text_id"], clip=True)
    return rounded(J.attach_text(blended, cur).select("fold", "text_id", *TARGETS, "full_text"))


_OOF_M = ",\n".join(oof_model_cte(f"m{i}", m) for i, m in enumerate(MODELS))
_n_cols, _n_from = blend_sql(lambda m, t: NORMALISED_WEIGHTS[MODELS.index(m)], "text_id", clip=False,
                              norm=sum(NORMALISED_WEIGHTS))


@register("blend_normalised", sql=f"WITH {essays_cte()},\n{_OOF_M}\nSELECT m0.text_id, {_n_cols} {_n_from}")
def blend_normalised(spark, sf_dir):
    t = Tables(spark, sf_dir)
    w = spark.createDataFrame([(m, tt, float(x)) for m, x in zip(MODELS, NORMALISED_WEIGHTS) for tt in TARGETS],
                              "model_id string, target string, w double")
    return rounded(G.blend(fx.oof_long(t).drop("fold"), w, ["text_id"], normalise=True))


@register("fold_mean", sql=f"WITH {essays_cte()},\n{current_cte()},\n"
          + ",\n".join(fold_model_cte(f"m{i}", m, "curr") for i, m in enumerate(MODELS)) + "\n"
          + " UNION ALL ".join(
              f"SELECT '{m}' AS model_id, text_id, '{t}' AS target, round(avg({t}), 6) AS pred FROM m{i} "
              f"GROUP BY text_id HAVING count(*) = 5" for i, m in enumerate(MODELS) for t in TARGETS))
def fold_mean(spark, sf_dir):
    t = Tables(spark, sf_dir)
    preds = fx.pseudo_long(fx.current_population(t).select("doc_id", "text_id", *TARGETS))
    return rounded(G.fold_mean(preds, ["model_id", "text_id"]).filter(F.col("pred").isNotNull()))


@register("clip_targets", sql=f"WITH {essays_cte()},\n{long_oof_cte()}\n"
          f"SELECT model_id, text_id, target, round({sql_clip('pred')}, 6) AS pred FROM oof")
def clip_targets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(G.clip_predictions(fx.oof_long(t).select("model_id", "text_id", "target", "pred")))


def _stacked_weight(model: str, target: str, source: str) -> float:
    i, j = MODELS.index(model), TARGETS.index(target)
    return fx.MODEL_WEIGHTS[(i + j) % 4] * (0.75 if source == target else 0.05)


_STACK_COLS = ", ".join(
    "round(" + " + ".join(f"{sql_float(_stacked_weight(m, t, s))} * m{i}.{s}" for i, m in enumerate(MODELS)
                          for s in TARGETS) + f", 6) AS {t}" for t in TARGETS)


@register("blend_stacked", sql=f"WITH {essays_cte()},\n{_OOF_M}\nSELECT m0.text_id, {_STACK_COLS} FROM m0 "
          + " ".join(f"LEFT JOIN m{i} USING (text_id)" for i in range(1, 4)))
def blend_stacked(spark, sf_dir):
    t = Tables(spark, sf_dir)
    w = spark.createDataFrame([(tt, m, s, _stacked_weight(m, tt, s)) for m in MODELS for tt in TARGETS
                               for s in TARGETS], "target string, model_id string, source_target string, w double")
    return rounded(G.blend_stacked(fx.oof_long(t).drop("fold"), w, ["text_id"]))


_bp_cols, _bp_from = blend_sql(columnwise_w, "text_id", clip=True)


@register("blend_predict", sql=f"WITH {essays_cte()},\n{_OOF_M}\nSELECT m0.text_id, {_bp_cols} {_bp_from}")
def blend_predict(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(G.blend(fx.oof_long(t).drop("fold"), fx.columnwise_weights(spark), ["text_id"], clip=True))


@register("ensemble_catalog", sql=f"WITH {essays_cte()},\n{_PSEUDO_MODELS}\n"
          f"SELECT m0.fold, m0.text_id, {_cw_cols} {_cw_from}")
def ensemble_catalog(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cat = fx.modelwise_weights(spark, "cat_modelwise").withColumn("kind", F.lit("modelwise")).unionByName(
        fx.columnwise_weights(spark, "cat_columnwise").withColumn("kind", F.lit("columnwise")))
    path = scratch_path(spark, "catalog") + ".parquet"
    (cat.withColumns({"source": F.lit("prev"), "destination": F.lit("fixture"), "fold_source": F.lit("own")})
        .select(*G.CATALOG_COLUMNS).write.parquet(path))
    preds = fx.pseudo_long(fx.essays(t))
    out = G.route_catalog(G.load_catalog(spark, path), "cat_columnwise", {"prev": preds}, ["fold", "text_id"])
    return rounded(out.drop("destination"))


# ten named ensembles: kind, population and fold source differ, weights are rotated
TEN = [(f"ens{i:02d}", ("modelwise", "columnwise", "normalised")[i % 3], ("prev", "curr")[i % 2], ("own", "zero")[i % 4 == 1]) for i in range(10)]


def _ten_weight(i: int, m: str, t: str) -> float:
    by_target = TARGETS.index(t) if TEN[i][1] == "columnwise" else 0
    return fx.MODEL_WEIGHTS[(MODELS.index(m) + by_target + i) % len(MODELS)] * (1 + i / 4)


def _ten_sql() -> str:
    ctes = [fold_model_cte(f"{p}_{i}", m, src) for p, src in (("prev", "prevpop"), ("curr", "curr")) for i, m in enumerate(MODELS)]
    blocks = []
    for i, (name, kind, source, folds) in enumerate(TEN):
        norm = sum(_ten_weight(i, m, TARGETS[0]) for m in MODELS) if kind == "normalised" else None
        cols, _ = blend_sql(lambda m, t, i=i: _ten_weight(i, m, t), "fold, text_id", clip=kind == "columnwise", norm=norm)
        joins = " ".join(f"LEFT JOIN {source}_{k} m{k} USING (fold, text_id)" for k in range(1, len(MODELS)))
        body = f"SELECT m0.fold, m0.text_id, {cols} FROM {source}_0 m0 {joins}"
        if folds == "zero":
            body = f"SELECT cast(r.f AS int) AS fold, b.* EXCLUDE (fold) FROM ({body}) b, range(5) r(f) WHERE b.fold = 0"
        blocks.append(f"SELECT '{name}' AS ensemble_id, 'pseudo_{name}' AS destination, x.* FROM ({body}) x")
    return f"WITH {essays_cte()},\n{current_cte()},\n{_PREV_SRC},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(blocks)


@register("catalog_all", sql=_ten_sql())
def catalog_all(spark, sf_dir):
    """Ten named ensembles over two populations; each population is shuffled once for all its ensembles."""
    t = Tables(spark, sf_dir)
    rows = [(name, kind, source, f"pseudo_{name}", folds, m, tt, _ten_weight(i, m, tt))
            for i, (name, kind, source, folds) in enumerate(TEN) for m in MODELS for tt in TARGETS]
    catalog = spark.createDataFrame(rows, "ensemble_id string, kind string, source string, destination string, fold_source string, "
                                          "model_id string, target string, w double")
    cur = fx.current_population(t)
    prev = J.drop_known_ids(fx.essays(t), fx.known_ids(t))
    sources = {"prev": fx.pseudo_long(prev.select("doc_id", "text_id", *TARGETS)), "curr": fx.pseudo_long(cur.select("doc_id", "text_id", *TARGETS))}
    return rounded(G.blend_catalog(catalog, sources, ["fold", "text_id"]))


_SCORES = f"""WITH {essays_cte()},\n{long_oof_cte()},
sc AS (SELECT model_id, target, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM oof GROUP BY model_id, target),
iw AS (SELECT model_id, target, (1e0 / rmse) / sum(1e0 / rmse) OVER (PARTITION BY target) AS w FROM sc)
"""


def _inverse_weights(spark, sf_dir):
    t = Tables(spark, sf_dir)
    scored = M.attach_truth(fx.oof_long(t), fx.essays(t))
    return G.inverse_error_weights(M.scores_by_target(scored, ["model_id"])), scored


@register("weights_inverse_rmse", sql=_SCORES + "SELECT model_id, target, round(w, 6) AS w FROM iw")
def weights_inverse_rmse(spark, sf_dir):
    w, _ = _inverse_weights(spark, sf_dir)
    return rounded(w)


@register("weight_importance", sql=_SCORES + "SELECT model_id, round(sum(w), 6) AS importance FROM iw GROUP BY model_id")
def weight_importance(spark, sf_dir):
    w, _ = _inverse_weights(spark, sf_dir)
    return rounded(G.weight_importance(w))


@register("importance_over_runs", sql=f"""WITH {essays_cte()},\n{long_oof_cte()},
sc AS (SELECT fold AS run, model_id, target, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM oof
       GROUP BY fold, model_id, target),
iw AS (SELECT run, model_id, target, (1e0 / rmse) / sum(1e0 / rmse) OVER (PARTITION BY run, target) AS w FROM sc)
SELECT model_id, round(sum(w) / 5e0, 6) AS importance FROM iw GROUP BY model_id""")
def importance_over_runs(spark, sf_dir):
    """Search runs = folds: inverse-RMSE weights fitted on each fold's rows, importance averaged over runs."""
    t = Tables(spark, sf_dir)
    scored = M.attach_truth(fx.oof_long(t), fx.essays(t))
    scores = M.scores_by_target(scored, ["fold", "model_id"])
    inv = F.lit(1.0) / F.col("rmse")
    from pyspark.sql import Window
    w = scores.select(F.col("fold").alias("run"), "model_id", "target",
                      (inv / F.sum(inv).over(Window.partitionBy("fold", "target"))).alias("w"))
    return rounded(G.importance_over_runs(w, "run"))


@register("weights_audit", sql=f"WITH {essays_cte()},\n{_OOF_M}\n" + " UNION ALL ".join(
    f"SELECT '{t}' AS target, round({' + '.join(sql_float(columnwise_weight(m, t)) for m in MODELS)}, 6) AS sum_w, "
    f"round(sqrt(avg(({' + '.join(f'{sql_float(columnwise_weight(m, t))} * m{i}.{t}' for i, m in enumerate(MODELS))} "
    f"- e.{t}) * ({' + '.join(f'{sql_float(columnwise_weight(m, t))} * m{i}.{t}' for i, m in enumerate(MODELS))} - e.{t}))), 6)"
    f" AS rmse FROM m0 " + " ".join(f"JOIN m{i} USING (text_id)" for i in range(1, 4))
    + " JOIN essays e USING (text_id)" for t in TARGETS))
def weights_audit(spark, sf_dir):
    """Σw per target and the RMSE of the (unclipped) blend on the rows every model scored."""
    t = Tables(spark, sf_dir)
    w = fx.columnwise_weights(spark)
    blended = G.blend(fx.oof_long(t).drop("fold"), w, ["text_id"])
    long = to_long(blended, ["text_id"])
    scored = M.attach_truth(long, fx.essays(t))
    scores = M.scores_by_target(scored, [])
    return rounded(G.weight_sums(w).join(scores.select("target", "rmse"), "target"))


# --- E keys -------------------------------------------------------------------------------------------------------

_MERGED_COLS = ", ".join(f"m{i}.{t} AS pred_{t}_{m}" for i, m in enumerate(MODELS) for t in TARGETS)


@register("merged_predictions", sql=f"WITH {essays_cte()},\n{_OOF_M}\n"
          f"SELECT e.text_id, {', '.join('round(e.' + t + ', 6) AS ' + t for t in TARGETS)}, "
          + ", ".join(f"round(m{i}.{t}, 6) AS pred_{t}_{m}" for i, m in enumerate(MODELS) for t in TARGETS)
          + " FROM essays e " + " ".join(f"LEFT JOIN m{i} ON m{i}.text_id = e.text_id" for i in range(4)))
def merged_predictions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(J.merged_predictions(fx.essays(t).select("text_id", *TARGETS), fx.oof_long(t), MODELS))


@register("restrict_population", sql=f"WITH {essays_cte()},\n"
          + ",\n".join(fold_model_cte(f"m{i}", m, "essays") for i, m in enumerate(MODELS)) + "\n"
          + " UNION ALL ".join(f"SELECT '{m}' AS model_id, fold, text_id, '{t}' AS target, round({t}, 6) AS pred "
                               f"FROM m{i} WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
                               for i, m in enumerate(MODELS) for t in TARGETS))
def restrict_population(spark, sf_dir):
    t, e, preds = _prev_pseudo(spark, sf_dir)
    population = J.flag_known_ids(e.select("text_id"), fx.known_ids(t))
    return rounded(J.restrict_population(preds, population).select("model_id", "fold", "text_id", "target", "pred"))


@register("alignment_audit", sql=f"WITH {essays_cte()}\n" + " UNION ALL ".join(
    f"SELECT '{m}' AS model_id, cast(k AS int) AS fold, count(*) AS n_rows, count(DISTINCT text_id) AS n_ids, "
    f"(SELECT count(*) FROM essays) - count(DISTINCT text_id) AS n_missing, cast(0 AS bigint) AS n_extra, "
    f"cast(0 AS bigint) AS n_dup FROM essays, range(5) r(k) WHERE {gap_filter(m)} GROUP BY k" for m in MODELS))
def alignment_audit(spark, sf_dir):
    """Every (model, fold) pseudo-label file against the previous population."""
    t = Tables(spark, sf_dir)
    e = fx.essays(t)
    ids = fx.pseudo_long(e).filter(F.col("target") == TARGETS[0]).select("model_id", "fold", "text_id")
    return J.alignment_audit(ids, e, by=["model_id", "fold"])


_mw_cols, _mw_from = blend_sql(modelwise_w, "fold, text_id", clip=False)


@register("attach_text", sql=f"WITH {essays_cte()},\n{_PSEUDO_MODELS}\n"
          f"SELECT m0.fold, m0.text_id, {_mw_cols}, e.full_text {_mw_from} "
          f"LEFT JOIN essays e ON e.text_id = m0.text_id")
def attach_text(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = fx.essays(t)
    blended = G.blend(fx.pseudo_long(e), fx.modelwise_weights(spark), ["fold", "text_id"])
    return rounded(J.attach_text(blended, e))


@register("average_labels", sql=f"WITH {essays_cte()},\n{current_cte()},\n"
          + fold_model_cte("p", "exp02_fb3", "curr", k_fixed=0) + "\n"
          + f"SELECT c.text_id, {', '.join(f'round((c.{t} + p.{t}) / 2, 6) AS {t}' for t in TARGETS)} "
            "FROM curr c LEFT JOIN (SELECT * FROM p WHERE fold = 0) p ON p.text_id = c.text_id")
def average_labels(spark, sf_dir):
    """True labels of the current data averaged with one model's fold-0 pseudo labels (gaps give NULL)."""
    t = Tables(spark, sf_dir)
    cur = fx.current_population(t)
    pl = fx.pseudo_long(cur.select("doc_id", "text_id", *TARGETS), ["exp02_fb3"], n_folds=1)
    wide = pl.groupBy("text_id").pivot("target", TARGETS).agg(F.when(F.count("pred") == 1, F.max("pred")))
    return rounded(J.average_labels(cur, wide))


@register("normalise_oof", sql=f"WITH {essays_cte()},\n{long_oof_cte()}\n"
          "SELECT model_id, text_id, fold, target, round(pred, 6) AS pred FROM oof")
def normalise_oof(spark, sf_dir):
    """Track-two OOF files (true targets + ``pred_*``) of every model → one long table."""
    t = Tables(spark, sf_dir)
    wides = [fx.oof_wide(t, m).withColumn("model_id", F.lit(m)) for m in MODELS]
    return rounded(to_long(J.union_widen(*wides), ["model_id", "text_id", "fold"]))


@register("fold_splice", sql=f"WITH {essays_cte()},\n{long_oof_cte()}\n"
          "SELECT fold, model_id, text_id, target, round(pred, 6) AS pred FROM oof WHERE "
          + " OR ".join(f"(fold = {k} AND model_id = '{m}')" for k, m in SPLICE.items()))
def fold_splice(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(J.fold_splice(fx.oof_long(t), SPLICE).select("fold", "model_id", "text_id", "target", "pred"))
