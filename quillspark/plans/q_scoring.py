"""Registered queries: batch scoring modes, registry scoring, fold-wise fitting, self-training (K keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as G
from ..operators import joins as J
from ..operators import models as MO
from ..operators import rounds as R
from ..operators import scoring as SC
from ..session import pin, scratch_path
from ..sources import store as S
from ..sources.tables import Tables
from ..targets import N_FOLDS, TARGETS, clip_score
from . import fixtures as fx
from .registry import register, rounded
from .sqlparts import current_cte, essays_cte

# twelve registered models (stand-ins that differ by an offset)
REGISTRY = {f"model_{i:02d}": i for i in range(12)}


def _score_sql(k: str, off: str = "0") -> str:
    return ", ".join(f"round(1e0 + ((length(full_text) + 13 * {k} + 7 * {j} + {off}) % 41) / 1e1, 6) AS {t}"
                     for j, t in enumerate(TARGETS))


def _pops(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = fx.essays(t)
    return e, fx.current_population(t)


BASE = f"WITH {essays_cte()},\n{current_cte()}\n"
_PREV = "(SELECT * FROM essays WHERE doc_id NOT IN (SELECT doc_id FROM labels))"


@register("score_batch", sql=BASE + f"SELECT text_id, fold AS fold_model, {_score_sql('fold')} FROM essays")
def score_batch(spark, sf_dir):
    """K1: every essay scored by the model of its fold through ``mapInPandas``."""
    e, _ = _pops(spark, sf_dir)
    return rounded(SC.score_batch(e.withColumn("fold_model", F.col("fold")), fx.ClosedFormScorer()))


@register("mode_oofs", sql=BASE + f"SELECT text_id, fold AS fold_model, {_score_sql('fold')} FROM curr")
def mode_oofs(spark, sf_dir):
    _, cur = _pops(spark, sf_dir)
    return rounded(SC.score_mode("oofs", cur, fx.ClosedFormScorer()))


@register("mode_prev", sql=BASE + f"SELECT text_id, cast(k AS int) AS fold_model, {_score_sql('k')} "
          f"FROM {_PREV} p, range(5) r(k)")
def mode_prev(spark, sf_dir):
    e, cur = _pops(spark, sf_dir)
    return rounded(SC.score_mode("prev_pseudolabels", cur, fx.ClosedFormScorer(), previous=e))


@register("mode_curr", sql=BASE + f"SELECT text_id, cast(k AS int) AS fold_model, {_score_sql('k')} "
          "FROM curr, range(5) r(k)")
def mode_curr(spark, sf_dir):
    _, cur = _pops(spark, sf_dir)
    return rounded(SC.score_mode("curr_pseudolabels", cur, fx.ClosedFormScorer()))


_MEAN = ", ".join(f"round(avg(1e0 + ((length(full_text) + 13 * k + 7 * {j}) % 41) / 1e1), 6) AS {t}"
                  for j, t in enumerate(TARGETS))


@register("mode_submission", sql=BASE + f"SELECT text_id, {_MEAN} FROM {_PREV} p, range(5) r(k) GROUP BY text_id")
def mode_submission(spark, sf_dir):
    e, cur = _pops(spark, sf_dir)
    test = J.drop_known_ids(e, cur)
    return rounded(SC.score_mode("submission", cur, fx.ClosedFormScorer(), test=test))


_REG_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS model_id, text_id, " + ", ".join(
        f"round(avg(1e0 + ((length(full_text) + 13 * k + 7 * {j} + {off}) % 41) / 1e1), 6) AS {t}"
        for j, t in enumerate(TARGETS)) + " FROM curr, range(5) r(k) GROUP BY text_id"
    for m, off in REGISTRY.items())


@register("registry_scoring", sql=BASE + _REG_SQL)
def registry_scoring(spark, sf_dir):
    """K3: a registry of models scores the chosen population (here the labelled essays), fold means."""
    _, cur = _pops(spark, sf_dir)
    return rounded(SC.registry_scoring(cur, {m: fx.ClosedFormScorer(off) for m, off in REGISTRY.items()}))


@register("fold_fit_oof")
def fold_fit_oof(spark, sf_dir):
    """K4 (rows-only): hashed TF-IDF ridge per (fold, target) on the labelled essays; OOF predictions."""
    _, cur = _pops(spark, sf_dir)
    oof, _ = SC.fold_fit_oof(cur.select("text_id", "full_text", "fold", *TARGETS))
    return rounded(oof)


@register("self_training_round")
def self_training_round(spark, sf_dir):
    """K5 (rows-only): one round. Fit with fold-k pseudo rows of the previous data; store the out-of-fold predictions
    and the previous data's pseudo labels; read both back, blend them with the earlier model as a named ensemble; assemble
    the next round's training set of every fold (true rows of other folds, pseudo rows without labelled ids)."""
    t = Tables(spark, sf_dir)
    e = fx.essays(t)
    cur = fx.current_population(t).select("text_id", "full_text", "fold", *TARGETS)
    prev = J.drop_known_ids(e.select("text_id", "full_text"), cur)
    earlier = J.restrict_population(fx.pseudo_long(e, ["model2"]), J.flag_known_ids(e.select("text_id"), fx.known_ids(t)))
    tokens = SC.tokenized(prev)             # a text trains five models and is scored by them
    seed = (earlier.groupBy("fold", "text_id").pivot("target", TARGETS).agg(F.max("pred"))
            .withColumnRenamed("fold", "fold_model").join(tokens, "text_id"))
    oof, scored = SC.fold_fit_oof(cur, extra_train=seed, extra_fold_col="fold_model", score_also=tokens)
    root = scratch_path(spark, "round")
    ids = ["text_id", "fold"]
    named = lambda df: df.select(F.lit("round1").alias("model_id"), *ids, "target", clip_score("pred").alias("pred"))
    S.write_predictions(named(S.to_long(oof, ids)), root, "oof", run_ts=1)
    S.write_predictions(named(S.to_long(scored.withColumnRenamed("fold_model", "fold"), ids)), root, "prev", run_ts=1)
    S.write_predictions(earlier.select("model_id", *ids, "target", "pred"), root, "prev", run_ts=1)
    catalog = spark.createDataFrame(
        [("next", "columnwise", "prev", "round2", "own", m, tt, w) for m, w in (("round1", 0.6), ("model2", 0.4)) for tt in TARGETS],
        "ensemble_id string, kind string, source string, destination string, fold_source string, model_id string, target string, w double")
    blended = G.route_catalog(catalog, "next", {"prev": S.read_predictions(spark, root, split="prev")}, ["fold", "text_id"])
    pseudo = J.attach_text(blended, e)
    sets = [J.assemble_training_set(cur, k, prev_pseudo=pseudo.filter(F.col("fold") == k)).withColumn("fold_model", F.lit(k))
            for k in range(N_FOLDS)]
    out = J.union_widen(*sets)
    return rounded(out.select("fold_model", "provenance", "text_id", *TARGETS))


@register("stored_models")
def stored_models(spark, sf_dir):
    """K1 + K3 (rows-only): a term model and a trigram model, fitted on the labelled essays, stored, and applied to all essays;
    fold means."""
    t = Tables(spark, sf_dir)
    cur = pin(fx.current_population(t).select("text_id", "full_text", "fold", *TARGETS))     # both fits read it
    registry = {kind: MO.save_model(spark, MO.fit_model(cur, kind, 512), kind) for kind in sorted(MO.FEATURES)}
    return rounded(MO.score_stored(fx.essays(t).select("text_id", "full_text"), registry))


@register("self_training_rounds")
def self_training_rounds(spark, sf_dir):
    """K5 (rows-only): rounds of self-training until the cross-validated score stops falling; score of every round."""
    t = Tables(spark, sf_dir)
    cur = fx.current_population(t).select("text_id", "full_text", "fold", *TARGETS)
    best, rounds, _ = R.self_training(spark, cur, fx.essays(t).select("text_id", "full_text"), scratch_path(spark, "rounds"), most_rounds=4,
                                      num_features=256)
    rows = [(r.number, r.mcrmse, r.number == best.number) for r in rounds]
    return rounded(spark.createDataFrame(rows, "round int, mcrmse double, best boolean"))
