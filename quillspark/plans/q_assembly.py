"""Registered queries: membership filters, unions and training-set assembly (E2, E6, F keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as G
from ..operators import joins as J
from ..sources.tables import Tables
from ..targets import TARGETS
from . import fixtures as fx
from .q_blend import MODELS
from .sqlparts import blend_sql, fold_model_cte, modelwise_w, sql_clip
from .registry import register, rounded
from .sqlparts import current_cte, essays_cte, known_cte

K_VALID = 2


@register("drop_known_ids", sql=f"WITH {essays_cte()},\n{known_cte()}\n"
          "SELECT text_id FROM essays WHERE text_id NOT IN (SELECT text_id FROM known)")
def drop_known_ids(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return J.drop_known_ids(fx.previous_population(t).select("text_id"), fx.known_ids(t))


@register("flag_known_ids", sql=f"WITH {essays_cte()},\n{known_cte()}\n"
          "SELECT text_id, text_id IN (SELECT text_id FROM known) AS in_fb3 FROM essays")
def flag_known_ids(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return J.flag_known_ids(fx.previous_population(t).select("text_id"), fx.known_ids(t))


def _curr_pseudo_wide(t, model="model21", k=K_VALID):
    """One model's fold-model-k pseudo labels of the labelled essays, wide."""
    cur = fx.current_population(t)
    pl = fx.pseudo_long(cur.select("doc_id", "text_id", *TARGETS), [model]).filter(F.col("fold") == k)
    return pl.groupBy("text_id").pivot("target", TARGETS).agg(F.first("pred"))


def _prev_pseudo_wide(spark, t, k=K_VALID):
    """Model-wise blend of the fold-model-k pseudo labels over the whole previous corpus, with text."""
    e = fx.essays(t)
    pl = fx.pseudo_long(e).filter(F.col("fold") == k)
    return J.attach_text(G.blend(pl, fx.modelwise_weights(spark), ["text_id"]), e)


_CURR_P = fold_model_cte("cp", "model21", "curr", k_fixed=K_VALID)
_PREV_M = ",\n".join(fold_model_cte(f"m{i}", m, "essays", k_fixed=K_VALID) for i, m in enumerate(MODELS))
_pb_cols, _pb_from = blend_sql(modelwise_w, "text_id", clip=False)
_pb_cols = _pb_cols.replace("round(", "(").replace(", 6) AS", ") AS")  # keep full precision inside the CTE
_PREV_BLEND = f"pb AS (SELECT m0.text_id, {_pb_cols} {_pb_from})"
BASE = f"WITH {essays_cte()},\n{current_cte()},\n{_CURR_P},\n{_PREV_M},\n{_PREV_BLEND}\n"
_CLIPPED = ", ".join(f"round({sql_clip(t)}, 6) AS {t}" for t in TARGETS)
_RAW = ", ".join(f"round({t}, 6) AS {t}" for t in TARGETS)

SQL_TRUE = f"SELECT text_id, full_text, fold, {_CLIPPED}, 'true' AS provenance FROM curr WHERE fold IS DISTINCT FROM {K_VALID}"
SQL_PREV = (f"SELECT text_id, full_text, cast(NULL AS int) AS fold, {_CLIPPED}, 'prev_pseudo' AS provenance FROM "
            f"(SELECT pb.*, e.full_text FROM pb LEFT JOIN essays e USING (text_id)) "
            f"WHERE text_id NOT IN (SELECT text_id FROM curr)")
SQL_CURR = (f"SELECT text_id, full_text, fold, {_CLIPPED}, 'curr_pseudo' AS provenance FROM "
            f"(SELECT cp.text_id, c.full_text, c.fold, {', '.join('cp.' + t for t in TARGETS)} FROM cp "
            f"LEFT JOIN curr c USING (text_id)) WHERE fold IS DISTINCT FROM {K_VALID}")


@register("curr_pseudo_no_leak", sql=BASE + f"SELECT text_id, full_text, fold, {_RAW} FROM "
          f"(SELECT cp.text_id, c.full_text, c.fold, {', '.join('cp.' + t for t in TARGETS)} FROM cp "
          f"LEFT JOIN curr c USING (text_id)) WHERE fold IS DISTINCT FROM {K_VALID}")
def curr_pseudo_no_leak(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = J.curr_pseudo_no_leak(_curr_pseudo_wide(t), fx.current_population(t), K_VALID)
    return rounded(out.select("text_id", "full_text", "fold", *TARGETS))


@register("union_widen", sql=BASE + f"SELECT text_id, fold, {_RAW} FROM curr UNION ALL "
          f"SELECT text_id, cast(NULL AS int) AS fold, {_RAW} FROM pb WHERE text_id NOT IN (SELECT text_id FROM curr)")
def union_widen(spark, sf_dir):
    """labelled rows (with fold) ∪ previous-data pseudo rows (no fold column)."""
    t = Tables(spark, sf_dir)
    true_rows = fx.current_population(t).select("text_id", "fold", *TARGETS)
    prev = J.drop_known_ids(_prev_pseudo_wide(spark, t).select("text_id", *TARGETS), true_rows)
    return rounded(J.union_widen(true_rows, prev))


@register("oof_union", sql=f"WITH {essays_cte()}\nSELECT text_id, fold, " + ", ".join(
    f"round({t} + ((doc_id * 71 + 31 * {j}) % 201 - 100) * 6e-3, 6) AS pred_{t}" for j, t in enumerate(TARGETS))
    + " FROM essays")
def oof_union(spark, sf_dir):
    """the five per-fold OOF frames of one model concatenated."""
    t = Tables(spark, sf_dir)
    wide = fx.oof_wide(t, "model21")
    parts = [wide.filter(F.col("fold") == k).select("text_id", "fold", *[f"pred_{c}" for c in TARGETS])
             for k in range(5)]
    return rounded(J.union_widen(*parts))


def _assemble(spark, sf_dir, use_true, use_prev, use_curr):
    t = Tables(spark, sf_dir)
    labelled = fx.current_population(t).select("text_id", "full_text", "fold", *TARGETS)
    return rounded(J.assemble_training_set(
        labelled, K_VALID, use_true=use_true,
        prev_pseudo=_prev_pseudo_wide(spark, t) if use_prev else None,
        curr_pseudo=_curr_pseudo_wide(t) if use_curr else None))


@register("assemble_true", sql=BASE + SQL_TRUE)
def assemble_true(spark, sf_dir):
    return _assemble(spark, sf_dir, True, False, False)


@register("assemble_prev", sql=BASE + SQL_PREV)
def assemble_prev(spark, sf_dir):
    return _assemble(spark, sf_dir, False, True, False)


@register("assemble_mixed", sql=BASE + SQL_TRUE + " UNION ALL " + SQL_PREV + " UNION ALL " + SQL_CURR)
def assemble_mixed(spark, sf_dir):
    return _assemble(spark, sf_dir, True, True, True)


@register("assemble_track2", sql=BASE + f"SELECT text_id, fold, {_RAW}, 'true' AS provenance FROM curr "
          f"WHERE fold IS DISTINCT FROM {K_VALID} UNION ALL "
          f"SELECT text_id, cast(NULL AS int) AS fold, {_RAW}, 'pseudo' AS provenance FROM pb")
def assemble_track2(spark, sf_dir):
    """F4 ``extend``: labelled rows of the other folds plus the fold's pseudo rows (no clip, no anti join)."""
    t = Tables(spark, sf_dir)
    labelled = fx.current_population(t).select("text_id", "fold", *TARGETS)
    pseudo = _prev_pseudo_wide(spark, t).select("text_id", *TARGETS)
    return rounded(J.assemble_track2(labelled, pseudo, K_VALID, "extend").select("text_id", "fold", *TARGETS,
                                                                              "provenance"))


@register("leakage_report", sql=BASE + f"""
, tr AS (SELECT DISTINCT text_id FROM ({SQL_TRUE} UNION ALL {SQL_PREV} UNION ALL {SQL_CURR})),
va AS (SELECT DISTINCT text_id FROM curr)
SELECT coalesce(tr.text_id, va.text_id) AS text_id, tr.text_id IS NOT NULL AS in_train,
       va.text_id IS NOT NULL AS in_valid, tr.text_id IS NOT NULL AND va.text_id IS NOT NULL AS leak
FROM tr FULL OUTER JOIN va ON tr.text_id = va.text_id""".replace("\n, tr AS", ", tr AS"))
def leakage_report(spark, sf_dir):
    """F5 with ``valid='all'``: every labelled essay is validated, so the training rows of fold 2 leak."""
    t = Tables(spark, sf_dir)
    labelled = fx.current_population(t).select("text_id", "full_text", "fold", *TARGETS)
    train = J.assemble_training_set(labelled, K_VALID, prev_pseudo=_prev_pseudo_wide(spark, t),
                                    curr_pseudo=_curr_pseudo_wide(t))
    return J.leakage_report(train, labelled, K_VALID, valid="all")
