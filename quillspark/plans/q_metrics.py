"""Registered queries: scores, leaderboards, losses, running training metrics (I, W keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.positions import running_aggregates
from ..sources.tables import Tables
from ..targets import TARGETS
from . import fixtures as fx
from .registry import register, round_scaled, rounded
from .sqlparts import essays_cte, long_oof_cte

WITH_OOF = f"WITH {essays_cte()},\n{long_oof_cte()}\n"
LOSS_WEIGHTS = [0.2, 0.15, 0.15, 0.2, 0.15, 0.15]


def _scored(spark, sf_dir, models=None):
    t = Tables(spark, sf_dir)
    return M.attach_truth(fx.oof_long(t, models), fx.essays(t)), t


@register("rmse_by_target", sql=WITH_OOF + """
SELECT target, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, count(*) AS n
FROM oof WHERE model_id = 'model21' GROUP BY target""")
def rmse_by_target(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir, ["model21"])
    return rounded(M.scores_by_target(scored, []))


@register("oof_scores", sql=WITH_OOF + """
SELECT model_id, target, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, count(*) AS n
FROM oof GROUP BY model_id, target""")
def oof_scores(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(M.scores_by_target(scored, ["model_id"]))


@register("mcrmse", sql=WITH_OOF + """
SELECT model_id, round(avg(rmse), 6) AS mcrmse FROM (
  SELECT model_id, target, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM oof GROUP BY model_id, target)
GROUP BY model_id""")
def mcrmse(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(M.mcrmse(M.scores_by_target(scored, ["model_id"]), ["model_id"]))


_LB_COLS = ", ".join(f"round(max(CASE WHEN target = '{t}' THEN rmse END), 6) AS {t}" for t in TARGETS)
_LB_MEAN = " + ".join(f"max(CASE WHEN target = '{t}' THEN rmse END)" for t in TARGETS)


@register("leaderboard", sql=WITH_OOF + f"""
SELECT model_id, {_LB_COLS}, min(n) AS n, round(({_LB_MEAN}) / 6e0, 6) AS mcrmse FROM (
  SELECT model_id, target, sqrt(avg((pred - y) * (pred - y))) AS rmse, count(*) AS n FROM oof GROUP BY model_id, target)
GROUP BY model_id""")
def leaderboard(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(M.leaderboard(M.scores_by_target(scored, ["model_id"])))


@register("cumulative_cv", sql=WITH_OOF + """
SELECT model_id, fold, round(avg(r), 6) AS cv FROM (
  SELECT model_id, fold, target,
    sqrt(sum(sse) OVER (PARTITION BY model_id, target ORDER BY fold ROWS UNBOUNDED PRECEDING)
       / sum(n) OVER (PARTITION BY model_id, target ORDER BY fold ROWS UNBOUNDED PRECEDING)) AS r
  FROM (SELECT model_id, fold, target, sum((pred - y) * (pred - y)) AS sse, count(*) AS n
        FROM oof GROUP BY model_id, fold, target))
GROUP BY model_id, fold""")
def cumulative_cv(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(M.cumulative_cv(scored, ["model_id"]))


@register("loss_mse", sql=WITH_OOF + """
SELECT model_id, round(avg((pred - y) * (pred - y)), 6) AS loss FROM oof GROUP BY model_id""")
def loss_mse(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(M.loss_mse(scored, ["model_id"]))


@register("loss_rmse_eps", sql=WITH_OOF + """
SELECT model_id, round(sum(sqrt((pred - y) * (pred - y) + 1e-9)), 6) AS loss_sum,
       round(avg(sqrt((pred - y) * (pred - y) + 1e-9)), 6) AS loss_mean
FROM oof GROUP BY model_id""")
def loss_rmse_eps(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(M.loss_rmse_eps(scored, ["model_id"], eps=1e-9))


_LW_CASE = "CASE target " + " ".join(f"WHEN '{t}' THEN {w}e0" for t, w in zip(TARGETS, LOSS_WEIGHTS)) + " END"


@register("loss_mcrmse", sql=WITH_OOF + f"""
SELECT model_id, round(sum(m * {_LW_CASE}), 6) AS loss FROM (
  SELECT model_id, target, avg(sqrt((pred - y) * (pred - y) + 1e-9)) AS m FROM oof GROUP BY model_id, target)
GROUP BY model_id""")
def loss_mcrmse(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(M.loss_mcrmse(scored, ["model_id"], LOSS_WEIGHTS))


@register("loss_smooth_l1", sql=WITH_OOF + """
SELECT model_id, round(avg(CASE WHEN abs(pred - y) < 1e0 THEN 5e-1 * (pred - y) * (pred - y) / 1e0
                               ELSE abs(pred - y) - 5e-1 * 1e0 END), 6) AS loss
FROM oof GROUP BY model_id""")
def loss_smooth_l1(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(M.loss_smooth_l1(scored, ["model_id"], beta=1.0))


@register("loss_huber", sql=WITH_OOF + """
SELECT model_id, round(avg(CASE WHEN abs(pred - y) < 5e-1 THEN 5e-1 * (pred - y) * (pred - y)
                               ELSE 5e-1 * (abs(pred - y) - 5e-1 * 5e-1) END), 6) AS loss
FROM oof GROUP BY model_id""")
def loss_huber(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return rounded(M.loss_huber(scored, ["model_id"], delta=0.5))


# --- array (logit) losses: one row per (model, essay) with six logits --------------------------------------------

def _logit_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    oof = fx.oof_long(t)
    wide = oof.groupBy("model_id", "text_id").agg(
        F.array(*[F.max(F.when(F.col("target") == c, F.col("pred"))) for c in TARGETS]).alias("logits"))
    e = fx.essays(t).select("text_id", "doc_id", "fold", F.array(*TARGETS).alias("y"))
    return wide.join(e, "text_id").withColumn("soft", M.normalise_rows(F.col("y")))


# SQL: wide columns p1..p6 of each model joined to the truth.
_WIDE_LOGITS = ",\n".join(
    f"""w{i} AS (SELECT '{m}' AS model_id, doc_id, text_id, fold, {", ".join(
        f"{t} + ((doc_id * {a} + 31 * {j}) % 201 - 100) * {c}e-3 AS p{j + 1}" for j, t in enumerate(TARGETS))},
        {", ".join(f"{t} AS y{j + 1}" for j, t in enumerate(TARGETS))}
      FROM essays WHERE {"doc_id % 97 <> 0" if m == "exp02_fb3" else "TRUE"})"""
    for i, (m, a, c) in enumerate(fx.FIXTURE_MODELS))
_ALL_LOGITS = " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(len(fx.FIXTURE_MODELS)))
_P = [f"p{j}" for j in range(1, 7)]
_Y = [f"y{j}" for j in range(1, 7)]
_MAXP = f"greatest({', '.join(_P)})"
_LSE = f"({_MAXP} + ln({' + '.join(f'exp({p} - {_MAXP})' for p in _P)}))"
_YSUM = "(" + " + ".join(_Y) + ")"
_ARGMAX_LOGP = "CASE " + " ".join(
    f"WHEN y{j} = greatest({', '.join(_Y)}) AND {' AND '.join(f'y{i} < y{j}' for i in range(1, j)) or 'TRUE'} "
    f"THEN p{j} - {_LSE}" for j in range(1, 7)) + " END"
_DENSE_CE = "-(" + " + ".join(f"(y{j} / {_YSUM}) * (p{j} - {_LSE})" for j in range(1, 7)) + ")"
WITH_LOGITS = f"WITH {essays_cte()},\n{_WIDE_LOGITS},\nlg AS ({_ALL_LOGITS})\n"


@register("loss_focal", sql=WITH_LOGITS + f"""
SELECT model_id, round(avg(-(pow(1e0 - exp(lp), 2e0) * lp)), 6) AS loss
FROM (SELECT model_id, {_ARGMAX_LOGP} AS lp FROM lg) GROUP BY model_id""")
def loss_focal(spark, sf_dir):
    rows = _logit_rows(spark, sf_dir)
    return rounded(rows.groupBy("model_id").agg(F.avg(M.focal_row(F.col("logits"), F.col("y"), 2.0)).alias("loss")))


@register("loss_dense_ce", sql=WITH_LOGITS + f"""
SELECT model_id, round(avg({_DENSE_CE}), 6) AS loss FROM lg GROUP BY model_id""")
def loss_dense_ce(spark, sf_dir):
    rows = _logit_rows(spark, sf_dir)
    return rounded(rows.groupBy("model_id").agg(F.avg(M.dense_ce_row(F.col("logits"), F.col("soft"))).alias("loss")))


@register("loss_weighted_ce", sql=WITH_LOGITS + f"""
SELECT model_id, round(sum({_DENSE_CE} * (1 + doc_id % 3)) / sum(1 + doc_id % 3), 6) AS loss
FROM lg GROUP BY model_id""")
def loss_weighted_ce(spark, sf_dir):
    rows = _logit_rows(spark, sf_dir)
    w = (F.lit(1) + F.col("doc_id") % 3).cast("double")
    return rounded(rows.groupBy("model_id").agg(
        M.weighted_mean(M.dense_ce_row(F.col("logits"), F.col("soft")), w).alias("loss")))


def _pair_rows(spark, sf_dir, student="model2", teacher="model17"):
    rows = _logit_rows(spark, sf_dir)
    s = rows.filter(F.col("model_id") == student).select("text_id", "fold", F.col("logits").alias("s"))
    te = rows.filter(F.col("model_id") == teacher).select("text_id", F.col("logits").alias("t"))
    return s.join(te, "text_id")


def _sql_softmax_terms(a: str, b: str, a_cols, b_cols) -> str:
    """Σ softmax(b)_j · -(log softmax(a)_j) over six logit columns."""
    amax = f"greatest({', '.join(a_cols)})"
    alse = f"({amax} + ln({' + '.join(f'exp({c} - {amax})' for c in a_cols)}))"
    bmax = f"greatest({', '.join(b_cols)})"
    blse = f"({bmax} + ln({' + '.join(f'exp({c} - {bmax})' for c in b_cols)}))"
    return "(" + " + ".join(f"exp({bc} - {blse}) * -({ac} - {alse})" for ac, bc in zip(a_cols, b_cols)) + ")"


_S = [f"s.p{j}" for j in range(1, 7)]
_TT = [f"t.p{j}" for j in range(1, 7)]
WITH_PAIR = WITH_LOGITS + ", pair AS (SELECT s.text_id, s.fold, " + ", ".join(
    f"s.p{j} AS sp{j}, t.p{j} AS tp{j}" for j in range(1, 7)) + \
    " FROM w0 s JOIN w1 t ON s.text_id = t.text_id)\n"
_SP = [f"sp{j}" for j in range(1, 7)]
_TP = [f"tp{j}" for j in range(1, 7)]


@register("divergence_kl", sql=WITH_PAIR + f"""
SELECT fold, round(avg({_sql_softmax_terms('s', 't', _SP, _TP)}), 6) AS loss FROM pair GROUP BY fold""")
def divergence_kl(spark, sf_dir):
    p = _pair_rows(spark, sf_dir)
    return rounded(p.groupBy("fold").agg(F.avg(M.kl_row(F.col("s"), F.col("t"))).alias("loss")))


@register("divergence_sym", sql=WITH_PAIR + f"""
SELECT fold, round(avg({_sql_softmax_terms('s', 't', _SP, _TP)} + {_sql_softmax_terms('t', 's', _TP, _SP)}), 6)
  AS loss FROM pair GROUP BY fold""")
def divergence_sym(spark, sf_dir):
    p = _pair_rows(spark, sf_dir)
    return rounded(p.groupBy("fold").agg(F.avg(M.symmetric_kl_row(F.col("s"), F.col("t"))).alias("loss")))


@register("divergence_mse", sql=WITH_PAIR + f"""
SELECT fold, round(sum({' + '.join(f'(sp{j} - tp{j}) * (sp{j} - tp{j})' for j in range(1, 7))}) / (6 * count(*)), 6)
  AS loss FROM pair GROUP BY fold""")
def divergence_mse(spark, sf_dir):
    p = _pair_rows(spark, sf_dir)
    return rounded(p.groupBy("fold").agg(
        (F.sum(M.sq_diff_sum(F.col("s"), F.col("t"))) / (F.count(F.lit(1)) * 6)).alias("loss")))


# --- training-metric log (events) -------------------------------------------------------------------------------

METRIC_LOG_SQL = """metric_log AS (
  SELECT user_id AS run_id, event_id, cast(event_id % 5 AS int) AS fold, value AS loss,
         cast(1 + event_id % 6 AS int) AS n,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step
  FROM events)"""


@register("epoch_loss", sql="""
SELECT user_id AS run_id, cast(event_id % 5 AS int) AS fold,
       round(round(sum(value * (1 + event_id % 6)), 9) / sum(1 + event_id % 6), 6) AS epoch_loss
FROM events GROUP BY user_id, cast(event_id % 5 AS int)""")
def epoch_loss(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    log = ev.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 5).cast("int").alias("fold"),
                    F.col("value").alias("loss"), (F.lit(1) + F.col("event_id") % 6).alias("n"))
    # The numerator is rounded to 9 decimals so both engines divide the same double (summation order differs).
    return rounded(log.groupBy("run_id", "fold").agg(
        (round_scaled(F.sum(F.col("loss") * F.col("n")), 9) / F.sum("n")).alias("epoch_loss")))


@register("running_loss", sql=f"WITH {METRIC_LOG_SQL}\n" + """
SELECT run_id, fold, step, loss AS val,
  round(sum(loss * n) OVER w, 6) AS loss_sum,
  cast(sum(n) OVER w AS bigint) AS n_seen,
  round(round(sum(loss * n) OVER w, 9) / sum(n) OVER w, 6) AS avg
FROM metric_log
WINDOW w AS (PARTITION BY run_id, fold ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_loss(spark, sf_dir):
    log = fx.metric_log(Tables(spark, sf_dir))
    out = running_aggregates(log, ["run_id", "fold"], ["step"],
                             sums={"loss_sum": F.col("loss") * F.col("n"), "n_seen": F.col("n").cast("long")})
    return rounded(out.select("run_id", "fold", "step", F.col("loss").alias("val"), "loss_sum", "n_seen",
                              (round_scaled(F.col("loss_sum"), 9) / F.col("n_seen")).alias("avg")))


@register("best_so_far", sql=f"WITH {METRIC_LOG_SQL}\n" + """
SELECT run_id, fold, step, loss,
  coalesce(loss < min(loss) OVER (PARTITION BY run_id, fold ORDER BY step
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best
FROM metric_log""")
def best_so_far(spark, sf_dir):
    log = fx.metric_log(Tables(spark, sf_dir))
    out = running_aggregates(log, ["run_id", "fold"], ["step"], mins={"_prev_best": F.col("loss")},
                             include_current=False)
    return out.select("run_id", "fold", "step", "loss",
                      F.coalesce(F.col("loss") < F.col("_prev_best"), F.lit(True)).alias("is_best"))


@register("best_checkpoint", sql=f"WITH {METRIC_LOG_SQL}\n" + """
SELECT run_id, fold, step AS best_step, loss AS best_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, fold ORDER BY loss, step) AS r FROM metric_log)
WHERE r = 1""")
def best_checkpoint(spark, sf_dir):
    log = fx.metric_log(Tables(spark, sf_dir))
    # primitive buffers keep the hash aggregate: the lowest loss first, then the first step that reached it
    lowest = log.groupBy("run_id", "fold").agg(F.min("loss").alias("best_loss"))
    return (log.join(lowest, ["run_id", "fold"]).filter(F.col("loss") == F.col("best_loss"))
            .groupBy("run_id", "fold", "best_loss").agg(F.min("step").alias("best_step"))
            .select("run_id", "fold", "best_step", "best_loss"))


# --- T1: the same roll-up as a stream ----------------------------------------------------------------------------

@register("metric_stream", sql="""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, user_id AS run_id,
       cast(event_id % 5 AS int) AS fold,
       round(sum(value * (1 + event_id % 6)), 6) AS loss_sum, cast(sum(1 + event_id % 6) AS bigint) AS n,
       round(min(value), 6) AS best_loss, count(*) AS steps,
       round(round(sum(value * (1 + event_id % 6)), 9) / sum(1 + event_id % 6), 6) AS epoch_loss
FROM events GROUP BY 1, 2, 3""")
def metric_stream(spark, sf_dir):
    """Structured Streaming roll-up (watermark, daily window, update mode, foreachBatch sink), read back.

    The backlog arrives as eight files in no time order, two per trigger; no row may fall behind the watermark.
    """
    from ..session import scratch_path
    from ..streaming import metric_stream as MS
    events = Tables(spark, sf_dir).events
    source = scratch_path(spark, "metric-source")
    events.repartition(8, F.xxhash64("event_id")).write.parquet(source)
    sink, dropped = MS.run_metric_stream(spark, source, events.schema, max_files_per_trigger=2)
    if dropped:
        raise RuntimeError(f"{dropped} rows were behind the watermark")
    return rounded(MS.finish(MS.latest(spark, sink)))
