"""Metrics and losses as grouped aggregates.

Predictions are long ``(…, model_id, text_id, target, pred)``; truth is the wide essay table. Truth is
attached with one equi-join on ``text_id`` and a CASE lookup of the target column, so truth is never
unpivoted. Every metric is a partial (map-side) aggregate: hot groups do not concentrate rows in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..targets import TARGETS

Criterion = Callable[[Column, Column], Column]


def attach_truth(predictions: DataFrame, truth: DataFrame, id_col: str = "text_id",
                 targets: list[str] | None = None) -> DataFrame:
    targets = targets or TARGETS
    t = truth.select(id_col, *[F.col(c).alias(f"_y_{c}") for c in targets])
    joined = predictions.join(t, id_col)
    y = None
    for c in targets:
        cond = F.col("target") == c
        y = F.when(cond, F.col(f"_y_{c}")) if y is None else y.when(cond, F.col(f"_y_{c}"))
    return joined.withColumn("y", y).drop(*[f"_y_{c}" for c in targets])


def rmse(y: Column, p: Column) -> Column:
    d = p - y
    return F.sqrt(F.avg(d * d))


def mse(y: Column, p: Column) -> Column:
    d = p - y
    return F.avg(d * d)


def scores_by_target(scored: DataFrame, by: list[str], criterion: Criterion = rmse,
                     name: str = "rmse", strict: bool = False) -> DataFrame:
    """One row per (by..., target) with the criterion and the number of scored rows.

    Lenient (default): rows whose prediction or truth is NULL or NaN are skipped and show up as a smaller ``n``.
    ``strict``: any such row is an error, raised when the result is computed.
    """
    y, p = F.col("y"), F.col("pred")
    valid = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    if strict:
        fail = F.raise_error(F.lit("a prediction or label is missing or NaN")).cast("double")
        rows = scored.withColumn("pred", F.when(valid, p).otherwise(fail))
    else:
        rows = scored.filter(valid)
    return rows.groupBy(*by, "target").agg(criterion(F.col("y"), F.col("pred")).alias(name), F.count(F.lit(1)).alias("n"))


def mcrmse(target_scores: DataFrame, by: list[str], col: str = "rmse", targets: list[str] | None = None) -> DataFrame:
    """Mean of the per-target scores; NULL unless every target has one."""
    targets = targets or TARGETS
    scored = F.count(F.when(F.col("target").isin(targets), F.col(col)))
    return target_scores.groupBy(*by).agg(F.when(scored == len(targets), F.avg(col)).alias("mcrmse"))


def leaderboard(target_scores: DataFrame, by: str = "model_id", col: str = "rmse",
                targets: list[str] | None = None) -> DataFrame:
    """I4: targets as columns, MCRMSE and the scored rows of the least covered target (``n``), best first, ties by id;
    a model that lacks a target has no MCRMSE and comes last."""
    targets = targets or TARGETS
    wide = target_scores.groupBy(by).agg(*[F.max(F.when(F.col("target") == t, F.col(col))).alias(t)
                                           for t in targets],
                                         F.when(F.count(F.when(F.col("target").isin(targets), F.col(col))) == len(targets),
                                                F.min("n")).otherwise(F.lit(0)).cast("long").alias("n"))
    mean = sum((F.col(t) for t in targets), F.lit(0.0)) / F.lit(float(len(targets)))
    return wide.withColumn("mcrmse", mean).orderBy(F.col("mcrmse").asc_nulls_last(), by)


def cumulative_cv(scored: DataFrame, by: list[str], fold_col: str = "fold", targets: list[str] | None = None) -> DataFrame:
    """After each fold, the MCRMSE over all folds seen so far; NULL unless the fold has every target. Works on (by, fold,
    target) partials."""
    targets = targets or TARGETS
    d = F.col("pred") - F.col("y")
    partial = (scored.filter(F.col("pred").isNotNull())
               .groupBy(*by, fold_col, "target").agg(F.sum(d * d).alias("_sse"), F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(*by, "target").orderBy(fold_col).rowsBetween(Window.unboundedPreceding, 0)
    running = partial.select(*by, fold_col, "target",
                             F.sqrt(F.sum("_sse").over(w) / F.sum("_n").over(w)).alias("_rmse"))
    known = running.filter(F.col("target").isin(targets))
    return known.groupBy(*by, fold_col).agg(F.when(F.count("_rmse") == len(targets), F.avg("_rmse")).alias("cv"))


# --- element-wise losses reduced per group --------------------------------------------------------------------

def loss_mse(scored: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("pred") - F.col("y")
    return scored.groupBy(*by).agg(F.avg(d * d).alias("loss"))


def loss_rmse_eps(scored: DataFrame, by: list[str], eps: float = 1e-9) -> DataFrame:
    """Element-wise sqrt(d² + eps), reduced by sum and mean (``none`` is the row expression itself)."""
    d = F.col("pred") - F.col("y")
    e = F.sqrt(d * d + F.lit(eps))
    return scored.groupBy(*by).agg(F.sum(e).alias("loss_sum"), F.avg(e).alias("loss_mean"))


def loss_mcrmse(scored: DataFrame, by: list[str], weights: list[float], eps: float = 1e-9,
                targets: list[str] | None = None) -> DataFrame:
    """I8: Σ_t w_t · mean(sqrt(d²+eps)) over the rows of target t. One weight per target is required."""
    targets = targets or TARGETS
    if len(weights) != len(targets):
        raise ValueError(f"need {len(targets)} weights, got {len(weights)}")
    d = F.col("pred") - F.col("y")
    e = F.sqrt(d * d + F.lit(eps))
    per_target = scored.groupBy(*by, "target").agg(F.avg(e).alias("_m"))
    w = F.lit(0.0)
    for t, wt in zip(targets, weights):
        w = F.when(F.col("target") == t, F.lit(float(wt))).otherwise(w)
    return per_target.groupBy(*by).agg(F.sum(F.col("_m") * w).alias("loss"))


def loss_smooth_l1(scored: DataFrame, by: list[str], beta: float = 1.0) -> DataFrame:
    a = F.abs(F.col("pred") - F.col("y"))
    e = F.when(a < F.lit(beta), F.lit(0.5) * a * a / F.lit(beta)).otherwise(a - F.lit(0.5 * beta))
    return scored.groupBy(*by).agg(F.avg(e).alias("loss"))


def loss_huber(scored: DataFrame, by: list[str], delta: float = 0.5) -> DataFrame:
    a = F.abs(F.col("pred") - F.col("y"))
    e = F.when(a < F.lit(delta), F.lit(0.5) * a * a).otherwise(F.lit(delta) * (a - F.lit(0.5 * delta)))
    return scored.groupBy(*by).agg(F.avg(e).alias("loss"))


# --- distribution losses over arrays of logits ----------------------------------------------------------------

def log_softmax(x: Column) -> Column:
    m = F.array_max(x)
    lse = m + F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))
    return F.transform(x, lambda v: v - lse)


def normalise_rows(t: Column) -> Column:
    s = F.aggregate(t, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(t, lambda v: v / s)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)


def focal_row(logits: Column, target: Column, gamma: float = 2.0, weights: list[float] | None = None) -> Column:
    """I11 row term: -w_c · (1 - p_c)^γ · log p_c for c = first argmax of the target; class weights default to 1.

    As in the usual weighted negative log-likelihood, the mean over rows is Σ terms / Σ w_c (``class_weight``).
    """
    logp = log_softmax(logits)
    c = F.array_position(target, F.array_max(target))
    lp = F.element_at(logp, c.cast("int"))
    return -(F.pow(F.lit(1.0) - F.exp(lp), F.lit(gamma)) * lp) * class_weight(target, weights)


def class_weight(target: Column, weights: list[float] | None) -> Column:
    """Weight of the row's class (first argmax of the target)."""
    if weights is None:
        return F.lit(1.0)
    c = F.array_position(target, F.array_max(target)).cast("int")
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), c)


def dense_ce_row(logits: Column, target: Column) -> Column:
    """I12 row term: -Σ t · log softmax(x)."""
    return -_dot(target, log_softmax(logits))


def kl_row(student: Column, teacher: Column) -> Column:
    """I14 'kl' (a cross-entropy): Σ softmax(teacher) · (-log softmax(student))."""
    p_t = F.transform(log_softmax(teacher), lambda v: F.exp(v))
    return -_dot(p_t, log_softmax(student))


def symmetric_kl_row(student: Column, teacher: Column) -> Column:
    return kl_row(student, teacher) + kl_row(teacher, student)


def sq_diff_sum(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda acc, v: acc + v)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Σ v·w / Σ w as an aggregate."""
    return F.sum(value * weight) / F.sum(weight)
