"""Blend-weight fitting from distributed sufficient statistics (H1–H6).

RMSE² of a blend Σ wᵢ·pᵢ is the quadratic wᵀGw − 2bᵀw + yy over n rows, with G = PᵀP, b = Pᵀy. One pass over
the predictions (``mapInPandas`` partial Gram per Arrow batch, then a ``groupBy().sum()``) gives G, b, yy, n
per target; every later step — box-constrained least squares, the model-level objective (mean of per-target
RMSE, convex), scoring any number of trial weight vectors — works on those (M+1)² numbers. Only they reach the
driver, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..targets import TARGETS, target_value
from ..session import pin
from .ensemble import collect_small

GRAM_SCHEMA = "grp string, i int, j int, v double"


def wide_design(predictions: DataFrame, truth: DataFrame, models: list[str], id_col: str = "text_id",
                features: str = "model", complete: bool = True) -> DataFrame:
    """Design rows, complete cases only (``incomplete_rows`` counts the others; ``complete=False`` keeps them).

    ``features='model'``: ``(grp, f0..f{M-1}, y)``, one row per (essay, target) from one row per essay, so the
    predictions are shuffled once. ``features='stacked'``: ``(f0..f{6M-1}, y0..y5)``, one row per essay: all targets
    share the features. An id that a model predicted twice is incomplete: neither prediction is preferred.
    """
    t = truth.select(id_col, *TARGETS)
    cols = [(m, s) for m in models for s in TARGETS]

    def cell(m, s):
        here = F.when((F.col("model_id") == m) & (F.col("target") == s), F.col("pred"))
        return F.when(F.count(here) == 1, F.max(here))
    wide = predictions.groupBy(id_col).agg(*[cell(m, s).alias(f"f{i}") for i, (m, s) in enumerate(cols)])
    rows = wide.join(t, id_col)
    if features == "stacked":
        names = [*[f"f{i}" for i in range(len(cols))], *[f"y{j}" for j in range(len(TARGETS))]]
        out = rows.select(*names[:len(cols)], *[F.col(x).alias(f"y{j}") for j, x in enumerate(TARGETS)])
    elif features == "model":
        names = [*[f"f{i}" for i in range(len(models))], "y"]
        per = [F.struct(F.lit(x).alias("grp"), *[F.col(f"f{cols.index((m, x))}").alias(f"f{i}") for i, m in enumerate(models)],
                        F.col(x).alias("y")) for x in TARGETS]
        out = rows.select(F.explode(F.array(*per)).alias("r")).select("r.grp", *[f"r.{c}" for c in names])
    else:
        raise ValueError("features must be 'model' or 'stacked'")
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return out.filter(ok) if complete else out.withColumn("complete", ok)


def incomplete_rows(predictions: DataFrame, truth: DataFrame, models: list[str], id_col: str = "text_id",
                    features: str = "model") -> DataFrame:
    """How many design rows a fit leaves out because a model has no single finite prediction: ``(grp,) n, n_dropped``."""
    d = wide_design(predictions, truth, models, id_col, features, complete=False)
    by = ["grp"] if features == "model" else []
    return d.groupBy(*by).agg(F.count(F.when(F.col("complete"), 1)).alias("n"),
                              F.count(F.when(~F.col("complete"), 1)).alias("n_dropped"))


def stacked_grams(design: DataFrame, k: int) -> dict[str, "Gram"]:
    """H3: the six targets share one Gram matrix over [F, Y]; each target reads its own column of it."""
    m = len(TARGETS)
    stats = gram_statistics(design.select(F.lit("all").alias("grp"), *[f"f{i}" for i in range(k)], *[f"y{j}" for j in range(m)]))
    rows = collect_small(stats, limit=(k + m) * (k + m + 1) // 2 + 1)
    full, n = np.zeros((k + m, k + m)), 0.0
    for r in rows:
        if r["i"] < 0:
            n = r["v"]
        else:
            full[r["i"], r["j"]] = full[r["j"], r["i"]] = r["v"]
    out = {}
    for j, t in enumerate(TARGETS):
        keep = [*range(k), k + j]
        own = full[np.ix_(keep, keep)]
        g = Gram(k, [])
        g.G, g.b, g.yy, g.n = own[:k, :k], own[:k, k], own[k, k], n
        out[t] = g
    return out


def _partial_gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    acc: dict[str, np.ndarray] = {}
    count: dict[str, int] = {}
    for pdf in batches:
        if pdf.empty:
            continue
        for grp, part in pdf.groupby("grp", sort=False):
            x = part.drop(columns=["grp"]).to_numpy(dtype=np.float64)
            g = x.T @ x
            acc[grp] = acc[grp] + g if grp in acc else g
            count[grp] = count.get(grp, 0) + len(part)
    for grp, g in acc.items():
        k = g.shape[0]
        ii, jj = np.triu_indices(k)
        out = pd.DataFrame({"grp": grp, "i": ii.astype("int32"), "j": jj.astype("int32"), "v": g[ii, jj]})
        out = pd.concat([out, pd.DataFrame({"grp": [grp], "i": [-1], "j": [-1], "v": [float(count[grp])]})])
        yield out.astype({"i": "int32", "j": "int32"})


def gram_statistics(design: DataFrame) -> DataFrame:
    """Per group: upper triangle of [F y]ᵀ[F y] and the row count (i = j = -1). Partial per task, summed."""
    partial = design.mapInPandas(_partial_gram, GRAM_SCHEMA)
    return partial.groupBy("grp", "i", "j").agg(F.sum("v").alias("v"))


class Gram:
    """G, b, yy, n of one group, read from the statistics table."""

    def __init__(self, k: int, entries: list):
        full = np.zeros((k + 1, k + 1))
        n = 0.0
        for i, j, v in entries:
            if i < 0:
                n = v
                continue
            full[i, j] = v
            full[j, i] = v
        self.G = full[:k, :k]
        self.b = full[:k, k]
        self.yy = full[k, k]
        self.n = n

    def sse(self, w: np.ndarray) -> float:
        return float(w @ self.G @ w - 2 * self.b @ w + self.yy)

    def rmse(self, w: np.ndarray) -> float:
        return float(np.sqrt(max(self.sse(w), 0.0) / self.n))


def collect_grams(stats: DataFrame, k: int, groups: int = len(TARGETS)) -> dict[str, Gram]:
    """Statistics of ``groups`` groups over ``k`` features: (k + 1)(k + 2) / 2 sums and a count each."""
    rows = collect_small(stats, limit=groups * ((k + 1) * (k + 2) // 2 + 1))
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["grp"], []).append((r["i"], r["j"], r["v"]))
    return {g: Gram(k, e) for g, e in by.items()}


# Largest violation of the optimality conditions (scaled as in ``kkt_violation``) that a fit may return.
KKT_TOL = 1e-8


class NotOptimal(ArithmeticError):
    """A fit whose weights do not meet the optimality conditions."""


def certified(G: np.ndarray, b: np.ndarray, w: np.ndarray, lb: np.ndarray, ub: np.ndarray, tol: float = KKT_TOL) -> np.ndarray:
    """``w``, if it meets the KKT conditions of the box problem; else an error."""
    worst = kkt_violation(G, b, w, lb, ub)
    if not worst <= tol:
        raise NotOptimal(f"optimality conditions violated by {worst:.3g} (allowed {tol:.3g})")
    return w


def solve_box_ls(G: np.ndarray, b: np.ndarray, lb: np.ndarray, ub: np.ndarray, ridge: float = 1e-10,
                 tol: float = KKT_TOL) -> np.ndarray:
    """min wᵀGw − 2bᵀw on lb ≤ w ≤ ub by active sets; the result is certified.

    Weights at a bound are held there, the others solve their linear system; a step that would leave the box stops at the
    first bound and holds that weight. Once the free weights are at their optimum, the held weight with the strongest pull
    inwards is let go. Every optimum of a face is strictly better than the one before, so no face comes twice and the
    search ends after finitely many faces. ``ridge`` (relative to the mean diagonal of G) makes the optimum unique when models
    are collinear; its effect on the conditions lies below ``tol``. Conditions that are not met are an error.
    """
    k = len(b)
    lb, ub = np.broadcast_to(np.asarray(lb, float), k), np.broadcast_to(np.asarray(ub, float), k)
    if (lb > ub).any():
        raise ValueError("a lower bound lies above its upper bound")
    scale = max(np.trace(G) / max(k, 1), 1e-300)
    Gs, bs = G / scale + ridge * np.eye(k), b / scale
    w = np.clip(np.linalg.solve(Gs, bs) if k else bs, lb, ub)
    free = (w > lb) & (w < ub)
    faces = set()
    while True:
        while free.any():
            target = np.linalg.solve(Gs[np.ix_(free, free)], bs[free] - Gs[np.ix_(free, ~free)] @ w[~free])
            step = target - w[free]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(step > 0, (ub[free] - w[free]) / step, np.where(step < 0, (lb[free] - w[free]) / step, np.inf))
            first = int(np.argmin(room))
            if room[first] >= 1:
                w[free] = target
                break
            at = np.flatnonzero(free)[first]
            w[free] += room[first] * step
            w[at] = ub[at] if step[first] > 0 else lb[at]
            w = np.clip(w, lb, ub)
            free[at] = False
        pull = bs - Gs @ w                                  # half the negative gradient
        inwards = np.where(free | (lb == ub), 0.0, np.where(w <= lb, pull, -pull))
        at = int(np.argmax(inwards)) if k else 0
        face = tuple(np.where(free, 0, np.where(w <= lb, -1, 1)))
        if not k or inwards[at] <= tol / 4 or face in faces:
            return certified(G, b, w, lb, ub, tol)
        faces.add(face)
        free[at] = True


def kkt_violation(G: np.ndarray, b: np.ndarray, w: np.ndarray, lb: np.ndarray, ub: np.ndarray) -> float:
    """Largest violation of the box KKT conditions (gradient scaled by the trace of G); weights without room have none."""
    scale = max(np.trace(G) / max(len(b), 1), 1e-300)
    g = 2 * (G @ w - b) / scale
    viol = np.where(w <= lb + 1e-12, np.maximum(-g, 0), np.where(w >= ub - 1e-12, np.maximum(g, 0), np.abs(g)))
    return float(np.where(lb == ub, 0.0, viol).max()) if len(viol) else 0.0


def bounds(models: list[str], upper: dict[str, float] | None = None, lower: float = 0.0):
    """H5: per-model upper bounds (default 1), common lower bound."""
    upper = upper or {}
    lb = np.full(len(models), lower)
    ub = np.array([upper.get(m, 1.0) for m in models])
    return lb, ub


def fit_columnwise(grams: dict[str, Gram], models: list[str], upper: dict[str, float] | None = None):
    """H1: per target, the box-constrained least-squares weights and their RMSE."""
    lb, ub = bounds(models, upper)
    out = {}
    for t, g in grams.items():
        w = solve_box_ls(g.G, g.b, lb, ub)
        out[t] = (w, g.rmse(w))
    return out


def mean_rmse_slope(gs: list[Gram], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the mean RMSE. A target that is met exactly has the subgradient 0."""
    k = len(w)
    grad, hess = np.zeros(k), np.zeros((k, k))
    for g in gs:
        r = g.rmse(w)
        if r * r * g.n <= 1e-13 * max(g.yy, 1e-300):
            continue
        d = (g.G @ w - g.b) / (r * g.n)
        grad += d / len(gs)
        hess += (g.G / (r * g.n) - np.outer(d, d) / r) / len(gs)
    return grad, hess


def box_violation(grad: np.ndarray, w: np.ndarray, lb: np.ndarray, ub: np.ndarray) -> float:
    """Largest part of a gradient that points out of no bound."""
    v = np.where(w <= lb + 1e-12, np.maximum(-grad, 0), np.where(w >= ub - 1e-12, np.maximum(grad, 0), np.abs(grad)))
    return float(v.max()) if len(v) else 0.0


def fit_modelwise(grams: dict[str, Gram], models: list[str], upper: dict[str, float] | None = None, tol: float = KKT_TOL):
    """H2: one vector for all targets minimising the mean of the per-target RMSE (convex).

    Newton steps on the box: each step solves the quadratic model exactly (``solve_box_ls``) and is halved until the mean
    RMSE falls. It ends when the gradient that no bound holds is at most ``tol``; when no step helps before that, it
    is an error, never a silent limit. Returns (weights, mean RMSE).
    """
    lb, ub = bounds(models, upper)
    gs = list(grams.values())
    w = np.mean([solve_box_ls(g.G, g.b, lb, ub) for g in gs], axis=0)

    def mean_rmse(v):
        return float(np.mean([g.rmse(v) for g in gs]))
    now = mean_rmse(w)
    while True:
        grad, hess = mean_rmse_slope(gs, w)
        if box_violation(grad, w, lb, ub) <= tol:
            return w, now
        hess += 1e-12 * max(np.trace(hess) / len(w), 1e-300) * np.eye(len(w))
        step = solve_box_ls(hess, hess @ w - grad, lb, ub, tol=np.inf) - w
        size, better = 1.0, None
        while size > 1e-12:
            value = mean_rmse(w + size * step)
            if value < now:
                better = np.clip(w + size * step, lb, ub)
                break
            size /= 2
        if better is None:
            if box_violation(grad, w, lb, ub) <= 100 * tol:     # the objective has no more digits
                return w, now
            raise NotOptimal(f"mean RMSE {now}: gradient {box_violation(grad, w, lb, ub):.3g}, and no step lowers it")
        w, now = better, mean_rmse(better)


def score_trials(stats: DataFrame, trials: DataFrame, n_feat: int) -> DataFrame:
    """H6: MCRMSE of every trial weight vector from the Gram table, in Spark (no fan-out over rows).

    ``trials``: ``(trial, i, w)`` with i the model index < ``n_feat``. Σᵢⱼ wᵢwⱼGᵢⱼ − 2Σᵢ wᵢbᵢ + yy per
    (trial, target). The Gram table is read by five branches, so it is materialised once (it is tiny).
    """
    stats = pin(stats)
    g = stats.filter(F.col("i") >= 0)
    gram = g.filter((F.col("i") < n_feat) & (F.col("j") < n_feat))
    b = g.filter((F.col("j") == n_feat) & (F.col("i") < n_feat)).select("grp", "i", F.col("v").alias("b"))
    yy = g.filter((F.col("i") == n_feat) & (F.col("j") == n_feat)).select("grp", F.col("v").alias("yy"))
    n = stats.filter(F.col("i") < 0).select("grp", F.col("v").alias("n"))
    wi = trials.select("trial", F.col("i"), F.col("w").alias("wi"))
    wj = trials.select("trial", F.col("i").alias("j"), F.col("w").alias("wj"))
    mult = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(2.0))  # upper triangle only
    quad = (gram.join(wi, "i").join(wj, ["trial", "j"])
            .groupBy("trial", "grp").agg(F.sum(mult * F.col("wi") * F.col("wj") * F.col("v")).alias("q")))
    lin = b.join(wi, "i").groupBy("trial", "grp").agg(F.sum(F.col("wi") * F.col("b")).alias("l"))
    per = (quad.join(lin, ["trial", "grp"]).join(yy, "grp").join(n, "grp")
           .select("trial", "grp", F.sqrt(F.greatest(F.col("q") - 2 * F.col("l") + F.col("yy"), F.lit(0.0))
                                          / F.col("n")).alias("rmse")))
    return per.groupBy("trial").agg(F.avg("rmse").alias("mcrmse"))


def dirichlet_weights(n_models: int, n_trials: int, seed: int) -> np.ndarray:
    """Weight vectors drawn from Dirichlet(1, …, 1), seeded."""
    return np.random.default_rng(seed).dirichlet(np.ones(n_models), size=n_trials)


def dirichlet_trials(spark, n_models: int, n_trials: int, seed: int) -> DataFrame:
    """H4: random restarts as a ``(trial, i, w)`` table."""
    w = dirichlet_weights(n_models, n_trials, seed)
    rows = [(int(t), int(i), float(w[t, i])) for t in range(n_trials) for i in range(n_models)]
    return spark.createDataFrame(rows, "trial int, i int, w double")


def best_trial(scored: DataFrame, trials: DataFrame) -> DataFrame:
    """H4: the trial with the lowest MCRMSE (ties: the first) with its weights: ``(trial, i, w, mcrmse)``."""
    best = scored.filter(F.col("mcrmse").isNotNull() & ~F.isnan("mcrmse")).orderBy("mcrmse", "trial").limit(1)
    return best.join(trials, "trial").select("trial", "i", "w", "mcrmse")


# Factor by which a search draws wider than its best trials lie.
WIDER = 1.3


def _proposals(seed: int, number: int, trials: np.ndarray, mean: np.ndarray, root: np.ndarray, lb: np.ndarray, ub: np.ndarray) -> np.ndarray:
    """Weight vectors of the numbered trials of a round; each depends on (seed, round, trial) alone."""
    out = np.empty((len(trials), len(mean)))
    for row, t in enumerate(trials.tolist()):
        rng = np.random.Generator(np.random.Philox(key=[seed, (number << 40) + t]))
        out[row] = rng.dirichlet(np.ones(len(mean))) if number == 0 else mean + root @ rng.standard_normal(len(mean))
    return np.clip(out, lb, ub)


def search_weights(spark, grams: dict[str, Gram], models: list[str], upper: dict[str, float] | None = None, n_trials: int = 1000,
                   elite: int = 30, seed: int = 42, spread: float = 1e-5, most_rounds: int = 200):
    """H4 + H6: seeded random restarts, then a cross-entropy search, all scored by MCRMSE from the Gram statistics.

    Round 0 draws ``n_trials`` Dirichlet vectors; every later round draws from a normal with the mean and (widened by
    ``WIDER``, so that it does not narrow before it has arrived) the covariance of the ``elite`` best of the round before,
    clipped to the box. Trials are numbered and drawn and scored in Spark tasks, so
    their number is not bound by the driver, which reads the ``elite`` best of a round. A trial depends on (seed, round,
    number) alone: any partitioning gives the same search. The best vector of all rounds is kept, so the result is never
    worse than a restart. The search ends when the largest spread falls below ``spread``; ``most_rounds`` rounds without that
    are an error. Returns (weights, mcrmse, history rows).
    """
    lb, ub = bounds(models, upper)
    k = len(models)
    gs = list(grams.values())
    G, b = np.stack([g.G for g in gs]), np.stack([g.b for g in gs])
    yy, n = np.array([g.yy for g in gs]), np.array([g.n for g in gs])
    shipped = spark.sparkContext.broadcast((G, b, yy, n))
    mean, root = np.full(k, 1 / k), np.eye(k)
    best, best_w, history = np.inf, None, []
    for number in range(most_rounds):
        def run(batches, number=number, mean=mean, root=root):
            G, b, yy, n = shipped.value
            for batch in batches:
                ids = batch["id"].to_numpy()
                w = _proposals(seed, number, ids, mean, root, lb, ub)
                sse = np.einsum("ti,gij,tj->tg", w, G, w) - 2 * w @ b.T + yy
                score = np.sqrt(np.maximum(sse, 0) / n).mean(axis=1)
                yield pd.DataFrame({"trial": ids, "mcrmse": score, "w": list(w)})
        scored = spark.range(n_trials).mapInPandas(run, "trial long, mcrmse double, w array<double>")
        top = collect_small(scored.orderBy("mcrmse", "trial").limit(elite), elite)
        w = np.array([r["w"] for r in top])
        if top[0]["mcrmse"] < best:
            best, best_w = top[0]["mcrmse"], w[0]
        mean, width = w.mean(axis=0), float(w.std(axis=0).max())
        cov = np.atleast_2d(np.cov(w.T, bias=True))
        values, axes = np.linalg.eigh(0.95 * cov + 0.05 * np.diag(np.diag(cov)))
        root = WIDER * axes * np.sqrt(np.maximum(values, 0))
        history.append((number, n_trials * (number + 1), float(best), width))
        if width <= spread:
            return best_w, float(best), history
    raise NotOptimal(f"the search did not narrow down in {most_rounds} rounds (spread {width:.3g})")


def refine_clipped(design: DataFrame, start: dict[str, np.ndarray], lb: np.ndarray, ub: np.ndarray,
                   tol: float = 1e-12, lo: float = 1.0, hi: float = 5.0):
    """H1, class version: the blend is clipped to [lo, hi] inside the objective, which is no longer quadratic.

    Projected Gauss-Newton from the Gram optimum, run until no target improves its squared error by more than
    ``tol`` (relative). Only rows whose blend lies strictly inside the range have a gradient, so a step solves the
    box-constrained least squares of those rows (one distributed Gram pass); the step length is chosen among halvings of
    the full step by their exact clipped errors (one distributed scoring pass). The error falls strictly in every
    accepted step, so the loop ends without a round limit. Returns ``{target: (weights, clipped rmse)}``.
    """
    names = sorted((c for c in design.columns if c.startswith("f") and c[1:].isdigit()), key=lambda c: int(c[1:]))
    k = len(names)
    cur = {t: np.asarray(w, dtype=float) for t, w in start.items()}
    src = design.select("grp", *names, "y")
    best = {t: (sse[0], n) for t, (sse, n) in _clipped_errors(src, {t: w[None] for t, w in cur.items()}, names, lo, hi).items()}
    moving = set(best)
    while moving:
        at = {t: cur[t] for t in moving}
        stats = src.mapInPandas(_active_gram(at, names, lo, hi), GRAM_SCHEMA)
        grams = collect_grams(stats.groupBy("grp", "i", "j").agg(F.sum("v").alias("v")), k, groups=len(cur))
        trials = {}
        for t in moving:
            if t not in grams:
                continue
            full = solve_box_ls(grams[t].G, grams[t].b, lb, ub) - cur[t]
            trials[t] = np.vstack([cur[t] + full / 2 ** s for s in range(31)])
        errors = _clipped_errors(src, trials, names, lo, hi) if trials else {}
        moving = set()
        for t, (sse, n) in errors.items():
            c = int(np.argmin(sse))
            if sse[c] < best[t][0] * (1 - tol):
                cur[t], best[t] = trials[t][c], (sse[c], n)
                moving.add(t)
    return {t: (cur[t], float(np.sqrt(best[t][0] / best[t][1]))) for t in best}


def _clipped_errors(src: DataFrame, cands: dict[str, np.ndarray], names: list[str], lo: float, hi: float):
    """``{target: (clipped squared error of every candidate, rows)}`` in one distributed pass."""
    scored = src.mapInPandas(_clipped_sse(cands, names, lo, hi), "grp string, c int, sse double, n long")
    totals = scored.groupBy("grp", "c").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    out: dict[str, tuple] = {}
    for r in collect_small(totals, limit=sum(len(v) for v in cands.values())):
        sse, _ = out.setdefault(r["grp"], (np.zeros(len(cands[r["grp"]])), r["n"]))
        sse[r["c"]] = r["sse"]
    return out


def _active_gram(at: dict[str, np.ndarray], names: list[str], lo: float, hi: float):
    """Partial Gram statistics of the rows whose blend lies strictly inside the clipping range."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def inside():
            for pdf in batches:
                for grp, part in pdf.groupby("grp", sort=False):
                    if grp in at:
                        p = part[names].to_numpy(dtype=np.float64) @ at[grp]
                        yield part[(p > lo) & (p < hi)]
        yield from _partial_gram(inside())
    return run


def _clipped_sse(cands: dict[str, np.ndarray], names: list[str], lo: float, hi: float):
    """Per Arrow batch: clipped squared error of every candidate (X·Wᵀ with numpy), one row per candidate."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}
        cnt: dict[str, int] = {}
        for pdf in batches:
            for grp, part in pdf.groupby("grp", sort=False):
                if grp not in cands:
                    continue
                x = part[names].to_numpy(dtype=np.float64)
                err = np.clip(x @ cands[grp].T, lo, hi) - part["y"].to_numpy(dtype=np.float64)[:, None]
                acc[grp] = acc.get(grp, 0.0) + (err * err).sum(axis=0)
                cnt[grp] = cnt.get(grp, 0) + len(part)
        for grp, sse in acc.items():
            yield pd.DataFrame({"grp": grp, "c": np.arange(len(sse), dtype="int32"), "sse": sse,
                                "n": np.full(len(sse), cnt[grp], dtype="int64")})
    return run
