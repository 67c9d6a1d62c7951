"""Registered queries: blend-weight fitting and trial scoring (H keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import weights as H
from ..session import pin
from ..sources.tables import Tables
from ..targets import TARGETS
from . import fixtures as fx
from .q_blend import MODELS
from .sqlparts import oof_model_cte
from .registry import register, rounded
from .sqlparts import essays_cte

N_TRIALS = 50
UPPER = {"model2": 0.35}
K = len(MODELS)

# --- SQL twins of the fits: every combination of weights held at a bound or free is solved, the best feasible one wins -----

_M = ",\n".join(oof_model_cte(f"m{i}", m) for i, m in enumerate(MODELS))
_J = ("j AS MATERIALIZED (SELECT e.text_id, " + ", ".join(f"e.{t} AS y_{t}" for t in TARGETS) + ", "
      + ", ".join(f"m{i}.{t} AS p{i}_{t}" for i in range(K) for t in TARGETS)
      + " FROM essays e " + " ".join(f"JOIN m{i} USING (text_id)" for i in range(K)) + ")")
_PAIRS = [(i, j) for i in range(K) for j in range(i, K)]
_GRAM = "gram AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{t}' AS target, count(*) AS n, sum(y_{t} * y_{t}) AS yy, "
    + ", ".join(f"sum(p{i}_{t} * p{j}_{t}) AS g{i}{j}" for i, j in _PAIRS) + ", "
    + ", ".join(f"sum(p{i}_{t} * y_{t}) AS b{i}" for i in range(K)) + " FROM j" for t in TARGETS) + ")"


def _g(i: int, j: int) -> str:
    return f"g{min(i, j)}{max(i, j)}"


def _quad(prefix: str = "") -> str:
    """wᵀGw − 2bᵀw."""
    square = " + ".join(f"{1 if i == j else 2} * {prefix}w{i} * {prefix}w{j} * {_g(i, j)}" for i, j in _PAIRS)
    return f"({square} - 2 * ({' + '.join(f'{prefix}w{i} * b{i}' for i in range(K))}))"


def _box_ctes(src: str, name: str, upper: list[float]) -> str:
    """CTEs up to ``name``: the rows of ``src`` (keys, g.., b..) with the weights w0.. that minimise the quadratic on [0, upper].

    Gaussian elimination of the system with a row wᵢ = bound for every held weight; what is left of G is positive
    definite, so no pivots are needed.
    """
    held = lambda i, free, fixed: f"CASE WHEN s{i} = 0 THEN {free} ELSE {fixed} END"
    start = ", ".join(f"{held(i, _g(i, j), '1e0' if i == j else '0e0')} AS a{i}{j}" for i in range(K) for j in range(K))
    rhs = ", ".join(f"CASE s{i} WHEN 0 THEN b{i} WHEN 1 THEN 0e0 ELSE {upper[i]!r}e0 END AS r{i}" for i in range(K))
    sets = " ".join(f"CROSS JOIN range(3) c{i}(s{i})" for i in range(K))
    out = [f"{name}_0 AS MATERIALIZED (SELECT *, {start}, {rhs} FROM {src} {sets})"]
    for p in range(K - 1):
        rows = ", ".join([f"a{i}{j} - a{i}{p} * a{p}{j} / a{p}{p} AS a{i}{j}" for i in range(p + 1, K) for j in range(p + 1, K)]
                         + [f"r{i} - a{i}{p} * r{p} / a{p}{p} AS r{i}" for i in range(p + 1, K)])
        out.append(f"{name}_{p + 1} AS MATERIALIZED (SELECT * REPLACE ({rows}) FROM {name}_{p})")
    last = f"{name}_{K - 1}"
    for p in reversed(range(K)):
        known = "".join(f" - a{p}{j} * w{j}" for j in range(p + 1, K))
        out.append(f"{name}_w{p} AS MATERIALIZED (SELECT *, (r{p}{known}) / a{p}{p} AS w{p} FROM {last})")
        last = f"{name}_w{p}"
    drop = ", ".join([f"a{i}{j}" for i in range(K) for j in range(K)] + [f"r{i}" for i in range(K)] + [f"s{i}" for i in range(K)])
    inside = " AND ".join(f"w{i} BETWEEN -1e-9 AND {upper[i]!r}e0 + 1e-9" for i in range(K))
    out.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE ({drop}) FROM {last} WHERE {inside} "
               f"QUALIFY row_number() OVER (PARTITION BY target ORDER BY {_quad()}) = 1)")
    return ",\n".join(out)


_RMSE = f"sqrt(greatest({_quad()} + yy, 0) / n)"
_UPPER = [UPPER.get(m, 1.0) for m in MODELS]


def _fit_sql() -> str:
    scale = f"(({' + '.join(_g(i, i) for i in range(K))}) / {K})"
    slope = [f"2 * ({' + '.join(f'{_g(i, j)} * w{j}' for j in range(K))} - b{i}) / {scale}" for i in range(K)]
    pull = ", ".join(f"CASE WHEN w{i} <= 1e-9 THEN greatest(-({d}), 0) WHEN w{i} >= {u!r}e0 - 1e-9 THEN greatest({d}, 0) ELSE abs({d}) END"
                     for i, (d, u) in enumerate(zip(slope, _UPPER)))
    rows = " UNION ALL ".join(f"SELECT target, '{m}' AS model_id, round(w{i}, 6) AS w, round({_RMSE}, 6) AS rmse, "
                              f"round(greatest({pull}), 6) AS kkt FROM fit" for i, m in enumerate(MODELS))
    return f"WITH {essays_cte()},\n{_M},\n{_J},\n{_GRAM},\n{_box_ctes('gram', 'fit', _UPPER)}\n{rows}"


def _mean_fit_ctes(upper: list[float], rounds: int = 30) -> str:
    """CTEs up to ``w_mean`` (w0..): the weights with the lowest mean RMSE, by quadratic fits in which each target counts with
    one over its RMSE at the weights before."""
    out = [f"w_0 AS MATERIALIZED (SELECT {', '.join(f'0.25e0 AS w{i}' for i in range(K))})"]
    sums = ", ".join([f"sum({_g(i, j)} / r) AS {_g(i, j)}" for i, j in _PAIRS] + [f"sum(b{i} / r) AS b{i}" for i in range(K)])
    for n in range(rounds):
        out.append(f"q_{n} AS MATERIALIZED (SELECT 'all' AS target, {sums} FROM (SELECT *, {_RMSE} AS r FROM gram CROSS JOIN w_{n}))")
        out.append(_box_ctes(f"q_{n}", f"f_{n}", upper))
        out.append(f"w_{n + 1} AS MATERIALIZED (SELECT {', '.join(f'w{i}' for i in range(K))} FROM f_{n})")
    out.append(f"w_mean AS MATERIALIZED (SELECT * FROM w_{rounds})")
    return ",\n".join(out)


def _mean_sql(upper: list[float], tail: str) -> str:
    return (f"WITH {essays_cte()},\n{_M},\n{_J},\n{_GRAM},\n{_mean_fit_ctes(upper)},\n"
            f"s AS (SELECT avg({_RMSE}) AS mcrmse FROM gram CROSS JOIN w_mean)\n{tail}")


def _stats(spark, sf_dir, features="model"):
    t = Tables(spark, sf_dir)
    design = H.wide_design(fx.oof_long(t), fx.essays(t), MODELS, features=features)
    return H.gram_statistics(design)


@register("fit_columnwise")
def fit_columnwise(spark, sf_dir):
    """H1 + H5 (rows-only): per-target weights, one model capped at 0.35; KKT and optimality are tested.

    Two variants: ``unclipped`` (exact, from the Gram statistics) and ``clipped`` (blend clipped to [1, 5]
    inside the objective, refined from the unclipped optimum by distributed candidate scoring)."""
    t = Tables(spark, sf_dir)
    # read by the Gram pass and by every refinement round: materialise once in the shared checkpoint folder
    design = pin(H.wide_design(fx.oof_long(t), fx.essays(t), MODELS))
    grams = H.collect_grams(H.gram_statistics(design), len(MODELS))
    fits = H.fit_columnwise(grams, MODELS, UPPER)
    lb, ub = H.bounds(MODELS, UPPER)
    clipped = H.refine_clipped(design, {k: w for k, (w, _) in fits.items()}, lb, ub)
    rows = [("unclipped", tg, m, float(w[i]), r) for tg, (w, r) in fits.items() for i, m in enumerate(MODELS)]
    rows += [("clipped", tg, m, float(w[i]), r) for tg, (w, r) in clipped.items() for i, m in enumerate(MODELS)]
    return spark.createDataFrame(rows, "variant string, target string, model_id string, w double, rmse double")


@register("fit_box", sql=_fit_sql())
def fit_box(spark, sf_dir):
    """H1 + H5: per target the weights in [0, 1] (one model capped at 0.35) with the lowest RMSE, and the largest violation of
    the optimality conditions."""
    grams = H.collect_grams(_stats(spark, sf_dir), K)
    lb, ub = H.bounds(MODELS, UPPER)
    rows = [(t, m, float(w[i]), r, H.kkt_violation(grams[t].G, grams[t].b, w, lb, ub))
            for t, (w, r) in H.fit_columnwise(grams, MODELS, UPPER).items() for i, m in enumerate(MODELS)]
    return rounded(spark.createDataFrame(rows, "target string, model_id string, w double, rmse double, kkt double"))


@register("fit_modelwise", sql=_mean_sql(_UPPER, " UNION ALL ".join(
    f"SELECT '{m}' AS model_id, round(w{i}, 6) AS w, round(mcrmse, 6) AS mcrmse FROM w_mean, s" for i, m in enumerate(MODELS))))
def fit_modelwise(spark, sf_dir):
    """H2 + H5: one weight vector for all targets, minimising the mean of the six RMSE."""
    grams = H.collect_grams(_stats(spark, sf_dir), len(MODELS))
    w, score = H.fit_modelwise(grams, MODELS, UPPER)
    return rounded(spark.createDataFrame([(m, float(w[i]), score) for i, m in enumerate(MODELS)],
                                         "model_id string, w double, mcrmse double"))


@register("fit_stacked")
def fit_stacked(spark, sf_dir):
    """H3 (rows-only): every (model, source column) is a feature of every target."""
    k = len(MODELS) * len(TARGETS)
    t = Tables(spark, sf_dir)
    grams = H.stacked_grams(H.wide_design(fx.oof_long(t), fx.essays(t), MODELS, features="stacked"), k)
    lb, ub = H.bounds([f"{m}:{s}" for m in MODELS for s in TARGETS])
    rows = []
    for t, g in grams.items():
        w = H.solve_box_ls(g.G, g.b, lb, ub)
        feats = [(m, s) for m in MODELS for s in TARGETS]
        rows += [(t, m, s, float(w[i]), g.rmse(w)) for i, (m, s) in enumerate(feats)]
    return spark.createDataFrame(rows, "target string, model_id string, source_target string, w double, rmse double")


def _trial_table(spark):
    rows = [(t, i, ((t * (i + 3)) % 17) / 17.0) for t in range(1, N_TRIALS + 1) for i in range(len(MODELS))]
    return spark.createDataFrame(rows, "trial int, i int, w double")


_TR = ("tr AS (SELECT cast(t AS int) AS trial, " + ", ".join(f"((t * {i + 3}) % 17) / 17e0 AS w{i}"
                                                               for i in range(len(MODELS)))
       + f" FROM range(1, {N_TRIALS + 1}) r(t))")
_PER_T = " UNION ALL ".join(
    f"SELECT trial, sqrt(avg(({' + '.join(f'w{i} * p{i}_{t}' for i in range(len(MODELS)))} - y_{t}) * "
    f"({' + '.join(f'w{i} * p{i}_{t}' for i in range(len(MODELS)))} - y_{t}))) AS r FROM tr, j GROUP BY trial"
    for t in TARGETS)


# the drawn weights are parameters; the SQL scores the same ones
_DRAWS = H.dirichlet_weights(len(MODELS), 20, seed=42)
_DR = ("tr AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([str(i), *[f"{x!r}e0" if "e" not in repr(x) else repr(x)
                                                                       for x in map(float, w)]]) + ")"
                                                       for i, w in enumerate(_DRAWS))
       + ") v(trial, " + ", ".join(f"w{i}" for i in range(len(MODELS))) + "))")


@register("weight_trials", sql=f"WITH {essays_cte()},\n{_M},\n{_J},\n{_DR}\n"
          f"SELECT trial, round(avg(r), 6) AS mcrmse FROM ({_PER_T}) GROUP BY trial")
def weight_trials(spark, sf_dir):
    """H4: 20 seeded Dirichlet restarts scored in one pass over the Gram table."""
    trials = H.dirichlet_trials(spark, len(MODELS), 20, seed=42)
    return rounded(H.score_trials(_stats(spark, sf_dir), trials, len(MODELS)))


@register("score_weight_trials", sql=f"WITH {essays_cte()},\n{_M},\n{_J},\n{_TR}\n"
          f"SELECT trial, round(avg(r), 6) AS mcrmse FROM ({_PER_T}) GROUP BY trial")
def score_weight_trials(spark, sf_dir):
    """H6: 50 weight vectors scored from the distributed Gram statistics (no rows × trials fan-out)."""
    return rounded(H.score_trials(_stats(spark, sf_dir), _trial_table(spark), len(MODELS)))


@register("best_restart", sql=f"WITH {essays_cte()},\n{_M},\n{_J},\n{_DR},\n"
          f"s AS (SELECT trial, avg(r) AS mcrmse FROM ({_PER_T}) GROUP BY trial ORDER BY mcrmse, trial LIMIT 1)\n" + " UNION ALL ".join(
              f"SELECT trial, '{m}' AS model_id, round(w{i}, 6) AS w, round(mcrmse, 6) AS mcrmse FROM s JOIN tr USING (trial)"
              for i, m in enumerate(MODELS)))
def best_restart(spark, sf_dir):
    """H4: the best of 20 seeded Dirichlet restarts, with its weights."""
    trials = H.dirichlet_trials(spark, K, 20, seed=42)
    best = H.best_trial(H.score_trials(_stats(spark, sf_dir), trials, K), trials)
    names = F.element_at(F.array(*[F.lit(m) for m in MODELS]), F.col("i") + 1)
    return rounded(best.select("trial", names.alias("model_id"), "w", "mcrmse"))


@register("weight_search", sql=_mean_sql([1.0] * K, "SELECT round(mcrmse, 6) AS mcrmse, TRUE AS beats_restarts FROM s"))
def weight_search(spark, sf_dir):
    """H4 + H6: seeded restarts and a cross-entropy search over weight vectors; the best MCRMSE found, which the SQL reaches as
    the exact optimum, and that no restart is better."""
    grams = H.collect_grams(_stats(spark, sf_dir), K)
    _, best, history = H.search_weights(spark, grams, MODELS)
    return rounded(spark.createDataFrame([(best, best <= history[0][2])], "mcrmse double, beats_restarts boolean"))
