"""Weight fits with certificates and the weight search, against exhaustive and dense solutions."""

from itertools import product

import numpy as np
import pytest

from quillspark.operators import weights as H


def exhaustive(G, b, lb, ub):
    """Lowest value over every choice of weights that are free or held at a bound."""
    best = np.inf
    for s in product((0, 1, 2), repeat=len(b)):
        s = np.array(s)
        w, free = np.where(s == 1, lb, ub).astype(float), s == 0
        if free.any():
            w[free] = np.linalg.lstsq(G[np.ix_(free, free)], b[free] - G[np.ix_(free, ~free)] @ w[~free], rcond=None)[0]
        if (w >= lb - 1e-9).all() and (w <= ub + 1e-9).all():
            best = min(best, w @ G @ w - 2 * b @ w)
    return best


def test_box_fit_equals_exhaustive_search():
    rng = np.random.default_rng(0)
    for trial in range(300):
        k, n = int(rng.integers(1, 6)), int(rng.integers(2, 30))
        x = rng.normal(size=(n, k)) * (10 ** rng.uniform(-3, 3) if trial % 3 else 1)
        if trial % 5 == 0 and k > 1:
            x[:, 1] = x[:, 0]                               # collinear models
        y = x @ rng.uniform(-1, 2, k) + 0.1 * rng.normal(size=n)
        lb, ub = np.zeros(k), rng.choice([1, 0.35, 0, 5], k)
        G, b = x.T @ x, x.T @ y
        w = H.solve_box_ls(G, b, lb, ub)
        best = exhaustive(G, b, lb, ub)
        assert ((w >= lb) & (w <= ub)).all() and w @ G @ w - 2 * b @ w <= best + 1e-8 * max(abs(best), 1)
        assert H.kkt_violation(G, b, w, lb, ub) <= H.KKT_TOL
    base = rng.normal(3, 1, 2000)
    x = base[:, None] + rng.normal(0, 0.3, (2000, 200))     # many alike models: more weights than any round limit of old
    w = H.solve_box_ls(x.T @ x, x.T @ base, np.zeros(200), np.ones(200))
    assert H.kkt_violation(x.T @ x, x.T @ base, w, np.zeros(200), np.ones(200)) <= H.KKT_TOL


def test_what_is_not_optimal_raises():
    G, b, lb, ub = np.eye(2), np.array([0.5, 0.5]), np.zeros(2), np.ones(2)
    assert H.certified(G, b, np.array([0.5, 0.5]), lb, ub) is not None
    with pytest.raises(H.NotOptimal):
        H.certified(G, b, np.array([0.5, 0.4]), lb, ub)
    with pytest.raises(H.NotOptimal):
        H.solve_box_ls(G * np.nan, b, lb, ub)
    with pytest.raises(ValueError):
        H.solve_box_ls(G, b, ub, lb)


def grams(seed, k=4, n=3000, exact=False):
    rng = np.random.default_rng(seed)
    out = {}
    for t in range(6):
        y = rng.integers(2, 11, n) / 2
        p = np.stack([y + rng.integers(-100, 101, n) * c for c in (0.010, 0.008, 0.006, 0.009)[:k]], axis=1)
        if exact and t == 0:
            p[:, 0] = y                                     # a model that meets a target exactly
        g = H.Gram(k, [])
        g.G, g.b, g.yy, g.n = p.T @ p, p.T @ y, float(y @ y), n
        out[f"t{t}"] = g
    return out


@pytest.mark.parametrize("exact", [False, True])
def test_modelwise_fit_meets_its_conditions(exact):
    gs = grams(1, exact=exact)
    models = list("abcd")
    w, score = H.fit_modelwise(gs, models, {"c": 0.2})
    lb, ub = H.bounds(models, {"c": 0.2})
    assert H.box_violation(H.mean_rmse_slope(list(gs.values()), w)[0], w, lb, ub) <= 1e-6 and w[2] == 0.2
    rng = np.random.default_rng(2)
    for scale in (1e-1, 1e-3, 1e-5):
        for _ in range(100):
            v = np.clip(w + rng.normal(scale=scale, size=4), lb, ub)
            assert np.mean([g.rmse(v) for g in gs.values()]) >= score - 1e-12


def test_search_is_repeatable_and_never_worse_than_restarts(spark):
    gs, models = grams(3), list("abcd")
    w, best, history = H.search_weights(spark, gs, models, n_trials=300, elite=15)
    old = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    again = H.search_weights(spark, gs, models, n_trials=300, elite=15)
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if old is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", old)
    assert (again[0] == w).all() and again[1:] == (best, history)
    score = lambda v: np.mean([g.rmse(v) for g in gs.values()])
    draws = H._proposals(42, 0, np.arange(300), np.full(4, 0.25), np.eye(4), np.zeros(4), np.ones(4))
    assert np.allclose(draws.sum(axis=1), 1) and best <= min(map(score, draws)) and abs(score(w) - best) < 1e-12
    assert abs(best - H.fit_modelwise(gs, models)[1]) < 1e-8
    assert [h[2] for h in history] == sorted((h[2] for h in history), reverse=True)
    capped = H.search_weights(spark, gs, models, {"c": 0.2}, n_trials=300, elite=15)
    assert capped[0][2] <= 0.2 and abs(capped[1] - H.fit_modelwise(gs, models, {"c": 0.2})[1]) < 1e-8
    with pytest.raises(H.NotOptimal):
        H.search_weights(spark, gs, models, n_trials=50, elite=10, most_rounds=2)


def test_best_trial_is_kept(spark):
    trials = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (2, 0, 0.5), (2, 1, 0.5), (3, 0, 0.2), (3, 1, 0.8)], "trial int, i int, w double")
    scored = spark.createDataFrame([(1, 0.7), (2, 0.3), (3, 0.3), (4, float("nan")), (5, None)], "trial int, mcrmse double")
    assert sorted(tuple(r) for r in H.best_trial(scored, trials).collect()) == [(2, 0, 0.5, 0.3), (2, 1, 0.5, 0.3)]
