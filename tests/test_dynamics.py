"""Iterative estimators: gradients, recovered parameters, known values, and their queries on the smallest tables."""

import numpy as np
import pytest
from scenalyx.operators import dynamics as D
from scenalyx.operators import kernels as N


def _target(seed=0, n=300, k=3):
    x = np.random.default_rng(seed).multivariate_normal(np.zeros(k), 1e-4 * (np.eye(k) + 0.5), n)
    p = np.full(n, 1 / n)
    mean, cov = N.weighted_moments(x, p)
    return D.MomentTarget(np.vstack([mean, *(p @ (x - mean) ** j for j in (2, 3, 4))]), cov)


def test_moment_gradients():
    rng = np.random.default_rng(1)
    x, p, t = rng.normal(0, 0.02, (9, 3)), rng.dirichlet(np.full(9, 2.0)), _target()
    _, gx, gp = t.value_and_gradients(x, p)
    dx, dp = rng.normal(size=x.shape), rng.normal(size=9)
    h = 1e-7
    along_x = (t.value_and_gradients(x + h * dx, p)[0] - t.value_and_gradients(x - h * dx, p)[0]) / (2 * h)
    assert along_x == pytest.approx((gx * dx).sum(), rel=1e-5)
    # p @ d is no longer zero off the simplex, so only directions that keep the sum are held to the gradient
    dp -= dp.mean()
    along_p = (t.value_and_gradients(x, p + h * dp)[0] - t.value_and_gradients(x, p - h * dp)[0]) / (2 * h)
    assert along_p == pytest.approx(gp @ dp, rel=1e-5)


@pytest.mark.parametrize(("p_step", "x_step"), [("mirror", "joint"), ("projected", "joint"), ("mirror", "sequential"), ("mirror", "jacobi")])
def test_moment_matching_lowers_the_objective(p_step, x_step):
    t = _target()
    x = np.random.default_rng(2).normal(0, 0.03, (60, 3))
    first = t.value_and_gradients(x, np.full(60, 1 / 60))[0]
    out = D.Matching(t, 1e-6, p_step, x_step).run(x, np.full(60, 1 / 60), 40)
    assert out["f"] < 1e-2 * first and out["g"] >= out["f"] and out["p"].sum() == pytest.approx(1) and (out["p"] >= 0).all()
    assert all(b <= a + 1e-9 for a, b in zip(out["path"], out["path"][1:], strict=False)) and len(out["path"]) == out["rounds"] + 1
    assert out["stationary"] == (out["x_residual"] <= 1e-4 and out["p_residual"] <= 1e-4)
    with pytest.raises(ValueError):
        D.Matching(t, 1e-6, "other")


def test_dcc_fit_and_simulation():
    rng = np.random.default_rng(3)
    base, n = 0.6 * np.eye(3) + 0.4, 1500
    q, rows = base.copy(), []
    for _ in range(n):
        r = q / np.sqrt(np.outer(np.diag(q), np.diag(q)))
        z = np.linalg.cholesky(r) @ rng.standard_normal(3)
        rows.append(z)
        q = 0.12 * base + 0.08 * np.outer(z, z) + 0.8 * q
    fit = D.fit_dcc(0.01 * np.array(rows))
    assert fit["a"] == pytest.approx(0.08, abs=0.05) and 0.5 < fit["b"] < 0.95
    assert fit["df"] > 30  # the residuals are Gaussian
    sim = D.simulate_dcc(fit, np.full(3, 0.001), 8.0, 4000, 5, 1)
    assert sim.shape == (4000, 3)
    assert sim.mean(0) == pytest.approx(1.001**5 - 1, abs=2e-3)
    assert D.simulate_dcc(fit, np.zeros(3), 8.0, 4000, 10, 1).std() > sim.std()


def test_portfolios():
    rng = np.random.default_rng(4)
    x = rng.normal(0.002, 1, (300, 4)) * np.array([0.01, 0.02, 0.03, 0.04])
    p = np.full(300, 1 / 300)
    w, loss = D.min_cvar(x, p, 0.05, 0.4)
    assert w.sum() == pytest.approx(1) and w.max() <= 0.4 + 1e-9
    others = [D.tail_loss(N.capped_simplex(v, 0.4), x, p, 0.05)[0] for v in rng.dirichlet(np.ones(4), 3000)]
    assert loss <= min(others) + 1e-5
    mean, cov = N.weighted_moments(x + 0.003, p)
    v, value = D.max_sharpe(mean, cov, np.full(4, 0.25), ridge=0.0)
    tangent = np.linalg.solve(cov, mean)
    if (tangent > 0).all():
        assert v == pytest.approx(tangent / tangent.sum(), abs=1e-3)
    assert value <= -(mean.sum() / 4) / np.sqrt(cov.sum() / 16)


def test_tail_loss_of_thirds():
    # losses 6, 3, 0 of a third each: the worst half takes the first and half of the second
    loss, grad = D.tail_loss(np.ones(1), np.array([[0.0], [-6.0], [-3.0]]), np.full(3, 1 / 3), 0.5)
    assert loss == pytest.approx((6 / 3 + 3 / 6) / 0.5) and grad == pytest.approx([loss])


def test_min_cvar_meets_the_bound_of_all_vertices():
    """The exact optimum of two assets is at a kink: compare with a fine grid of weights."""
    rng = np.random.default_rng(9)
    x, p = rng.normal(0, 0.02, (40, 2)), rng.dirichlet(np.ones(40))
    w, loss = D.min_cvar(x, p, 0.1)
    grid = [D.tail_loss(np.array([a, 1 - a]), x, p, 0.1)[0] for a in np.linspace(0, 1, 20_001)]
    assert loss <= min(grid) + 1e-12 and loss == pytest.approx(min(grid), abs=1e-6)
    with pytest.raises(ValueError):
        D.min_cvar(x, p, 0.1, 0.4)


def test_elimination():
    rng = np.random.default_rng(5)
    losses = 0.1 + rng.normal(0, 0.05, (200, 1)) + rng.normal(0, 0.02, (200, 3)) + np.array([0, 0, 0.4])
    start = rng.integers(0, 197, (500, 50))
    drawn = losses[(start[:, :, None] + np.arange(4)).reshape(500, -1)].mean(1)
    out = D.eliminate(losses.mean(0), drawn)
    assert out[0][0] == 2 and out[0][2] < 0.05 and [r[2] for r in out] == sorted(r[2] for r in out) and out[-1][2] == 1


def test_elimination_takes_rounding_for_no_spread():
    mean = np.array([0.11, 0.12, 0.13])
    drawn = np.stack([mean, np.nextafter(mean, 1)]).repeat(100, 0)
    assert D.eliminate(mean, drawn) == [(0, 1, 1.0, 0.0), (1, 2, 1.0, 0.0), (2, 3, 1.0, 0.0)]
    # signed losses: means near zero say nothing of the rounding of their sums
    noisy = np.array([1e-16, -1e-16, 2e-16]) + 1e-15 * np.arange(-2, 3)[:, None] * [1, 2, -1]
    assert [r[2:] for r in D.eliminate(np.zeros(3), noisy, np.ones(3))] == [(1.0, 0.0)] * 3
    # a small spread that is none of rounding counts
    assert D.eliminate(mean, mean + 1e-9 * np.arange(-2, 3)[:, None] * [1, 2, -1])[0][0] == 2


def test_kolmogorov():
    # one observation: P(D >= d) = 2 (1 - d) for d over a half; tabled 5 % points
    assert D.kolmogorov_tail(0.7, 1) == pytest.approx(0.6)
    assert D.kolmogorov_tail(0.40925, 10) == pytest.approx(0.05, abs=1e-4)
    assert D.kolmogorov_tail(0.29408, 20) == pytest.approx(0.05, abs=1e-4)
    assert D.kolmogorov_tail(1.0, 9) == 0 and D.kolmogorov_tail(0.0, 9) == 1
    rng = np.random.default_rng(1)
    u = np.sort(rng.random((40_000, 19)), 1)
    d = np.maximum(np.arange(1, 20) / 19 - u, u - np.arange(19) / 19).max(1)
    assert D.kolmogorov_tail(0.2, 19) == pytest.approx((d >= 0.2).mean(), abs=0.01)


def test_scenario_sets(spark):
    """Drawn sets have the moments they were drawn with."""
    from scenalyx.plans import estimators as E

    sets = E.scenario_sets(spark, "/root/testdata/sf0.01")
    assert sorted(sets) == ["dcc_garch", "gaussian_terminal", "historical_weighted", "student_t_terminal"]
    of = {name: df.groupBy("asset").agg({"p": "sum", "x": "count"}).toPandas().set_index("asset") for name, df in sets.items()}
    assert all(np.allclose(f["sum(p)"], 1) for f in of.values()) and (of["gaussian_terminal"]["count(x)"] == 10_000).all()
    mean = {name: df.selectExpr("asset", "p * x as v").groupBy("asset").sum("v").toPandas().set_index("asset")["sum(v)"] for name, df in sets.items()}
    assert np.allclose(mean["dcc_garch"], mean["historical_weighted"].loc[mean["dcc_garch"].index], atol=1e-9)
    spread = sets["historical_weighted"].selectExpr("x * x as v", "p").selectExpr("sqrt(sum(p * v)) as s").first().s
    for name in ("gaussian_terminal", "student_t_terminal"):
        assert np.allclose(mean[name], mean["historical_weighted"].loc[mean[name].index], atol=5 * spread / 100)


@pytest.mark.parametrize("name", ["dcc_fit", "dcc_simulation", "moment_match_bcd", "moment_match_starts", "moment_match_histories", "max_sharpe", "min_cvar", "walk_forward_hrp", "sharpe_diff_bootstrap", "confidence_set", "ks_pvalues"])
def test_queries_run(spark, name):
    import __spark_entry__

    rows = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(rows) and not rows.isna().all().any()
    if name in ("max_sharpe", "min_cvar"):
        assert rows["weight"].max() <= 0.25 + 1e-9 and rows["weight"].sum() == pytest.approx(rows["model"].nunique() if "model" in rows else 1)
    if name == "dcc_simulation":
        assert rows["scenario"].nunique() == 10_000 and not rows.duplicated(["scenario", "asset"]).any()
    if name == "moment_match_bcd":
        one = rows.drop_duplicates("scenario")
        assert len(one) == 500 and one["p"].sum() == pytest.approx(1)
    if name == "moment_match_starts":
        assert rows["chosen"].sum() == 1 and len(rows) == 5
    if name == "moment_match_histories":
        assert rows["falls"].all() and rows.groupby("start").size().nunique() == 1
    if name == "walk_forward_hrp":
        assert np.allclose(rows.groupby("rebalance_date")["weight"].sum(), 1)
    if name == "confidence_set":
        assert rows.groupby("metric")["in_set"].any().all() and len(rows) == 9
