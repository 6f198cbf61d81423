"""Moment matching on a partitioned set against the kernel that holds it whole."""

import numpy as np
import pytest
from scenalyx.operators import dynamics, kernels, matching


def target_of(seed, n=4):
    rng = np.random.default_rng(seed)
    y = rng.standard_t(6, (600, n)) @ (np.eye(n) + 0.3) * 0.03
    p = rng.dirichlet(np.ones(600))
    mean, cov = kernels.weighted_moments(y, p)
    d = y - mean
    return dynamics.MomentTarget(np.vstack([mean, *(p @ d**k for k in (2, 3, 4))]), cov)


@pytest.fixture(scope="module")
def whole():
    target = target_of(1)
    rng = np.random.default_rng(2)
    return target, rng.dirichlet(np.ones(500)), kernels.gaussian(target.moments[0], target.cov, 500, 3)


@pytest.mark.parametrize("rows", [500, 64])
def test_values_and_residuals_equal_the_kernel(spark, whole, rows):
    target, p, x = whole
    own = dynamics.Matching(target, 1e-5)
    f, g, gx, gp = own.g(x, p)
    s = matching.Set(matching.blocks_of(spark, p, x, rows), target, 1e-5)
    assert (s.point.f, s.point.g) == (pytest.approx(f, rel=1e-9), pytest.approx(g, rel=1e-9))
    gradients = s.point.gradients(p, x)
    assert np.allclose(gradients[0], gx, rtol=1e-8, atol=1e-12) and np.allclose(gradients[1], gp, rtol=1e-8, atol=1e-12)
    assert s.residuals() == pytest.approx(own.residuals(x, p), rel=1e-8)


def test_steps_lower_the_objective(spark, whole):
    target, p, x = whole
    s = matching.Set(matching.blocks_of(spark, p, x, 128), target, 1e-5)
    start = s.point.g
    s.step_p(2)
    after_p = s.point.g
    taken = s.step_x(6)
    assert after_p < start and s.point.g < after_p and taken == 6
    # what the sums say is what the stored set has
    rows = s.scenarios_table(list("abcd")).orderBy("scenario", "asset").collect()
    q, y = np.array([r.p for r in rows[::4]]), np.array([r.x for r in rows]).reshape(-1, 4)
    assert q.sum() == pytest.approx(1) and len(q) == 500
    assert dynamics.Matching(target, 1e-5).g(y, q)[1] == pytest.approx(s.point.g, rel=1e-6)


def test_direction_equals_the_recursion_on_vectors():
    rng = np.random.default_rng(4)
    pairs = [(s := rng.normal(size=30), s * rng.uniform(0.5, 2, 30)) for _ in range(4)]
    g = rng.normal(size=30)
    basis = np.array([v for pair in pairs for v in pair] + [g])
    direction, stack = g.copy(), []
    for s, y in reversed(pairs):
        stack.append(s @ direction / (s @ y))
        direction -= stack[-1] * y
    s, y = pairs[-1]
    direction *= (s @ y) / (y @ y)
    for (s, y), w in zip(pairs, reversed(stack)):
        direction += s * (w - y @ direction / (s @ y))
    assert np.allclose(matching._two_loop(basis @ basis.T) @ basis, direction)


def test_a_million_scenarios(spark):
    """No block is held by the driver, and none is larger than its rows."""
    target = target_of(5)
    s = matching.Set(matching.started(spark, target, 1_000_000, 7), target)
    start = s.point.g
    assert s.scenarios == 1_000_000 and s.state.agg({"rows": "max"}).first()[0] == matching.ROWS
    s.step_p(1)
    s.step_x(2)
    assert s.point.g < start


def test_no_scenarios(spark):
    with pytest.raises(ValueError):
        matching.Set(spark.createDataFrame([], matching.STATE), target_of(6))
