"""Scans of variance and correlation recursions, and profile likelihoods, against the kernels that loop over days."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenalyx.functions.expr import log_gamma
from scenalyx.operators import dynamics, kernels, profile, recursions

POINTS = ((0.05, 0.85), (0.1, 0.5), (0.3, 0.69))


def shocks(seed, n):
    rng = np.random.default_rng(seed)
    e = np.empty(n)
    v = 1.0
    for t in range(n):
        e[t] = np.sqrt(v) * rng.normal()
        v = 0.1 + 0.15 * e[t] ** 2 + 0.75 * v
    return e - e.mean()


@pytest.fixture(scope="module")
def variance(spark):
    data = {"a": shocks(1, 400), "b": shocks(2, 130), None: shocks(3, 57), "flat": np.zeros(20)}
    rows = [(k, t, [float(v)]) for k, e in data.items() if k for t, v in enumerate(e)]
    return data, spark.createDataFrame(rows, "k string, date int, x array<double>").repartition(5)


def loss_of(e, a, b):
    v = kernels.garch_variance(e, a, b)
    return float(np.sum(np.log(v[:-1]) + e * e / v[:-1])), float(v[-1])


@pytest.mark.parametrize("block", [4096, 32])
def test_variance_likelihood(variance, monkeypatch, block):
    """Blocks of a series chain to the states of one long loop."""
    data, df = variance
    monkeypatch.setattr(recursions, "BLOCK", block)
    blocks, level = recursions.packed(df, ["k"]), recursions.mean_products(df, ["k"], 1)
    assert blocks.groupBy("k").count().agg(F.max("count")).first()[0] == (1 if block == 4096 else 13)
    points = level.withColumn("a", F.array(*[F.lit(a) for a, _ in POINTS])).withColumn("b", F.array(*[F.lit(b) for _, b in POINTS]))
    got = {(r.k, r.point): r for r in recursions.likelihood(blocks, points, ["k"]).collect()}
    for k in ("a", "b"):
        for g, (a, b) in enumerate(POINTS):
            loss, after = loss_of(data[k], a, b)
            assert (got[k, g].loss, got[k, g]["next"][0]) == (pytest.approx(loss, abs=1e-8), pytest.approx(after, abs=1e-12))
    assert got["flat", 0].loss is None
    one = level.withColumn("a", F.lit(0.1)).withColumn("b", F.lit(0.8))
    path = {(r.k, r.rn): r.state[0] for r in recursions.paths(blocks, one, ["k"]).collect()}
    for k in ("a", "b"):
        v = kernels.garch_variance(data[k], 0.1, 0.8)
        assert [path[k, t + 1] for t in range(len(data[k]))] == pytest.approx(v[:-1].tolist())


def test_variance_fit(variance):
    data, df = variance
    got = {r.k: r for r in recursions.fit(recursions.packed(df, ["k"]), recursions.mean_products(df, ["k"], 1), ["k"]).collect()}
    for k in ("a", "b"):
        a, b, _ = kernels.fit_garch(data[k])
        assert got[k].loss <= loss_of(data[k], a, b)[0] + 1e-6
        assert got[k].loss == pytest.approx(loss_of(data[k], a, b)[0], abs=1e-3)
        assert (got[k].a, got[k].b) == (pytest.approx(a, abs=2e-3), pytest.approx(b, abs=2e-3))


def test_correlation_fit(spark, monkeypatch):
    monkeypatch.setattr(recursions, "BLOCK", 64)
    rng = np.random.default_rng(4)
    q = np.eye(3)
    z = np.empty((300, 3))
    for t in range(300):
        sd = np.sqrt(np.diag(q))
        z[t] = np.linalg.cholesky(q / np.outer(sd, sd)) @ rng.normal(size=3)
        q = 0.05 * np.eye(3) + 0.15 * np.outer(z[t], z[t]) + 0.8 * q
    rows = spark.createDataFrame([(1, t, x.tolist()) for t, x in enumerate(z)], "k int, date int, x array<double>")
    level = recursions.mean_products(rows, ["k"], 3)
    blocks = recursions.packed(rows, ["k"])
    base = z.T @ z / len(z)
    for a, b in POINTS:
        c = dynamics._to_correlation(dynamics.correlation_path(z, a, b, base)[:-1])
        want = sum(np.linalg.slogdet(r)[1] + x @ np.linalg.solve(r, x) - x @ x for r, x in zip(c, z))
        one = level.withColumn("a", F.array(F.lit(a))).withColumn("b", F.array(F.lit(b)))
        assert recursions.likelihood(blocks, one, ["k"]).first().loss == pytest.approx(want, abs=1e-8)
    got, kernel = recursions.fit(blocks, level, ["k"]).first(), dynamics.fit_correlation(z)
    assert got.loss <= kernel["loss"] + 1e-6
    assert np.reshape(got["next"], (3, 3)) == pytest.approx(dynamics.correlation_path(z, got.a, got.b, base)[-1])


def test_profile_likelihood(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k, df in (("heavy", 5.0), ("light", 30.0)):
        x = rng.normal(size=(900, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]]) * np.sqrt((df - 2) / rng.chisquare(df, 900))[:, None]
        p = rng.dirichlet(np.full(900, 5.0))
        want[k] = kernels.fit_df(x, p)
        rows += [(k, float(a), b.tolist()) for a, b in zip(p, x)]
    got = profile.fit(spark.createDataFrame(rows, "k string, p double, x array<double>").repartition(4), ["k"], 3)
    for r in got.collect():
        own = want[r.k]
        assert (r.df, r.loglik, r.gain, r.at_bound) == (pytest.approx(own["df"], abs=5e-3), pytest.approx(own["loglik"], abs=1e-8), pytest.approx(own["gain"], abs=1e-8), own["at_bound"])


def test_log_gamma(spark):
    import math

    x = [1e-3, 0.5, 1.0, 2.5, 7.0, 33.3, 1e4]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-11) for r in rows)
    assert spark.range(1).select(log_gamma(F.lit(-1.0)).alias("g")).first().g is None
