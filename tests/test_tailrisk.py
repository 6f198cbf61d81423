"""Cutting planes over partitioned scenarios against the kernel that holds the set."""

import datetime

import numpy as np
import pytest
from scenalyx.operators import dynamics, tailrisk


def test_min_cvar(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    first = datetime.date(2000, 1, 1)
    for m, n in (("a", 150), ("b", 260)):
        x = np.round(rng.standard_t(5, (n, 4)) * [0.01, 0.02, 0.03, 0.02] + 0.001, 3)  # rounded: values tie
        p = rng.dirichlet(np.full(n, 3.0))
        want[m] = (dynamics.min_cvar(x, p, 0.1, 0.5), x, p)
        rows += [(m, a, first + datetime.timedelta(t), float(p[t]), float(x[t, k])) for t in range(n) for k, a in enumerate("wxyz")]
    scen = spark.createDataFrame(rows, "model string, asset string, date date, p double, x double").repartition(5)
    for r in tailrisk.min_cvar(scen, 0.1, 0.5).groupBy("model").agg({"tail_loss": "max", "bound": "max", "weight": "sum"}).collect():
        (_, loss), *_ = want[r["model"]]
        assert r["max(tail_loss)"] == pytest.approx(loss, abs=1e-7) and r["max(bound)"] == pytest.approx(loss, abs=1e-7)
        assert r["sum(weight)"] == pytest.approx(1)
    one = {m: np.full(4, 0.25) for m in want}
    sets = spark.createDataFrame([(m, float(p), row.tolist()) for m, (_, x, q) in want.items() for p, row in zip(q, x)], "model string, p double, x array<double>")
    for m, (loss, grad) in tailrisk.tail_losses(sets, one, 0.1).items():
        _, x, p = want[m]
        assert loss == pytest.approx(dynamics.tail_loss(one[m], x, p, 0.1)[0]) and grad @ one[m] == pytest.approx(loss)
    with pytest.raises(ValueError):
        tailrisk.min_cvar(scen, 0.1, 0.2)
    assert tailrisk.min_cvar(scen.where("false")).count() == 0
