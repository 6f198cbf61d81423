"""Observed writes, merged co-moments, binned densities, and settings that change tables."""

import datetime
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenalyx import lineage, steps
from scenalyx.config import Settings
from scenalyx.operators import density, inference, moments, panel
from scenalyx.sources import sinks

SOURCE = "/root/testdata/sf0.01"


def days(n, first=datetime.date(2000, 1, 3)):
    return [first + datetime.timedelta(7 * k) for k in range(n)]


class Prices:
    """A source that counts how often its rows are read."""

    def __init__(self, rows, counter):
        self.rows, self.counter = rows, counter

    def prices(self, spark, grain):
        seen = self.counter

        @F.udf("double")
        def counted(x):
            seen.add(1)
            return x

        frame = spark.createDataFrame(self.rows, "date date, asset string, raw double")
        return frame.withColumn("raw", counted.asNondeterministic()("raw"))

    def tables(self):
        return []


def test_observed_write_publishes_only_what_holds(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    good = spark.range(10).toDF("x")
    with sinks.staged(good, target, {"small": F.col("x") < 10}) as stored:
        assert stored.count() == 10 and not (tmp_path / "t").exists()
    assert spark.read.parquet(target).count() == 10
    with pytest.raises(ValueError, match="small"):
        with sinks.staged(spark.range(20).toDF("x"), target, {"any": F.lit(True), "small": F.col("x") < 10}):
            raise AssertionError("a broken rule ends the write")
    with pytest.raises(ValueError, match="no rows"):
        with sinks.staged(good.where("false"), target, {}):
            pass
    with pytest.raises(RuntimeError):
        with sinks.staged(spark.range(3).toDF("x"), target, {}):
            raise RuntimeError("the block refuses")
    assert spark.read.parquet(target).count() == 10 and [p.name for p in Path(tmp_path).iterdir()] == ["t"]
    with sinks.staged(spark.range(3).toDF("x"), target, {}):
        pass
    assert spark.read.parquet(target).count() == 3


def test_download_reads_its_source_once(spark, tmp_path):
    rows = [(d, a, 1.0 + k) for k, d in enumerate(days(30)) for a in "ab"]
    seen = spark.sparkContext.accumulator(0)
    run = steps.Run(spark, f"file://{tmp_path}/run", Prices(rows, seen), Settings())
    steps.download(run)
    # fill lists dates and assets of the panel beside its rows
    assert run.read("prices").count() == 60 and seen.value <= 3 * 60
    bad = steps.Run(spark, f"file://{tmp_path}/bad", Prices([*rows[:-1], (*rows[-1][:2], -1.0)], seen), Settings())
    with pytest.raises(ValueError, match="prices over 0"):
        steps.download(bad)
    assert not (tmp_path / "bad" / "prices").exists()
    thin = steps.Run(spark, f"file://{tmp_path}/thin", Prices([(d, a, None if a == "b" and k % 3 else 1.0) for k, d in enumerate(days(30)) for a in "ab"], seen), Settings())
    with pytest.raises(ValueError, match="coverage"):
        steps.download(thin)
    assert not (tmp_path / "thin" / "prices").exists()


def test_json_is_replaced_in_one_rename(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    for k in range(3):
        lineage.write_json(spark, path, {"k": k})
        assert lineage.read_json(spark, path) == {"k": k}
    assert [p.name for p in Path(tmp_path).iterdir() if not p.name.endswith(".crc")] == ["m.json"]


def test_rows_between_the_samples_go(spark):
    """start_oos takes effect: what lies between the in-sample end and it belongs to neither part."""
    rows = [(d, a, 1.0 + 0.1 * k) for k, d in enumerate(days(20)) for a in "ab"]
    frame = spark.createDataFrame(rows, "date date, asset string, raw double").withColumn("price", F.col("raw"))
    split, begin = days(20)[8], days(20)[12]
    got = panel.returns(frame, str(split), begin=str(begin))
    assert {(r.date, r.segment) for r in got.collect()} == {(d, "is" if d <= split else "oos") for d in days(20)[1:] if d <= split or d >= begin}
    assert panel.returns(frame, str(split)).select("date").distinct().count() == 19


def test_half_life_changes_the_weights(spark):
    w = spark.createDataFrame([(d, "a", 0.1) for d in days(40)], "date date, asset string, tret double")
    for half_life in (5.0, 55.0):
        got = {r.date: r.p for r in moments.scenario_models(w, half_life=half_life).where("model = 'ewma'").collect()}
        assert got[days(40)[-1]] / got[days(40)[-6]] == pytest.approx(2 ** (5 / half_life))


def test_confidence_changes_intervals_and_rejections(spark):
    rng = np.random.default_rng(1)
    rows = [("mean_crps", m, d, float(rng.normal(k * 0.4, 1))) for d in days(120) for k, m in enumerate(("focal", "other"))]
    scores = spark.createDataFrame(rows, "metric string, model string, date date, score double")
    wide, narrow = (inference.focal_table(scores, "focal", ["other"], 400, 7, block=2, level=x).first() for x in (0.99, 0.5))
    assert wide.ci_low < narrow.ci_low < narrow.ci_high < wide.ci_high and wide.pvalue == narrow.pvalue
    assert (wide.reject, narrow.reject) == (wide.holm < 0.01, narrow.holm < 0.5)
    found = inference.sensitivity(scores, "focal", ["other"], 200, 7, (1, 3))
    assert sorted((r.requested, r.block) for r in found.collect()) == [(1, 1), (3, 3)]
    blocks = spark.createDataFrame([("mean_crps", 2)], "metric string, block int")
    sets = {r.model: r for r in inference.confidence_sets(scores.withColumn("fold", F.year("date")), blocks, 0.05, 400, 7, ["fold"]).collect()}
    assert sets["focal"].pvalue == 1.0 and sets["focal"].in_set and sets["other"].left_at == 1


def test_rounding_is_no_spread_of_a_confidence_set(spark):
    """A block as long as the series draws the observed means again: they differ by rounding alone, and no model leaves for that."""
    rng = np.random.default_rng(6)
    rows = [("energy", m, d, float(x)) for m in ("a", "b", "c") for d, x in zip(days(19), 0.1 + rng.normal(0, 0.03, 19))]
    scores = spark.createDataFrame(rows, "metric string, model string, date date, score double").repartition(3)
    for block, still in ((19, True), (2, False)):
        sizes = spark.createDataFrame([("energy", block)], "metric string, block int")
        got = inference.confidence_sets(scores, sizes, 0.1, 200, 7).orderBy("left_at").collect()
        assert [r.left_at for r in got] == [1, 2, 3] and all(r.statistic == 0 and r.pvalue == 1 and r.in_set for r in got) == still
        wide = scores.groupBy("model", "date").agg(F.first("score").alias("score"))
        pairs = inference.confidence_set_statistics(wide, "score", block, 200, 7).collect()
        assert len(pairs) == 3 and all((r.t is None) == still for r in pairs)


def test_expanding_covariance(spark):
    rng = np.random.default_rng(2)
    x = 1e4 + rng.normal(size=(60, 3))
    rows = [(d, a, float(x[k, j])) for k, d in enumerate(days(60)) for j, a in enumerate("abc")]
    marks = [days(60)[k] for k in (0, 1, 20, 21, 45)] + [days(60)[-1] + datetime.timedelta(1)]
    frame = spark.createDataFrame(rows, "date date, asset string, ret double").repartition(5)
    got = {(r.rebalance_date, r.asset_i, r.asset_j): r for r in moments.expanding_covariance(frame, spark.createDataFrame([(m,) for m in marks], "rebalance_date date")).collect()}
    assert len(got) == 5 * 6  # nothing precedes the first mark
    for (m, i, j), r in got.items():
        own = x[[d < m for d in days(60)]]
        a, b = "abc".index(i), "abc".index(j)
        assert r.n == len(own) and (r.mean_i, r.mean_j) == (pytest.approx(own[:, a].mean()), pytest.approx(own[:, b].mean()))
        assert r["cov"] == pytest.approx(np.cov(own[:, a], own[:, b], bias=True)[0, 1], abs=1e-9)


def test_density_is_close_to_the_sum_over_all_values(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=400), rng.uniform(0.5, 2, 400)
    rows = [("k", float(a), float(b)) for a, b in zip(x, w)] + [("k", None, 1.0), ("k", 9.0, 0.0), ("one", 2.0, 1.0), ("one", 2.0, 3.0)]
    got = density.density(spark.createDataFrame(rows, "k string, x double, w double"), ["k"], 400).orderBy("point").collect()
    p = w / w.sum()
    width = 0.3 * math.sqrt((p * (x - p @ x) ** 2).sum() / (1 - (p * p).sum()))
    for r in got:
        if r.k == "k":
            want = (p * np.exp(-(((r.x - x) / width) ** 2) / 2)).sum() / width / math.sqrt(2 * math.pi)
            assert r.density == pytest.approx(want, abs=2e-3)
        else:
            assert r.density is None
    assert len(got) == 800


def test_walk_forward_takes_an_estimator(spark):
    from scenalyx.operators import kernels, portfolio

    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3)) * [0.01, 0.02, 0.04]
    rows = [(d, a, float(x[k, j])) for k, d in enumerate(days(80)) for j, a in enumerate("abc")]
    frame = spark.createDataFrame(rows, "date date, asset string, ret double")
    marks = spark.createDataFrame([(days(80)[k],) for k in (10, 40, 79)], "rebalance_date date")
    for estimator, want in (
        (portfolio.inverse_variance, lambda c: (1 / np.diag(c)) / (1 / np.diag(c)).sum()),
        (portfolio.equal_weight, lambda c: np.full(3, 1 / 3)),
        (portfolio.hierarchical, kernels.hierarchical_risk_parity),
        (lambda stats: stats.where("asset_i = asset_j").select("rebalance_date", F.col("asset_i").alias("asset"), (F.col("asset_i") == "b").cast("double").alias("weight")), lambda c: np.array([0.0, 1.0, 0.0])),
    ):
        got = {(r.rebalance_date, r.asset): r for r in portfolio.walk_forward(frame, marks, 20, estimator).collect()}
        assert {d for d, _ in got} == {days(80)[40], days(80)[79]}  # ten rows are too few
        for k in (40, 79):
            w = want(np.cov(x[:k].T, bias=True))
            assert [got[days(80)[k], a].weight for a in "abc"] == pytest.approx(w.tolist())
            assert got[days(80)[k], "a"].n == k
    short = spark.createDataFrame([r for r in rows if r[1] != "c" or r[0] >= days(80)[30]], frame.schema)
    assert {r.rebalance_date for r in portfolio.walk_forward(short, marks, 20).collect()} == {days(80)[79]}  # one short history, no weights


def test_matching_takes_any_objective():
    from scenalyx.operators import dynamics

    class Mean:
        """Distance of the mean from 1."""

        def value_and_gradients(self, x, p):
            gap = p @ x - 1
            return float(gap @ gap), 2 * p[:, None] * gap, 2 * x @ gap

    rng = np.random.default_rng(1)
    out = dynamics.Matching(Mean(), 0.0).run(rng.normal(size=(50, 2)), np.full(50, 0.02), rounds=20)
    assert out["f"] < 1e-10 and out["p"].sum() == pytest.approx(1)


def test_environment_and_code(spark):
    found = lineage.environment(spark)
    assert found["spark"] == spark.version and set(found) == {"numpy", "pandas", "pyarrow", "python", "spark", "system"}
    assert lineage.code_fingerprint() == lineage.code_fingerprint() and len(lineage.code_fingerprint()) == 64
