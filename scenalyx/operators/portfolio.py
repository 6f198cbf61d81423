"""Closed-form weights, rebalancing calendar and a window-based backtest.

Defined cases: assets without variance take the whole inverse-variance weight,
shared evenly; a flat ledger has no Sharpe ratio (null) and no drawdown; a return of
-1 or less ends a backtest with an error, as no weight can drift from nothing; a
schedule with dates outside the returns is an error; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, ship
from . import checks
from .moments import expanding_covariance
from .resampling import block_sums
from .scoring import expected_shortfall


def inverse_weights(var: Column, over) -> Column:
    """Weights in proportion to 1 / var; assets without variance share all of the weight."""
    none = F.sum((var <= 0).cast("int")).over(over)
    inv = F.try_divide(F.lit(1.0), F.when(var > 0, var))
    return F.when(none > 0, F.when(var <= 0, 1.0 / none).otherwise(0.0)).otherwise(inv / F.sum(inv).over(over))


def closed_form(rets: DataFrame) -> DataFrame:
    """(asset, equal, inverse_variance)."""
    v = rets.groupBy("asset").agg(F.var_pop("ret").alias("var"))
    w = Window.partitionBy()
    return v.select("asset", (1.0 / F.count(F.lit(1)).over(w)).alias("equal"), inverse_weights(F.col("var"), w).alias("inverse_variance"))


def calendar(rets: DataFrame) -> DataFrame:
    """First observed date of each quarter."""
    return rets.groupBy(F.trunc("date", "quarter").alias("quarter")).agg(F.min("date").alias("rebalance_date"))


#: From (rebalance_date, asset_i, asset_j, n, mean_i, mean_j, cov), each pair once, to (rebalance_date, asset, weight).
Estimator = Callable[[DataFrame], DataFrame]


def _variances(stats: DataFrame) -> DataFrame:
    return stats.where("asset_i = asset_j").select("rebalance_date", F.col("asset_i").alias("asset"), "n", F.col("cov").alias("var"))


def inverse_variance(stats: DataFrame) -> DataFrame:
    by_date = Window.partitionBy("rebalance_date")  # a row an asset
    return _variances(stats).select("rebalance_date", "asset", inverse_weights(F.col("var"), by_date).alias("weight"))


def equal_weight(stats: DataFrame) -> DataFrame:
    own = _variances(stats)
    return own.select("rebalance_date", "asset", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("rebalance_date"))).alias("weight"))


def hierarchical(stats: DataFrame) -> DataFrame:
    """Risk parity by bisection of the single-linkage tree: the covariances of a date, assets x assets numbers, are one group."""
    from .kernels import hierarchical_risk_parity

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["asset_i"]))
        at = {a: i for i, a in enumerate(names)}
        c = np.zeros((len(names), len(names)))
        for i, j, v in zip(pdf["asset_i"], pdf["asset_j"], pdf["cov"], strict=True):
            c[at[i], at[j]] = c[at[j], at[i]] = v
        return pd.DataFrame({"rebalance_date": pdf["rebalance_date"].iloc[0], "asset": names, "weight": hierarchical_risk_parity(c)})

    ship(stats.sparkSession)
    return stats.groupBy("rebalance_date").applyInPandas(run, "rebalance_date date, asset string, weight double")


def walk_forward(rets: DataFrame, rebalances: DataFrame, min_history: int = 250, estimator: Estimator = inverse_variance) -> DataFrame:
    """(rebalance_date, asset, n, var, weight): the estimator's weights from all earlier rows, merged period by period.

    A date before which any asset has fewer rows than ``min_history`` has no weights at all.
    """
    stats = expanding_covariance(rets, rebalances)
    ready = stats.groupBy("rebalance_date").agg(F.min("n").alias("least")).where(F.col("least") >= min_history)
    stats = cut(stats.join(ready.select("rebalance_date"), "rebalance_date"))
    return _variances(stats).join(estimator(stats), ["rebalance_date", "asset"]).select("rebalance_date", "asset", "n", "var", "weight")


def backtest(rets: DataFrame, schedule: DataFrame, cost_bps: float = 20.0) -> DataFrame:
    """(portfolio, date, turnover, cost, wealth) with drift between rebalances and costs before the day's return.

    No day-by-day loop: within a segment wealth grows by sum(w * prod(1 + r));
    drifted end weights give the next turnover; segments chain by cumulative products.
    """
    rets = checks.compoundable(rets)
    schedule = checks.scheduled(schedule.withColumn("date", F.col("rebalance_date")), rets, "date").drop("date")
    days = rets.select("date").distinct()
    marks = schedule.select("portfolio", "rebalance_date").distinct()
    ports = schedule.select("portfolio").distinct()
    seg_w = Window.partitionBy("portfolio").orderBy("date")
    seg = days.join(F.broadcast(ports)).join(marks.withColumn("date", F.col("rebalance_date")), ["portfolio", "date"], "left")
    seg = seg.withColumn("segment_start", F.last("rebalance_date", ignorenulls=True).over(seg_w)).where("segment_start is not null").select("portfolio", "date", "segment_start")
    w = schedule.select("portfolio", F.col("rebalance_date").alias("segment_start"), "asset", "weight")
    cell = seg.join(rets.select("date", "asset", "ret"), "date").join(w, ["portfolio", "segment_start", "asset"])
    grow = F.exp(F.sum(F.log1p("ret")).over(Window.partitionBy("portfolio", "segment_start", "asset").orderBy("date")))
    cell = cell.withColumn("value", F.col("weight") * grow)
    day = cell.groupBy("portfolio", "segment_start", "date").agg(F.sum("value").alias("growth"))
    last = Window.partitionBy("portfolio", "segment_start")
    ends = cell.withColumn("end", F.max("date").over(last)).where("date = end").groupBy("portfolio", "segment_start", "asset").agg(F.max("value").alias("value"))
    ends = ends.withColumn("drifted", F.col("value") / F.sum("value").over(last))
    by = Window.partitionBy("portfolio", "asset").orderBy("segment_start")
    n = F.count(F.lit(1)).over(Window.partitionBy("portfolio", "segment_start"))
    turn = w.join(ends.select("portfolio", "segment_start", "asset", "drifted"), ["portfolio", "segment_start", "asset"]).withColumn("before", F.coalesce(F.lag("drifted").over(by), 1.0 / n))
    turn = turn.groupBy("portfolio", "segment_start").agg((F.sum(F.abs(F.col("weight") - F.col("before"))) / 2).alias("turnover")).withColumn("cost", F.col("turnover") * (cost_bps / 10000.0))
    tops = day.groupBy("portfolio", "segment_start").agg(F.max_by("growth", "date").alias("g")).join(turn, ["portfolio", "segment_start"])
    chain = F.sum(F.log(F.col("g") * (1 - F.col("cost")))).over(Window.partitionBy("portfolio").orderBy("segment_start").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.withColumn("base", F.exp(F.coalesce(chain, F.lit(0.0))) * (1 - F.col("cost")))
    out = day.join(tops.select("portfolio", "segment_start", "turnover", "cost", "base"), ["portfolio", "segment_start"])
    first = F.col("date") == F.col("segment_start")
    return out.select("portfolio", "date", F.when(first, F.col("turnover")).otherwise(0.0).alias("turnover"), F.when(first, F.col("cost")).otherwise(0.0).alias("cost"), (F.col("base") * F.col("growth")).alias("wealth"))


def net_returns(ledger: DataFrame) -> DataFrame:
    """(portfolio, date, r, wealth, turnover) of a ledger whose wealth starts at 1."""
    w = Window.partitionBy("portfolio").orderBy("date")
    return ledger.select("portfolio", "date", (F.col("wealth") / F.coalesce(F.lag("wealth").over(w), F.lit(1.0)) - 1).alias("r"), "wealth", "turnover")


def metrics(ledger: DataFrame, per_year: float = 252.0) -> DataFrame:
    """Final wealth, annual growth and volatility, Sharpe ratio, drawdown (the initial wealth of 1 is not in it)."""
    w = Window.partitionBy("portfolio").orderBy("date")
    d = net_returns(ledger).withColumn("dd", F.col("wealth") / F.max("wealth").over(w) - 1)
    n, sd = F.count(F.lit(1)), F.stddev_samp("r")
    return d.groupBy("portfolio").agg(
        F.max_by("wealth", "date").alias("final_wealth"),
        (F.pow(F.max_by("wealth", "date"), F.lit(per_year) / n) - 1).alias("cagr"),
        (sd * per_year**0.5).alias("volatility"),
        (F.try_divide(F.avg("r"), F.when(sd > 1e-15, sd)) * per_year**0.5).alias("sharpe"),
        F.min("dd").alias("max_drawdown"),
        F.sum("turnover").alias("turnover"),
    )


def tail_mean(scen: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """(keys, lower_es) of (keys, date, p, x): the lower tail of mass alpha, with the fraction of the scenario that alpha cuts."""
    return expected_shortfall(scen, keys, alpha).withColumnRenamed("es", "lower_es")


def diagnostics(weights: DataFrame, scen: DataFrame, alpha: float = 0.05, risk_free: float = 0.0) -> DataFrame:
    """(model, portfolio, ...): eight figures of every portfolio (portfolio, asset, weight) under every scenario set (model, asset, date, p, x)."""
    held = weights.groupBy("portfolio").agg(F.sum(F.col("weight") * F.col("weight")).alias("herfindahl"), F.max("weight").alias("max_weight"))
    r = scen.join(weights, "asset").groupBy("model", "portfolio", "date").agg(F.max("p").alias("p"), F.sum(F.col("weight") * F.col("x")).alias("x"))
    over = Window.partitionBy("model", "portfolio")
    mean = F.sum(F.col("p") * F.col("x")).over(over)
    m = r.withColumn("mean", mean).groupBy("model", "portfolio").agg(F.max("mean").alias("expected_return"), F.sqrt(F.sum(F.col("p") * F.pow(F.col("x") - F.col("mean"), F.lit(2.0)))).alias("volatility"))
    m = m.join(tail_mean(r, ["model", "portfolio"], alpha), ["model", "portfolio"]).join(held, "portfolio")
    sharpe = (F.col("expected_return") - risk_free) / F.greatest("volatility", F.lit(1e-15))
    return m.select("model", "portfolio", "expected_return", "volatility", sharpe.alias("sharpe"), F.lit(risk_free).alias("risk_free_rate"), "lower_es", "herfindahl", (1 / F.col("herfindahl")).alias("effective_assets"), "max_weight")


def sharpe_bootstrap(returns: DataFrame, pairs: DataFrame, block: int, samples: int, seed: int, per_year: float = 252.0, level: float = 0.95) -> DataFrame:
    """(portfolio, design, benchmark, difference, ci_low, ci_high, pvalue): both series of a pair take the same blocks.

    ``returns`` is (portfolio, date, r), ``pairs`` (portfolio, design, benchmark). Block sums of r and r^2 come from
    running sums of each pair's series; percentile interval, add-one p-value of the distance from the observed difference.
    """
    a = returns.select("portfolio", "date", F.col("r").alias("a"))
    b = returns.select(F.col("portfolio").alias("benchmark"), "date", F.col("r").alias("b"))
    keys = ["portfolio", "design", "benchmark"]
    both = pairs.join(a, "portfolio").join(b, ["benchmark", "date"])
    moments = {"a1": F.col("a"), "a2": F.col("a") * F.col("a"), "b1": F.col("b"), "b2": F.col("b") * F.col("b")}

    def ratio(one: Column, two: Column) -> Column:
        mean = one / F.col("n")
        sd = F.sqrt(F.greatest((two - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
        return F.when(sd > 1e-12, F.try_divide(mean, F.when(sd > 1e-12, sd))).otherwise(0.0) * per_year**0.5

    difference = ratio(F.col("a1"), F.col("a2")) - ratio(F.col("b1"), F.col("b2"))
    seen = both.groupBy(*keys).agg(*(F.sum(v).alias(c) for c, v in moments.items()), F.count(F.lit(1)).alias("n")).select(*keys, difference.alias("seen"))
    draws = block_sums(both, keys, ["date"], moments, pairs.select(*keys).distinct().withColumn("block", F.lit(block)), keys, samples, seed, "sharpe", [])
    each = draws.select(*keys, difference.alias("d")).join(seen, keys)
    far = F.round(F.abs(F.col("d") - F.col("seen")), 9) >= F.round(F.abs("seen"), 9)
    return each.groupBy(*keys).agg(
        F.max("seen").alias("difference"),
        F.percentile("d", F.lit((1 - level) / 2)).alias("ci_low"),
        F.percentile("d", F.lit((1 + level) / 2)).alias("ci_high"),
        ((F.count_if(far) + 1) / (F.count(F.lit(1)) + 1)).alias("pvalue"),
    )
