"""Weights, weighted moments, pair covariances, shrinkage, scenario sets.

Scenarios are (model, asset, date, p, x) with every asset on every date of a model.
Defined cases: a scenario without probability counts nothing; assets that are not
correlated at all shrink fully; equal (model, asset, date) rows count each; no rows
give no rows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE = 55.0


def ewma(windows: DataFrame, half_life: float = HALF_LIFE, keys: tuple[str, ...] = ()) -> DataFrame:
    """(date, p): weights that halve every ``half_life`` rows, newest heaviest, summing to 1."""
    dates = windows.select(*keys, "date").distinct()
    w = Window.partitionBy(*keys)
    lam = 0.5 ** (1.0 / half_life)
    age = F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy("date"))
    raw = dates.withColumn("u", F.pow(F.lit(lam), age.cast("double")))
    return raw.select(*keys, "date", (F.col("u") / F.sum("u").over(w)).alias("p"))


def scenario_models(windows: DataFrame, recent: int = 250, half_life: float = HALF_LIFE) -> DataFrame:
    """(model, asset, date, p, x) of three historical scenario sets over the same windows."""
    by_date = ewma(windows, half_life)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    nth = F.row_number().over(Window.orderBy(F.desc("date")))
    by_date = by_date.withColumn("n", n).withColumn("back", nth)
    weights = by_date.select(
        "date",
        F.explode(
            F.array(
                F.struct(F.lit("ewma").alias("model"), F.col("p").alias("p")),
                F.struct(F.lit("recent").alias("model"), F.when(F.col("back") <= recent, 1.0 / F.least(F.col("n"), F.lit(recent))).alias("p")),
                F.struct(F.lit("uniform").alias("model"), (F.lit(1.0) / F.col("n")).alias("p")),
            )
        ).alias("m"),
    ).select("date", "m.model", "m.p").where("p is not null")
    return windows.select("date", "asset", F.col("tret").alias("x")).join(weights, "date").select("model", "asset", "date", "p", "x")


def moments(scen: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean and central moments 2 to 4 in one pass over deviations."""
    mean = F.sum(F.col("p") * F.col("x")).over(Window.partitionBy(*keys))
    d = scen.withColumn("m1", mean).withColumn("d", F.col("x") - F.col("m1"))
    return d.groupBy(*keys).agg(F.max("m1").alias("m1"), *[F.sum(F.col("p") * F.pow("d", F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)])


def deviations(scen: DataFrame, keys: list[str]) -> DataFrame:
    return scen.withColumn("d", F.col("x") - F.sum(F.col("p") * F.col("x")).over(Window.partitionBy(*keys, "asset")))


def pairs(d: DataFrame, keys: list[str]) -> DataFrame:
    """Deviations of every pair asset_i <= asset_j on a date: rows of one date meet in one aggregate, not in a join."""
    vec = d.groupBy(*keys, "date").agg(F.first("p").alias("p"), F.sort_array(F.collect_list(F.struct("asset", "d"))).alias("v"))
    one = vec.select(*keys, "date", "p", "v", F.explode("v").alias("i"))
    two = one.select(*keys, "date", "p", "i", F.explode("v").alias("j")).where("i.asset <= j.asset")
    return two.select(*keys, "date", "p", F.col("i.asset").alias("asset_i"), F.col("j.asset").alias("asset_j"), F.col("i.d").alias("di"), F.col("j.d").alias("dj"))


def covariance(scen: DataFrame, keys: list[str]) -> DataFrame:
    return pairs(deviations(scen, keys), keys).groupBy(*keys, "asset_i", "asset_j").agg(F.sum(F.col("p") * F.col("di") * F.col("dj")).alias("value"))


def expanding_covariance(rets: DataFrame, marks: DataFrame) -> DataFrame:
    """(rebalance_date, asset_i, asset_j, n, mean_i, mean_j, cov): each pair over all dates before each of ``marks``.

    Dates are dealt to the periods between marks, each pair's (n, means, co-moment) of a
    period is one row, and the periods are merged from the first on: a row of returns is
    read once, whatever the number of marks. A pair without earlier dates has no row.
    """
    ends = [r["rebalance_date"] for r in marks.select("rebalance_date").distinct().orderBy("rebalance_date").collect()]  # one a rebalancing
    bounds = F.array(*[F.lit(d) for d in ends]).cast("array<date>")
    rows = rets.where(F.col("date") < F.lit(max(ends))) if ends else rets.where("false")
    # a period is named by the number of marks that are not after the date
    period = F.size(F.filter(bounds, lambda e: e <= F.col("date")))
    both = pairs(rows.select("date", "asset", F.lit(1.0).alias("p"), F.col("ret").alias("d")), [])
    one = both.groupBy("asset_i", "asset_j", period.alias("period")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("di").alias("mi"), F.avg("dj").alias("mj"), (F.covar_pop("di", "dj") * F.count(F.lit(1))).alias("c")
    )
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mi", "mj", "c")])

    def merge(a: Column, b: Column) -> Column:
        n, di, dj = a["n"] + b["n"], b["mi"] - a["mi"], b["mj"] - a["mj"]
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        return F.struct(n.alias("n"), (a["mi"] + di * share).alias("mi"), (a["mj"] + dj * share).alias("mj"), (a["c"] + b["c"] + di * dj * a["n"] * share).alias("c"))

    # a row a period: as many as rebalancings
    found = one.groupBy("asset_i", "asset_j").agg(F.collect_list(F.struct("period", "n", "mi", "mj", "c")).alias("s"))
    upto = lambda k: F.aggregate(F.filter("s", lambda x: x["period"] <= k), none, merge)
    nth = F.explode(F.sequence(F.lit(0), F.lit(max(len(ends) - 1, 0))))
    out = found.select("asset_i", "asset_j", "s", nth.alias("k")).select("asset_i", "asset_j", "k", upto(F.col("k")).alias("m")).where("m.n > 0")
    return out.select(F.get(bounds, F.col("k")).alias("rebalance_date"), "asset_i", "asset_j", F.col("m.n").cast("long").alias("n"), F.col("m.mi").alias("mean_i"), F.col("m.mj").alias("mean_j"), (F.col("m.c") / F.col("m.n")).alias("cov"))


def shrinkage(scen: DataFrame, keys: list[str]) -> DataFrame:
    """Ledoit-Wolf-type intensity: noise of the off-diagonal terms over their size, clipped to [0, 1]."""
    pr = pairs(deviations(scen, keys), keys).where("asset_i < asset_j")
    w = Window.partitionBy(*keys, "asset_i", "asset_j")
    pr = pr.withColumn("s", F.sum(F.col("p") * F.col("di") * F.col("dj")).over(w))
    per = pr.groupBy(*keys, "asset_i", "asset_j").agg(F.max("s").alias("s"), F.sum(F.col("p") * F.col("p") * F.pow(F.col("di") * F.col("dj") - F.col("s"), F.lit(2.0))).alias("noise"))
    tot = per.groupBy(*keys).agg(F.sum("noise").alias("noise"), F.sum(F.col("s") * F.col("s")).alias("signal"))
    return tot.select(*keys, F.when(F.col("signal") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("noise") / F.col("signal")))).alias("intensity"))


def shrunk(cov: DataFrame, intensity: DataFrame, keys: list[str]) -> DataFrame:
    return cov.join(intensity, keys).select(*keys, "asset_i", "asset_j", F.when(F.col("asset_i") == F.col("asset_j"), F.col("value")).otherwise(F.col("value") * (1 - F.col("intensity"))).alias("value"))


def concentration(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Effective size, entropy, divergence from uniform and Gini of the scenario probabilities."""
    w = Window.partitionBy(*keys)
    cum = F.sum("p").over(w.orderBy("p", "date").rowsBetween(Window.unboundedPreceding, 0))
    d = weights.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("cum", cum)
    return d.groupBy(*keys).agg(
        (1 / F.sum(F.col("p") * F.col("p"))).alias("ess"),
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("entropy"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") * F.col("n"))).otherwise(0.0)).alias("kl"),
        (1 + 1 / F.max("n").cast("double") - 2 * F.avg("cum")).alias("gini"),
    )
