"""Scenario sets as tables: draws from discrete distributions, support resampling, dispatch by name.

Draws come from keyed hashes, so any engine, any partitioning and any retry gives
the same rows.

Defined cases: probabilities need not sum to 1 (``normalised``); negative, missing
and all-zero ones are an error; a support of the wanted size or less is kept as it
is; unknown model names are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import uniform
from . import checks


def normalised(scen: DataFrame, keys: list[str]) -> DataFrame:
    """p of every scenario over the sum of its set."""
    checks.finite(scen, "p")
    if not scen.where("p < 0").isEmpty():
        raise ValueError("probabilities below 0")
    total = F.sum("p").over(Window.partitionBy(*keys))
    if not scen.groupBy(*keys).agg(F.sum("p").alias("s")).where("s <= 0").isEmpty():
        raise ValueError("probabilities that sum to 0")
    return scen.withColumn("p", F.col("p") / total)


def drawn(support: DataFrame, draws: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each draw (keys, u, ...) with the scenario of its set whose span of cumulative probability holds u.

    One sort of draws and scenarios together stands for the range join.
    """
    w = Window.partitionBy(*keys)
    upto = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("p").over(w)
    s = support.withColumn("u", F.coalesce(F.sum("p").over(upto), F.lit(0.0)) / total)
    own = [c for c in support.columns if c not in keys]
    extra = [c for c in draws.columns if c not in (*keys, "u")]
    marks = s.select(*keys, "u", F.lit(0).alias("is_draw"), F.struct(*own).alias("held"), F.lit(None).cast(draws.select(F.struct(*extra)).schema[0].dataType).alias("asked"))
    asks = draws.select(*keys, "u", F.lit(1).alias("is_draw"), F.lit(None).cast(s.select(F.struct(*own)).schema[0].dataType).alias("held"), F.struct(*extra).alias("asked"))
    both = marks.unionByName(asks)
    # a scenario without probability begins where the next one does, and gives way to it
    held = F.last("held", ignorenulls=True).over(w.orderBy("u", "is_draw", F.col(f"held.{order}")).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("held", held).where("is_draw = 1").select(*keys, "u", "asked.*", "held.*")


def resampled(support: DataFrame, size: int, seed: int, keys: list[str], order: str) -> DataFrame:
    """Sets of more than ``size`` scenarios (rows of one order value) drawn anew, with replacement, to that many of equal probability."""
    n = support.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    small, large = n.where(F.col("n") <= size).drop("n"), n.where(F.col("n") > size).drop("n")
    draws = large.select(*keys).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    draws = draws.withColumn("u", uniform(seed, "support", *[F.col(k) for k in keys], F.col("draw")))
    out = drawn(large, draws, keys, order).withColumn("p", F.lit(1.0 / size)).drop("u")
    return small.withColumn("draw", F.lit(None).cast("int")).unionByName(out.select(*small.columns, "draw"))


def dispatch(registry: dict, include: list[str], seed: int) -> dict[str, DataFrame]:
    """The scenario sets of the named models; the k-th model of the registry draws with seed + k."""
    unknown = sorted(set(include) - set(registry))
    if unknown:
        raise ValueError(f"models not known: {unknown}")
    return {name: make(seed + k) for k, (name, make) in enumerate(registry.items()) if name in include}


def resolved_df(mode: str, fixed: float | None, fitted) -> tuple[float, dict]:
    """Degrees of freedom by configuration, and where they come from; ``fitted`` gives the estimate's report when asked."""
    if mode not in ("mle", "fixed"):
        raise ValueError("the mode has to be mle or fixed")
    if mode == "fixed":
        if fixed is None or fixed <= 4:
            raise ValueError("degrees of freedom have to be over 4")
        return float(fixed), {"mode": "fixed", "df": float(fixed)}
    report = fitted()
    return report["df"], {"mode": "mle", **report}
