"""Minimum expected shortfall by cutting planes, with losses and subgradients from sorted ranges.

The tail loss of weights is the largest of finitely many linear functions of them.
Each round takes the one that is largest at the point at hand from the scenarios, for
all models at once: portfolio values are summed by value and over sorted ranges
(``ordered``), which gives the value at risk and the mass below it; the mean of the
tail by asset is then one aggregate. A linear programme over the cuts so far gives the
next point and a bound, and a model is done where its bound meets its loss. The driver
sees one number an asset and round; scenarios stay where they are.

Defined cases: scenarios that tie at the value at risk share what of the tail is left;
a cap that no weights can keep is an error; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .kernels import capped_simplex, linear_programme
from .ordered import value_sums


def tail_losses(sets: DataFrame, weights: dict[str, np.ndarray], alpha: float) -> dict[str, tuple[float, np.ndarray]]:
    """Loss and subgradient of each model's weights; sets is (model, p, x array)."""
    spark = sets.sparkSession
    held = spark.createDataFrame([(m, [float(v) for v in w]) for m, w in weights.items()], "model string, w array<double>")  # a row a model
    value = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = cut(sets.join(F.broadcast(held), "model").select("model", "p", "x", value.alias("r")))
    sums = value_sums(rows, ["model"], "r", {"p": F.col("p")})
    at = sums.where(F.col("p_upto") >= alpha - 1e-12).groupBy("model").agg(F.min_by(F.struct("r", "p", "p_upto"), "r").alias("v"))
    at = at.select("model", F.col("v.r").alias("var"), F.greatest(F.lit(0.0), alpha - (F.col("v.p_upto") - F.col("v.p"))).alias("left"), F.col("v.p").alias("tied"))
    take = F.when(F.col("r") < F.col("var"), F.col("p")).when(F.col("r") == F.col("var"), F.col("p") * F.col("left") / F.col("tied")).otherwise(0.0)
    assets = len(next(iter(weights.values())))
    tail = rows.join(F.broadcast(at), "model").where(F.col("r") <= F.col("var")).withColumn("take", take)
    found = tail.groupBy("model").agg(F.sum(F.col("take") * F.col("r")).alias("loss"), F.array(*[F.sum(F.col("take") * F.col("x")[k]) for k in range(assets)]).alias("grad")).collect()
    return {r["model"]: (-r["loss"] / alpha, -np.array(r["grad"]) / alpha) for r in found}


def next_point(cuts: list[np.ndarray], cap: float) -> tuple[np.ndarray, float]:
    """Weights of least bound under the cuts, and the bound."""
    n, k = len(cuts[0]), len(cuts)
    # weights, their slacks to the cap, the level's two signs, the slacks of the cuts
    a = np.zeros((1 + n + k, 2 * n + 2 + k))
    a[0, :n] = 1
    a[1 : n + 1, :n] = a[1 : n + 1, n : 2 * n] = np.eye(n)
    a[n + 1 :] = np.hstack([np.array(cuts), np.zeros((k, n)), np.tile([-1.0, 1.0], (k, 1)), np.eye(k)])
    cost = np.r_[np.zeros(2 * n), 1.0, -1.0, np.zeros(k)]
    point = linear_programme(cost, a, np.r_[1.0, np.full(n, cap), np.zeros(k)])
    return point[:n], float(point[2 * n] - point[2 * n + 1])


def min_cvar(scen: DataFrame, alpha: float = 0.05, cap: float = 1.0, tol: float = 1e-8, rounds: int = 500) -> DataFrame:
    """(model, asset, weight, tail_loss, bound, rounds) of every set of scen (model, asset, date, p, x)."""
    spark = scen.sparkSession
    names = [r["asset"] for r in scen.select("asset").distinct().orderBy("asset").collect()]
    if names and cap * len(names) < 1 - 1e-12:
        raise ValueError("the cap is infeasible")
    row = F.transform(F.sort_array(F.collect_list(F.struct("asset", "x"))), lambda s: s["x"])
    sets = cut(scen.groupBy("model", "date").agg(F.first("p").alias("p"), row.alias("x")).select("model", "p", "x"))
    models = [r["model"] for r in sets.select("model").distinct().collect()]
    at = {m: capped_simplex(np.full(len(names), 1 / len(names)), cap) for m in models}
    best: dict[str, tuple[float, np.ndarray]] = {}
    cuts: dict[str, list[np.ndarray]] = {m: [] for m in models}
    done: dict[str, tuple[float, int]] = {}
    for k in range(1, rounds + 1):
        live = [m for m in models if m not in done]
        if not live:
            break
        for m, (loss, grad) in tail_losses(sets.where(F.col("model").isin(live)), {m: at[m] for m in live}, alpha).items():
            if m not in best or loss < best[m][0]:
                best[m] = (loss, at[m])
            cuts[m].append(grad)
            at[m], bound = next_point(cuts[m], cap)
            if best[m][0] - bound <= tol * max(1.0, abs(best[m][0])):
                done[m] = (bound, k)
    if len(done) < len(models):
        raise ArithmeticError("the cuts did not meet")
    out = [(m, a, float(w), best[m][0], *done[m]) for m in models for a, w in zip(names, best[m][1])]
    return spark.createDataFrame(out, "model string, asset string, weight double, tail_loss double, bound double, rounds int")
