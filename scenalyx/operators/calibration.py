"""Calibration of probability transforms: dispersion, reliability, and their summary by model.

Transforms are (model, asset, date, u) with u in [0, 1]. Defined cases: a bin without
a transform counts as empty; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(ratio: Column, tolerance: float = 0.05) -> Column:
    """Over 1: the forecast is too narrow."""
    return F.when(ratio > 1 + tolerance, "underdispersed").when(ratio < 1 - tolerance, "overdispersed").otherwise("calibrated")


def detail(pit: DataFrame, bins: int = 10) -> DataFrame:
    """Per model and asset: count, mean, variance, dispersion against the uniform, reliability index (distance of the histogram from flat)."""
    place = F.least(F.floor(F.round("u", 9) * bins), F.lit(bins - 1))
    share = [F.abs(F.count_if(place == k) / F.count(F.lit(1)) - 1.0 / bins) for k in range(bins)]
    g = pit.groupBy("model", "asset").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("u").alias("pit_mean"),
        F.var_pop("u").alias("pit_variance"),
        F.round(F.var_pop("u") * 12, 6).alias("ratio"),
        sum(share[1:], share[0]).alias("reliability"),
    )
    return g.withColumn("label", label(F.col("ratio")))


def summary(details: DataFrame) -> DataFrame:
    """Per model: means and medians over assets, and how many assets are of which kind."""
    kind = lambda name: F.count_if(F.col("label") == name).alias(name)
    return details.groupBy("model").agg(
        F.count(F.lit(1)).alias("assets"),
        # ratios have six digits: whole millionths add up alike in any order, and a mean halfway between two of them is that
        (F.sum(F.round(F.col("ratio") * 1e6)) / (F.count("ratio") * 1e6)).alias("mean_ratio"),
        F.median("ratio").alias("median_ratio"),
        F.avg("reliability").alias("mean_reliability"),
        kind("underdispersed"),
        kind("overdispersed"),
        kind("calibrated"),
        (F.sum(F.col("pit_mean") * F.col("n")) / F.sum("n")).alias("pooled_mean"),
    )
