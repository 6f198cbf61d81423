"""Degrees of freedom of Student's t by profile likelihood, with mean and covariance held.

Rows are (keys, p, x): a weight and the values of all assets. Their squared distances
under mean and covariance are made once; the likelihood of a grid of degrees is then
one aggregate for all keys, and a fit is a few of these, each on a finer grid about the
best point. What is known of a key is one row: its covariance, its grid, its best point.

Defined cases: a covariance that is not positive is repaired as by ``nearest_psd``;
rows without weight count nothing; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import log_gamma
from ..runtime import cut, ship
from .kernels import nearest_psd

#: Points of a grid, and the step at which a fit ends.
POINTS, TOLERANCE = 17, 1e-5


def _whitened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Inverse Cholesky factor, row by row, and the log-determinant of each key's covariance."""
    for pdf in batches:
        white, det = [], []
        for cov in pdf["cov"]:
            n = math.isqrt(len(cov))
            chol = np.linalg.cholesky(nearest_psd(np.asarray(cov, float).reshape(n, n)))
            white.append(np.linalg.inv(chol).ravel().tolist())
            det.append(2 * float(np.log(np.diag(chol)).sum()))
        yield pdf.drop(columns="cov").assign(white=white, log_det=det)


def distances(rows: DataFrame, keys: list[str], assets: int) -> DataFrame:
    """(keys, p, d2, log_det): weights sum to 1 in each key."""
    ship(rows.sparkSession)
    x, mean = F.col("x"), F.col("mean")
    own = rows.groupBy(*keys).agg(F.sum("p").alias("w"), F.array(*[F.sum(F.col("p") * x[i]) / F.sum("p") for i in range(assets)]).alias("mean"))
    both = rows.join(cut(own), keys)
    cells = [F.sum(F.col("p") / F.col("w") * (x[i] - mean[i]) * (x[j] - mean[j])) for i in range(assets) for j in range(assets)]
    cov = both.groupBy(*keys).agg(F.array(*cells).alias("cov"))
    doubles = T.StructField("white", T.ArrayType(T.DoubleType()))
    white = cov.mapInPandas(_whitened, T.StructType([*(rows.schema[k] for k in keys), doubles, T.StructField("log_det", T.DoubleType())]))
    z = [sum((F.col("white")[i * assets + j] * (x[j] - mean[j]) for j in range(1, i + 1)), F.col("white")[i * assets] * (x[0] - mean[0])) for i in range(assets)]
    return both.join(cut(white), keys).select(*keys, (F.col("p") / F.col("w")).alias("p"), sum((v * v for v in z[1:]), z[0] * z[0]).alias("d2"), "log_det")


def _constant(df: Column, assets: int) -> Column:
    return log_gamma((df + assets) / 2) - log_gamma(df / 2) - assets / 2 * F.log(math.pi * (df - 2)) - F.col("log_det") / 2


def likelihood(d: DataFrame, keys: list[str], assets: int, grids: DataFrame, points: int) -> DataFrame:
    """(keys, df, loglik) for each of the ``points`` degrees in grids (keys, dfs array)."""
    sums = [F.sum(F.col("p") * F.log1p(F.col("d2") / (F.col("dfs")[k] - 2))) for k in range(points)]
    g = d.join(grids, keys).groupBy(*keys).agg(F.max("log_det").alias("log_det"), F.first("dfs").alias("dfs"), F.array(*sums).alias("s"))
    one = g.select(*keys, "log_det", F.explode(F.arrays_zip("dfs", "s")).alias("e")).select(*keys, "log_det", F.col("e.dfs").alias("df"), F.col("e.s").alias("s"))
    return one.select(*keys, "df", (_constant(F.col("df"), assets) - (F.col("df") + assets) / 2 * F.col("s")).alias("loglik"))


def fit(rows: DataFrame, keys: list[str], assets: int, low: float = 4.05, high: float = 100.0) -> DataFrame:
    """(keys, df, loglik, gain, at_bound): the best degrees between the bounds, and what they gain over the upper one."""
    d = cut(distances(rows, keys, assets))
    # even steps of the logarithm first, as the likelihood is flat for many degrees
    first = [low * (high / low) ** (k / (POINTS - 1)) for k in range(POINTS)]
    grids = d.select(*keys).distinct().withColumn("dfs", F.array(*map(F.lit, first)))
    step, top = (high - low) * 0.25, None
    while True:
        tried = cut(likelihood(d, keys, assets, grids, POINTS))
        best = tried.groupBy(*keys).agg(F.max_by(F.struct("df", "loglik"), F.struct("loglik", -F.col("df"))).alias("x")).select(*keys, "x.df", "x.loglik")
        if top is None:
            top = tried.where(F.col("df") >= high - 1e-9).select(*keys, F.col("loglik").alias("top"))
        if step <= TOLERANCE:
            bound = (F.col("df") <= low + 1e-3) | (F.col("df") >= high - 1e-3)
            return best.join(top, keys).select(*keys, "df", "loglik", (F.col("loglik") - F.col("top")).alias("gain"), bound.alias("at_bound"))
        step = step / 4
        around = F.transform(F.sequence(F.lit(-(POINTS // 2)), F.lit(POINTS // 2)), lambda k: F.least(F.greatest(F.col("df") + k * step, F.lit(low)), F.lit(high)))
        grids = best.select(*keys, around.alias("dfs"))
