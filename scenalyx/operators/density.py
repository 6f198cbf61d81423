"""Density estimates on a grid from binned values.

Values are dealt linearly to the two grid points beside them, which is one aggregate;
what is left are the grid's masses, and a Gaussian kernel of any width is a sum over
them. The work after the first aggregate does not grow with the rows.

Defined cases: a key without spread has all its mass at one point and a null density;
rows without weight or value count nothing; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Taps of the kernel reach this many widths to each side (fixed value); what is beyond is below 1e-13.
REACH = 8.0


def bins(values: DataFrame, keys: list[str], spans: DataFrame, points: int) -> DataFrame:
    """(keys, bin, mass): the weight of (keys, x, w) rows at each grid point of spans (keys, low, high)."""
    at = (F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * (points - 1)
    rows = values.where("x is not null and w > 0").join(spans.where("high > low"), keys).where("x between low and high").withColumn("at", at)
    left = F.least(F.floor("at"), F.lit(points - 2)).cast("int")
    share = F.col("at") - left
    sides = F.array(F.struct(left.alias("bin"), (F.col("w") * (1 - share)).alias("m")), F.struct((left + 1).alias("bin"), (F.col("w") * share).alias("m")))
    return rows.select(*keys, F.explode(sides).alias("e")).groupBy(*keys, F.col("e.bin").alias("bin")).agg(F.sum("e.m").alias("mass"))


def density(values: DataFrame, keys: list[str], points: int = 200, factor: float = 0.3) -> DataFrame:
    """(keys, point, x, density): a Gaussian kernel of ``factor`` standard deviations over the key's range of values.

    ``values`` is (keys, x, w). The standard deviation is the weighted one, unbiased for
    weights as of reliability, as usual for weighted estimates.
    """
    w, x = F.col("w"), F.col("x")
    live = values.where("x is not null and w > 0")
    mean = live.groupBy(*keys).agg((F.sum(w * x) / F.sum(w)).alias("mean"), F.sum(w).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum(w * w).alias("squares"))
    spread = live.join(mean, keys).groupBy(*keys).agg(F.sum(w * F.pow(x - F.col("mean"), F.lit(2.0))).alias("s"))
    own = mean.join(spread, keys).withColumn("sd", F.sqrt(F.try_divide(F.col("s") / F.col("total"), 1 - F.col("squares") / F.pow("total", F.lit(2.0)))))
    own = own.select(*keys, "low", "high", "total", (F.col("sd") * factor).alias("width"))
    step = (F.col("high") - F.col("low")) / (points - 1)
    masses = bins(values, keys, own.select(*keys, "low", "high"), points).join(own, keys)
    reach = F.least(F.ceil(F.lit(REACH) * F.col("width") / step), F.lit(points)).cast("int")
    low, high = F.greatest(F.col("bin") - reach, F.lit(0)), F.least(F.col("bin") + reach, F.lit(points - 1))
    spreaded = masses.withColumn("point", F.explode(F.sequence(low, high)))
    z = (F.col("point") - F.col("bin")) * step / F.col("width")
    kernel = F.exp(-z * z / 2) / (F.col("width") * math.sqrt(2 * math.pi))
    found = spreaded.groupBy(*keys, "point").agg(F.sum(F.col("mass") / F.col("total") * kernel).alias("density"))
    grid = own.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return grid.join(found, [*keys, "point"], "left").select(*keys, "point", (F.col("low") + F.col("point") * step).alias("x"), F.when(F.col("high") > F.col("low"), F.coalesce("density", F.lit(0.0))).alias("density"))
