"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(seed: int, stream: str, *keys: Column) -> Column:
    """Keyed hash 0 .. 2**32 - 1 that SQL engines evaluate alike: first 8 hex digits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    return hash32(seed, stream, *keys) / F.lit(4294967296.0)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """A double for comparison across engines; -0 becomes 0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


#: Degrees of freedom up to which the tail of Student's t is summed.
_SUMMED = 400


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t with whole degrees of freedom, as the finite sum over the angle atan(|t| / sqrt(df)).

    Beyond ``_SUMMED`` degrees the normal tail at a transformed t, whose error is below
    1e-10 there. Null where t is null or there is no degree of freedom.
    """
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.pow(F.cos(theta), F.lit(2.0))
    odd = F.pmod(df, F.lit(2)) == 1
    # terms of one parity only, the k-th from the one before
    count = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc, k):
        ratio = F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        term = acc["term"] * ratio * cos2
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    some = F.aggregate(F.when((count >= 1) & (df <= _SUMMED), F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, add, lambda a: a["sum"])
    within = F.when(df == 1, 2 / math.pi * theta).when(odd, 2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * some)).otherwise(F.sin(theta) * some)
    # The coefficients of Hill's normalising expansion (1970)
    n = F.greatest(df.cast("double"), F.lit(1.0))
    a = n - 0.5
    b, y = 48 * a * a, a * F.log1p(t * t / n)
    squared = y * F.pow(((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0, F.lit(2.0))
    return F.when(t.isNotNull() & (df > _SUMMED), chi2_tail(squared)).when(t.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), 1 - within))


def chi2_tail(x: Column) -> Column:
    """P(X >= x) of chi-squared with one degree of freedom: 1 - erf(sqrt(x / 2)) by its series of positive terms, beyond 9 by the tail's continued fraction.

    The fraction keeps the tail's own digits, so that small probabilities are no mere noise.
    """
    z = F.sqrt(F.greatest(x, F.lit(0.0)) / 2)
    start = F.struct(z.alias("term"), z.alias("sum"))

    def add(acc, k):
        term = acc["term"] * 2 * z * z / (2.0 * k + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, add, lambda a: a["sum"])
    w = F.greatest(z, F.lit(1.0))
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1)), w, lambda acc, k: w + k / 2.0 / acc)
    far = F.exp(-w * w) / (math.sqrt(math.pi) * fraction)
    return F.when(x > 9, far).otherwise(F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * total))


#: Coefficients of Stirling's series of log-gamma in 1 / x, 1 / x^3, ...
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x > 0, by Stirling's series at x + 8; null elsewhere."""
    y = x + 8
    series = F.lit(0.0)
    for k, c in enumerate(_STIRLING):
        series = series + c / F.pow(y, F.lit(2.0 * k + 1))
    shift = x
    for k in range(1, 8):
        shift = shift * (x + k)
    return F.when(x > 0, (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(shift))
