"""Likelihoods of variance and correlation recursions by a scan over blocks of time.

A state follows s' = (1 - a - b) level + a u + b s, where u are products of the day's
values. Over a block this is one affine map, so a series needs no task of its own:
every block composes its map for all points (a, b) of a grid at once, the maps of a
series (one row a block) are chained, and every block is then scored from the state it
begins with. The losses of all series and points are one aggregate. A fit is a few
such aggregates, each on a finer grid about the best point of the one before; no value
of it passes the driver.

Variance: values e, u = e^2, loss sum(log s + e^2 / s). Correlation: values z of all
assets, u = z z', loss sum(log|R| + z' R^-1 z - z' z) with R the correlations of s.

Defined cases: a series without variance has a null loss; of points that are equally
good the one of the smaller persistence, then of the smaller share, is taken; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, ship
from .ordered import BLOCK, placed

#: States of this many days are held at a time.
DAYS = 256
#: Persistence and the share of news in it are searched in this range (fixed values), to this step.
LOW, HIGH, TOLERANCE = 1e-4, 0.999, 2e-5
FIRST, ZOOM = 12, 4


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_no, days, x) from (keys, date, x array): each series in blocks of consecutive dates, values day by day."""
    own = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    at = placed(rows.select(*keys, "date", "x"), keys, ["date"]).join(own, keys)
    # as many blocks as days in one, beyond a block's least size
    no = F.floor((F.col("rn") - 1) / F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("n"))))
    days = at.groupBy(*keys, no.alias("block_no")).agg(F.sort_array(F.collect_list(F.struct("rn", "x"))).alias("d"))
    return cut(days.select(*keys, "block_no", F.size("d").alias("days"), F.flatten(F.transform("d", lambda e: e["x"])).alias("x")))


def _products(x: np.ndarray) -> np.ndarray:
    """u of each day: x x' as a row."""
    return (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)


def _states(u: np.ndarray, level: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """States before each day, and after the last: (days + 1, points, width)."""
    out = np.empty((len(u) + 1, *start.shape))
    out[0] = start
    rest, a, b = ((1 - a - b)[:, None] * level), a[:, None], b[:, None]
    for t in range(len(u)):
        out[t + 1] = rest + a * u[t] + b * out[t]
    return out


def _loss(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Loss of each point over some days."""
    n = x.shape[1]
    if n == 1:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.log(s[:, :, 0]) + x * x / s[:, :, 0]).sum(0)
    q = s.reshape(*s.shape[:2], n, n)
    sd = np.sqrt(np.einsum("tgii->tgi", q))
    chol = np.linalg.cholesky(q / (sd[..., :, None] * sd[..., None, :]))
    u = np.linalg.solve(chol, np.broadcast_to(x[:, None, :, None], (*q.shape[:3], 1)))[..., 0]
    return (2 * np.log(np.einsum("tgii->tgi", chol)).sum(2) + (u * u).sum(2) - (x * x).sum(1)[:, None]).sum(0)


def _blocks(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, values, level, a, b) of each block of a batch."""
    for i, (days, x, level, a, b) in enumerate(zip(pdf["days"], pdf["x"], pdf["level"], pdf["a"], pdf["b"])):
        yield i, np.asarray(x, float).reshape(days, -1), np.asarray(level, float), np.asarray(a, float), np.asarray(b, float)


def _tails(keys: list[str]):
    """What each block adds to the state it begins with."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, x, level, a, b in _blocks(pdf):
                s = np.zeros((len(a), len(level)))
                for t in range(0, len(x), DAYS):
                    s = _states(_products(x[t : t + DAYS]), level, a, b, s)[-1]
                out.append(s.tobytes())
            yield pdf[[*keys, "block_no", "days"]].assign(b=pdf["b"], level=pdf["level"], tail=out)

    return fn


def _chained(keys: list[str]):
    """The state that every block of a series begins with; the first one's is the level."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_no")
        level, b = np.asarray(pdf["level"].iloc[0], float), np.asarray(pdf["b"].iloc[0], float)
        state, out = np.broadcast_to(level, (len(b), len(level))), []
        for days, tail in zip(pdf["days"], pdf["tail"]):
            out.append(state.tobytes())
            state = (b ** int(days))[:, None] * state + np.frombuffer(tail).reshape(len(b), -1)
        return pdf[[*keys, "block_no"]].assign(start=out)

    return fn


def _start(start: bytes | None, level: np.ndarray, points: int) -> np.ndarray:
    return np.broadcast_to(level, (points, len(level))) if start is None else np.frombuffer(start).reshape(points, -1)


def _scored(keys: list[str]):
    """Loss of every point over each block, and the state after it."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, x, level, a, b in _blocks(pdf):
                state, loss = _start(pdf["start"].iloc[i], level, len(a)), np.zeros(len(a))
                for t in range(0, len(x), DAYS):
                    s = _states(_products(x[t : t + DAYS]), level, a, b, state)
                    loss += _loss(x[t : t + DAYS], s[:-1])
                    state = s[-1]
                head = {k: [pdf[k].iloc[i]] * len(a) for k in (*keys, "block_no")}
                yield pd.DataFrame(head | {"point": np.arange(len(a)), "a": a, "b": b, "loss": np.where(np.isfinite(loss), loss, np.nan), "next": list(state)})

    return fn


def _paths(keys: list[str]):
    """State before every day of each block, for one point."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, x, level, a, b in _blocks(pdf):
                state = _start(pdf["start"].iloc[i], level, 1)
                for t in range(0, len(x), DAYS):
                    s = _states(_products(x[t : t + DAYS]), level, a, b, state)
                    state = s[-1]
                    head = {k: [pdf[k].iloc[i]] * (len(s) - 1) for k in (*keys, "block_no")}
                    yield pd.DataFrame(head | {"nth": np.arange(t, t + len(s) - 1), "state": list(s[:-1, 0])})

    return fn


def _fields(df: DataFrame, keys: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, t) for n, t in more)])


def _joined(blocks: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with their level, points and the state they begin with; points: (keys, level, a, b)."""
    ship(blocks.sparkSession)
    rows = blocks.join(points.select(*keys, "level", "a", "b"), keys)
    if not blocks.where("block_no > 0").limit(1).count():
        return rows.withColumn("start", F.lit(None).cast("binary"))
    doubles = T.ArrayType(T.DoubleType())
    tail = _fields(blocks, keys, ("block_no", T.LongType()), ("days", T.IntegerType()), ("b", doubles), ("level", doubles), ("tail", T.BinaryType()))
    start = _fields(blocks, keys, ("block_no", T.LongType()), ("start", T.BinaryType()))
    chained = rows.mapInPandas(_tails(keys), tail).groupBy(*keys).applyInPandas(_chained(keys), start)
    return rows.join(chained, [*keys, "block_no"])


def likelihood(blocks: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, point, a, b, loss, next): points is (keys, level, a array, b array), next the state after the last day."""
    doubles = T.ArrayType(T.DoubleType())
    schema = _fields(blocks, keys, ("block_no", T.LongType()), ("point", T.IntegerType()), ("a", T.DoubleType()), ("b", T.DoubleType()), ("loss", T.DoubleType()), ("next", doubles))
    each = _joined(blocks, points, keys).mapInPandas(_scored(keys), schema)
    loss = F.when(F.count("loss") == F.count(F.lit(1)), F.sum("loss"))
    return each.groupBy(*keys, "point").agg(F.max("a").alias("a"), F.max("b").alias("b"), loss.alias("loss"), F.max_by("next", "block_no").alias("next"))


def paths(blocks: DataFrame, point: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rn, state): the state before every day under each series' one point (keys, level, a, b)."""
    first = blocks.groupBy(*keys).agg(F.max("days").alias("size"))
    one = point.select(*keys, "level", F.array("a").alias("a"), F.array("b").alias("b"))
    schema = _fields(blocks, keys, ("block_no", T.LongType()), ("nth", T.LongType()), ("state", T.ArrayType(T.DoubleType())))
    out = _joined(blocks, one, keys).mapInPandas(_paths(keys), schema).join(first, keys)
    return out.select(*keys, (F.col("block_no") * F.col("size") + F.col("nth") + 1).alias("rn"), "state")


def _grid(total: Column, share: Column, step: Column) -> Column:
    """(total, share) points about a point."""
    inside = lambda c: F.least(F.greatest(c, F.lit(LOW)), F.lit(HIGH))
    around = F.sequence(F.lit(-ZOOM), F.lit(ZOOM))
    return F.flatten(F.transform(around, lambda i: F.transform(around, lambda j: F.struct(inside(total + i * step).alias("total"), inside(share + j * step).alias("share")))))


def fit(blocks: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, loss, next, level): the best point of each series by grids that close in on it.

    levels: (keys, level). A grid after the first reaches one step of the former grid to
    each side of its best point, in ``ZOOM`` steps.
    """
    width = (HIGH - LOW) / (FIRST - 1)
    axis = [LOW + k * width for k in range(FIRST)]
    every = F.array(*[F.struct(F.lit(t).alias("total"), F.lit(s).alias("share")) for t in axis for s in axis])
    best = levels.select(*keys, "level", every.alias("grid"))
    while True:
        points = best.select(*keys, "level", F.transform("grid", lambda g: g["total"] * g["share"]).alias("a"), F.transform("grid", lambda g: g["total"] * (1 - g["share"])).alias("b"))
        tried = likelihood(blocks, points, keys).join(best.select(*keys, "level", "grid"), keys).withColumn("at", F.element_at("grid", F.col("point") + 1))
        order = F.struct(F.coalesce("loss", F.lit(float("inf"))), F.col("at.total"), F.col("at.share"))
        found = cut(tried.groupBy(*keys).agg(F.min_by(F.struct("at", "a", "b", "loss", "next", "level"), order).alias("x")).select(*keys, "x.*"))
        if width <= TOLERANCE:
            return found.select(*keys, "a", "b", "loss", "next", "level")
        width /= ZOOM
        best = found.select(*keys, "level", _grid(F.col("at.total"), F.col("at.share"), F.lit(width)).alias("grid"))


def mean_products(rows: DataFrame, keys: list[str], assets: int) -> DataFrame:
    """(keys, level): mean of x x' of each series, row by row of the matrix."""
    cells = [F.avg(F.col("x")[i] * F.col("x")[j]) for i in range(assets) for j in range(assets)]
    return rows.groupBy(*keys).agg(F.array(*cells).alias("level"))
