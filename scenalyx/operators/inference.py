"""Autocovariance, long-run variance, block lengths, Diebold-Mariano, block bootstrap, Holm, confidence sets.

A contrast is named by ``keys`` (such as benchmark, or metric and benchmark); its
observations are ordered by date, within the segments (folds) of ``within`` where
these are given. Every contrast is a group of one plan, so tables of many contrasts
cost one pass.

Defined cases: a constant series has block length 1, no long-run variance, and null
statistics; a segment of one observation takes part in means, and has no
autocovariance of lag 1 and more; no rows give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import hash32, t_two_sided
from ..runtime import cut, ship
from . import checks
from .ordered import BLOCK, haloed, placed
from .resampling import BUCKET, block_sums


def paired(scores: DataFrame, focal: str, metric: str) -> DataFrame:
    """(benchmark, date, diff): focal minus benchmark on the same observation; unpaired ones are an error."""
    models = [r["model"] for r in scores.select("model").distinct().collect()]
    scores = checks.complete_pairs(scores, models, ["date"])
    a = scores.where(F.col("model") == focal).select("date", F.col(metric).alias("a"))
    b = scores.where(F.col("model") != focal).select("date", F.col("model").alias("benchmark"), F.col(metric).alias("b"))
    return b.join(a, "date").select("benchmark", "date", (F.col("a") - F.col("b")).alias("diff"))


def auto_lag(n: Column) -> Column:
    """floor(4 (n / 100)^(2/9))."""
    return F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int")


def segments(diff: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """(keys, within, own, total): rows and sum of every segment."""
    return diff.groupBy(*keys, *(within or [])).agg(F.count(F.lit(1)).alias("own"), F.sum("diff").alias("total"))


def contrasts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, shortest) of segments: rows, mean, and rows of the shortest segment."""
    return parts.groupBy(*keys).agg(F.sum("own").alias("n"), (F.sum("total") / F.sum("own")).alias("mean"), F.min("own").alias("shortest"))


#: Lags beyond which products are taken by a transform, in n log n.
FEW_LAGS = 48


def lagged_products(c: np.ndarray, own: int, lags: int) -> np.ndarray:
    """Sums of c[t] c[t + lag] over the first ``own`` places t, for lags 0 to ``lags``; c goes on behind them."""
    if lags <= FEW_LAGS:
        return np.array([c[: max(0, min(own, len(c) - k))] @ c[k : k + own] for k in range(lags + 1)])
    size = 1 << (len(c) + own).bit_length()
    both = np.fft.irfft(np.conj(np.fft.rfft(c[:own], size)) * np.fft.rfft(c, size), size)
    out = np.zeros(lags + 1)
    out[: len(c)] = both[: min(lags + 1, len(c))]
    return out


def _block_products(keys: list[str]):
    def fn(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rn")
        lags = int(block["lags"].iloc[0])
        found = lagged_products(block["diff"].to_numpy() - block["mean"].iloc[0], int(block["own"].sum()), lags)
        return pd.DataFrame({k: [block[k].iloc[0]] * (lags + 1) for k in keys} | {"lag": np.arange(lags + 1), "s": found})

    return fn


def autocovariance(diff: DataFrame, keys: list[str], lags: int | Column, within: list[str] | None = None) -> DataFrame:
    """(keys, lag, acov, n, mean, shortest): products never cross the segments of ``within``; centred on the contrast's mean.

    ``lags`` may depend on n and shortest. A segment is dealt into blocks of consecutive
    rows, at least four times as long as the lags reach, that each know the first rows
    of the next; a block makes the products of all lags at once. So rows are shuffled
    in proportion to n, whatever the lags.
    """
    seg = [*keys, *(within or [])]
    parts = segments(diff, keys, within)
    # segments of one observation have no dependence to show
    parts = cut(parts.where("own > 1") if within else parts)
    last = F.lit(lags) if isinstance(lags, int) else lags
    stats = cut(contrasts(parts, keys).withColumn("lags", F.greatest(last, F.lit(0)).cast("int")))
    rows = diff.select(*seg, "date", F.col("diff").cast("double").alias("diff")).join(parts.select(*seg), seg, "left_semi")
    rows = placed(rows, seg, ["date"]).join(stats.select(*keys, "mean", "lags"), keys)
    blocks = haloed(rows, seg, "rn", F.greatest(F.lit(BLOCK), 4 * F.col("lags")), F.col("lags"))
    ship(diff.sparkSession)
    schema = T.StructType([*(diff.schema[k] for k in keys), T.StructField("lag", T.IntegerType()), T.StructField("s", T.DoubleType())])
    sums = blocks.groupBy(*seg, "block_no").applyInPandas(_block_products(keys), schema).groupBy(*keys, "lag").agg(F.sum("s").alias("s"))
    return sums.join(stats, keys).select(*keys, "lag", (F.col("s") / F.col("n")).alias("acov"), "n", "mean", "shortest")


def newey_west(diff: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """(keys, bw, n, mean, lrv): Bartlett-weighted long-run variance, at the automatic lag or what the shortest segment has."""
    bw = F.least(auto_lag(F.col("n")), F.col("shortest").cast("int") - 1)
    d = autocovariance(diff, keys, bw, within).withColumn("bw", F.greatest(bw, F.lit(0)))
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (F.col("bw") + 1.0)))
    return d.groupBy(*keys).agg(F.greatest(F.sum(weight * F.col("acov")), F.lit(0.0)).alias("lrv"), F.max("bw").alias("bw"), F.max("n").alias("n"), F.max("mean").alias("mean"))


def diebold_mariano(nw: DataFrame) -> DataFrame:
    """dm, pvalue: the statistic with the small-sample factor of horizon lag + 1, against t of n - 1 degrees; null where the variance is not positive."""
    n, h = F.col("n").cast("double"), F.col("bw").cast("double") + 1
    factor = F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(1e-12)))
    # rounding leaves a constant series some 1e-34 of variance
    out = nw.withColumn("degenerate", F.col("lrv") <= 1e-24 * F.greatest(F.col("mean") * F.col("mean"), F.lit(1e-12)))
    out = out.withColumn("dm", F.when(~F.col("degenerate"), F.col("mean") / F.sqrt(F.col("lrv") / n) * factor))
    return out.withColumn("pvalue", F.when(F.col("dm").isNotNull(), t_two_sided(F.col("dm"), F.col("n") - 1)))


def block_length(diff: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """(keys, m, bandwidth, raw, block, capped): Politis and White's automatic block length from a flat-top kernel.

    The first run of small autocorrelations (six within the noise band, fewer at the end of the search) gives the
    bandwidth; the length is capped by the shortest segment. Series of under four observations have null lengths.
    """
    search = F.greatest(F.least(F.col("shortest") - 1, F.greatest(F.lit(5), F.ceil(F.sqrt("n"))) + 10), F.lit(1)).cast("int")
    a = autocovariance(diff, keys, search, within).withColumn("search", search)
    by = Window.partitionBy(*keys).orderBy("lag")
    a = a.withColumn("at0", F.max(F.when(F.col("lag") == 0, F.col("acov"))).over(Window.partitionBy(*keys)))
    band = 2 * F.sqrt(F.log10("n") / F.col("n"))
    small = (F.abs(F.try_divide(F.col("acov"), F.col("at0"))) < band).cast("int")
    a = a.withColumn("small", small).withColumn("calm", F.min("small").over(by.rowsBetween(0, 5)))
    first = F.min(F.when((F.col("lag") >= 1) & (F.col("calm") == 1), F.col("lag"))).over(Window.partitionBy(*keys))
    a = a.withColumn("m", F.greatest(F.coalesce(first - 1, F.col("search")), F.lit(1))).withColumn("bandwidth", F.least(2 * F.col("m"), F.col("search")))
    share = F.col("lag") / F.col("bandwidth").cast("double")
    taper = F.when(F.col("lag") > F.col("bandwidth"), 0.0).when(share <= 0.5, 1.0).otherwise(2 * (1 - share))
    twice = F.when(F.col("lag") == 0, 1.0).otherwise(2.0)
    g = a.groupBy(*keys).agg(
        *(F.max(c).alias(c) for c in ("n", "m", "bandwidth", "shortest", "at0")),
        F.sum(2 * taper * F.col("lag") * F.col("acov")).alias("g"),
        F.sum(twice * taper * F.col("acov")).alias("level"),
        F.max(F.abs("mean")).alias("size"),
    )
    flat = F.col("at0") <= F.pow(1e-12 * F.greatest(F.col("size"), F.lit(1.0)), F.lit(2.0))
    d = 4.0 / 3.0 * F.col("level") * F.col("level")
    raw = F.when(flat | (d <= 0) | (F.col("g") == 0), 1.0).otherwise(F.pow(F.try_divide(2 * F.col("g") * F.col("g"), d), F.lit(1.0 / 3.0)) * F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0)))
    g = g.withColumn("raw", F.when(F.col("n") >= 4, raw))
    # a hair below the next whole number counts as that number in every engine
    block = F.least(F.greatest(F.ceil(F.round("raw", 9)), F.lit(1)), F.col("shortest")).cast("int")
    return g.select(*keys, "n", "m", "bandwidth", "raw", block.alias("block"), (F.col("raw") > F.col("shortest")).alias("capped"))


def resolved_blocks(diff: DataFrame, keys: list[str], within: list[str] | None = None, fixed: int | None = None, fallback: int = 4) -> DataFrame:
    """(keys, block, automatic, capped): the automatic length, or a fixed one; at most the shortest segment.

    Series too short for the automatic rule take the fallback.
    """
    if fixed is not None:
        size = contrasts(segments(diff, keys, within), keys)
        block = F.least(F.lit(max(1, fixed)), F.col("shortest")).cast("int")
        return size.select(*keys, block.alias("block"), F.lit(None).cast("double").alias("raw"), F.lit(False).alias("capped"))
    found = block_length(diff, keys, within)
    return found.select(*keys, F.coalesce("block", F.least(F.lit(fallback), F.col("n").cast("int"))).alias("block"), "raw", F.coalesce("capped", F.lit(False)).alias("capped"))


def block_starts(diff: DataFrame, keys: list[str], blocks: DataFrame, samples: int, seed: int, within: list[str] | None = None, stream: list[str] | None = None) -> DataFrame:
    """(keys, within, sample, block, start, take): the rows that a moving-block bootstrap takes, as spans of places in a segment."""
    seg = [*keys, *(within or [])]
    n = diff.groupBy(*seg).agg(F.count(F.lit(1)).cast("int").alias("n")).join(blocks.select(*keys, F.col("block").alias("size")), keys)
    n = n.withColumn("size", F.greatest(F.least("size", "n"), F.lit(1))).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    each = n.withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.col("size")) - 1).cast("int"))))
    tag = [F.col(k).cast("string") for k in [*(stream or []), *(within or [])]]
    start = F.pmod(hash32(seed, "block", *tag, F.col("sample"), F.col("block")), F.col("n") - F.col("size") + 1)
    return each.select(*seg, "sample", "block", start.alias("start"), F.least(F.col("size"), F.col("n") - F.col("block") * F.col("size")).alias("take"))


def block_means(diff: DataFrame, keys: list[str], blocks: DataFrame, samples: int, seed: int, within: list[str] | None = None, stream: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """(keys, sample, mean) of a moving-block bootstrap in which blocks stay in their segments, and segments keep their lengths.

    Blocks are summed by look-ups in running sums (see ``resampling``), so what grows
    with samples x blocks is never a table. ``stream`` names the keys that draw apart from one another.
    """
    seg = [*keys, *(within or [])]
    sums = block_sums(diff, seg, ["date"], {"sum": F.col("diff")}, blocks, keys, samples, seed, "block", [*(stream or []), *(within or [])], bucket)
    return sums.groupBy(*keys, "sample").agg((F.sum("sum") / F.sum("n")).alias("mean"))


def bootstrap_ci(diff: DataFrame, means: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """Basic (reflected) interval, median, add-one two-sided p-value from twice the smaller tail of the centred means,
    and the share of samples in which the focal model wins."""
    obs = diff.groupBy(*keys).agg(F.avg("diff").alias("mean_diff"))
    m = means.join(obs, keys)
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    null, seen = F.round(F.col("mean") - F.col("mean_diff"), 12), F.round("mean_diff", 12)
    tail = F.least(F.count_if(null <= seen), F.count_if(null >= seen))
    return m.groupBy(*keys).agg(
        F.max("mean_diff").alias("mean_diff"),
        (2 * F.max("mean_diff") - F.percentile("mean", F.lit(hi))).alias("ci_low"),
        F.percentile("mean", F.lit(0.5)).alias("median"),
        (2 * F.max("mean_diff") - F.percentile("mean", F.lit(lo))).alias("ci_high"),
        F.least(F.lit(1.0), 2 * (tail + 1) / (F.count(F.lit(1)) + 1)).alias("pvalue"),
        F.avg((F.col("mean") < 0).cast("double")).alias("p_better"),
    )


def holm(p: DataFrame, family: list[str], order: list[str]) -> DataFrame:
    """Step-down adjusted p-values within each family; null p-values stay out of it."""
    w = Window.partitionBy(*family)
    rk = F.row_number().over(w.orderBy(F.asc_nulls_last("pvalue"), *order))
    d = p.withColumn("rk", rk).withColumn("m", F.count("pvalue").over(w))
    step = F.max((F.col("m") - F.col("rk") + 1) * F.col("pvalue")).over(w.orderBy("rk").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("holm", F.when(F.col("pvalue").isNotNull(), F.least(F.lit(1.0), step))).drop("rk", "m")


def focal_table(scores: DataFrame, focal: str, benchmarks: list[str], samples: int, seed: int, within: list[str] | None = None, block: int | None = None, primary: tuple[str, str] | None = None, level: float = 0.95) -> DataFrame:
    """The focal model against every benchmark on every metric, one row a contrast.

    ``scores`` is long: (metric, model, [within], date, score). Bootstrap interval and p-value, Holm over all rows,
    Diebold-Mariano, the block length with its diagnostics, and the flags that reports read; intervals and
    rejections at ``level``.
    """
    keys = ["metric", "benchmark"]
    own = checks.complete_pairs(scores, [focal, *benchmarks], ["metric", *(within or []), "date"])
    at = ["metric", *(within or []), "date"]
    a = own.where(F.col("model") == focal).select(*at, F.col("score").alias("a"))
    b = own.where(F.col("model") != focal).select(*at, F.col("model").alias("benchmark"), F.col("score").alias("b"))
    both = b.join(a, at)
    diff = cut(both.select(*keys, *(within or []), "date", (F.col("a") - F.col("b")).alias("diff")))
    means = both.groupBy(*keys).agg(F.avg("a").alias("focal_mean"), F.avg("b").alias("benchmark_mean"))
    blocks = cut(resolved_blocks(diff, keys, within, block))
    ci = bootstrap_ci(diff, block_means(diff, keys, blocks, samples, seed, within, stream=keys), keys, level)
    dm = diebold_mariano(newey_west(diff, keys, within)).select(*keys, "n", "bw", "lrv", "dm", F.col("pvalue").alias("dm_pvalue"))
    out = holm(ci.withColumn("one", F.lit(1)), ["one"], keys).drop("one").join(blocks, keys).join(dm, keys).join(means, keys)
    out = out.withColumn("relative_pct", 100 * F.col("mean_diff") / F.greatest(F.abs("benchmark_mean"), F.lit(1e-15)))
    out = out.withColumn("reject", F.col("holm") < round(1 - level, 12)).withColumn("ci_excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))
    metric, benchmark = primary or (None, None)
    return out.withColumn("is_primary", F.coalesce((F.col("metric") == F.lit(metric)) & (F.col("benchmark") == F.lit(benchmark)), F.lit(False)))


def sensitivity(scores: DataFrame, focal: str, benchmarks: list[str], samples: int, seed: int, grid: tuple[int, ...], within: list[str] | None = None, primary: tuple[str, str] | None = None, level: float = 0.95) -> DataFrame:
    """The comparison at fixed block lengths: focal_table with ``requested``, the length asked for."""
    parts = [focal_table(scores, focal, benchmarks, samples, seed, within, b, primary, level).withColumn("requested", F.lit(b)) for b in grid]
    return reduce(DataFrame.unionByName, parts)


def confidence_sets(scores: DataFrame, blocks: DataFrame, alpha: float, samples: int, seed: int, within: list[str] | None = None) -> DataFrame:
    """(metric, model, left_at, pvalue, statistic, in_set): the order in which models leave each metric's set, and who stays at ``alpha``.

    ``scores`` is long, as for focal_table; ``blocks`` has (metric, block). All models of a metric draw the same blocks,
    which stay in the segments of ``within``.
    """
    from .dynamics import eliminate

    ship(scores.sparkSession)
    losses = cut(scores.select("metric", "model", *(within or []), "date", F.col("score").alias("diff")))
    own = losses.select("metric", "model").distinct().join(blocks.select("metric", "block"), "metric")
    means = block_means(losses, ["metric", "model"], cut(own), samples, seed, within, stream=["metric"])
    seen = losses.groupBy("metric", "model").agg(F.avg("diff").alias("seen"), F.avg(F.abs("diff")).alias("size"))

    def run(pdf):
        x = pdf.pivot(index="sample", columns="model", values="mean").sort_index()
        own = pdf.groupby("model")[["seen", "size"]].first().loc[x.columns]
        found = eliminate(own["seen"].to_numpy(), x.to_numpy(), own["size"].to_numpy())
        return pd.DataFrame([(pdf["metric"].iloc[0], x.columns[c], step, p, t, p > alpha) for c, step, p, t in found], columns=["metric", "model", "left_at", "pvalue", "statistic", "in_set"])

    # samples x models rows of a metric
    return means.join(seen, ["metric", "model"]).groupBy("metric").applyInPandas(run, "metric string, model string, left_at int, pvalue double, statistic double, in_set boolean")


def confidence_set_statistics(scores: DataFrame, metric: str, block: int, samples: int, seed: int) -> DataFrame:
    """(model_i, model_j, diff, sd, t): studentised mean loss differences with bootstrap variance; all models draw alike."""
    losses = scores.select("model", "date", F.col(metric).alias("diff"))
    blocks = losses.groupBy("model").agg(F.lit(block).alias("block"))
    return set_statistics(losses, block_means(losses, ["model"], blocks, samples, seed), [])


def set_statistics(losses: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_i, model_j, diff, sd, t); t is null where the spread is rounding."""
    from .dynamics import ROUNDING

    obs = losses.groupBy(*keys, "model").agg(F.avg("diff").alias("m"), F.avg(F.abs("diff")).alias("size"))
    vec = means.join(obs, [*keys, "model"]).groupBy(*keys, "sample").agg(F.sort_array(F.collect_list(F.struct("model", "mean", "m", "size"))).alias("v"))  # one entry a model
    one = vec.select(*keys, "v", F.explode("v").alias("i"))
    two = one.select(*keys, "i", F.explode("v").alias("j")).where("i.model < j.model")
    d = two.select(*keys, F.col("i.model").alias("model_i"), F.col("j.model").alias("model_j"), (F.col("i.m") - F.col("j.m")).alias("diff"), (F.col("i.mean") - F.col("j.mean") - F.col("i.m") + F.col("j.m")).alias("e"), F.greatest("i.size", "j.size").alias("size"))
    g = d.groupBy(*keys, "model_i", "model_j").agg(F.max("diff").alias("diff"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("sd"), F.max("size").alias("size"))
    return g.withColumn("t", F.when(F.col("sd") > ROUNDING * F.col("size"), F.try_divide(F.col("diff"), F.col("sd")))).drop("size")
