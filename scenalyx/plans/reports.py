"""Queries behind reports: score frames, comparisons, calibration, portfolio contrasts, chart frames and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fingerprints
from ..functions.expr import uniform
from ..operators import calibration as C
from ..operators import checks
from ..operators import inference as I
from ..operators import models as G
from ..operators import moments as M
from ..operators import panel as P
from ..operators import portfolio as B
from ..operators import scoring as S
from ..runtime import cut
from . import oracle_base as O
from .catalogue import ALPHA, SAMPLES, SEED, SHARPE_SAMPLES, R, _both, _diff, _ledger, _obs, _panel, _pit, _r, _rets, _scen, _sets, query

FOCAL, BENCHMARKS, PRIMARY = "ewma", ["recent", "uniform"], ("mean_crps", "uniform")


def _frame(spark, d):
    return cut(S.observation_scores(*_both(spark, d)))


# scores


@query("score_frame", f"SELECT model, date, {R('mean_crps', 'energy', 'variogram')} FROM score_frame")
def score_frame(spark, d):
    return _r(checks.some_rows(_frame(spark, d), "observation scores"))


@query("normalised_weights", "SELECT model, date, round(p / sum(p) OVER (PARTITION BY model), 9) AS p FROM (SELECT model, date, p * 3 AS p FROM weights)")
def normalised_weights(spark, d):
    """Probabilities from weights of another sum."""
    w = _scen(spark, d).select("model", "date", (F.col("p") * 3).alias("p")).distinct()
    return G.normalised(w, ["model"]).select("model", "date", F.round("p", 9).alias("p"))


_RHO = (
    "SELECT c.model, c.asset_i, c.asset_j, c.value / sqrt(a.value * b.value) AS rho"
    " FROM cov c JOIN cov a ON a.model = c.model AND a.asset_i = c.asset_i AND a.asset_j = c.asset_i"
    " JOIN cov b ON b.model = c.model AND b.asset_i = c.asset_j AND b.asset_j = c.asset_j"
    " WHERE c.asset_i < c.asset_j"
)
_MARGINAL = (
    f"SELECT *, hits / n::DOUBLE AS rate, {O.chi2_sql('lr_uc')} AS p_uc, {O.chi2_sql('lr_ind')} AS p_ind, lr_uc + lr_ind AS lr_cc, exp(-(lr_uc + lr_ind) / 2) AS p_cc"
    f" FROM (SELECT model, asset, avg(crps) AS crps FROM crps GROUP BY 1, 2) JOIN var USING (model, asset)"
    f" JOIN (SELECT model, asset, sum(x * greatest(0.0::DOUBLE, least(p, 0.05::DOUBLE - (cum - p)))) / 0.05::DOUBLE AS es"
    f" FROM cum GROUP BY 1, 2) USING (model, asset) JOIN kupiec USING (model, asset)"
    f" JOIN (SELECT model, asset, lr_ind FROM christoffersen) USING (model, asset)"
)


@query("weighted_correlation", f"SELECT model, asset_i, asset_j, {R('rho')} FROM ({_RHO})")
def weighted_correlation(spark, d):
    return _r(S.weighted_correlation(_scen(spark, d)))


@query("marginal_table", f"SELECT model, asset, n, hits, {R('crps', 'var', 'es', 'rate', 'lr_uc', 'p_uc', 'lr_ind', 'p_ind', 'lr_cc', 'p_cc')} FROM ({_MARGINAL})")
def marginal_table(spark, d):
    return _r(S.marginal_table(*_both(spark, d), ALPHA))


@query(
    "aggregate_table",
    (
        f"SELECT model, {R('mean_crps', 'mean_exceedance_rate')}, coverage_rejections, {R('energy', 'variogram', 'correlation_mae')}"
        f" FROM (SELECT model, avg(crps) AS mean_crps, avg(rate) AS mean_exceedance_rate, count(*) FILTER (p_uc < 0.05) AS coverage_rejections"
        f" FROM ({_MARGINAL}) GROUP BY 1) JOIN (SELECT model, avg(energy) AS energy, avg(variogram) AS variogram"
        f" FROM score_frame GROUP BY 1) USING (model) JOIN (SELECT model, avg(abs(rho - seen)) AS correlation_mae"
        f" FROM ({_RHO}) JOIN (SELECT a.asset AS asset_i, b.asset AS asset_j, corr(a.y, b.y) AS seen"
        f" FROM obs a JOIN obs b ON a.date = b.date AND a.asset < b.asset GROUP BY 1, 2) USING (asset_i, asset_j)"
        f" GROUP BY 1) USING (model)"
    ),
)
def aggregate_table(spark, d):
    scen, obs = _both(spark, d)
    obs = cut(obs)
    own = obs.select("date", "asset", F.col("y").alias("d"), F.lit(1.0).alias("p"))
    seen = M.pairs(own, []).where("asset_i < asset_j").groupBy("asset_i", "asset_j").agg(F.corr("di", "dj").alias("rho"))
    return _r(S.aggregate_table(S.marginal_table(scen, obs, ALPHA), S.observation_scores(scen, obs), S.weighted_correlation(scen), seen))


# comparisons


_OUT = ("mean_diff", "ci_low", "median", "ci_high", "pvalue", "p_better", "holm", "raw", "lrv", "dm", "dm_pvalue", "focal_mean", "benchmark_mean", "relative_pct")
_EXACT = "metric, benchmark, block, capped, n, bw, reject, ci_excludes_zero, is_primary"


def _table_sql(grouped: bool, fixed: int | None = None) -> str:
    src = f"SELECT metric, benchmark, {'fold' if grouped else '0'} AS seg, date, diff FROM contrast"
    keys = "metric, benchmark"
    sizes = O.sizes_sql(src, keys, grouped, fixed)
    stream = "metric || '|' || benchmark || '|' ||" + (" seg || '|' ||" if grouped else "")
    ci = O.holm_sql(O.ci_sql(src, keys, O.means_sql(src, keys, sizes, SAMPLES, SEED, stream)), "1", keys)
    means = "SELECT metric, benchmark, avg(fa) AS focal_mean, avg(fb) AS benchmark_mean FROM contrast GROUP BY 1, 2"
    flags = f"holm < 0.05 AS reject, ci_low > 0 OR ci_high < 0 AS ci_excludes_zero, metric = '{PRIMARY[0]}' AND benchmark = '{PRIMARY[1]}' AS is_primary"
    return (
        f"SELECT *, {flags}, 100 * mean_diff / greatest(abs(benchmark_mean), 1e-15) AS relative_pct"
        f" FROM ({ci}) JOIN ({sizes}) USING ({keys}) JOIN (SELECT {keys}, n, bw, lrv, dm, pvalue AS dm_pvalue"
        f" FROM ({O.dm_sql(src, keys, grouped)})) USING ({keys}) JOIN ({means}) USING ({keys})"
    )


def _long(spark, d):
    return S.long_scores(_frame(spark, d))


def _compared(df: DataFrame, *first: str) -> DataFrame:
    names = [*first, *(c.strip() for c in _EXACT.split(",")), *_OUT]
    return _r(df, *names)


@query("focal_comparison", f"SELECT {_EXACT}, {R(*_OUT)} FROM ({_table_sql(False)})")
def focal_comparison(spark, d):
    return _compared(I.focal_table(_long(spark, d), FOCAL, BENCHMARKS, SAMPLES, SEED, primary=PRIMARY))


@query("focal_comparison_grouped", f"SELECT {_EXACT}, {R(*_OUT)} FROM ({_table_sql(True)})")
def focal_comparison_grouped(spark, d):
    return _compared(I.focal_table(_long(spark, d).withColumn("fold", F.year("date")), FOCAL, BENCHMARKS, SAMPLES, SEED, ["fold"], primary=PRIMARY))


_GRID = (2, 4, 8)


@query("block_sensitivity", " UNION ALL ".join(f"SELECT {b} AS requested, {_EXACT}, {R(*_OUT)} FROM ({_table_sql(False, b)})" for b in _GRID))
def block_sensitivity(spark, d):
    """The comparison at fixed block lengths."""
    long = cut(_long(spark, d))
    return _compared(I.sensitivity(long, FOCAL, BENCHMARKS, SAMPLES, SEED, _GRID, primary=PRIMARY), "requested")


@query("fold_score_calibration", f"SELECT model, fold, {R('score', 'ratio')} FROM (SELECT model, year(date) AS fold, avg(score) AS score FROM scores GROUP BY 1, 2) JOIN (SELECT model, year(date) AS fold, var_pop(u) * 12 AS ratio FROM pit GROUP BY 1, 2) USING (model, fold)")
def fold_score_calibration(spark, d):
    """Mean score beside dispersion, by model and fold: each key once on either side."""
    score = _frame(spark, d).groupBy("model", F.year("date").cast("long").alias("fold")).agg(F.avg("mean_crps").alias("score"))
    ratio = _pit(spark, d).groupBy("model", F.year("date").cast("long").alias("fold")).agg((F.var_pop("u") * 12).alias("ratio"))
    return _r(checks.joined_one_to_one(score, ratio, "model", "fold"), "model", "fold", "score", "ratio")


@query("forest_plot", f"SELECT metric, benchmark, {R('mean_diff', 'ci_low', 'ci_high')}, ci_excludes_zero, row_number() OVER (ORDER BY metric, round(mean_diff, 9), benchmark)::INT AS place FROM ({_table_sql(True)})")
def forest_plot(spark, d):
    t = I.focal_table(_long(spark, d).withColumn("fold", F.year("date")), FOCAL, BENCHMARKS, SAMPLES, SEED, ["fold"], primary=PRIMARY)
    place = F.row_number().over(Window.orderBy("metric", F.round("mean_diff", 9), "benchmark"))  # a row a contrast
    return _r(t.withColumn("place", place), "metric", "benchmark", "mean_diff", "ci_low", "ci_high", "ci_excludes_zero", "place")


@query("bootstrap_index", (
    f"SELECT benchmark, sample, block, ('0x' || substr(md5('{SEED}|block|' || sample || '|' || block), 1, 8))::BIGINT % (n - size + 1) AS start, least(size, n - block * size) AS take"
    f" FROM (SELECT *, unnest(range(0, ceil(n / size::DOUBLE)::BIGINT)) AS block"
    f" FROM (SELECT benchmark, n, least(4, n) AS size, unnest(range(0, 200)) AS sample"
    f" FROM (SELECT benchmark, count(*) AS n FROM diff GROUP BY 1)))"
))
def bootstrap_index(spark, d):
    """The spans that 200 samples of blocks of 4 take."""
    diff = _diff(spark, d)
    out = I.block_starts(diff, ["benchmark"], I.resolved_blocks(diff, ["benchmark"], fixed=4), 200, SEED)
    return out.select("benchmark", *(F.col(c).cast("long").alias(c) for c in ("sample", "block", "start", "take")))


@query("dcc_correlation_recursion", (
    "SELECT asset_i, asset_j, round(q / sqrt(qi * qj), 6) + 0.0::DOUBLE AS next_rho"
    " FROM (SELECT p.asset_i, p.asset_j, p.q, i.q AS qi, j.q AS qj FROM (SELECT asset_i, asset_j, 0.05::DOUBLE * base * (1 - pow(0.92::DOUBLE, n)) / 0.08::DOUBLE + 0.03::DOUBLE * w + pow(0.92::DOUBLE, n) * base AS q"
    " FROM (SELECT asset_i, asset_j, avg(zz) AS base, count(*) AS n, sum(pow(0.92::DOUBLE, n_all - rn) * zz) AS w"
    " FROM (SELECT a.asset AS asset_i, b.asset AS asset_j, a.z * b.z AS zz, a.rn, a.n AS n_all"
    " FROM zs a JOIN zs b ON a.rn = b.rn AND a.asset <= b.asset) GROUP BY 1, 2)) p"
    " JOIN (SELECT asset_i AS a, 0.05::DOUBLE * base * (1 - pow(0.92::DOUBLE, n)) / 0.08::DOUBLE + 0.03::DOUBLE * w + pow(0.92::DOUBLE, n) * base AS q"
    " FROM (SELECT asset AS asset_i, avg(z * z) AS base, count(*) AS n, sum(pow(0.92::DOUBLE, n - rn) * z * z) AS w"
    " FROM zs GROUP BY 1)) i ON i.a = p.asset_i JOIN (SELECT asset_i AS a, 0.05::DOUBLE * base * (1 - pow(0.92::DOUBLE, n)) / 0.08::DOUBLE + 0.03::DOUBLE * w + pow(0.92::DOUBLE, n) * base AS q"
    " FROM (SELECT asset AS asset_i, avg(z * z) AS base, count(*) AS n, sum(pow(0.92::DOUBLE, n - rn) * z * z) AS w"
    " FROM zs GROUP BY 1)) j ON j.a = p.asset_j) WHERE asset_i < asset_j"
))
def dcc_correlation_recursion(spark, d):
    """Next correlations by the recursion 0.05 base + 0.03 z z' + 0.92 before, over standardised in-sample returns."""
    w = Window.partitionBy("asset")
    r = _rets(spark, d).where("segment = 'is'").withColumn("z", (F.col("ret") - F.avg("ret").over(w)) / F.stddev_pop("ret").over(w))
    zz = M.pairs(r.select("date", "asset", F.col("z").alias("d"), F.lit(1.0).alias("p")), [])
    steps = zz.groupBy("asset_i", "asset_j").agg(F.avg(F.col("di") * F.col("dj")).alias("base"), F.transform(F.sort_array(F.collect_list(F.struct("date", (F.col("di") * F.col("dj")).alias("zz")))), lambda e: e["zz"]).alias("zz"))
    q = cut(steps.select("asset_i", "asset_j", F.aggregate("zz", F.col("base"), lambda acc, x: 0.05 * F.col("base") + 0.03 * x + 0.92 * acc).alias("q")))
    own = lambda name: q.where("asset_i = asset_j").select(F.col("asset_i").alias(name), F.col("q").alias(f"q_{name}"))
    out = q.where("asset_i < asset_j").join(own("asset_i"), "asset_i").join(own("asset_j"), "asset_j")
    return _r(out.select("asset_i", "asset_j", (F.col("q") / F.sqrt(F.col("q_asset_i") * F.col("q_asset_j"))).alias("next_rho")))


# calibration


_DETAIL = "SELECT model, asset, count(*) AS n, avg(u) AS pit_mean, var_pop(u) AS pit_variance, round(var_pop(u) * 12, 6) AS ratio FROM pit GROUP BY 1, 2"
_RELIABILITY = (
    "SELECT model, asset, sum(abs(coalesce(c, 0) / n::DOUBLE - 0.1)) AS reliability"
    " FROM (SELECT model, asset, n, unnest(range(0, 10)) AS bin FROM (SELECT model, asset, count(*) AS n"
    " FROM pit GROUP BY 1, 2)) LEFT JOIN (SELECT model, asset, least(floor(round(u, 9) * 10), 9)::BIGINT AS bin, count(*) AS c"
    " FROM pit GROUP BY 1, 2, 3) USING (model, asset, bin) GROUP BY 1, 2"
)
_LABEL = "CASE WHEN ratio > 1.05 THEN 'underdispersed' WHEN ratio < 0.95 THEN 'overdispersed' ELSE 'calibrated' END"


@query("calibration_detail", f"SELECT model, asset, n, {R('pit_mean', 'pit_variance', 'ratio', 'reliability')}, {_LABEL} AS label FROM ({_DETAIL}) JOIN ({_RELIABILITY}) USING (model, asset)")
def calibration_detail(spark, d):
    return _r(C.detail(_pit(spark, d)))


@query(
    "calibration_summary",
    (
        f"SELECT model, count(*) AS assets, {R('mean_ratio', 'median_ratio', 'mean_reliability').replace('round(mean_ratio', 'round(avg(ratio)').replace('round(median_ratio', 'round(median(ratio)').replace('round(mean_reliability', 'round(avg(reliability)')}, count(*) FILTER (label = 'underdispersed') AS underdispersed, count(*) FILTER (label = 'overdispersed') AS overdispersed, count(*) FILTER (label = 'calibrated') AS calibrated, round(sum(pit_mean * n) / sum(n), 6) + 0.0::DOUBLE AS pooled_mean"
        f" FROM (SELECT *, {_LABEL} AS label FROM ({_DETAIL}) JOIN ({_RELIABILITY}) USING (model, asset))"
        f" GROUP BY model"
    ),
)
def calibration_summary(spark, d):
    return _r(C.summary(C.detail(_pit(spark, d))))


_SUPPORT = "SELECT model, date, p, sum(p) OVER (PARTITION BY model ORDER BY date ROWS UNBOUNDED PRECEDING) - p AS cb, sum(p) OVER (PARTITION BY model) AS total FROM weights"


@query("support_resampled", (
    f"SELECT model, draw::INT AS draw, date, round(p, 9) AS p FROM (SELECT model, NULL AS draw, date, p"
    f" FROM weights WHERE model IN (SELECT model FROM weights GROUP BY 1 HAVING count(*) <= 100)"
    f" UNION ALL SELECT d.model, draw, s.date, 0.01 FROM (SELECT model, draw, ('0x' || substr(md5('{SEED}|support|' || model || '|' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u"
    f" FROM (SELECT model, unnest(range(0, 100)) AS draw FROM weights GROUP BY 1 HAVING count(*) > 100)) d ASOF"
    f" JOIN (SELECT *, cb / total AS low FROM ({_SUPPORT})) s ON d.model = s.model AND d.u >= s.low)"
))
def support_resampled(spark, d):
    """Every scenario set at the same support: sets of more than 100 scenarios are drawn anew."""
    support = _scen(spark, d).select("model", "date", "p").distinct()
    return G.resampled(support, 100, SEED, ["model"], "date").select("model", "draw", "date", F.round("p", 9).alias("p"))


# portfolios


#: Portfolios, their evaluation designs and baselines.
_PAIRS = [("WF_InverseVariance", "expanding_window_walk_forward", "WF_EqualWeight"), ("InverseVariance", "static_single_shot_oos", "EqualWeight"), ("WF_EqualWeight", "rebalancing_effect", "EqualWeight"), ("WF_InverseVariance", "rebalancing_effect", "InverseVariance")]
_SHARPE_BLOCK = 20


def _sharpe_sql() -> str:
    pairs = ", ".join(str(p) for p in _PAIRS)
    keys = "portfolio, design, benchmark"
    both = f"SELECT {keys}, a.date, a.r AS a, b.r AS b FROM (VALUES {pairs}) pr({keys}) JOIN ledger a USING (portfolio) JOIN (SELECT portfolio AS benchmark, date, r FROM ledger) b USING (benchmark) WHERE a.date = b.date"
    rows = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM ({both})"
    drawn = (
        f"SELECT {keys}, n, sample, nth, size, ('0x' || substr(md5('{SEED}|sharpe|' || sample || '|' || nth), 1, 8))::BIGINT % (n - size + 1) AS start, least(size, n - nth * size) AS take"
        f" FROM (SELECT *, unnest(range(0, ceil(n / size::DOUBLE)::BIGINT)) AS nth"
        f" FROM (SELECT DISTINCT {keys}, n, least({_SHARPE_BLOCK}, n) AS size, unnest(range(0, {SHARPE_SAMPLES})) AS sample"
        f" FROM ({rows})))"
    )
    ratio = lambda c: f"CASE WHEN stddev_samp({c}) > 1e-12 THEN avg({c}) / stddev_samp({c}) ELSE 0 END * sqrt(52.0::DOUBLE)"
    each = f"SELECT {keys}, sample, {ratio('a')} - {ratio('b')} AS d FROM ({drawn}) w JOIN ({rows}) r USING ({keys}) WHERE r.k >= w.start AND r.k < w.start + w.take GROUP BY {keys}, sample"
    seen = f"SELECT {keys}, {ratio('a')} - {ratio('b')} AS seen FROM ({rows}) GROUP BY {keys}"
    ci = (
        f"SELECT {keys}, max(seen) AS difference, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high, (count(*) FILTER (round(abs(d - seen), 9) >= round(abs(seen), 9)) + 1) / (count(*) + 1)::DOUBLE AS pvalue"
        f" FROM ({each}) JOIN ({seen}) USING ({keys}) GROUP BY {keys}"
    )
    return O.holm_sql(ci, "design", "portfolio")


@query("sharpe_diff_bootstrap", f"SELECT portfolio, design, benchmark, design <> 'rebalancing_effect' AS like_for_like, {R('difference', 'ci_low', 'ci_high', 'pvalue', 'holm')}, holm < 0.05 AS reject, ci_low > 0 OR ci_high < 0 AS ci_excludes_zero FROM ({_sharpe_sql()})")
def sharpe_diff_bootstrap(spark, d):
    """Portfolios against the baseline of their design, and walked forward against set once; Holm within each family."""
    r = B.net_returns(_ledger(spark, d)).select("portfolio", "date", "r")
    pairs = spark.createDataFrame(_PAIRS, "portfolio string, design string, benchmark string")
    checks.present([x["portfolio"] for x in r.select("portfolio").distinct().collect()], {p[2] for p in _PAIRS}, "baselines")
    out = I.holm(B.sharpe_bootstrap(r, pairs, _SHARPE_BLOCK, SHARPE_SAMPLES, SEED, 52.0), ["design"], ["portfolio"])
    out = out.withColumn("like_for_like", F.col("design") != "rebalancing_effect").withColumn("reject", F.col("holm") < 0.05).withColumn("ci_excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))
    return _r(out, "portfolio", "design", "benchmark", "like_for_like", "difference", "ci_low", "ci_high", "pvalue", "holm", "reject", "ci_excludes_zero")


_UNIVERSES = "SELECT portfolio, rank() OVER (ORDER BY round(sharpe, 9) DESC) AS place, sharpe FROM (SELECT portfolio, avg(r) / nullif(stddev_samp(r), 0) AS sharpe FROM ledger {where} GROUP BY 1)"


@query("portfolio_comparison_outer", (
    f"SELECT portfolio, design, sharpe_full, sharpe_late, round(sharpe_late - sharpe_full, 6) + 0.0::DOUBLE AS delta"
    f" FROM (SELECT portfolio, CASE WHEN portfolio LIKE 'WF%' THEN 'walk_forward' ELSE 'static' END AS design, {R('sharpe_full').replace('round(sharpe_full', 'round(avg(r) / nullif(stddev_samp(r), 0)')}"
    f" FROM ledger GROUP BY 1) FULL JOIN (SELECT portfolio, CASE WHEN portfolio LIKE 'WF%' THEN 'walk_forward' ELSE 'static' END AS design, {R('sharpe_late').replace('round(sharpe_late', 'round(avg(r) / nullif(stddev_samp(r), 0)')}"
    f" FROM ledger WHERE date >= DATE '2000-07-01' AND portfolio <> 'EqualWeight'"
    f" GROUP BY 1) USING (portfolio, design)"
))
def portfolio_comparison_outer(spark, d):
    """Sharpe ratios of all dates beside those of a later, narrower run, matched on two keys."""
    r = B.net_returns(_ledger(spark, d)).withColumn("design", F.when(F.startswith("portfolio", F.lit("WF")), "walk_forward").otherwise("static"))
    sd = F.stddev_samp("r")
    ratio = lambda df, name: df.groupBy("portfolio", "design").agg(F.round(F.try_divide(F.avg("r"), F.when(sd > 0, sd)), 6).alias(name))
    late = r.where("date >= '2000-07-01' and portfolio <> 'EqualWeight'")
    both = ratio(r, "sharpe_full").join(ratio(late, "sharpe_late"), ["portfolio", "design"], "outer")
    return _r(both.withColumn("delta", F.col("sharpe_late") - F.col("sharpe_full")), "portfolio", "design", "sharpe_full", "sharpe_late", "delta")


@query("performance_ranking", f"SELECT portfolio, {R('sharpe')}, row_number() OVER (ORDER BY round(sharpe, 9) DESC, portfolio)::INT AS place FROM (SELECT portfolio, avg(r) / nullif(stddev_samp(r), 0) * sqrt(52.0::DOUBLE) AS sharpe FROM ledger GROUP BY 1)")
def performance_ranking(spark, d):
    m = B.metrics(_ledger(spark, d), 52.0).select("portfolio", "sharpe")
    place = F.row_number().over(Window.orderBy(F.desc(F.round("sharpe", 9)), "portfolio"))  # a row a portfolio
    return _r(m.withColumn("place", place), "portfolio", "sharpe", "place")


# moments and charts


@query("moment_errors", (
    f"SELECT model, {R('mae1', 'rmse1', 'mae2', 'rmse2', 'corr_mae', 'corr_max')}"
    f" FROM (SELECT s.model, avg(abs(s.m1 - t.m1) / sqrt(t.m2)) AS mae1, sqrt(avg(pow((s.m1 - t.m1) / sqrt(t.m2), 2))) AS rmse1, avg(abs(s.m2 - t.m2) / t.m2) AS mae2, sqrt(avg(pow((s.m2 - t.m2) / t.m2, 2))) AS rmse2"
    f" FROM moments s JOIN moments t ON t.model = 'ewma' AND t.asset = s.asset"
    f" GROUP BY 1) JOIN (SELECT a.model, avg(abs(a.rho - b.rho)) AS corr_mae, max(abs(a.rho - b.rho)) AS corr_max"
    f" FROM ({_RHO}) a JOIN ({_RHO}) b ON b.model = 'ewma' AND a.asset_i = b.asset_i AND a.asset_j = b.asset_j"
    f" GROUP BY 1) USING (model)"
))
def moment_errors(spark, d):
    """Scaled errors of mean and variance, and of correlations, against the weighted windows."""
    s = _scen(spark, d)
    m = cut(M.moments(s, ["model", "asset"]))
    t = m.where("model = 'ewma'").select("asset", F.col("m1").alias("t1"), F.col("m2").alias("t2"))
    e1, e2 = (F.col("m1") - F.col("t1")) / F.sqrt("t2"), (F.col("m2") - F.col("t2")) / F.col("t2")
    own = m.join(t, "asset").groupBy("model").agg(F.avg(F.abs(e1)).alias("mae1"), F.sqrt(F.avg(e1 * e1)).alias("rmse1"), F.avg(F.abs(e2)).alias("mae2"), F.sqrt(F.avg(e2 * e2)).alias("rmse2"))
    rho = cut(S.weighted_correlation(s))
    aim = rho.where("model = 'ewma'").select("asset_i", "asset_j", F.col("rho").alias("aim"))
    gap = F.abs(F.col("rho") - F.col("aim"))
    return _r(own.join(rho.join(aim, ["asset_i", "asset_j"]).groupBy("model").agg(F.avg(gap).alias("corr_mae"), F.max(gap).alias("corr_max")), "model"))


_LORENZ = "SELECT model, date, p, row_number() OVER w AS k, sum(p) OVER w AS mass, count(*) OVER (PARTITION BY model) AS n FROM weights WINDOW w AS (PARTITION BY model ORDER BY p DESC, date)"


def _masses(spark, d):
    w = Window.partitionBy("model").orderBy(F.desc("p"), "date")
    own = _scen(spark, d).select("model", "date", "p").distinct()
    return own.select("model", "date", "p", F.row_number().over(w).alias("k"), F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("mass"), F.count(F.lit(1)).over(Window.partitionBy("model")).alias("n"))


@query("mass_concentration", f"SELECT model, min(k) FILTER (round(mass, 12) >= 0.5) AS n50, min(k) FILTER (round(mass, 12) >= 0.8) AS n80 FROM ({_LORENZ}) GROUP BY model")
def mass_concentration(spark, d):
    """Scenarios that hold half, and four fifths, of the mass."""
    at = lambda share: F.min(F.when(F.round("mass", 12) >= share, F.col("k"))).cast("long")
    return _masses(spark, d).groupBy("model").agg(at(0.5).alias("n50"), at(0.8).alias("n80"))


@query("lorenz_curve", f"SELECT model, k, round(k / n::DOUBLE, 6) AS share, round(mass, 6) AS mass FROM ({_LORENZ})")
def lorenz_curve(spark, d):
    return _masses(spark, d).select("model", F.col("k").cast("long").alias("k"), F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round("mass", 6).alias("mass"))


@query("top_scenarios", f"SELECT model, date, k, round(p, 9) AS p FROM ({_LORENZ}) WHERE k <= 30")
def top_scenarios(spark, d):
    return _masses(spark, d).where("k <= 30").select("model", "date", F.col("k").cast("long").alias("k"), F.round("p", 9).alias("p"))


@query("scenario_histogram", (
    "SELECT model, asset, least(floor(round((x - low) / nullif(high - low, 0), 9) * 20), 19)::INT AS bin, round(sum(p), 6) + 0.0::DOUBLE AS mass"
    " FROM (SELECT *, min(x) OVER (PARTITION BY asset) AS low, max(x) OVER (PARTITION BY asset) AS high"
    " FROM scen) GROUP BY 1, 2, 3"
))
def scenario_histogram(spark, d):
    """Probability in 20 equal bins of an asset's range over all models."""
    w = Window.partitionBy("asset")
    x = _scen(spark, d).withColumn("low", F.min("x").over(w)).withColumn("span", F.max("x").over(w) - F.col("low"))
    place = F.least(F.floor(F.round(F.try_divide(F.col("x") - F.col("low"), F.when(F.col("span") > 0, F.col("span"))), 9) * 20), F.lit(19)).cast("int")
    return _r(x.groupBy("model", "asset", place.alias("bin")).agg(F.sum("p").alias("mass")))


# unions and checks


@query("segment_union", f"SELECT date, asset, {R('ret')} FROM returns")
def segment_union(spark, d):
    """In-sample and out-of-sample rows in one table; a key in both would be refused."""
    r = _rets(spark, d).select("date", "asset", "ret", "segment")
    return _r(checks.united(r.where("segment = 'is'"), r.where("segment = 'oos'"), "date", "asset").select("date", "asset", "ret"))


@query("mask_alignment", "SELECT date, asset, raw IS NOT NULL AS observed, price IS NOT NULL AND raw IS NULL AS imputed FROM filled")
def mask_alignment(spark, d):
    """Every cell of the filled panel with its mask of observed prices."""
    p = cut(checks.positive(_panel(spark, d)))
    mask = p.select("date", "asset", F.col("raw").isNotNull().alias("observed"))
    return checks.aligned(p.select("date", "asset", "price"), mask, "date", "asset").select("date", "asset", "observed", (F.col("price").isNotNull() & ~F.col("observed")).alias("imputed"))


@query("semi_join_universe", "SELECT date, asset, round(ret, 6) + 0.0::DOUBLE AS ret FROM returns WHERE asset IN (SELECT asset FROM quality WHERE segment = 'is' AND vol <= (SELECT median(vol) FROM quality WHERE segment = 'is'))")
def semi_join_universe(spark, d):
    """Returns of the calmer half of the universe."""
    r = _rets(spark, d)
    q = P.quality(_panel(spark, d), r).where("segment = 'is'").select("asset", "vol")
    calm = q.join(F.broadcast(q.agg(F.median("vol").alias("middle")))).where("vol <= middle")
    return _r(r.join(calm, "asset", "left_semi").select("date", "asset", "ret"))


@query("distinct_counts", "SELECT asset, count(DISTINCT ret) AS n_returns, count(*) = count(DISTINCT date) AS dates_unique FROM returns GROUP BY asset")
def distinct_counts(spark, d):
    return _rets(spark, d).groupBy("asset").agg(F.count_distinct("ret").alias("n_returns"), (F.count(F.lit(1)) == F.count_distinct("date")).alias("dates_unique"))


@query(
    "contract_checks",
    (
        "SELECT 'weights_sum_to_one' AS check_name, bool_and(abs(s - 1) < 1e-9) AS passed, count(*) AS n"
        " FROM (SELECT model, sum(p) AS s FROM weights GROUP BY 1) UNION ALL SELECT 'variances_not_negative', bool_and(m2 >= 0), count(*)"
        " FROM moments UNION ALL SELECT 'transforms_in_unit_interval', bool_and(u >= 0 AND u <= 1), count(*)"
        " FROM pit UNION ALL SELECT 'scores_not_negative', bool_and(mean_crps >= 0 AND energy >= 0 AND variogram >= 0), count(*)"
        " FROM score_frame UNION ALL SELECT 'wealth_positive', bool_and(wealth > 0), count(*)"
        " FROM ledger UNION ALL SELECT 'targets_sum_to_one', bool_and(abs(s - 1) < 1e-9), count(*)"
        " FROM (SELECT portfolio, rebalance_date, sum(weight) AS s FROM plan_weights"
        " GROUP BY 1, 2) UNION ALL SELECT 'shortfall_below_var', bool_and(es <= var + 1e-12), count(*)"
        " FROM (SELECT model, asset, sum(x * greatest(0.0::DOUBLE, least(p, 0.05::DOUBLE - (cum - p)))) / 0.05::DOUBLE AS es"
        " FROM cum GROUP BY 1, 2) JOIN var USING (model, asset)"
    ),
)
def contract_checks(spark, d):
    """What the tables promise, one row a promise: whether it holds, and over how many rows it was judged."""
    from .catalogue import _plans

    scen, obs = _both(spark, d)
    obs = cut(obs)
    judged = [
        ("weights_sum_to_one", scen.select("model", "date", "p").distinct().groupBy("model").agg(F.sum("p").alias("s")), F.abs(F.col("s") - 1) < 1e-9),
        ("variances_not_negative", M.moments(scen, ["model", "asset"]), F.col("m2") >= 0),
        ("transforms_in_unit_interval", _pit(spark, d), F.col("u").between(0, 1)),
        ("scores_not_negative", S.observation_scores(scen, obs), (F.col("mean_crps") >= 0) & (F.col("energy") >= 0) & (F.col("variogram") >= 0)),
        ("wealth_positive", _ledger(spark, d), F.col("wealth") > 0),
        ("targets_sum_to_one", _plans(_rets(spark, d)).groupBy("portfolio", "rebalance_date").agg(F.sum("weight").alias("s")), F.abs(F.col("s") - 1) < 1e-9),
        ("shortfall_below_var", S.expected_shortfall(scen, ["model", "asset"], ALPHA).join(S.value_at_risk(scen, ["model", "asset"], ALPHA), ["model", "asset"]), F.col("es") <= F.col("var") + 1e-12),
    ]
    return reduce(DataFrame.unionByName, [df.agg(F.bool_and(ok).alias("passed"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "passed", "n") for name, df, ok in judged])


@query("file_fingerprints")
def file_fingerprints(spark, d):
    return fingerprints.hashed(spark, [d]).select("file", "bytes", "leaves", "sha256")
