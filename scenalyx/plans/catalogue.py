"""Registered queries over the driver's tables, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import inference as I
from ..operators import moments as M
from ..operators import panel as P
from ..operators import portfolio as B
from ..operators import scoring as S
from ..operators.ordered import value_sums
from ..runtime import cut
from ..sources.tables import keep_last, table
from . import oracle_base as O
from .oracle_base import with_base

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ALPHA = 0.05


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = with_base(sql)
        return fn

    return add


#: Bootstrap samples of score contrasts, confidence sets and Sharpe differences, and the seed of all draws.
SAMPLES, SHARPE_SAMPLES, SEED = 5000, 2000, 7


def _panel(spark: SparkSession, d: str, grain: str = "week") -> DataFrame:
    return P.fill(P.cleaned(P.price_panel(table(spark, d, "lineitem"), table(spark, d, "part"), grain)))


# What several branches of a plan read is made once: returns, scenarios and scores are small tables beside the prices.


def _rets(spark, d):
    return cut(P.returns(P.complete(_panel(spark, d))))


def _term(spark, d):
    return P.terminal(_rets(spark, d))


def _is(spark, d):
    return _term(spark, d).where("segment = 'is'")


def _obs(spark, d):
    return _observed(_term(spark, d))


def _scen(spark, d):
    return _sets(_term(spark, d))


def _sets(term):
    return cut(M.scenario_models(term.where("segment = 'is'")))


def _observed(term):
    return term.where("segment = 'oos' and is_nonoverlap").select("asset", "date", F.col("tret").alias("y"))


def _both(spark, d):
    """Scenario sets and observations of one run over the panel."""
    term = cut(_term(spark, d))
    return _sets(term), _observed(term)


def _r(df: DataFrame, *cols: str) -> DataFrame:
    """Round the doubles, keep the rest, in the given order."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(c).alias(c) if kinds[c] == "double" else F.col(c) for c in (cols or df.columns)])


def R(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in cols)


# panel and quality


@query("panel_coverage", (
    f"SELECT asset, count(*) AS n_dates, count(raw) AS n_obs, round(avg(CASE WHEN raw IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS coverage, min(CASE WHEN raw IS NOT NULL THEN date END) AS first_obs, max(CASE WHEN raw IS NOT NULL THEN date END) AS last_obs, count(*) FILTER (raw IS NULL AND price IS NOT NULL) AS imputed, count(*) FILTER (price IS NULL) AS unresolved"
    f" FROM filled GROUP BY asset"
))
def panel_coverage(spark, d):
    return _r(P.coverage(_panel(spark, d)))


@query("panel_gap_runs", (
    "SELECT asset, max(CASE WHEN flag = 1 THEN n ELSE 0 END) AS longest_gap FROM (SELECT asset, flag, island, count(*) AS n"
    " FROM (SELECT asset, flag, rn - row_number() OVER (PARTITION BY asset, flag ORDER BY date) AS island"
    " FROM (SELECT asset, date, (raw IS NULL)::INT AS flag, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn"
    " FROM grid)) GROUP BY ALL) GROUP BY asset"
))
def panel_gap_runs(spark, d):
    return P.longest_run(_panel(spark, d), ["asset"], F.col("raw").isNull(), "longest_gap")


@query("panel_ffill_bounded", f"SELECT date, asset, {R('raw', 'price')} FROM filled")
def panel_ffill_bounded(spark, d):
    return _r(_panel(spark, d), "date", "asset", "raw", "price")


@query("panel_complete_dates", "SELECT DISTINCT date FROM complete")
def panel_complete_dates(spark, d):
    return P.complete(_panel(spark, d)).select("date").distinct()


@query("dedup_keep_last", "SELECT date_trunc('hour', ts) AS hour, event_type, arg_max(event_id, event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2")
def dedup_keep_last(spark, d):
    e = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("hour"), "event_type", "event_id", "value").withColumn("seq", F.col("event_id"))
    return _r(keep_last(e, ["hour", "event_type"], "seq").select("hour", "event_type", "event_id", "value"))


_DAILY = (
    "SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS price"
    " FROM (SELECT d.date, a.asset, px.raw FROM (SELECT DISTINCT date FROM dpx) d CROSS"
    " JOIN (SELECT DISTINCT asset FROM dpx) a LEFT JOIN dpx px ON px.date = d.date AND px.asset = a.asset)"
)


@query("returns_daily", (
    f"SELECT date, asset, {R('ret')} FROM (SELECT date, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret"
    f" FROM (SELECT *, count(price) OVER (PARTITION BY date) AS have, count(*) OVER (PARTITION BY date) AS n"
    f" FROM ({_DAILY})) WHERE have = n) WHERE ret IS NOT NULL"
))
def returns_daily(spark, d):
    return _r(P.returns(P.complete(_panel(spark, d, "day")), exclude_imputed=False), "date", "asset", "ret")


@query("returns_endpoint_exclusion", f"SELECT date, asset, {R('ret')} FROM returns")
def returns_endpoint_exclusion(spark, d):
    return _r(_rets(spark, d), "date", "asset", "ret")


@query("split_is_oos", "SELECT segment, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM returns GROUP BY segment")
def split_is_oos(spark, d):
    return _rets(spark, d).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("zero_run_quality", f"SELECT asset, segment, n, {R('zero_rate', 'vol')}, max_zero_run FROM quality")
def zero_run_quality(spark, d):
    return _r(P.quality(_panel(spark, d), _rets(spark, d)), "asset", "segment", "n", "zero_rate", "vol", "max_zero_run")


@query("zero_run_quality_full", (
    f"SELECT asset, 'full' AS segment, count(*) AS n, round(avg(CASE WHEN ret = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0::DOUBLE AS zero_rate, round(stddev_pop(ret), 6) + 0.0::DOUBLE AS vol"
    f" FROM returns GROUP BY asset UNION ALL SELECT asset, segment, n, {R('zero_rate', 'vol')}"
    f" FROM quality"
))
def zero_run_quality_full(spark, d):
    return _r(P.quality(_panel(spark, d), P.with_full_segment(_rets(spark, d))), "asset", "segment", "n", "zero_rate", "vol")


@query("quality_flags_by_segment", (
    "SELECT asset, flag_is, flag_oos, flag_oos AND NOT flag_is AS deteriorates"
    " FROM (SELECT asset, coalesce(bool_or(bad) FILTER (segment = 'is'), FALSE) AS flag_is, coalesce(bool_or(bad) FILTER (segment = 'oos'), FALSE) AS flag_oos"
    " FROM (SELECT *, zero_rate > 0.03 OR max_zero_run > 5 AS bad FROM quality)"
    " GROUP BY asset)"
))
def quality_flags_by_segment(spark, d):
    return P.flags(P.quality(_panel(spark, d), _rets(spark, d)), 0.03, 5)


@query("universe_selection", (
    f"SELECT c.asset, reason = '' AS selected, reason, sum((reason = '')::INT) OVER () >= 2 AS enough, {R('zero_rate_oos', 'vol_oos')}"
    f" FROM (SELECT asset, concat_ws('+', CASE WHEN zero_rate > 0.03 THEN 'zero_rate' END, CASE WHEN max_zero_run > 5 THEN 'zero_run' END) AS reason"
    f" FROM quality WHERE segment = 'is') c LEFT JOIN (SELECT asset, zero_rate AS zero_rate_oos, vol AS vol_oos"
    f" FROM quality WHERE segment = 'oos') o USING (asset)"
))
def universe_selection(spark, d):
    return _r(P.universe(P.quality(_panel(spark, d), _rets(spark, d)), 0.03, 5))


@query("price_profile", f"SELECT asset, count(*) AS n_obs, {R('unique_ratio', 'low', 'high').replace('unique_ratio,', 'count(DISTINCT raw) / count(*)::DOUBLE,', 1).replace('low,', 'min(raw),', 1).replace('high,', 'max(raw),', 1)} FROM grid WHERE raw IS NOT NULL GROUP BY asset")
def price_profile(spark, d):
    return _r(P.price_profile(_panel(spark, d)))


@query("terminal_overlapping", f"SELECT segment, asset, date, rn, {R('tret')} FROM term")
def terminal_overlapping(spark, d):
    return _r(_term(spark, d), "segment", "asset", "date", "rn", "tret")


@query("terminal_nonoverlap", f"SELECT segment, asset, date, {R('tret')} FROM term WHERE is_nonoverlap")
def terminal_nonoverlap(spark, d):
    return _r(_term(spark, d).where("is_nonoverlap"), "segment", "asset", "date", "tret")


# weights and moments


@query("ewma_weights", "SELECT date, round(p, 9) AS p FROM weights WHERE model = 'ewma'")
def ewma_weights(spark, d):
    return M.ewma(_is(spark, d)).select("date", F.round("p", 9).alias("p"))


@query("effective_sample_size", f"SELECT model, {R('ess')} FROM (SELECT model, 1 / sum(p * p) AS ess FROM weights GROUP BY model)")
def effective_sample_size(spark, d):
    w = _scen(spark, d).select("model", "date", "p").distinct()
    return _r(w.groupBy("model").agg((1 / F.sum(F.col("p") * F.col("p"))).alias("ess")))


@query("entropy_kl_gini", (
    f"SELECT model, {R('ess', 'entropy', 'kl', 'gini')} FROM (SELECT model, 1 / sum(p * p) AS ess, -sum(p * ln(p)) AS entropy, sum(p * ln(p * n)) AS kl, 1 + 1 / max(n)::DOUBLE - 2 * avg(cum) AS gini"
    f" FROM (SELECT *, count(*) OVER (PARTITION BY model) AS n, sum(p) OVER (PARTITION BY model ORDER BY p, date ROWS UNBOUNDED PRECEDING) AS cum"
    f" FROM weights) GROUP BY model)"
))
def entropy_kl_gini(spark, d):
    return _r(M.concentration(_scen(spark, d).select("model", "date", "p").distinct(), ["model"]))


@query("topk_mass", f"SELECT model, {R('mass')} FROM (SELECT model, sum(p) AS mass FROM (SELECT model, p, row_number() OVER (PARTITION BY model ORDER BY p DESC, date) AS rn FROM weights) WHERE rn <= 20 GROUP BY model)")
def topk_mass(spark, d):
    w = _scen(spark, d).select("model", "date", "p").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("p"), "date")))
    return _r(w.where("rn <= 20").groupBy("model").agg(F.sum("p").alias("mass")))


@query("historical_scenarios", "SELECT model, asset, date, round(p, 9) AS p, round(x, 6) + 0.0::DOUBLE AS x FROM scen")
def historical_scenarios(spark, d):
    return _scen(spark, d).select("model", "asset", "date", F.round("p", 9).alias("p"), rounded("x").alias("x"))


@query("weighted_moments", "SELECT model, asset, round(m1, 8) AS m1, round(m2, 8) AS m2, round(m3, 8) AS m3, round(m4, 8) AS m4 FROM moments")
def weighted_moments(spark, d):
    return M.moments(_scen(spark, d), ["model", "asset"]).select("model", "asset", *[F.round(f"m{k}", 8).alias(f"m{k}") for k in range(1, 5)])


@query("skew_excess_kurtosis", f"SELECT model, asset, {R('skew', 'kurt')} FROM (SELECT model, asset, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM moments)")
def skew_excess_kurtosis(spark, d):
    m = M.moments(_scen(spark, d), ["model", "asset"])
    return _r(m.select("model", "asset", (F.col("m3") / F.pow("m2", F.lit(1.5))).alias("skew"), (F.col("m4") / (F.col("m2") * F.col("m2")) - 3).alias("kurt")))


@query("weighted_covariance", "SELECT model, asset_i, asset_j, round(value, 8) AS value FROM cov")
def weighted_covariance(spark, d):
    return M.covariance(_scen(spark, d), ["model"]).withColumn("value", F.round("value", 8))


_SHRINK = (
    "SELECT model, CASE WHEN sum(s * s) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, sum(noise) / sum(s * s))) END AS intensity"
    " FROM (SELECT model, asset_i, asset_j, max(s) AS s, sum(p * p * pow(di * dj - s, 2)) AS noise"
    " FROM (SELECT *, sum(p * di * dj) OVER (PARTITION BY model, asset_i, asset_j) AS s"
    " FROM pairs WHERE asset_i < asset_j) GROUP BY ALL) GROUP BY model"
)


@query("shrinkage_intensity", f"SELECT model, {R('intensity')} FROM ({_SHRINK})")
def shrinkage_intensity(spark, d):
    return _r(M.shrinkage(_scen(spark, d), ["model"]))


@query("shrunk_covariance", f"SELECT model, asset_i, asset_j, round(CASE WHEN asset_i = asset_j THEN value ELSE value * (1 - intensity) END, 8) + 0.0::DOUBLE AS value FROM cov JOIN ({_SHRINK}) USING (model)")
def shrunk_covariance(spark, d):
    s = _scen(spark, d)
    return M.shrunk(M.covariance(s, ["model"]), M.shrinkage(s, ["model"]), ["model"]).withColumn("value", rounded("value", 8))


@query("corr_matrix_oos", f"SELECT asset_i, asset_j, {R('rho')} FROM (SELECT a.asset AS asset_i, b.asset AS asset_j, corr(a.ret, b.ret) AS rho FROM returns a JOIN returns b ON a.date = b.date AND a.asset < b.asset WHERE a.segment = 'oos' GROUP BY 1, 2)")
def corr_matrix_oos(spark, d):
    r = _rets(spark, d).where("segment = 'oos'").select("date", "asset", F.col("ret").alias("d"), F.lit(1.0).alias("p"))
    return _r(M.pairs(r, []).where("asset_i < asset_j").groupBy("asset_i", "asset_j").agg(F.corr("di", "dj").alias("rho")))


_MM = """SELECT s.model, k::VARCHAR AS term, sum(CASE k WHEN 1 THEN 2.0 * pow((s.m1 - t.m1) / sqrt(t.m2), 2) WHEN 2 THEN 1.5 * pow((s.m2 - t.m2) / t.m2, 2) WHEN 3 THEN 0.5 * pow((s.m3 - t.m3) / pow(t.m2, 1.5), 2) ELSE 0.3 * pow((s.m4 - t.m4) / (t.m2 * t.m2), 2) END) AS f FROM moments s JOIN moments t ON t.model = 'ewma' AND s.asset = t.asset CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY 1, 2
    UNION ALL SELECT c.model, 'cov', sum(0.05 * pow((c.value - t.value) / greatest(sqrt(i.m2 * j.m2), 0.001), 2)) FROM cov c JOIN cov t ON t.model = 'ewma' AND c.asset_i = t.asset_i AND c.asset_j = t.asset_j JOIN moments i ON i.model = 'ewma' AND i.asset = c.asset_i JOIN moments j ON j.model = 'ewma' AND j.asset = c.asset_j WHERE c.asset_i < c.asset_j GROUP BY 1"""


@query("mm_objective_components", f"SELECT model, term, {R('f')} FROM ({_MM})")
def mm_objective_components(spark, d):
    from ..operators import dynamics as D

    s = _scen(spark, d)
    m = M.moments(s, ["model", "asset"])
    t = m.where("model = 'ewma'").select("asset", *[F.col(f"m{k}").alias(f"t{k}") for k in range(1, 5)])
    sd = F.sqrt("t2")
    parts = F.array(*[F.struct(F.lit(str(k)).alias("term"), (w * F.pow((F.col(f"m{k}") - F.col(f"t{k}")) / F.pow(sd, F.lit(float(k))), F.lit(2.0))).alias("f")) for k, w in enumerate(D.MOMENT_WEIGHTS, 1)])
    own = m.join(t, "asset").select("model", F.explode(parts).alias("e")).groupBy("model", F.col("e.term").alias("term")).agg(F.sum("e.f").alias("f"))
    c = cut(M.covariance(s, ["model"]))
    aim = c.where("model = 'ewma'").select("asset_i", "asset_j", F.col("value").alias("aim"))
    scale = lambda name: aim.where("asset_i = asset_j").select(F.col("asset_i").alias(name), F.sqrt("aim").alias(f"sd_{name}"))
    off = c.where("asset_i < asset_j").join(aim, ["asset_i", "asset_j"]).join(scale("asset_i"), "asset_i").join(scale("asset_j"), "asset_j")
    gap = (F.col("value") - F.col("aim")) / F.greatest(F.col("sd_asset_i") * F.col("sd_asset_j"), F.lit(D.COV_FLOOR))
    pair = off.groupBy("model").agg(F.sum(D.COV_WEIGHT * gap * gap).alias("f")).select("model", F.lit("cov").alias("term"), "f")
    return _r(own.unionByName(pair))


# scores


@query("var_quantile", f"SELECT model, asset, {R('var')} FROM var")
def var_quantile(spark, d):
    return _r(S.value_at_risk(_scen(spark, d), ["model", "asset"], ALPHA))


@query("expected_shortfall", f"SELECT model, asset, {R('es')} FROM (SELECT model, asset, sum(x * greatest(0.0::DOUBLE, least(p, 0.05::DOUBLE - (cum - p)))) / 0.05::DOUBLE AS es FROM cum GROUP BY 1, 2)")
def expected_shortfall(spark, d):
    return _r(S.expected_shortfall(_scen(spark, d), ["model", "asset"], ALPHA))


@query("crps_by_window", f"SELECT model, date, {R('mean_crps')} FROM (SELECT model, date, avg(crps) AS mean_crps FROM crps GROUP BY 1, 2)")
def crps_by_window(spark, d):
    return _r(S.crps(*_both(spark, d)).groupBy("model", "date").agg(F.avg("crps").alias("mean_crps")))


@query("energy_score_exact", f"SELECT model, date, {R('energy')} FROM energy")
def energy_score_exact(spark, d):
    return _r(S.energy(*_both(spark, d)))


@query("variogram_score", f"SELECT model, date, {R('variogram')} FROM variogram")
def variogram_score(spark, d):
    return _r(S.variogram(*_both(spark, d)))


@query("coverage_kupiec_lr", f"SELECT model, asset, n, hits, {R('lr_uc')} FROM kupiec")
def coverage_kupiec_lr(spark, d):
    return _r(S.kupiec(S.hits(*_both(spark, d), ALPHA), ALPHA))


@query("coverage_christoffersen_lr", f"SELECT model, asset, n00, n01, n10, n11, {R('lr_ind')} FROM christoffersen")
def coverage_christoffersen_lr(spark, d):
    return _r(S.christoffersen(S.hits(*_both(spark, d), ALPHA)))


@query("conditional_coverage_p", f"SELECT model, asset, {R('lr_cc', 'p_cc')} FROM (SELECT model, asset, lr_uc + lr_ind AS lr_cc, exp(-(lr_uc + lr_ind) / 2) AS p_cc FROM kupiec JOIN christoffersen USING (model, asset))")
def conditional_coverage_p(spark, d):
    h = S.hits(*_both(spark, d), ALPHA)
    lr = F.col("lr_uc") + F.col("lr_ind")
    return _r(S.kupiec(h, ALPHA).join(S.christoffersen(h), ["model", "asset"]).select("model", "asset", lr.alias("lr_cc"), F.exp(-lr / 2).alias("p_cc")))


def _pit(spark, d):
    from ..functions.expr import uniform

    r = S.ranked(*_both(spark, d))
    v = uniform(11, "pit", F.col("model"), F.col("asset"), F.col("date"))
    return r.select("model", "asset", "date", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("f_below") + v * (F.col("f") - F.col("f_below")))).alias("u"))


@query("pit_values", f"SELECT model, asset, date, {R('u')} FROM pit")
def pit_values(spark, d):
    return _r(_pit(spark, d))


@query("pit_histogram", "SELECT model, least(floor(round(u, 9) * 10), 9)::INT AS bin, count(*) AS n FROM pit GROUP BY 1, 2")
def pit_histogram(spark, d):
    return _pit(spark, d).groupBy("model", F.least(F.floor(F.round("u", 9) * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("pit_dispersion", f"SELECT model, asset, {R('ratio')}, CASE WHEN ratio > 1.05 THEN 'underdispersed' WHEN ratio < 0.95 THEN 'overdispersed' ELSE 'calibrated' END AS label FROM (SELECT model, asset, round(var_pop(u) * 12, 6) AS ratio FROM pit GROUP BY 1, 2)")
def pit_dispersion(spark, d):
    g = _pit(spark, d).groupBy("model", "asset").agg(F.round(F.var_pop("u") * 12, 6).alias("ratio"))
    return _r(g.withColumn("label", F.when(F.col("ratio") > 1.05, "underdispersed").when(F.col("ratio") < 0.95, "overdispersed").otherwise("calibrated")))


@query("ks_statistic", (
    f"SELECT model, asset, {R('ks')} FROM (SELECT model, asset, max(greatest(rn / n - u, u - (rn - 1) / n)) AS ks"
    f" FROM (SELECT *, row_number() OVER (PARTITION BY model, asset ORDER BY u, date)::DOUBLE AS rn, count(*) OVER (PARTITION BY model, asset) AS n"
    f" FROM pit) GROUP BY 1, 2)"
))
def ks_statistic(spark, d):
    u = value_sums(_pit(spark, d), ["model", "asset"], "u", {"own": F.lit(1.0)})
    n = u.groupBy("model", "asset").agg(F.max("own_upto").alias("n"))
    above, below = F.col("own_upto") / F.col("n") - F.col("u"), F.col("u") - (F.col("own_upto") - F.col("own")) / F.col("n")
    return _r(u.join(n, ["model", "asset"]).groupBy("model", "asset").agg(F.max(F.greatest(above, below)).alias("ks")))


# inference


def _scores(spark, d):
    return cut(S.crps(*_both(spark, d)).groupBy("model", "date").agg(F.avg("crps").alias("score")))


def _diff(spark, d):
    return cut(I.paired(_scores(spark, d), "ewma", "score"))


def _folded(spark, d):
    return _diff(spark, d).withColumn("fold", F.year("date"))


#: The differences as the makers of SQL want them.
_ONE = "SELECT benchmark, 0 AS seg, date, diff FROM diff"
_FOLD = "SELECT benchmark, year(date) AS seg, date, diff FROM diff"


@query("paired_differences", f"SELECT benchmark, date, {R('diff')} FROM diff")
def paired_differences(spark, d):
    return _r(_diff(spark, d))


@query("pooled_scores", f"SELECT model, {R('score')}, n FROM (SELECT model, avg(score) AS score, count(*) AS n FROM scores GROUP BY model)")
def pooled_scores(spark, d):
    return _r(_scores(spark, d).groupBy("model").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")))


@query("acf_pooled", f"SELECT benchmark, lag::INT AS lag, round(acov, 10) AS acov FROM ({O.acov_sql(_FOLD, 'benchmark', '3', True)})")
def acf_pooled(spark, d):
    return I.autocovariance(_folded(spark, d), ["benchmark"], 3, ["fold"]).select("benchmark", F.col("lag").cast("int").alias("lag"), F.round("acov", 10).alias("acov"))


@query("newey_west", f"SELECT benchmark, bw, n, round(lrv, 10) AS lrv FROM ({O.nw_sql(_ONE, 'benchmark')})")
def newey_west(spark, d):
    return I.newey_west(_diff(spark, d), ["benchmark"]).select("benchmark", "bw", "n", F.round("lrv", 10).alias("lrv"))


@query("newey_west_grouped", f"SELECT benchmark, bw, n, round(lrv, 10) AS lrv FROM ({O.nw_sql(_FOLD, 'benchmark', True)})")
def newey_west_grouped(spark, d):
    return I.newey_west(_folded(spark, d), ["benchmark"], ["fold"]).select("benchmark", "bw", "n", F.round("lrv", 10).alias("lrv"))


@query("newey_west_long", "SELECT asset, bw, n, round(lrv, 9) AS lrv FROM (" + O.nw_sql("SELECT event_type AS asset, 0 AS seg, event_id AS date, value AS diff FROM events", "asset") + ")")
def newey_west_long(spark, d):
    """The long-run variance of every event type's values: series whose automatic lag grows with their length."""
    e = table(spark, d, "events").select(F.col("event_type").alias("asset"), F.col("event_id").alias("date"), F.col("value").alias("diff"))
    return I.newey_west(e, ["asset"]).select("asset", "bw", "n", F.round("lrv", 9).alias("lrv"))


@query("dm_statistic", f"SELECT benchmark, {R('dm')} FROM ({O.dm_sql(_ONE, 'benchmark')})")
def dm_statistic(spark, d):
    return _r(I.diebold_mariano(I.newey_west(_diff(spark, d), ["benchmark"])), "benchmark", "dm")


@query("dm_pvalue", f"SELECT benchmark, {R('pvalue')} FROM ({O.dm_sql(_ONE, 'benchmark')})")
def dm_pvalue(spark, d):
    return _r(I.diebold_mariano(I.newey_west(_diff(spark, d), ["benchmark"])), "benchmark", "pvalue")


@query("politis_white_block", f"SELECT benchmark, n, m, bandwidth, {R('raw')}, block, capped FROM ({O.block_sql(_ONE, 'benchmark')})")
def politis_white_block(spark, d):
    return _blocks_out(I.block_length(_diff(spark, d), ["benchmark"]))


@query("politis_white_grouped", f"SELECT benchmark, n, m, bandwidth, {R('raw')}, block, capped FROM ({O.block_sql(_FOLD, 'benchmark', True)})")
def politis_white_grouped(spark, d):
    return _blocks_out(I.block_length(_folded(spark, d), ["benchmark"], ["fold"]))


def _blocks_out(b):
    return _r(b.select("benchmark", F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), F.col("bandwidth").cast("long").alias("bandwidth"), "raw", "block", "capped"))


_CI = f"SELECT benchmark, {R('mean_diff', 'ci_low', 'median', 'ci_high', 'pvalue', 'p_better')} FROM "


def _boot_sql(source: str, grouped: bool) -> str:
    return O.ci_sql(source, "benchmark", O.means_sql(source, "benchmark", O.sizes_sql(source, "benchmark", grouped), SAMPLES, SEED, "seg || '|' ||" if grouped else ""))


def _boot(diff, within=None):
    blocks = cut(I.resolved_blocks(diff, ["benchmark"], within))
    return I.bootstrap_ci(diff, I.block_means(diff, ["benchmark"], blocks, SAMPLES, SEED, within), ["benchmark"])


@query("block_bootstrap_ci", f"{_CI} ({_boot_sql(_ONE, False)})")
def block_bootstrap_ci(spark, d):
    return _r(_boot(_diff(spark, d)))


@query("grouped_block_bootstrap", f"{_CI} ({_boot_sql(_FOLD, True)})")
def grouped_block_bootstrap(spark, d):
    return _r(_boot(_folded(spark, d), ["fold"]))


@query("holm_adjust", f"SELECT benchmark, {R('pvalue', 'holm')} FROM ({O.holm_sql(_boot_sql(_ONE, False), '1', 'benchmark')})")
def holm_adjust(spark, d):
    return _r(I.holm(_boot(_diff(spark, d)).withColumn("one", F.lit(1)), ["one"], ["benchmark"]), "benchmark", "pvalue", "holm")


@query("holm_by_family", f"SELECT model, asset, {R('pvalue', 'holm')} FROM ({O.holm_sql('SELECT model, asset, round(exp(-(lr_uc + lr_ind) / 2), 9) AS pvalue FROM kupiec JOIN christoffersen USING (model, asset)', 'model', 'asset')})")
def holm_by_family(spark, d):
    h = S.hits(*_both(spark, d), ALPHA)
    p = S.kupiec(h, ALPHA).join(S.christoffersen(h), ["model", "asset"]).select("model", "asset", F.round(F.exp(-(F.col("lr_uc") + F.col("lr_ind")) / 2), 9).alias("pvalue"))
    return _r(I.holm(p, ["model"], ["asset"]), "model", "asset", "pvalue", "holm")


_LOSS = "SELECT model, 0 AS seg, date, score AS diff FROM scores"
_SET = O.means_sql(_LOSS, "model", O.sizes_sql(_LOSS, "model", fixed=4), SAMPLES, SEED)


@query("mcs_statistics", (
    f"SELECT model_i, model_j, {R('diff', 'sd', 't')} FROM (SELECT model_i, model_j, max(gap) AS diff, sqrt(avg(e * e)) AS sd, max(gap) / nullif(sqrt(avg(e * e)), 0) AS t"
    f" FROM (SELECT a.model AS model_i, b.model AS model_j, a.m - b.m AS gap, a.mean - b.mean - a.m + b.m AS e"
    f" FROM (SELECT * FROM ({_SET}) JOIN (SELECT model, avg(score) AS m FROM scores"
    f" GROUP BY 1) USING (model)) a JOIN (SELECT * FROM ({_SET}) JOIN (SELECT model, avg(score) AS m"
    f" FROM scores GROUP BY 1) USING (model)) b ON a.sample = b.sample AND a.model < b.model)"
    f" GROUP BY 1, 2)"
))
def mcs_statistics(spark, d):
    return _r(I.confidence_set_statistics(_scores(spark, d), "score", 4, SAMPLES, SEED))


@query("stability_ranks", (
    f"SELECT model, {R('mean_rank', 'median_rank')}, min_rank, max_rank, wins, folds"
    f" FROM (SELECT model, avg(rk) AS mean_rank, median(rk) AS median_rank, min(rk) AS min_rank, max(rk) AS max_rank, count(*) FILTER (rk = 1) AS wins, count(*) AS folds"
    f" FROM (SELECT model, fold, rank() OVER (PARTITION BY fold ORDER BY round(score, 9)) AS rk"
    f" FROM (SELECT model, year(date) AS fold, avg(score) AS score FROM scores"
    f" GROUP BY 1, 2)) GROUP BY model)"
))
def stability_ranks(spark, d):
    f = _scores(spark, d).groupBy("model", F.year("date").alias("fold")).agg(F.avg("score").alias("score"))
    r = f.withColumn("rk", F.rank().over(Window.partitionBy("fold").orderBy(F.round("score", 9))).cast("long"))
    return _r(r.groupBy("model").agg(F.avg("rk").alias("mean_rank"), F.median("rk").alias("median_rank"), F.min("rk").alias("min_rank"), F.max("rk").alias("max_rank"), F.count_if(F.col("rk") == 1).alias("wins"), F.count(F.lit(1)).alias("folds")))


@query("fold_excess", f"SELECT model, fold, {R('excess')} FROM (SELECT model, fold, score - min(score) OVER (PARTITION BY fold) AS excess FROM (SELECT model, year(date)::INT AS fold, avg(score) AS score FROM scores GROUP BY 1, 2))")
def fold_excess(spark, d):
    f = _scores(spark, d).groupBy("model", F.year("date").alias("fold")).agg(F.avg("score").alias("score"))
    return _r(f.select("model", "fold", (F.col("score") - F.min("score").over(Window.partitionBy("fold"))).alias("excess")))


_FOLDS = [(y, f"{y - 1}-12-31", f"{y}-01-01", f"{y}-12-31") for y in (1998, 1999, 2000, 2001)]


@query("fold_range_join", (
    "SELECT fold, role, asset, count(*) AS n, round(avg(ret), 6) + 0.0::DOUBLE AS mean"
    " FROM (SELECT f AS fold, CASE WHEN year(date) < f THEN 'train' ELSE 'evaluate' END AS role, asset, ret"
    " FROM returns JOIN (SELECT unnest([1998, 1999, 2000, 2001]) AS f) ON year(date) <= f)"
    " GROUP BY ALL"
))
def fold_range_join(spark, d):
    folds = spark.createDataFrame(_FOLDS, "fold int, train_end string, begin string, end string").select("fold", *[F.to_date(c).alias(c) for c in ("train_end", "begin", "end")])
    role = F.when(F.col("date") <= F.col("train_end"), "train").when(F.col("date").between(F.col("begin"), F.col("end")), "evaluate")
    # four configured rows
    j = _rets(spark, d).join(F.broadcast(folds), F.col("date") <= F.col("end")).withColumn("role", role).where("role is not null")
    return _r(j.groupBy("fold", "role", "asset").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean")))


@query("rank_comparison_outer", (
    f"SELECT model, rank_all, rank_late, rank_late - rank_all AS shift FROM (SELECT model, rank() OVER (ORDER BY round(avg(score), 9)) AS rank_all"
    f" FROM scores GROUP BY model) FULL JOIN (SELECT model, rank() OVER (ORDER BY round(avg(score), 9)) AS rank_late"
    f" FROM scores WHERE date >= DATE '2001-01-01' GROUP BY model) USING (model)"
))
def rank_comparison_outer(spark, d):
    s = _scores(spark, d)
    rk = lambda df, name: df.groupBy("model").agg(F.avg("score").alias("s")).select("model", F.rank().over(Window.orderBy(F.round("s", 9))).cast("long").alias(name))
    return rk(s, "rank_all").join(rk(s.where("date >= '2001-01-01'"), "rank_late"), "model", "outer").withColumn("shift", F.col("rank_late") - F.col("rank_all"))


# portfolio


@query("equal_inverse_variance", f"SELECT asset, {R('equal', 'inverse_variance')} FROM (SELECT asset, 1.0::DOUBLE / count(*) OVER () AS equal, (1 / v) / sum(1 / v) OVER () AS inverse_variance FROM (SELECT asset, var_pop(ret) AS v FROM returns WHERE segment = 'is' GROUP BY asset))")
def equal_inverse_variance(spark, d):
    return _r(B.closed_form(_rets(spark, d).where("segment = 'is'")))


@query("rebalance_calendar", "SELECT date_trunc('quarter', date)::DATE AS quarter, min(date) AS rebalance_date FROM returns WHERE segment = 'oos' GROUP BY 1")
def rebalance_calendar(spark, d):
    return B.calendar(_rets(spark, d).where("segment = 'oos'"))


def _walked(r):
    return B.walk_forward(r, B.calendar(r.where("segment = 'oos'")), 100)


@query("asof_training_cov", "SELECT rebalance_date, asset, n, round(var, 8) AS var, round(weight, 6) AS weight FROM schedule")
def asof_training_cov(spark, d):
    return _walked(_rets(spark, d)).select("rebalance_date", "asset", "n", F.round("var", 8).alias("var"), F.round("weight", 6).alias("weight"))


@query("schedule_anti_join", "SELECT DISTINCT rebalance_date FROM (SELECT rebalance_date FROM schedule UNION ALL SELECT rebalance_date + 1 FROM schedule) WHERE rebalance_date NOT IN (SELECT date FROM returns)")
def schedule_anti_join(spark, d):
    """Scheduled dates outside the calendar, of a schedule in which each rebalancing is followed by one a day later."""
    r = _rets(spark, d)
    s = _walked(r).select("rebalance_date")
    s = s.unionByName(s.select(F.date_add("rebalance_date", 1).alias("rebalance_date"))).distinct()
    return s.join(r.select(F.col("date").alias("rebalance_date")).distinct(), "rebalance_date", "left_anti")


def _plans(r):
    """(portfolio, rebalance_date, asset, weight): both closed-form portfolios, set once and walked forward."""
    oos = r.where("segment = 'oos'")
    s = _walked(r).withColumn("even", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("rebalance_date")))
    each = lambda inverse, even: F.explode(F.array(F.struct(F.lit(inverse).alias("portfolio"), F.col("weight").alias("weight")), F.struct(F.lit(even).alias("portfolio"), F.col("even").alias("weight")))).alias("e")
    walked = s.select("rebalance_date", "asset", each("WF_InverseVariance", "WF_EqualWeight"))
    once = B.closed_form(r.where("segment = 'is'")).select("asset", F.col("inverse_variance").alias("weight"), F.col("equal").alias("even")).crossJoin(oos.agg(F.min("date").alias("rebalance_date")))  # one row
    once = once.select("rebalance_date", "asset", each("InverseVariance", "EqualWeight"))
    return walked.unionByName(once).select("e.portfolio", "rebalance_date", "asset", "e.weight")


def _ledger(spark, d):
    r = _rets(spark, d)
    return cut(B.backtest(r.where("segment = 'oos'"), cut(_plans(r))))


@query("backtest_wealth", f"SELECT portfolio, date, {R('turnover', 'cost', 'wealth')} FROM ledger")
def backtest_wealth(spark, d):
    return _r(_ledger(spark, d))


@query("backtest_metrics", (
    f"SELECT portfolio, {R('final_wealth', 'cagr', 'volatility', 'sharpe', 'max_drawdown', 'turnover')}"
    f" FROM (SELECT portfolio, arg_max(wealth, date) AS final_wealth, pow(arg_max(wealth, date), 52.0::DOUBLE / count(*)) - 1 AS cagr, stddev_samp(r) * sqrt(52.0::DOUBLE) AS volatility, avg(r) / nullif(stddev_samp(r), 0) * sqrt(52.0::DOUBLE) AS sharpe, min(dd) AS max_drawdown, sum(turnover) AS turnover"
    f" FROM (SELECT *, wealth / max(wealth) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS dd"
    f" FROM ledger) GROUP BY portfolio)"
))
def backtest_metrics(spark, d):
    return _r(B.metrics(_ledger(spark, d), 52.0))


_HELD = (
    "SELECT 'equal' AS portfolio, asset, 1.0::DOUBLE / count(*) OVER () AS weight"
    " FROM (SELECT DISTINCT asset FROM returns WHERE segment = 'is') UNION ALL SELECT 'inverse_variance', asset, (1 / v) / sum(1 / v) OVER ()"
    " FROM (SELECT asset, var_pop(ret) AS v FROM returns WHERE segment = 'is'"
    " GROUP BY asset)"
)
_HELD_R = f"SELECT model, portfolio, date, max(p) AS p, sum(weight * x) AS r FROM scen JOIN ({_HELD}) USING (asset) GROUP BY 1, 2, 3"


@query(
    "portfolio_diagnostics",
    (
        f"SELECT model, portfolio, {R('expected_return', 'volatility', 'sharpe')}, 0.0::DOUBLE AS risk_free_rate, {R('lower_es', 'herfindahl', 'effective_assets', 'max_weight')}"
        f" FROM (SELECT model, portfolio, mean AS expected_return, sd AS volatility, mean / greatest(sd, 1e-15) AS sharpe, es AS lower_es, h AS herfindahl, 1 / h AS effective_assets, top AS max_weight"
        f" FROM (SELECT model, portfolio, max(mean) AS mean, sqrt(sum(p * pow(r - mean, 2))) AS sd"
        f" FROM (SELECT *, sum(p * r) OVER (PARTITION BY model, portfolio) AS mean"
        f" FROM ({_HELD_R})) GROUP BY 1, 2) JOIN (SELECT model, portfolio, sum(r * greatest(0.0::DOUBLE, least(p, 0.05::DOUBLE - (cum - p)))) / 0.05::DOUBLE AS es"
        f" FROM (SELECT *, sum(p) OVER (PARTITION BY model, portfolio ORDER BY r, date ROWS UNBOUNDED PRECEDING) AS cum"
        f" FROM ({_HELD_R})) GROUP BY 1, 2) USING (model, portfolio) JOIN (SELECT portfolio, sum(weight * weight) AS h, max(weight) AS top"
        f" FROM ({_HELD}) GROUP BY 1) USING (portfolio))"
    ),
)
def portfolio_diagnostics(spark, d):
    r = _rets(spark, d)
    w = B.closed_form(r.where("segment = 'is'")).select("asset", F.explode(F.array(F.struct(F.lit("equal").alias("portfolio"), F.col("equal").alias("weight")), F.struct(F.lit("inverse_variance").alias("portfolio"), F.col("inverse_variance").alias("weight")))).alias("e"))
    return _r(B.diagnostics(cut(w.select("e.portfolio", "asset", "e.weight")), _sets(P.terminal(r)), ALPHA))


@query("garch_variance_recursion", (
    "SELECT asset, round(0.1::DOUBLE * v0 * (1 - pow(0.85::DOUBLE, n)) / 0.15::DOUBLE + 0.05::DOUBLE * w + pow(0.85::DOUBLE, n) * v0, 8) AS next_variance"
    " FROM (SELECT asset, max(v0) AS v0, max(n) AS n, sum(pow(0.85::DOUBLE, n - rn) * e * e) AS w"
    " FROM (SELECT asset, ret - avg(ret) OVER (PARTITION BY asset) AS e, var_pop(ret) OVER (PARTITION BY asset) AS v0, count(*) OVER (PARTITION BY asset) AS n, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn"
    " FROM returns WHERE segment = 'is') GROUP BY asset)"
))
def garch_variance_recursion(spark, d):
    w = Window.partitionBy("asset")
    r = _rets(spark, d).where("segment = 'is'").withColumn("e", F.col("ret") - F.avg("ret").over(w)).withColumn("v0", F.var_pop("ret").over(w))
    g = r.groupBy("asset").agg(F.max("v0").alias("v0"), F.transform(F.sort_array(F.collect_list(F.struct("date", "e"))), lambda s: s["e"]).alias("e"))
    step = F.aggregate("e", F.col("v0"), lambda v, e: 0.1 * F.col("v0") + 0.05 * e * e + 0.85 * v)
    return g.select("asset", F.round(step, 8).alias("next_variance"))


def _wide(pdf):
    x = pdf.pivot(index="date", columns="asset", values="x").sort_index()
    return x, pdf.groupby("date")["p"].first().loc[x.index].to_numpy()


#: Columns of each table whose text is the same in every engine.
_PRINTED = {"orders": ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"], "customer": ["c_custkey", "c_name", "c_nationkey"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"]}


@query("lineage_fingerprint", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws('|', '7', 'row', {', '.join(f'coalesce({c}::VARCHAR, chr(0))' for c in cols)})), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM {t}" for t, cols in _PRINTED.items()))
def lineage_fingerprint(spark, d):
    """Rows and the sum of row hashes of each table: order and layout do not matter, and equal rows count each."""
    from functools import reduce

    from ..functions.expr import hash32

    parts = []
    for name, cols in _PRINTED.items():
        row = hash32(SEED, "row", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])
        parts.append(table(spark, d, name).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).alias("fingerprint")).withColumn("name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)
