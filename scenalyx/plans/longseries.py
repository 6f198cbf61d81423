"""Queries over the events table: series of all rows, which no task holds whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density as K
from ..operators import inference as I
from ..operators import moments as M
from ..operators import ordered as D
from ..operators import portfolio as B
from ..operators import scoring as S
from ..runtime import cut
from ..sources.tables import table
from . import oracle_base as O
from .catalogue import ALPHA, SEED, R, _r, _rets, _scen, query

#: Samples of the bootstrap of one series of all events; its blocks are one or two events long.
LONG_SAMPLES = 200


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("asset"), F.col("event_id").alias("date"), F.col("value"), "ts")


def _values(spark, d):
    """Every event type's values as one scenario set of equal weights."""
    e = _events(spark, d)
    n = e.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    return e.join(n, "asset").select(F.lit("events").alias("model"), "asset", "date", (1.0 / F.col("n")).alias("p"), F.col("value").alias("x"))


@query(
    "long_running_sum",
    """
SELECT event_type AS asset, event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS total,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place
FROM events""",
)
def long_running_sum(spark, d):
    """Each event's place among those of its type, and the sum of values up to it."""
    s = D.running_sums(_events(spark, d), ["asset"], ["date"], {"total": F.col("value"), "place": F.lit(1.0)})
    return s.select("asset", F.col("date").alias("event_id"), F.round("total", 4).alias("total"), F.col("place").cast("long").alias("place"))


@query(
    "long_tail_risk",
    f"""
WITH own AS (SELECT event_type AS asset, event_id, value AS x, 1.0::DOUBLE / count(*) OVER (PARTITION BY event_type) AS p FROM events),
c AS (SELECT *, sum(p) OVER (PARTITION BY asset ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM own)
SELECT asset, {R("var", "es")}
FROM (
  SELECT asset, min(x) FILTER (round(cum, 9) >= {ALPHA}) AS var, sum(x * greatest(0, least(p, {ALPHA} - (cum - p)))) / {ALPHA} AS es
  FROM c GROUP BY asset)""",
)
def long_tail_risk(spark, d):
    """Value at risk and expected shortfall of each type's values."""
    return _r(S.tail(_values(spark, d), ["asset"], ALPHA), "asset", "var", "es")


@query(
    "long_crps",
    f"""
SELECT * FROM (
WITH daily AS (SELECT event_type AS asset, ts::DATE AS date, avg(value) AS y FROM events GROUP BY 1, 2),
ranks AS (SELECT event_type AS asset, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
half AS (SELECT asset, sum((2 * i - n - 1) * x) / max(n) / max(n) AS half FROM ranks GROUP BY asset),
firsts AS (SELECT asset, date, avg(abs(value - y)) AS first FROM daily JOIN events ON event_type = asset GROUP BY 1, 2)
SELECT asset, date, {R("crps")} FROM (SELECT asset, date, first - half AS crps FROM firsts JOIN half USING (asset)))""",
)
def long_crps(spark, d):
    """Every day's mean value scored against the distribution of all values of its type."""
    y = _events(spark, d).groupBy("asset", F.to_date("ts").alias("date")).agg(F.avg("value").alias("y"))
    return _r(S.crps(cut(_values(spark, d)), cut(y)).select("asset", "date", "crps"))


_BY_TYPE = "SELECT event_type AS asset, 0 AS seg, event_id AS date, value AS diff FROM events"
_ALL = "SELECT 'all' AS asset, 0 AS seg, event_id AS date, value AS diff FROM events"


@query("long_block_length", f"SELECT asset, n, m, bandwidth, round(raw, 4) AS raw, block, capped FROM ({O.block_sql(_BY_TYPE, 'asset')})")
def long_block_length(spark, d):
    """The automatic block length of each type's values, from lags up to about the root of their number."""
    b = I.block_length(_events(spark, d).select("asset", "date", F.col("value").alias("diff")), ["asset"])
    return b.select("asset", *(F.col(c).cast("long").alias(c) for c in ("n", "m", "bandwidth")), F.round("raw", 4).alias("raw"), "block", "capped")


_LONG_MEANS = O.means_sql(_ALL, "asset", O.sizes_sql(_ALL, "asset"), LONG_SAMPLES, SEED)


@query("long_block_bootstrap", f"SELECT asset, {R('mean_diff', 'ci_low', 'median', 'ci_high')} FROM ({O.ci_sql(_ALL, 'asset', _LONG_MEANS)})")
def long_block_bootstrap(spark, d):
    """Interval of the mean of all events' values, from moving blocks of one series."""
    diff = cut(_events(spark, d).select(F.lit("all").alias("asset"), "date", F.col("value").alias("diff")))
    blocks = cut(I.resolved_blocks(diff, ["asset"]))
    ci = I.bootstrap_ci(diff, I.block_means(diff, ["asset"], blocks, LONG_SAMPLES, SEED), ["asset"])
    # values have two digits, so a figure may lie halfway between two that are shown: it is told to ten digits first
    return _r(ci.select("asset", *(F.round(c, 10).alias(c) for c in ("mean_diff", "ci_low", "median", "ci_high"))))


GRID, WIDTH = 64, 0.3


def _density_sql(source: str, keys: str) -> str:
    """Every value's two shares of the grid, summed at every point directly; source has (keys, x, w)."""
    by = f"PARTITION BY {keys}"
    return f"""
SELECT * FROM (
WITH v AS (
  SELECT *, sum(w * x) OVER ({by}) / sum(w) OVER ({by}) AS mean, sum(w) OVER ({by}) AS total, sum(w * w) OVER ({by}) AS squares, min(x) OVER ({by}) AS low, max(x) OVER ({by}) AS high
  FROM ({source})),
h AS (SELECT *, {WIDTH} * sqrt(sum(w * pow(x - mean, 2)) OVER ({by}) / total / (1 - squares / total / total)) AS width, (high - low) / {GRID - 1} AS step FROM v),
b AS (SELECT *, least(floor((x - low) / step), {GRID - 2}) AS bin, (x - low) / step - least(floor((x - low) / step), {GRID - 2}) AS part FROM h),
p AS (
  SELECT {keys}, point, max(low) + point * max(step) AS x,
    sum(w / total * ((1 - part) * exp(-pow((point - bin) * step / width, 2) / 2) + part * exp(-pow((point - bin - 1) * step / width, 2) / 2)) / width / sqrt(2 * pi())) AS density
  FROM b CROSS JOIN range(0, {GRID}) g(point) GROUP BY {keys}, point)
SELECT {keys}, point::INT AS point, {R("x", "density")} FROM p)"""


@query("scenario_density", _density_sql("SELECT model, asset, x, p AS w FROM scen WHERE p > 0", "model, asset"))
def scenario_density(spark, d):
    """Density of every asset's scenario values, as the marginal panels draw it."""
    values = _scen(spark, d).select("model", "asset", "x", F.col("p").alias("w"))
    return _r(K.density(values, ["model", "asset"], GRID, WIDTH))


@query("long_density", _density_sql("SELECT event_type AS asset, value AS x, 1.0::DOUBLE AS w FROM events", "asset"))
def long_density(spark, d):
    """Density of the values of all events of each type."""
    return _r(K.density(_events(spark, d).select("asset", F.col("value").alias("x"), F.lit(1.0).alias("w")), ["asset"], GRID, WIDTH))


@query(
    "expanding_covariance",
    f"""
SELECT m.rebalance_date, x.asset AS asset_i, y.asset AS asset_j, count(*) AS n, round(avg(x.ret), 8) AS mean_i, round(avg(y.ret), 8) AS mean_j, round(covar_pop(x.ret, y.ret), 9) AS cov
FROM (SELECT min(date) AS rebalance_date FROM returns WHERE segment = 'oos' GROUP BY date_trunc('quarter', date)) m
JOIN returns x ON x.date < m.rebalance_date JOIN returns y ON x.date = y.date AND x.asset <= y.asset
GROUP BY ALL""",
)
def expanding_covariance(spark, d):
    """Covariances of all pairs before every rebalancing, from merged periods."""
    r = _rets(spark, d)
    found = M.expanding_covariance(r, B.calendar(r.where("segment = 'oos'")))
    return found.select("rebalance_date", "asset_i", "asset_j", "n", F.round("mean_i", 8).alias("mean_i"), F.round("mean_j", 8).alias("mean_j"), F.round("cov", 9).alias("cov"))
