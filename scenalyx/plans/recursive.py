"""Queries over recursions and profiles: likelihoods at fixed points beside their SQL, and fits made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as L
from ..operators import recursions as R
from ..runtime import cut
from ..sources.tables import table
from .catalogue import R as rounds
from .catalogue import _r, _rets, _scen, query

#: News and memory at which likelihoods are compared.
POINTS = ((0.05, 0.9), (0.1, 0.85), (0.2, 0.75))
DEGREES = (5.0, 8.0, 15.0, 40.0)


def _at(levels: DataFrame) -> DataFrame:
    return levels.withColumn("a", F.array(*[F.lit(a) for a, _ in POINTS])).withColumn("b", F.array(*[F.lit(b) for _, b in POINTS]))


def _residuals(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, date, x): one value about its mean a day."""
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("m"))
    return rows.join(mean, keys).select(*keys, "date", F.array(F.col(value) - F.col("m")).alias("x"))


def _weekly(spark, d):
    return cut(_residuals(_rets(spark, d).where("segment = 'is'"), ["asset"], "ret"))


def _garch_sql(source: str) -> str:
    """asset, point, loss, next_variance; source has (asset, date, v). The state is a sum of earlier squares in powers of the memory."""
    points = ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(POINTS))
    return f"""
SELECT * FROM (
WITH points AS (SELECT * FROM (VALUES {points}) t(point, a, b)),
e AS (
  SELECT asset, v - avg(v) OVER w AS e, var_pop(v) OVER w AS level, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS t, count(*) OVER w AS n
  FROM ({source}) WINDOW w AS (PARTITION BY asset)),
s AS (
  SELECT *, coalesce(sum(pow(b, -t) * e * e) OVER (PARTITION BY asset, point ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM e CROSS JOIN points),
states AS (
  SELECT *, (1 - a - b) * level * (1 - pow(b, t)) / (1 - b) + pow(b, t) * level + a * pow(b, t - 1) * earlier AS h FROM s)
SELECT asset, point, {rounds("loss", "next_variance")}
FROM (
  SELECT asset, point, sum(ln(h) + e * e / h) AS loss, max(CASE WHEN t = n - 1 THEN (1 - a - b) * level + a * e * e + b * h END) AS next_variance
  FROM states GROUP BY asset, point))"""


def _garch_out(blocks: DataFrame, levels: DataFrame) -> DataFrame:
    found = R.likelihood(blocks, _at(levels), ["asset"])
    return _r(found.select("asset", "point", "loss", F.col("next")[0].alias("next_variance")))


@query("garch_likelihood", _garch_sql("SELECT asset, date, ret AS v FROM returns WHERE segment = 'is'"))
def garch_likelihood(spark, d):
    """Loss of three points of the variance recursion for every asset's weekly returns, and the variance after the last."""
    rows = _weekly(spark, d)
    return _garch_out(R.packed(rows, ["asset"]), R.mean_products(rows, ["asset"], 1))


@query("long_garch_likelihood", _garch_sql("SELECT event_type AS asset, event_id AS date, value AS v FROM events"))
def long_garch_likelihood(spark, d):
    """The same over the values of all events of each type."""
    e = table(spark, d, "events").select(F.col("event_type").alias("asset"), F.col("event_id").alias("date"), "value")
    rows = cut(_residuals(e, ["asset"], "value"))
    return _garch_out(R.packed(rows, ["asset"]), R.mean_products(rows, ["asset"], 1))


@query("garch_fit")
def garch_fit(spark, d):
    """News, memory and next variance of every asset by quasi-likelihood."""
    rows = _weekly(spark, d)
    found = R.fit(R.packed(rows, ["asset"]), R.mean_products(rows, ["asset"], 1), ["asset"])
    return found.select("asset", F.col("a").alias("alpha"), F.col("b").alias("beta"), F.col("next")[0].alias("next_variance"))


_PAIR_POINTS = ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(POINTS))


@query(
    "dcc_pair_likelihood",
    f"""
SELECT * FROM (
WITH points AS (SELECT * FROM (VALUES {_PAIR_POINTS}) t(point, a, b)),
z AS (
  SELECT asset, date, (ret - avg(ret) OVER w) / stddev_pop(ret) OVER w AS z
  FROM returns WHERE segment = 'is' WINDOW w AS (PARTITION BY asset)),
pairs AS (
  SELECT x.asset AS asset_i, y.asset AS asset_j, x.z AS zi, y.z AS zj, row_number() OVER (PARTITION BY x.asset, y.asset ORDER BY x.date) - 1 AS t
  FROM z x JOIN z y ON x.date = y.date AND x.asset < y.asset),
base AS (SELECT asset_i, asset_j, avg(zi * zi) AS lii, avg(zi * zj) AS lij, avg(zj * zj) AS ljj FROM pairs GROUP BY ALL),
s AS (
  SELECT *, coalesce(sum(pow(b, -t) * zi * zi) OVER w, 0) AS eii, coalesce(sum(pow(b, -t) * zi * zj) OVER w, 0) AS eij, coalesce(sum(pow(b, -t) * zj * zj) OVER w, 0) AS ejj
  FROM pairs JOIN base USING (asset_i, asset_j) CROSS JOIN points
  WINDOW w AS (PARTITION BY asset_i, asset_j, point ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (
  SELECT *, (1 - a - b) * (1 - pow(b, t)) / (1 - b) + pow(b, t) AS own, a * pow(b, t - 1) AS news FROM s),
r AS (
  SELECT *, (own * lij + news * eij) / sqrt((own * lii + news * eii) * (own * ljj + news * ejj)) AS rho FROM q)
SELECT asset_i, asset_j, point, {rounds("loss")}
FROM (
  SELECT asset_i, asset_j, point, sum(ln(1 - rho * rho) + (zi * zi - 2 * rho * zi * zj + zj * zj) / (1 - rho * rho) - zi * zi - zj * zj) AS loss
  FROM r GROUP BY ALL))""",
)
def dcc_pair_likelihood(spark, d):
    """Loss of three points of the correlation recursion for every pair of assets."""
    r = _rets(spark, d).where("segment = 'is'")
    own = r.groupBy("asset").agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("sd"))
    z = cut(r.join(own, "asset").select("asset", "date", ((F.col("ret") - F.col("m")) / F.col("sd")).alias("z")))
    # rows of one date meet in an aggregate, not in a join
    days = z.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("asset", "z"))).alias("v"))
    i = days.select("date", "v", F.explode("v").alias("i"))
    pairs = i.select("date", "i", F.explode("v").alias("j")).where("i.asset < j.asset")
    keys = ["asset_i", "asset_j"]
    rows = cut(pairs.select(F.col("i.asset").alias("asset_i"), F.col("j.asset").alias("asset_j"), "date", F.array("i.z", "j.z").alias("x")))
    found = R.likelihood(R.packed(rows, keys), _at(R.mean_products(rows, keys, 2)), keys)
    return _r(found.select(*keys, "point", "loss"))


@query("dcc_fit")
def dcc_fit(spark, d):
    """Variance recursions of all assets, the recursion of the correlations of what they leave, and the degrees of freedom of that.

    No task holds more than a block of days; the assets of a day are one row.
    """
    rows = _weekly(spark, d)
    blocks, keys = R.packed(rows, ["asset"]), ["asset"]
    garch = R.fit(blocks, R.mean_products(rows, keys, 1), keys)
    from ..operators.ordered import placed

    days = placed(rows.select("asset", "date", F.col("x")[0].alias("e")), keys, ["date"])
    z = R.paths(blocks, garch, keys).join(days, ["asset", "rn"]).select("asset", "date", (F.col("e") / F.sqrt(F.col("state")[0])).alias("z"))
    one = F.lit(1).alias("set")
    wide = cut(z.groupBy("date").agg(F.transform(F.sort_array(F.collect_list(F.struct("asset", "z"))), lambda s: s["z"]).alias("x")).select(one, "date", "x"))
    assets = garch.count()
    level = cut(R.mean_products(wide, ["set"], assets))
    joint = R.fit(R.packed(wide, ["set"]), level, ["set"])
    df = L.fit(wide.select("set", F.lit(1.0).alias("p"), "x"), ["set"], assets)
    both = joint.select("a", "b").crossJoin(df.select("df"))  # a row each
    return garch.select("asset", F.col("a").alias("alpha"), F.col("b").alias("beta"), F.col("next")[0].alias("next_variance")).crossJoin(F.broadcast(both))


_T_POINTS = ", ".join(f"({v}::DOUBLE)" for v in DEGREES)


@query(
    "pair_t_likelihood",
    f"""
SELECT * FROM (
WITH degrees AS (SELECT * FROM (VALUES {_T_POINTS}) t(df)),
pairs AS (
  SELECT x.model, x.asset AS asset_i, y.asset AS asset_j, x.p, x.x - sum(x.p * x.x) OVER w AS xi, y.x - sum(x.p * y.x) OVER w AS xj
  FROM scen x JOIN scen y ON x.model = y.model AND x.date = y.date AND x.asset < y.asset
  WINDOW w AS (PARTITION BY x.model, x.asset, y.asset)),
c AS (SELECT model, asset_i, asset_j, sum(p * xi * xi) AS cii, sum(p * xi * xj) AS cij, sum(p * xj * xj) AS cjj FROM pairs GROUP BY ALL),
d AS (
  SELECT *, (cjj * xi * xi - 2 * cij * xi * xj + cii * xj * xj) / (cii * cjj - cij * cij) AS d2, ln(cii * cjj - cij * cij) AS log_det
  FROM pairs JOIN c USING (model, asset_i, asset_j))
SELECT model, asset_i, asset_j, df, {rounds("loglik")}
FROM (
  SELECT model, asset_i, asset_j, df,
    lgamma((df + 2) / 2) - lgamma(df / 2) - ln(pi() * (df - 2)) - max(log_det) / 2 - (df + 2) / 2 * sum(p * ln(1 + d2 / (df - 2))) AS loglik
  FROM d CROSS JOIN degrees GROUP BY model, asset_i, asset_j, df))""",
)
def pair_t_likelihood(spark, d):
    """Profile likelihood of four degrees of freedom for every pair of assets of every scenario set."""
    days = _scen(spark, d).groupBy("model", "date").agg(F.first("p").alias("p"), F.sort_array(F.collect_list(F.struct("asset", "x"))).alias("v"))
    i = days.select("model", "date", "p", "v", F.explode("v").alias("i"))
    pairs = i.select("model", "p", "i", F.explode("v").alias("j")).where("i.asset < j.asset")
    keys = ["model", "asset_i", "asset_j"]
    rows = cut(pairs.select("model", F.col("i.asset").alias("asset_i"), F.col("j.asset").alias("asset_j"), "p", F.array("i.x", "j.x").alias("x")))
    grid = F.array(*[F.lit(v) for v in DEGREES])
    found = L.likelihood(L.distances(rows, keys, 2), keys, 2, rows.select(*keys).distinct().withColumn("dfs", grid), len(DEGREES))
    return _r(found, *keys, "df", "loglik")


@query("student_t_profile")
def student_t_profile(spark, d):
    """Degrees of freedom of every scenario set over all assets at once."""
    scen = _scen(spark, d)
    days = scen.groupBy("model", "date").agg(F.first("p").alias("p"), F.transform(F.sort_array(F.collect_list(F.struct("asset", "x"))), lambda s: s["x"]).alias("x"))
    return L.fit(cut(days.select("model", "p", "x")), ["model"], scen.select("asset").distinct().count())
