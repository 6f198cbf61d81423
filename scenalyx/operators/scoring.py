"""Proper scores, tail measures, coverage tests and calibration from sums over sorted values.

Scenarios are (model, asset, date, p, x), observations (asset, date, y). Defined
cases: equal scenario values share their probability at that value; an observation
equal to the value at risk is no hit; an asset with one observation has no
transition, and its independence ratio is 0; scenarios without observations, and
observations without scenarios, have no scores; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import value_sums


def cumulative(scen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, p, cum): each distinct value with its probability and that up to and with it."""
    return value_sums(scen, keys, "x", {"p": F.col("p")}).select(*keys, "x", "p", F.col("p_upto").alias("cum"))


def value_at_risk(scen: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Smallest x with cumulative probability of alpha or more."""
    return cumulative(scen, keys).where(F.round("cum", 12) >= alpha).groupBy(*keys).agg(F.min("x").alias("var"))


def expected_shortfall(scen: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Mean of the lower tail of mass alpha, with the fraction of the scenario that alpha cuts."""
    return cumulative(scen, keys).groupBy(*keys).agg(_tail_mean(alpha).alias("es"))


def tail(scen: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """(keys, var, es): both of one pass over the sorted values."""
    reached = F.when(F.round("cum", 12) >= alpha, F.col("x"))
    return cumulative(scen, keys).groupBy(*keys).agg(F.min(reached).alias("var"), _tail_mean(alpha).alias("es"))


def _tail_mean(alpha: float) -> Column:
    """Over (x, p, cum); a value that several scenarios share is cut like one of their joint probability."""
    take = F.greatest(F.lit(0.0), F.least(F.col("p"), F.lit(alpha) - (F.col("cum") - F.col("p"))))
    return F.sum(F.col("x") * take) / F.lit(alpha)


def distribution(scen: DataFrame, obs: DataFrame) -> DataFrame:
    """(model, asset, y, p, px, f, s): every value of scenarios and observations with its own and all lower probability, and their sums of p x."""
    models = scen.select("model").distinct()
    y = obs.join(F.broadcast(models)).select("model", "asset", "y", F.lit(0.0).alias("p"), F.lit(0.0).alias("px"))
    x = scen.select("model", "asset", F.col("x").alias("y"), "p", (F.col("p") * F.col("x")).alias("px"))
    d = value_sums(x.unionByName(y), ["model", "asset"], "y", {"p": F.col("p"), "px": F.col("px")})
    return d.withColumnsRenamed({"p_upto": "f", "px_upto": "s"})


def _at_observations(d: DataFrame, obs: DataFrame) -> DataFrame:
    total = d.groupBy("model", "asset").agg(F.sum("px").alias("total"))
    return obs.select("asset", "date", "y").join(d, ["asset", "y"]).join(total, ["model", "asset"]).select("model", "asset", "date", "y", "f", (F.col("f") - F.col("p")).alias("f_below"), "s", "total")


def ranked(scen: DataFrame, obs: DataFrame) -> DataFrame:
    """Per (model, asset, observation date): F(y), F(y-), S(y) and the mean.

    Replaces the scenarios x observations product: the values of both sides are sorted
    once, in ranges, and observations look theirs up.
    """
    return _at_observations(distribution(scen, obs), obs)


def crps(scen: DataFrame, obs: DataFrame) -> DataFrame:
    """(model, asset, date, crps); the half expected distance of two scenarios is a sum over the same sorted values."""
    d = distribution(scen, obs)
    below = F.col("y") * (F.col("f") - F.col("p")) - (F.col("s") - F.col("px"))
    half = d.groupBy("model", "asset").agg(F.sum(F.col("p") * below).alias("half"))
    r = _at_observations(d, obs).join(half, ["model", "asset"])
    first = F.col("y") * (2 * F.col("f") - 1) + F.col("total") - 2 * F.col("s")
    return r.select("model", "asset", "date", (first - F.col("half")).alias("crps"))


def _vectors(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("asset", value))), lambda s: s[value]).alias("v"))


def energy(scen: DataFrame, obs: DataFrame, salts: int | None = None, pairs: int | None = None, seed: int = 7) -> DataFrame:
    """(model, date, energy): scenario vectors meet observations by salted equi-join, the pair term is made once per model.

    Exact by default, in salts x salts cells of pairs. With ``pairs``, that many hashed draws of two scenarios per model
    (by their probabilities) stand for the pair term, whose work then does not grow with the square of the scenarios.
    """
    salts = salts or max(1, int(scen.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sv = scen.groupBy("model", "date").agg(F.first("p").alias("p"), F.transform(F.sort_array(F.collect_list(F.struct("asset", "x"))), lambda s: s["x"]).alias("v"))
    ov = _vectors(obs, ["date"], "y")
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    left = sv.withColumn("salt", F.pmod(F.hash("date"), F.lit(salts)))
    right = ov.select(F.col("date").alias("at"), F.col("v").alias("y"), salt)
    first = left.join(right, "salt").groupBy("model", "at").agg(F.sum(F.col("p") * dist(F.col("v"), F.col("y"))).alias("first"))
    second = _pair_draws(sv, dist, pairs, seed) if pairs else _pair_cells(sv, dist, max(1, round(salts**0.5)))
    # a set of one scenario has no pairs
    half = F.coalesce("half", F.lit(0.0))
    return first.join(second, "model", "left").select("model", F.col("at").alias("date"), (F.col("first") - half).alias("energy"))


def _pair_cells(sv: DataFrame, dist, side: int) -> DataFrame:
    """(model, half): every pair of scenarios, in side x side cells of a model, each with a share of either side."""
    mine = F.pmod(F.hash("date"), F.lit(side))
    every = F.sequence(F.lit(0), F.lit(side - 1))
    a = sv.select("model", "date", "p", "v", mine.alias("i"), F.explode(every).alias("j"))
    b = sv.select("model", F.col("date").alias("d2"), F.col("p").alias("p2"), F.col("v").alias("v2"), F.explode(every).alias("i"), mine.alias("j"))
    return a.join(b, ["model", "i", "j"]).where("date < d2").groupBy("model").agg(F.sum(F.col("p") * F.col("p2") * dist(F.col("v"), F.col("v2"))).alias("half"))


def _pair_draws(sv: DataFrame, dist, pairs: int, seed: int) -> DataFrame:
    """(model, half) from draws of two scenarios each."""
    from ..functions.expr import uniform
    from .models import drawn

    draws = sv.select("model").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    sides = []
    for k, name in enumerate(("one", "two")):
        u = draws.withColumn("u", uniform(seed, f"pair{k}", F.col("model"), F.col("draw")))
        sides.append(drawn(sv, u, ["model"], "date").select("model", "draw", F.col("v").alias(name)))
    return sides[0].join(sides[1], ["model", "draw"]).groupBy("model").agg((F.avg(dist(F.col("one"), F.col("two"))) / 2).alias("half"))


def observation_scores(scen: DataFrame, obs: DataFrame, pairs: int | None = None, seed: int = 7) -> DataFrame:
    """(model, date, mean_crps, energy, variogram) of every observation date; the energy's pair term exact, or from so many draws."""
    by_date = crps(scen, obs).groupBy("model", "date").agg(F.avg("crps").alias("mean_crps"))
    return by_date.join(energy(scen, obs, pairs=pairs, seed=seed), ["model", "date"]).join(variogram(scen, obs), ["model", "date"])


def long_scores(frame: DataFrame) -> DataFrame:
    """(metric, model, date, score) of a score frame."""
    return frame.unpivot([c for c in frame.columns if c not in ("mean_crps", "energy", "variogram")], ["mean_crps", "energy", "variogram"], "metric", "score")


def weighted_correlation(scen: DataFrame) -> DataFrame:
    """(model, asset_i, asset_j, rho) for asset_i < asset_j."""
    from .moments import covariance

    c = covariance(scen, ["model"])
    own = c.where("asset_i = asset_j")
    sd = lambda name: own.select("model", F.col("asset_i").alias(name), F.sqrt("value").alias(f"sd_{name}"))
    off = c.where("asset_i < asset_j").join(sd("asset_i"), ["model", "asset_i"]).join(sd("asset_j"), ["model", "asset_j"])
    return off.select("model", "asset_i", "asset_j", F.try_divide(F.col("value"), F.col("sd_asset_i") * F.col("sd_asset_j")).alias("rho"))


def marginal_table(scen: DataFrame, obs: DataFrame, alpha: float) -> DataFrame:
    """(model, asset, crps, var, es, n, hits, rate, lr and p of unconditional, independent and conditional coverage)."""
    from ..functions.expr import chi2_tail

    keys = ["model", "asset"]
    h = hits(scen, obs, alpha)
    out = crps(scen, obs).groupBy(*keys).agg(F.avg("crps").alias("crps"))
    for part in (tail(scen, keys, alpha), kupiec(h, alpha), christoffersen(h).select(*keys, "lr_ind")):
        out = out.join(part, keys)
    cc = F.col("lr_uc") + F.col("lr_ind")
    return out.select(*keys, "crps", "var", "es", "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), "lr_uc", chi2_tail(F.col("lr_uc")).alias("p_uc"), "lr_ind", chi2_tail(F.col("lr_ind")).alias("p_ind"), cc.alias("lr_cc"), F.exp(-cc / 2).alias("p_cc"))


def aggregate_table(marginal: DataFrame, scores: DataFrame, rho: DataFrame, rho_oos: DataFrame) -> DataFrame:
    """One row a model: mean scores, distance of the correlations from those observed, mean hit rate, rejections at 5 %."""
    m = marginal.groupBy("model").agg(F.avg("crps").alias("mean_crps"), F.avg("rate").alias("mean_exceedance_rate"), F.count_if(F.col("p_uc") < 0.05).alias("coverage_rejections"))
    s = scores.groupBy("model").agg(F.avg("energy").alias("energy"), F.avg("variogram").alias("variogram"))
    seen = rho_oos.select("asset_i", "asset_j", F.col("rho").alias("seen"))
    c = rho.join(seen, ["asset_i", "asset_j"]).groupBy("model").agg(F.avg(F.abs(F.col("rho") - F.col("seen"))).alias("correlation_mae"))
    return m.join(s, "model").join(c, "model", "left")


def variogram(scen: DataFrame, obs: DataFrame) -> DataFrame:
    """(model, date, variogram): squared gaps of root absolute differences; the expectations are made once per model."""

    def asset_pairs(df, keys, value):
        vec = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("asset", F.col(value).alias("v")))).alias("a"))
        one = vec.select(*keys, "a", F.explode("a").alias("i"))
        two = one.select(*keys, "i", F.explode("a").alias("j")).where("i.asset < j.asset")
        return two.select(*keys, F.col("i.asset").alias("ai"), F.col("j.asset").alias("aj"), F.sqrt(F.abs(F.col("i.v") - F.col("j.v"))).alias("g"))

    e = asset_pairs(scen, ["model", "date", "p"], "x").groupBy("model", "ai", "aj").agg(F.sum(F.col("p") * F.col("g")).alias("e"))
    y = asset_pairs(obs, ["date"], "y")
    return y.join(e, ["ai", "aj"]).groupBy("model", "date").agg(F.sum((F.col("g") - F.col("e")) * (F.col("g") - F.col("e"))).alias("variogram"))


def hits(scen: DataFrame, obs: DataFrame, alpha: float) -> DataFrame:
    """(model, asset, date, hit): observation strictly below the value at risk."""
    v = value_at_risk(scen, ["model", "asset"], alpha)
    return obs.join(v, "asset").select("model", "asset", "date", (F.col("y") < F.col("var")).cast("int").alias("hit"))


def _xlogy(n, p):
    return F.when(n > 0, n * F.log(F.greatest(p, F.lit(1e-12)))).otherwise(0.0)


def kupiec(h: DataFrame, alpha: float) -> DataFrame:
    """Likelihood ratio of unconditional coverage."""
    a = h.groupBy("model", "asset").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("hit").cast("double").alias("k"))
    n, k = F.col("n"), F.col("k")
    rate = k / n
    null = _xlogy(k, F.lit(alpha)) + _xlogy(n - k, F.lit(1 - alpha))
    full = _xlogy(k, rate) + _xlogy(n - k, 1 - rate)
    return a.select("model", "asset", n.cast("long").alias("n"), k.cast("long").alias("hits"), (2 * (full - null)).alias("lr_uc"))


def christoffersen(h: DataFrame) -> DataFrame:
    """Likelihood ratio of independence from counts of transitions."""
    t = h.withColumn("prev", F.lag("hit").over(Window.partitionBy("model", "asset").orderBy("date")))
    cell = lambda a, b: F.count_if((F.col("prev") == a) & (F.col("hit") == b)).cast("double").alias(f"n{a}{b}")
    c = t.groupBy("model", "asset").agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))
    n00, n01, n10, n11 = (F.col(x) for x in ("n00", "n01", "n10", "n11"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pi, p0, p1 = share(n01 + n11, n00 + n01 + n10 + n11), share(n01, n00 + n01), share(n11, n10 + n11)
    null = _xlogy(n00 + n10, 1 - pi) + _xlogy(n01 + n11, pi)
    full = _xlogy(n00, 1 - p0) + _xlogy(n01, p0) + _xlogy(n10, 1 - p1) + _xlogy(n11, p1)
    return c.select("model", "asset", *[F.col(x).cast("long").alias(x) for x in ("n00", "n01", "n10", "n11")], (2 * (full - null)).alias("lr_ind"))
