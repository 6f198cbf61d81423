"""Queries of the iterative estimators: a kernel runs once per model, asset, start or chunk of draws."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import checks
from ..operators import dynamics as D
from ..operators import inference as I
from ..operators import kernels as N
from ..operators import matching
from ..operators import models as G
from ..operators import moments as M
from ..operators import panel as P
from ..operators import portfolio as B
from ..operators import scoring as S
from ..operators import tailrisk
from ..runtime import cut, ship
from . import oracle_base as O
from .catalogue import ALPHA, SAMPLES, SEED, R, _both, _pit, _r, _rets, _scen, _sets, _wide, query

#: Scenarios of a drawn set, of moment matching, and of one task's share of draws; steps of a simulated path.
DRAWS, MATCHED, CHUNK, HORIZON = 10_000, 500, 1000, 5
CAP = 0.25


def _moments_of(x, p):
    mean, cov, _ = N.shrunk_moments(x, p)
    d = x - mean
    return np.vstack([mean, *(p @ d**k for k in (2, 3, 4))]), cov


# scenario sets


def _garch(rets: DataFrame) -> DataFrame:
    """One row an asset: the variance recursion's fit and the standardised residuals by date."""

    def run(pdf):
        pdf = pdf.sort_values("date")
        r = pdf["ret"].to_numpy()
        e = r - r.mean()
        alpha, beta, ahead = N.fit_garch(e)
        z = e / np.sqrt(N.garch_variance(e, alpha, beta)[:-1])
        return pd.DataFrame([(pdf["asset"].iloc[0], r.mean(), alpha, beta, ahead, float((e * e).mean()), z)], columns=["asset", "mean", "alpha", "beta", "next_variance", "target", "z"])

    return rets.groupBy("asset").applyInPandas(run, "asset string, mean double, alpha double, beta double, next_variance double, target double, z array<double>")


def _dcc(spark, rets: DataFrame) -> DataFrame:
    """One row: the fitted state as arrays. Variances are fitted asset by asset, then the correlations on their residuals."""
    ship(spark)

    def run(pdf):
        pdf = pdf.sort_values("asset")
        z = np.column_stack(pdf["z"].to_list())
        fit = D.fit_correlation(z)
        own = {c: pdf[c].to_numpy() for c in ("mean", "alpha", "beta", "next_variance", "target")}
        return pd.DataFrame([{"assets": list(pdf["asset"])} | {k: v.ravel() if isinstance(v, np.ndarray) else v for k, v in (fit | own).items()}])

    arrays = ("mean", "base", "next_q", "alpha", "beta", "next_variance", "target")
    schema = "assets array<string>, df double, a double, b double, loss double, " + ", ".join(f"{k} array<double>" for k in arrays)
    names = [c.strip().split()[0] for c in schema.split(",")]
    states = _garch(rets.where("segment = 'is'").select("date", "asset", "ret"))  # a row an asset
    return states.groupBy(F.lit(1).alias("fold")).applyInPandas(lambda pdf: run(pdf)[names], schema)


@query("dcc_diagnostics")
def dcc_diagnostics(spark, d):
    total = F.transform(F.arrays_zip("alpha", "beta"), lambda e: e["alpha"] + e["beta"])
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    f = _dcc(spark, _rets(spark, d)).withColumn("total", total)
    return f.select("a", "b", (F.col("a") + F.col("b")).alias("persistence"), F.col("df").alias("innovation_df"), mean(F.col("alpha")).alias("mean_alpha"), mean(F.col("beta")).alias("mean_beta"), mean(F.col("total")).alias("mean_persistence"), F.array_max("total").alias("max_persistence"))


def _simulated(state: DataFrame, centre: DataFrame, seed: int) -> DataFrame:
    """(scenario, asset, x): paths in chunks, each with its own seed, recentred on the mean that every model is given."""

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples():
                n = len(row.assets)
                fit = {k: np.array(getattr(row, k)) for k in ("alpha", "beta", "next_variance", "target")} | {k: np.array(getattr(row, k)).reshape(n, n) for k in ("base", "next_q")} | {"a": row.a, "b": row.b}
                x = D.simulate_dcc(fit, np.array(row.mean), row.df, min(CHUNK, DRAWS - row.chunk * CHUNK), HORIZON, 1000 * seed + row.chunk)
                yield pd.DataFrame({"scenario": np.repeat(np.arange(len(x)) + row.chunk * CHUNK, n), "asset": list(row.assets) * len(x), "x": x.ravel()})

    x = cut(_chunks(state).mapInPandas(run, "scenario long, asset string, x double"))
    # a grouped mean, so that no asset's paths meet in one task
    shift = x.groupBy("asset").agg(F.avg("x").alias("own")).join(centre, "asset").select("asset", (F.col("mean") - F.col("own")).alias("shift"))
    return x.join(shift, "asset").select("scenario", "asset", (F.col("x") + F.col("shift")).alias("x"))


def _chunks(state: DataFrame) -> DataFrame:
    n = -(-DRAWS // CHUNK)
    return state.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n, "chunk")


def _centre(scen: DataFrame) -> DataFrame:
    """(asset, mean) of the weighted windows."""
    return scen.where("model = 'ewma'").groupBy("asset").agg(F.sum(F.col("p") * F.col("x")).alias("mean"))


@query("dcc_simulation")
def dcc_simulation(spark, d):
    r = _rets(spark, d)
    return _simulated(_dcc(spark, r), _centre(_sets(P.terminal(r))), SEED)


def _targets(spark, scen: DataFrame, bounds: tuple[float, float] = (4.5, 60.0)) -> DataFrame:
    """One row: assets, mean, covariance, and the tails' degrees of freedom of the weighted windows."""
    ship(spark)

    def run(pdf):
        x, p = _wide(pdf)
        mean, cov, _ = N.shrunk_moments(x.to_numpy(), p)
        fit = N.fit_df(x.to_numpy(), p, *bounds, mean=mean, cov=cov)
        return pd.DataFrame([(list(x.columns), mean, cov.ravel(), fit["df"], fit["loglik"], fit["gain"], fit["at_bound"], float(1 / (p @ p)))], columns=["assets", "mean", "cov", "df", "loglik", "gain", "at_bound", "ess"])

    return scen.where("model = 'ewma'").groupBy("model").applyInPandas(run, "assets array<string>, mean array<double>, cov array<double>, df double, loglik double, gain double, at_bound boolean, ess double")


def _elliptical(state: DataFrame, seed: int, tails: bool) -> DataFrame:
    """(scenario, asset, x): draws of the mean and covariance, Gaussian or of the state's degrees of freedom."""

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples():
                n = len(row.assets)
                mean, cov, size = np.array(row.mean), np.array(row.cov).reshape(n, n), min(CHUNK, DRAWS - row.chunk * CHUNK)
                own = 1000 * seed + row.chunk
                x = N.student_t(mean, cov, row.df, size, own) if tails else N.gaussian(mean, cov, size, own)
                yield pd.DataFrame({"scenario": np.repeat(np.arange(size) + row.chunk * CHUNK, n), "asset": list(row.assets) * size, "x": x.ravel()})

    return _chunks(state).mapInPandas(run, "scenario long, asset string, x double")


def registry(spark, rets: DataFrame, scen: DataFrame, settings: Settings | None = None) -> dict:
    """Scenario sets by name, each a function of its seed: (scenario, asset, p, x)."""
    settings = settings or Settings()
    state = cut(_targets(spark, scen, settings.df_bounds))
    df, _ = G.resolved_df(settings.df_mode, settings.df, lambda: state.select("df", "loglik", "gain", "at_bound", "ess").first().asDict())
    state = state.withColumn("df", F.lit(df))
    even = lambda df: df.withColumn("p", F.lit(1.0 / DRAWS))

    def historical(_seed):
        own = scen.where("model = 'ewma'")
        nth = own.select("date").distinct().withColumn("scenario", F.row_number().over(Window.orderBy("date")).cast("long") - 1)  # as many rows as windows
        return own.join(nth, "date").select("scenario", "asset", "x", "p")

    return {
        "gaussian_terminal": lambda seed: even(_elliptical(state, seed, False)),
        "student_t_terminal": lambda seed: even(_elliptical(state, seed, True)),
        "historical_weighted": historical,
        "dcc_garch": lambda seed: even(_simulated(_dcc(spark, rets), _centre(scen), seed)),
    }


def scenario_sets(spark, d, include=("gaussian_terminal", "student_t_terminal", "historical_weighted", "dcc_garch"), seed: int = 42) -> dict[str, DataFrame]:
    r = _rets(spark, d)
    return G.dispatch(registry(spark, r, _sets(P.terminal(r))), list(include), seed)


@query("gaussian_scenarios")
def gaussian_scenarios(spark, d):
    return scenario_sets(spark, d, ["gaussian_terminal"])["gaussian_terminal"].select("scenario", "asset", "p", "x")


@query("student_t_scenarios")
def student_t_scenarios(spark, d):
    return scenario_sets(spark, d, ["student_t_terminal"])["student_t_terminal"].select("scenario", "asset", "p", "x")


@query("scenario_dispatch")
def scenario_dispatch(spark, d):
    """Every model's set in one table."""
    out = None
    for name, s in scenario_sets(spark, d).items():
        s = s.select(F.lit(name).alias("model"), "scenario", "asset", "p", "x")
        out = s if out is None else out.unionByName(s)
    return out


@query("student_t_df")
def student_t_df(spark, d):
    return _targets(spark, _scen(spark, d)).select("df", "loglik", "gain", "at_bound", "ess")


# moment matching


def matched(spark, scen: DataFrame, scenarios: int, starts: int, rounds: int, p_step: str = "mirror", x_step: str = "joint") -> DataFrame:
    """One row a start: how it ended, and its X (by rows) and p."""
    ship(spark)

    def run(pdf):
        x, p = _wide(pdf)
        start, (m, cov) = int(pdf["start"].iloc[0]), _moments_of(x.to_numpy(), p)
        rng = np.random.default_rng(123 + 1000 * start)
        q = rng.exponential(1.0, scenarios)
        out = D.Matching(D.MomentTarget(m, cov), 1e-5, p_step, x_step).run(N.gaussian(m[0], cov, scenarios, 123 + 1000 * start), q / q.sum(), rounds, 2, 3, 1e-5)
        out |= {"start": start, "assets": list(x.columns), "n_eff": float(1 / (out["p"] @ out["p"])), "x": out["x"].ravel()}
        return pd.DataFrame([{c: out[c] for c in names}])

    schema = "start int, f double, g double, rounds int, converged boolean, stationary boolean, x_residual double, p_residual double, n_eff double, assets array<string>, path array<double>, p array<double>, x array<double>"
    names = [c.strip().split()[0] for c in schema.split(", ")]
    own = scen.where("model = 'ewma'").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    out = cut(own.groupBy("start").applyInPandas(run, schema))
    out = out.withColumn("eligible", F.col("converged") & F.col("stationary"))
    rank = F.row_number().over(Window.orderBy(F.desc("eligible"), "g", "start"))  # a row a start
    return out.withColumn("chosen", rank == 1)


def chosen(found: DataFrame, strict: bool = False) -> DataFrame:
    """(scenario, asset, p, x) of the start of least G among those converged and stationary; of all where there is none, unless strict."""
    if strict and found.where("eligible").isEmpty():
        raise ArithmeticError("no start converged to a stationary point")
    rows = found.where("chosen").select("assets", "x", F.posexplode("p").alias("scenario", "p"))
    rows = rows.select("scenario", "p", "x", "assets", F.posexplode("assets").alias("k", "asset"))
    at = F.col("scenario") * F.size("assets") + F.col("k") + 1
    return rows.select("scenario", "asset", "p", F.element_at("x", at).alias("x"))


@query("moment_match_bcd")
def moment_match_bcd(spark, d):
    return chosen(matched(spark, _scen(spark, d), MATCHED, 5, 150))


@query("moment_match_starts")
def moment_match_starts(spark, d):
    """How every start ended, by G, with the one chosen."""
    return matched(spark, _scen(spark, d), MATCHED, 5, 150).select("start", "f", "g", "rounds", "converged", "stationary", "x_residual", "p_residual", "eligible", "chosen", "n_eff")


@query("moment_match_steps")
def moment_match_steps(spark, d):
    """The alternative steps on a smaller problem: projected p steps, x by columns in sequence and from one snapshot."""
    out, scen = None, _scen(spark, d)
    for p_step, x_step in (("mirror", "joint"), ("projected", "joint"), ("mirror", "sequential"), ("mirror", "jacobi")):
        s = matched(spark, scen, 60, 2, 20, p_step, x_step).select(F.lit(p_step).alias("p_step"), F.lit(x_step).alias("x_step"), "start", "f", "g", "rounds")
        out = s if out is None else out.unionByName(s)
    return out


@query("moment_match_histories")
def moment_match_histories(spark, d):
    """G of every start after every round, shorter histories padded with their last value; whether it ever rose."""
    s = matched(spark, _scen(spark, d), 60, 3, 40).select("start", "path")
    longest = F.max(F.size("path")).over(Window.partitionBy())  # a row a start
    rows = s.withColumn("n", longest).select("start", "path", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("round"))
    rows = rows.select("start", "round", F.coalesce(F.get("path", F.col("round")), F.element_at("path", -1)).alias("g"))
    step = F.col("g") - F.lag("g").over(Window.partitionBy("start").orderBy("round"))
    return rows.withColumn("falls", F.coalesce(step <= 1e-9, F.lit(True)))


@query("moment_match_partitioned")
def moment_match_partitioned(spark, d, scenarios: int = 20_000, rounds: int = 2):
    """A set whose X and p stay partitioned: G after every round, F, and the residuals of what was reached."""
    scen = _scen(spark, d).where("model = 'ewma'")
    found = matching.Set(matching.started(spark, _target(scen), scenarios, 123), _target(scen))
    path = found.run(rounds, x_rounds=4, p_rounds=2)
    gx, gp = found.residuals()
    rows = [(k, float(g), float(found.point.f), float(gx), float(gp), scenarios) for k, g in enumerate(path)]  # one a round
    return spark.createDataFrame(rows, "round int, g double, f double, x_residual double, p_residual double, scenarios long")


def _target(scen: DataFrame) -> D.MomentTarget:
    """Moments and shrunk covariances of one set, from aggregates: the driver sees assets x assets numbers."""
    m = {r["asset"]: [r[f"m{k}"] for k in (1, 2, 3, 4)] for r in M.moments(scen, ["asset"]).collect()}
    names = sorted(m)
    at = {a: i for i, a in enumerate(names)}
    cov = np.zeros((len(names), len(names)))
    for r in M.shrunk(M.covariance(scen, ["model"]), M.shrinkage(scen, ["model"]), ["model"]).collect():
        cov[at[r["asset_i"]], at[r["asset_j"]]] = cov[at[r["asset_j"]], at[r["asset_i"]]] = r["value"]
    return D.MomentTarget(np.array([m[a] for a in names]).T, N.nearest_psd(cov))


# rolling origins


#: Begins of the folds of the registered query.
FOLDS = ("2000-01-01", "2000-07-01", "2001-01-01", "2001-07-01")


def rolling(spark, rets: DataFrame, settings: Settings) -> DataFrame:
    """(fold, model, date, scores): every model fitted on what came before a fold, judged on the fold's own windows.

    Windows never reach across a fold's begin. A fold without windows on either side is an error.
    """

    def fold(at: tuple[int, tuple[str, str]]) -> DataFrame:
        k, (begin, end) = at
        own = rets.where(F.col("date") < end).select("date", "asset", "ret", F.when(F.col("date") < begin, "is").otherwise("oos").alias("segment"))
        own = cut(own)
        windows = cut(P.terminal(own, settings.horizon))
        scen = cut(M.scenario_models(windows.where("segment = 'is'"), half_life=settings.half_life))
        obs = checks.some_rows(windows.where("segment = 'oos' and is_nonoverlap").select("asset", "date", F.col("tret").alias("y")), f"windows of fold {k}")
        sets = G.dispatch(registry(spark, own, scen, settings), list(settings.models), settings.seed)
        sets["moment_matching"] = chosen(matched(spark, scen, settings.matched_scenarios, settings.starts, settings.rounds, settings.p_step, settings.x_step), settings.strict)
        # the scenario's number stands for its date
        day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("scenario").cast("int"))
        every = cut(reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("model"), "asset", day.alias("date"), "p", "x") for name, df in sets.items()]))
        return cut(S.observation_scores(every, cut(obs), settings.energy_pairs, settings.seed)).select(F.lit(k).alias("fold"), "*")

    # folds share nothing, and their small jobs leave most of a cluster idle
    ship(spark)
    spans = list(enumerate(zip(settings.folds, [*settings.folds[1:], "9999-12-31"], strict=True)))
    with ThreadPoolExecutor(len(spans)) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(fold), spans))


@query("rolling_origin")
def rolling_origin(spark, d):
    return rolling(spark, _rets(spark, d).select("date", "asset", "ret"), Settings(folds=FOLDS))


# portfolios


def _per_model(spark, scen: DataFrame, fn, schema: str) -> DataFrame:
    ship(spark)

    def run(pdf):
        x, p = _wide(pdf)
        return pd.DataFrame([(pdf["model"].iloc[0], *row) for row in fn(list(x.columns), x.to_numpy(), p)], columns=[c.split()[0] for c in schema.split(", ")])

    return scen.groupBy("model").applyInPandas(run, schema)


_WEIGHTS = "model string, asset string, weight double"


def _hrp(assets, x, p):
    return list(zip(assets, N.hierarchical_risk_parity(N.weighted_moments(x, p)[1]).tolist(), strict=True))


def _calm(cap: float):
    return lambda assets, x, p: list(zip(assets, N.min_variance(N.weighted_moments(x, p)[1], ridge=0.01, cap=cap).tolist(), strict=True))


def _tail(alpha: float, cap: float):
    def fn(assets, x, p):
        w, loss = D.min_cvar(x, p, alpha, cap)
        return [(a, float(v), loss) for a, v in zip(assets, w, strict=True)]

    return fn


def _sharpest(spark, scen: DataFrame, cap: float, starts: int = 20) -> DataFrame:
    """Weights of the best of the starts (equal weights and seeded draws from the simplex) on one scenario set."""
    ship(spark)

    def run(pdf):
        x, p = _wide(pdf)
        start, (mean, cov) = int(pdf["start"].iloc[0]), N.weighted_moments(x.to_numpy(), p)
        n = len(mean)
        w, loss = D.max_sharpe(mean, cov, np.random.default_rng(start).dirichlet(np.ones(n)) if start else np.full(n, 1 / n), cap=cap)
        return pd.DataFrame([(start, loss, list(x.columns), w)], columns=["start", "loss", "assets", "weights"])

    own = scen.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    found = own.groupBy("start").applyInPandas(run, "start int, loss double, assets array<string>, weights array<double>")
    best = found.agg(F.min_by(F.arrays_zip("assets", "weights"), F.struct("loss", "start")).alias("w"))
    return best.select(F.explode("w").alias("e")).select(F.col("e.assets").alias("asset"), F.col("e.weights").alias("weight"))


def optimised(spark, scen: DataFrame, alpha: float, cap: float) -> dict[str, DataFrame]:
    """(asset, weight) of every optimised portfolio on one scenario set."""
    return {
        "HRP": _per_model(spark, scen, _hrp, _WEIGHTS),
        "MinVariance": _per_model(spark, scen, _calm(cap), _WEIGHTS),
        "MinTailLoss": _per_model(spark, scen, _tail(alpha, cap), _WEIGHTS + ", tail_loss double"),
        "MaxSharpe": _sharpest(spark, scen, cap),
    }


@query("hrp")
def hrp(spark, d):
    return _per_model(spark, _scen(spark, d), _hrp, _WEIGHTS)


@query("min_variance")
def min_variance(spark, d):
    return _per_model(spark, _scen(spark, d), _calm(CAP), _WEIGHTS)


@query("max_sharpe")
def max_sharpe(spark, d):
    return _sharpest(spark, _scen(spark, d).where("model = 'ewma'"), CAP)


@query("min_cvar")
def min_cvar(spark, d):
    """Weights of least expected shortfall of every set, and that shortfall, by cuts from partitioned scenarios."""
    return tailrisk.min_cvar(_scen(spark, d), ALPHA, CAP).select("model", "asset", "weight", "tail_loss")


@query("walk_forward_hrp")
def walk_forward_hrp(spark, d):
    """Hierarchical weights at every rebalancing, from the covariance of all earlier rows."""
    r = _rets(spark, d)
    marks = B.calendar(r.where("segment = 'oos'")).select("rebalance_date")
    return B.walk_forward(r, marks, 1, B.hierarchical).select("rebalance_date", "asset", "weight")


# inference


def _set_sql(grouped: bool) -> str:
    seg = "year(date)" if grouped else "0"
    losses = f"SELECT metric, model, {seg} AS seg, date, score AS diff FROM long_scores"
    contrasts = f"SELECT metric, benchmark, {seg} AS seg, date, diff FROM contrast"
    last = f"SELECT metric, block FROM ({O.sizes_sql(contrasts, 'metric, benchmark', grouped)}) WHERE benchmark = (SELECT max(model) FROM scores WHERE model <> 'ewma')"
    sizes = f"SELECT metric, model, block FROM (SELECT DISTINCT metric, model FROM long_scores) JOIN ({last}) USING (metric)"
    stream = "metric || '|' ||" + (" seg || '|' ||" if grouped else "")
    seen = "SELECT metric, model, avg(score) AS m FROM long_scores GROUP BY 1, 2"
    gone = O.elimination_sql(seen, O.means_sql(losses, "metric, model", sizes, SAMPLES, SEED, stream), 3)
    return f"SELECT metric, model, left_at::INT AS left_at, {R('pvalue', 'statistic')}, pvalue > 0.1 AS in_set FROM ({gone})"


def _sets_of(long, within):
    others = [r["model"] for r in long.select("model").distinct().collect() if r["model"] != "ewma"]
    at = ["metric", *(within or []), "date"]
    a = long.where("model = 'ewma'").select(*at, F.col("score").alias("a"))
    diff = long.where("model <> 'ewma'").join(a, at).select(*at, F.col("model").alias("benchmark"), (F.col("a") - F.col("score")).alias("diff"))
    last = I.resolved_blocks(diff, ["metric", "benchmark"], within).where(F.col("benchmark") == max(others))
    return _r(I.confidence_sets(long, last.select("metric", "block"), 0.1, SAMPLES, SEED, within))


@query("confidence_set", _set_sql(False))
def confidence_set(spark, d):
    """For every metric the order in which models leave, their p-values, and the set; the block is that of the metric's last contrast."""
    return _sets_of(cut(S.long_scores(S.observation_scores(*_both(spark, d)))), None)


@query("confidence_set_grouped", _set_sql(True))
def confidence_set_grouped(spark, d):
    """The same with blocks that stay within their year."""
    long = S.long_scores(S.observation_scores(*_both(spark, d))).withColumn("fold", F.year("date"))
    return _sets_of(cut(long), ["fold"])


@query("ks_pvalues")
def ks_pvalues(spark, d):
    """Exact p-values of the uniformity test of every asset's transforms, Holm-adjusted within the model."""
    ship(spark)
    w = Window.partitionBy("model", "asset")
    u = _pit(spark, d).withColumn("rn", F.row_number().over(w.orderBy("u", "date"))).withColumn("n", F.count(F.lit(1)).over(w))
    ks = u.groupBy("model", "asset").agg(F.max(F.greatest(F.col("rn") / F.col("n") - F.col("u"), F.col("u") - (F.col("rn") - 1) / F.col("n"))).alias("ks"), F.max("n").alias("n"))

    def run(frames):
        for pdf in frames:
            yield pdf.assign(pvalue=[D.kolmogorov_tail(k, int(n)) for k, n in zip(pdf["ks"], pdf["n"], strict=True)])

    out = I.holm(ks.mapInPandas(run, "model string, asset string, ks double, n long, pvalue double"), ["model"], ["asset"])
    return out.withColumn("rejects", F.col("holm") < 0.05)
