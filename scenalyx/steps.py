"""The stages of a run as steps over tables in one folder, with their order, their needs and their resumption.

Each step reads tables of earlier steps, writes its own, and leaves a manifest last
(``lineage``). A step refuses to begin while a stage it needs is not current. Every
step is a declarative plan; what iterates runs as grouped kernels on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lineage
from .config import Settings
from .operators import calibration as C
from .operators import checks
from .operators import inference as I
from .operators import models as G
from .operators import moments as M
from .operators import panel as P
from .operators import portfolio as B
from .operators import scoring as S
from .runtime import cut
from .sources import sinks


@dataclass
class Run:
    """Where a run's tables stand, what it reads and how it is set."""

    spark: SparkSession
    folder: str
    source: sinks.OrderPrices
    settings: Settings

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str) -> str:
        return sinks.write_table(df, self.path(name))

    def manifest(self, stage: str) -> str:
        return f"{self.folder}/{stage}.manifest.json"


def download(run: Run) -> None:
    """Raw prices, filled within the limit; profile of coverage; nothing is filled that was never seen.

    The source is read once: its rows are judged while they are written, and coverage by
    what was written. Bad prices leave no table.
    """
    s = run.settings
    filled = P.fill(P.cleaned(run.source.prices(run.spark, s.grain)), s.fill_limit)
    positive = F.col("raw").isNull() | (F.col("raw") > 0)
    with sinks.staged(filled, run.path("prices"), {"prices over 0": positive}) as stored:
        checks.covered(stored, s.min_coverage)
    run.write(P.coverage(run.read("prices")), "coverage")


def transform(run: Run) -> None:
    """Returns, compounded windows, quality of both segments."""
    s = run.settings
    prices = run.read("prices")
    observed = prices.select("date", "asset", F.col("raw").isNotNull().alias("seen"))
    checks.aligned(prices.select("date", "asset"), observed, "date", "asset")
    run.write(checks.compoundable(P.returns(P.complete(prices), s.end_train, begin=s.start_oos)), "returns")
    r = run.read("returns")
    run.write(P.terminal(r, s.horizon), "windows")
    q = P.quality(prices, P.with_full_segment(r))
    run.write(q, "quality")
    run.write(P.flags(run.read("quality"), s.max_zero_rate, s.max_zero_run), "flags")


def _windows(run: Run) -> DataFrame:
    return checks.some_rows(run.read("windows").where("segment = 'is'"), "in-sample windows")


def _history(run: Run) -> DataFrame:
    return cut(M.scenario_models(_windows(run), half_life=run.settings.half_life))


def _observations(run: Run) -> DataFrame:
    w = run.read("windows").where("segment = 'oos' and is_nonoverlap")
    return checks.some_rows(w.select("asset", "date", F.col("tret").alias("y")), "out-of-sample windows")


def mm(run: Run) -> None:
    """Scenarios that match the weighted moments; how every start ended."""
    from .plans import estimators as E

    s = run.settings
    scen = _history(run)
    found = cut(E.matched(run.spark, scen, s.matched_scenarios, s.starts, s.rounds, s.p_step, s.x_step))
    run.write(found.drop("assets", "path", "p", "x"), "starts")
    sinks.write_scenarios(E.chosen(found, s.strict), run.path("scenarios_moment_matching"))


def benchmarks(run: Run) -> None:
    """The scenario sets that matching is compared with."""
    from .plans import estimators as E

    s = run.settings
    registry = E.registry(run.spark, run.read("returns"), _history(run), s)
    for name, scen in G.dispatch(registry, list(s.models), s.seed).items():
        sinks.write_scenarios(scen, run.path(f"scenarios_{name}"))


def _sets(run: Run) -> DataFrame:
    """(model, asset, date, p, x) of every stored set; the scenario's number stands for its date."""
    names = ["moment_matching", *run.settings.models]
    parts = [sinks.read_scenarios(run.spark, run.path(f"scenarios_{n}")).select(F.lit(n).alias("model"), "asset", F.date_add(F.lit("1900-01-01").cast("date"), F.col("scenario").cast("int")).alias("date"), "p", "x") for n in names]
    return cut(G.normalised(reduce(DataFrame.unionByName, parts), ["model", "asset"]))


def evaluate(run: Run) -> None:
    """Scores by observation, marginal tables, comparison with every benchmark, calibration at equal support."""
    s = run.settings
    scen, obs = _sets(run), cut(_observations(run))
    run.write(S.observation_scores(scen, obs, s.energy_pairs, s.seed), "observation_scores")
    run.write(S.marginal_table(scen, obs, s.alpha), "marginal")
    _compare(run, S.long_scores(run.read("observation_scores")), None, "")
    if s.support:
        chosen = G.resampled(scen.select("model", "date", "p").distinct(), s.support, s.seed, ["model"], "date")
        scen = cut(_redrawn(chosen, scen))
    run.write(C.detail(_transforms(scen, obs, s.seed)), "calibration")
    run.write(C.summary(run.read("calibration")), "calibration_summary")


#: Block lengths at which comparisons are repeated (fixed values).
SENSITIVITY = (2, 4, 8)


def _compare(run: Run, long: DataFrame, within: list[str] | None, prefix: str) -> None:
    """The matched set against every other: contrasts, the same at fixed blocks, and each metric's confidence set."""
    s = run.settings
    primary, others = ("mean_crps", s.models[0]), list(s.models)
    block = s.block if s.block_mode == "fixed" else None
    run.write(I.focal_table(long, "moment_matching", others, s.samples, s.seed, within, block, primary, s.confidence), f"{prefix}comparison")
    run.write(I.sensitivity(long, "moment_matching", others, s.samples, s.seed, SENSITIVITY, within, primary, s.confidence), f"{prefix}sensitivity")
    last = run.read(f"{prefix}comparison").where(F.col("benchmark") == others[-1]).select("metric", "block")
    alpha = round(1 - s.confidence, 12)
    run.write(I.confidence_sets(long, last, alpha, s.samples, s.seed + 500_000, within), f"{prefix}confidence_sets")


def _redrawn(chosen: DataFrame, scen: DataFrame) -> DataFrame:
    """Drawn scenarios with the values of those they were drawn from; the draw's number stands for the date."""
    nth = F.when(F.col("draw").isNull(), F.col("date")).otherwise(F.date_add(F.lit("1900-01-01").cast("date"), F.col("draw")))
    own = chosen.select("model", "date", nth.alias("nth"), "p")
    return own.join(scen.select("model", "asset", "date", "x"), ["model", "date"]).select("model", "asset", F.col("nth").alias("date"), "p", "x")


def _transforms(scen: DataFrame, obs: DataFrame, seed: int) -> DataFrame:
    from .functions.expr import uniform

    v = uniform(seed, "pit", F.col("model"), F.col("asset"), F.col("date"))
    u = F.col("f_below") + v * (F.col("f") - F.col("f_below"))
    return S.ranked(scen, obs).select("model", "asset", "date", F.least(F.lit(1.0), F.greatest(F.lit(0.0), u)).alias("u"))


def portfolio(run: Run) -> None:
    """Closed-form and optimised weights, and their figures under every scenario set."""
    from .plans import estimators as E

    s = run.settings
    w = B.closed_form(run.read("returns").where("segment = 'is'"))
    parts = [w.select(F.lit(name).alias("portfolio"), "asset", F.col(c).alias("weight")) for name, c in (("EqualWeight", "equal"), ("InverseVariance", "inverse_variance"))]
    scen = _sets(run).where("model = 'moment_matching'")
    parts += [df.select(F.lit(name).alias("portfolio"), "asset", "weight") for name, df in E.optimised(run.spark, scen, s.alpha, s.cap).items()]
    run.write(reduce(DataFrame.unionByName, parts), "weights")
    run.write(B.diagnostics(run.read("weights"), _sets(run), s.alpha), "portfolio_figures")


def backtest(run: Run) -> None:
    """Every portfolio set once, and the closed-form ones walked forward; metrics and contrasts with Holm in each family."""
    s = run.settings
    r = run.read("returns")
    oos = r.where("segment = 'oos'")
    first = oos.agg(F.min("date").alias("rebalance_date"))  # one row
    once = run.read("weights").crossJoin(first).select("portfolio", "rebalance_date", "asset", "weight")
    walked = cut(B.walk_forward(r, B.calendar(oos), s.min_history))
    checks.some_rows(walked, "rebalancings")
    even = (1.0 / F.count(F.lit(1)).over(Window.partitionBy("rebalance_date"))).alias("weight")
    plans = once.unionByName(walked.select(F.lit("WF_InverseVariance").alias("portfolio"), "rebalance_date", "asset", "weight")).unionByName(walked.select(F.lit("WF_EqualWeight").alias("portfolio"), "rebalance_date", "asset", even))
    run.write(B.backtest(oos, cut(plans), s.cost_bps), "ledger")
    ledger = run.read("ledger")
    per_year = {"day": 252.0, "week": 52.0, "month": 12.0}[s.grain]
    run.write(B.metrics(ledger, per_year), "metrics")
    names = sorted(x["portfolio"] for x in run.read("metrics").select("portfolio").collect())
    base = {False: ("static_single_shot_oos", "EqualWeight"), True: ("expanding_window_walk_forward", "WF_EqualWeight")}
    pairs = [(n, *base[n.startswith("WF_")]) for n in names if n not in ("EqualWeight", "WF_EqualWeight")]
    pairs += [(n, "rebalancing_effect", n.removeprefix("WF_")) for n in names if n.startswith("WF_") and n.removeprefix("WF_") in names]
    frame = run.spark.createDataFrame(pairs, "portfolio string, design string, benchmark string")
    contrasts = B.sharpe_bootstrap(B.net_returns(ledger).select("portfolio", "date", "r"), frame, 20, 2000, s.seed, per_year, s.confidence)
    run.write(I.holm(contrasts, ["design"], ["portfolio"]), "sharpe_contrasts")


def liquid(run: Run) -> Run:
    """The run on the assets that pass the quality rules, whose tables stand in a folder of their own."""
    return replace(run, folder=run.path("liquid"))


def liquidity(run: Run) -> None:
    """Everything made anew on the assets that pass the quality rules in sample, beside what all assets gave.

    Windows and returns are those of the run, of fewer assets; targets, matching, the other
    models, scores, comparisons, portfolios and backtest are computed from them.
    """
    s = run.settings
    chosen = P.universe(run.read("quality"), s.max_zero_rate, s.max_zero_run, s.min_assets)
    run.write(chosen, "universe")
    kept = run.read("universe").where("selected").select("asset")
    if kept.count() < s.min_assets:
        raise ValueError("too few assets pass the quality rules")
    own = liquid(run)
    for name in ("returns", "windows"):
        own.write(run.read(name).join(kept, "asset", "left_semi"), name)
    for step in (mm, benchmarks, evaluate, portfolio, backtest):
        step(own)
    place = lambda r, name: r.read("observation_scores").groupBy("model").agg(F.avg("mean_crps").alias(f"crps_{name}")).withColumn(f"rank_{name}", F.rank().over(Window.orderBy(F.round(f"crps_{name}", 12))).cast("long"))
    both = place(run, "all").join(place(own, "liquid"), "model", "outer")
    run.write(both.withColumn("shift", F.col("rank_liquid") - F.col("rank_all")), "liquidity")
    figures = ("cagr", "volatility", "sharpe", "max_drawdown", "final_wealth", "turnover")
    of = lambda r, name: r.read("metrics").select("portfolio", *(F.col(c).alias(f"{c}_{name}") for c in figures))
    metrics = of(run, "all").join(of(own, "liquid"), "portfolio", "outer")
    run.write(metrics.withColumn("delta_sharpe", F.col("sharpe_liquid") - F.col("sharpe_all")), "liquidity_portfolios")


def rolling(run: Run) -> None:
    """Every model made anew at the begin of every fold from what came before, scored within the fold; pooled scores and stability."""
    from .plans import estimators as E

    s = run.settings
    r = checks.unique(run.read("returns"), "date", "asset").select("date", "asset", "ret")
    run.write(E.rolling(run.spark, r, s), "rolling_scores")
    scores = run.read("rolling_scores")
    pooled = scores.groupBy("model").agg(*(F.avg(c).alias(c) for c in ("mean_crps", "energy", "variogram")), F.count(F.lit(1)).alias("n"))
    run.write(pooled, "rolling_pooled")
    rank = F.rank().over(Window.partitionBy("fold").orderBy(F.round("m", 12)))
    ranks = scores.groupBy("model", "fold").agg(F.avg("mean_crps").alias("m")).withColumn("rank", rank)
    run.write(ranks.groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"), F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"), F.count_if(F.col("rank") == 1).alias("wins"), F.count(F.lit(1)).alias("folds")), "rolling_stability")
    _compare(run, S.long_scores(scores.select("fold", "model", "date", "mean_crps", "energy", "variogram")), ["fold"], "rolling_")


def snapshot(run: Run) -> None:
    """Copies of the result tables under a name of their own, and one file with settings, environment, code and every stage's manifest."""
    found = {stage: lineage.read_json(run.spark, run.manifest(stage)) for stage in NEEDS if stage != "snapshot"}
    name = f"snapshots/{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%fZ')}"
    for table in KEPT:
        run.write(run.read(table), f"{name}/{table}")
    copies = [run.path(f"{name}/{table}") for table in KEPT]
    hashes = {r["table"].rsplit("/", 1)[1]: r["sha256"] for r in lineage.fingerprints(run.spark, copies)}
    value = {"settings": asdict(run.settings), "environment": lineage.environment(run.spark), "code": lineage.code_fingerprint(), "folder": name, "tables": hashes, "stages": found}
    lineage.write_json(run.spark, run.path(f"{name}/snapshot.json"), value)
    lineage.write_json(run.spark, run.path("snapshot.json"), value)


def reuse(run: Run) -> None:
    """Keep the stored prices, if they are what the last download wrote with the same settings."""
    found = lineage.validate(run.spark, run.manifest("download"), asdict(run.settings))
    if found:
        raise RuntimeError(f"the stored prices cannot be used: {', '.join(found)}")


#: Result tables that a snapshot copies.
KEPT = ("coverage", "quality", "flags", "starts", "observation_scores", "marginal", "comparison", "sensitivity", "confidence_sets", "calibration", "calibration_summary", "weights", "portfolio_figures", "metrics", "sharpe_contrasts", "universe", "liquidity", "liquidity_portfolios", "rolling_scores", "rolling_pooled", "rolling_stability", "rolling_comparison", "rolling_sensitivity", "rolling_confidence_sets")

#: Every stage with what it needs, in the order of a whole run.
NEEDS: dict[str, tuple[str, ...]] = {
    "download": (),
    "transform": ("download",),
    "mm": ("transform",),
    "benchmarks": ("transform",),
    "evaluate": ("mm", "benchmarks"),
    "portfolio": ("mm", "benchmarks"),
    "backtest": ("portfolio",),
    "liquidity": ("evaluate", "backtest"),
    "rolling": ("transform",),
    "snapshot": ("backtest", "liquidity", "rolling"),
}
STEPS: dict[str, Callable[[Run], None]] = {"download": download, "reuse-download": reuse, "transform": transform, "mm": mm, "benchmarks": benchmarks, "evaluate": evaluate, "portfolio": portfolio, "backtest": backtest, "liquidity": liquidity, "rolling": rolling, "snapshot": snapshot}

#: Tables that each stage writes.
WRITES: dict[str, tuple[str, ...]] = {
    "download": ("prices", "coverage"),
    "transform": ("returns", "windows", "quality", "flags"),
    "mm": ("starts", "scenarios_moment_matching"),
    "benchmarks": (),  # one for each model
    "evaluate": ("observation_scores", "marginal", "comparison", "sensitivity", "confidence_sets", "calibration", "calibration_summary"),
    "portfolio": ("weights", "portfolio_figures"),
    "backtest": ("ledger", "metrics", "sharpe_contrasts"),
    "liquidity": ("universe", "liquidity", "liquidity_portfolios", "liquid/returns", "liquid/windows"),  # and what the stages on these write
    "rolling": ("rolling_scores", "rolling_pooled", "rolling_stability", "rolling_comparison", "rolling_sensitivity", "rolling_confidence_sets"),
}


def writes(run: Run, stage: str) -> list[str]:
    models = [f"scenarios_{m}" for m in run.settings.models]
    names = list(WRITES[stage]) if stage != "benchmarks" else models
    if stage == "liquidity":
        names += [f"liquid/{n}" for of in ("mm", "evaluate", "portfolio", "backtest") for n in WRITES[of]] + [f"liquid/{n}" for n in models]
    return [run.path(n) for n in names]


def sequence(step: str) -> list[str]:
    """The stages that a step name stands for."""
    if step == "all":
        return list(NEEDS)
    if step not in STEPS:
        raise ValueError(f"unknown step: {step}")
    return [step]


def current(run: Run, stage: str) -> list[str]:
    """Why a stage has to run; empty if it is current."""
    if stage not in WRITES:
        return ["runs always"]
    return lineage.validate(run.spark, run.manifest(stage), asdict(run.settings))


def plan(run: Run, step: str) -> list[tuple[str, str, str]]:
    """(stage, run or current, why) without doing anything. What needs a stage that runs, runs."""
    out, runs = [], set()
    for stage in sequence(step):
        why = current(run, stage) or [f"needs {n}" for n in NEEDS.get(stage, ()) if n in runs]
        if why:
            runs.add(stage)
        out.append((stage, "run" if why else "current", ", ".join(why)))
    return out


def execute(run: Run, step: str, resume: bool = False) -> list[str]:
    """Run the stages; with resume, those that are current are left out. What was run."""
    done = []
    for stage in sequence(step):
        if resume and stage in WRITES and not current(run, stage) and not set(NEEDS[stage]) & set(done):
            continue
        for need in NEEDS.get(stage, ()):
            lineage.require(run.spark, run.manifest(need))
        STEPS[stage](run)
        if stage in WRITES:
            inputs = [t for need in NEEDS[stage] for t in writes(run, need)] or run.source.tables()
            lineage.write_manifest(run.spark, run.manifest(stage), stage, inputs, writes(run, stage), asdict(run.settings))
        done.append(stage)
    return done
