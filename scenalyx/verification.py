"""Checks of a finished run: one row a promise, with whether its tables keep it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage
from .steps import SENSITIVITY, WRITES, Run, writes


def _holds(df: DataFrame, ok: Column) -> tuple[bool, str]:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad")).first()
    return r["n"] > 0 and r["bad"] == 0, f"{r['bad']} of {r['n']}"


def _core(run: Run) -> list[tuple[str, Callable[[], tuple[bool, str]]]]:
    s, read = run.settings, run.read
    sides = lambda: read("returns").groupBy("segment").agg(F.min("date").alias("low"), F.max("date").alias("high"))

    def disjoint():
        at = {r["segment"]: r for r in sides().collect()}
        return set(at) == {"is", "oos"} and at["is"]["high"] < at["oos"]["low"], str({k: (str(v["low"]), str(v["high"])) for k, v in at.items()})

    model_sets = [f"scenarios_{m}" for m in ("moment_matching", *s.models)]
    return [
        ("the samples do not overlap", disjoint),
        ("the in-sample part ends in time", lambda: _holds(read("returns").where("segment = 'is'"), F.col("date") <= s.end_train)),
        ("returns are complete", lambda: _holds(read("returns").groupBy("date").count().join(read("returns").agg(F.count_distinct("asset").alias("assets"))), F.col("count") == F.col("assets"))),
        ("returns can be compounded", lambda: _holds(read("returns"), F.col("ret") > -1)),
        ("coverage is enough", lambda: _holds(read("coverage"), F.col("coverage") >= s.min_coverage)),
        *[(f"probabilities of {n}", lambda n=n: _holds(read(n).agg(F.sum("p").alias("s"), F.min("p").alias("low")), (F.abs(F.col("s") - 1) < 1e-9) & (F.col("low") >= 0))) for n in model_sets],
        ("matched scenarios are as many as asked", lambda: _holds(read("scenarios_moment_matching").agg(F.count(F.lit(1)).alias("n")), F.col("n") == s.matched_scenarios)),
        ("one start was chosen", lambda: _holds(read("starts").agg(F.count_if("chosen").alias("n")), F.col("n") == 1)),
        ("scores are finite and not negative", lambda: _holds(read("observation_scores"), (F.col("mean_crps") >= 0) & (F.col("energy") >= -1e-12) & (F.col("variogram") >= 0))),
        ("adjusted p-values are no smaller", lambda: _holds(read("comparison"), F.col("holm") >= F.col("pvalue") - 1e-12)),
        ("one contrast is primary", lambda: _holds(read("comparison").agg(F.count_if("is_primary").alias("n")), F.col("n") == 1)),
        ("intervals hold the difference", lambda: _holds(read("comparison"), F.col("ci_low") <= F.col("ci_high"))),
        ("supports are equal", lambda: _holds(read("calibration").groupBy("model").agg(F.count_distinct("n").alias("k")), F.col("k") == 1)),
        ("weights sum to one", lambda: _holds(read("weights").groupBy("portfolio").agg(F.sum("weight").alias("s"), F.min("weight").alias("low")), (F.abs(F.col("s") - 1) < 1e-6) & (F.col("low") >= -1e-9))),
    ]


def _full(run: Run) -> list[tuple[str, Callable[[], tuple[bool, str]]]]:
    read = run.read
    stages = [(f"lineage of {stage}", lambda stage=stage: ((found := lineage.validate(run.spark, run.manifest(stage), asdict(run.settings))) == [], ", ".join(found))) for stage in WRITES if writes(run, stage)]
    return [
        *_core(run),
        ("wealth stays positive", lambda: _holds(read("ledger"), F.col("wealth") > 0)),
        ("turnover costs", lambda: _holds(read("ledger"), F.abs(F.col("cost") - F.col("turnover") * run.settings.cost_bps / 1e4) < 1e-12)),
        ("every family is adjusted", lambda: _holds(read("sharpe_contrasts"), F.col("holm") >= F.col("pvalue") - 1e-12)),
        ("the universe was chosen in sample", lambda: _holds(read("universe"), F.col("selected") == (F.col("reason") == ""))),
        ("the liquid run has the chosen assets only", lambda: _holds(read("liquid/windows").select("asset").distinct().join(read("universe"), "asset", "left"), F.col("selected"))),
        ("the liquid run was calibrated on its own", lambda: _holds(read("liquid/starts").agg(F.count_if("chosen").alias("n")), F.col("n") == 1)),
        *[(f"{n}: every metric has a set, and a last model of p-value 1", lambda n=n: _holds(read(n).groupBy("metric").agg(F.count_if("in_set").alias("k"), F.max("pvalue").alias("top")), (F.col("k") > 0) & (F.col("top") == 1))) for n in ("confidence_sets", "rolling_confidence_sets", "liquid/confidence_sets")],
        *[(f"{n}: p-values rise along the order in which models leave", lambda n=n: _holds(read(n).withColumn("before", F.lag("pvalue").over(Window.partitionBy("metric").orderBy("left_at"))), F.coalesce(F.col("pvalue") >= F.col("before"), F.lit(True)))) for n in ("confidence_sets", "rolling_confidence_sets")],
        ("sensitivity covers the contrasts", lambda: _holds(read("sensitivity").groupBy("metric", "benchmark").agg(F.count_distinct("requested").alias("k")), F.col("k") == len(SENSITIVITY))),
        ("nothing lies between the samples", lambda: _holds(read("returns"), (F.col("date") <= run.settings.end_train) | (F.col("date") >= run.settings.start_oos))),
        ("folds have scores", lambda: _holds(read("rolling_scores").agg(F.count_distinct("fold").alias("k")), F.col("k") == len(run.settings.folds))),
        ("folded contrasts are adjusted", lambda: _holds(read("rolling_comparison"), F.col("holm") >= F.col("pvalue") - 1e-12)),
        *stages,
    ]


def verify(run: Run, scope: str = "full") -> DataFrame:
    """(check_name, passed, detail); a table that is missing fails its checks."""
    if scope not in ("core", "full"):
        raise ValueError("the scope has to be core or full")
    rows = []
    for name, check in (_core if scope == "core" else _full)(run):
        try:
            passed, detail = check()
        except Exception as error:  # a missing or broken table is what a check is there to tell
            passed, detail = False, str(error).splitlines()[0][:200]
        rows.append((name, bool(passed), detail))
    return run.spark.createDataFrame(rows, "check_name string, passed boolean, detail string")
