"""Frames that charts of a run read: nothing is drawn here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import checks
from .sources.sinks import write_table
from .steps import Run


def fold_excess(run: Run) -> DataFrame:
    """Each model's mean score over the best of the fold, in basis points."""
    f = run.read("rolling_scores").groupBy("model", "fold").agg(F.avg("mean_crps").alias("score"))
    return f.withColumn("excess_bp", (F.col("score") - F.min("score").over(Window.partitionBy("fold"))) * 1e4)


def forest(run: Run) -> DataFrame:
    """Contrasts with their intervals, in the order of a forest plot."""
    c = run.read("rolling_comparison").select("metric", "benchmark", "mean_diff", "ci_low", "ci_high", "holm", "ci_excludes_zero", "is_primary")
    return c.withColumn("place", F.row_number().over(Window.orderBy("metric", "mean_diff", "benchmark")))  # a row a contrast


def prediction_against_calibration(run: Run) -> DataFrame:
    """Mean score beside reliability, a row a model."""
    score = run.read("observation_scores").groupBy("model").agg(F.avg("mean_crps").alias("mean_crps"))
    return checks.joined_one_to_one(score, run.read("calibration_summary").select("model", "mean_reliability", "mean_ratio"), "model")


def concentration(run: Run) -> DataFrame:
    """Lorenz curve of the matched probabilities, heaviest first."""
    w = Window.orderBy(F.desc("p"), "scenario")  # as many rows as matched scenarios
    s = run.read("scenarios_moment_matching").select("scenario", "p")
    return s.withColumn("k", F.row_number().over(w)).withColumn("mass", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def convergence(run: Run) -> DataFrame:
    """Starts ranked by F."""
    return run.read("starts").withColumn("rank_f", F.row_number().over(Window.orderBy("f", "start")))  # a row a start


def wealth(run: Run) -> DataFrame:
    """Wealth and drawdown of every portfolio by date."""
    top = F.max("wealth").over(Window.partitionBy("portfolio").orderBy("date"))
    return run.read("ledger").select("portfolio", "date", "wealth", (F.col("wealth") / top - 1).alias("drawdown"))


def card(run: Run) -> DataFrame:
    """The primary contrast in one row."""
    return run.read("comparison").where("is_primary").select("metric", "benchmark", "mean_diff", "ci_low", "ci_high", "pvalue", "holm", "reject")


FRAMES: dict[str, Callable[[Run], DataFrame]] = {f.__name__: f for f in (fold_excess, forest, prediction_against_calibration, concentration, convergence, wealth, card)}


def write(run: Run, folder: str) -> list[str]:
    return [write_table(make(run), f"{folder}/chart_{name}") for name, make in FRAMES.items()]
