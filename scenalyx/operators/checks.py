"""Checks that refuse bad input, each one aggregate or anti-join; a check returns its input, so plans can go through it.

Defined cases: empty input passes, except where a check asks for rows; a null key
is a key like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _refuse(bad: DataFrame, what: str) -> None:
    found = bad.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def present(names, wanted, what: str) -> list:
    """The wanted names; those missing are an error."""
    missing = sorted(set(wanted) - set(names))
    if missing:
        raise ValueError(f"{what} missing: {missing}")
    return list(wanted)


def columns(df: DataFrame, wanted) -> DataFrame:
    present(df.columns, wanted, "columns")
    return df


def some_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def positive(df: DataFrame, column: str = "price") -> DataFrame:
    """Prices over 0 (null is missing, not wrong)."""
    _refuse(df.where(F.col(column) <= 0), f"{column} of 0 or less")
    return df


def compoundable(rets: DataFrame) -> DataFrame:
    """Returns over -1, as wealth that is gone cannot grow again."""
    _refuse(rets.where("ret <= -1"), "returns of -1 or less")
    return rets


def finite(df: DataFrame, *names: str) -> DataFrame:
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in names]
    _refuse(df.where(reduce(lambda a, b: a | b, bad)), "values that are missing or not finite")
    return df


def covered(panel: DataFrame, least: float) -> DataFrame:
    """Share of raw prices of each asset, before anything is filled."""
    share = F.avg(F.col("raw").isNotNull().cast("double"))
    _refuse(panel.groupBy("asset").agg(share.alias("coverage")).where(F.col("coverage") < least), f"coverage below {least}")
    return panel


def unique(df: DataFrame, *keys: str) -> DataFrame:
    _refuse(df.groupBy(*keys).count().where("count > 1"), f"duplicates of {keys}")
    return df


def aligned(panel: DataFrame, mask: DataFrame, *keys: str) -> DataFrame:
    """The panel with the mask's columns; a cell that the mask does not cover is an error."""
    unique(mask, *keys)
    _refuse(panel.join(mask, list(keys), "left_anti").select(*keys), "cells that the mask does not cover")
    return panel.join(mask, list(keys))


def joined_one_to_one(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Inner join of two tables in which no key repeats."""
    return unique(a, *keys).join(unique(b, *keys), list(keys))


def united(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """All rows of both; a key in both, or twice in one, is an error."""
    return unique(a.unionByName(b), *keys)


def scheduled(schedule: DataFrame, calendar: DataFrame, column: str) -> DataFrame:
    """Every scheduled date has to be in the calendar."""
    _refuse(schedule.select(column).distinct().join(calendar.select(column).distinct(), column, "left_anti"), f"{column} outside the calendar")
    return schedule


def complete_pairs(scores: DataFrame, models, keys: list[str]) -> DataFrame:
    """Scores of the given models: each of them once on every observation that any of them has."""
    own = unique(scores.where(F.col("model").isin(*models)), "model", *keys)
    present([r["model"] for r in own.select("model").distinct().collect()], models, "models")
    _refuse(own.groupBy(*keys).agg(F.count_distinct("model").alias("n")).where(F.col("n") < len(set(models))), "observations that are not paired")
    return own


def never_rises(df: DataFrame, keys: list[str], order: str, value: str, slack: float = 1e-9) -> DataFrame:
    """(keys, falls): whether value never rises by more than slack along order."""
    from pyspark.sql import Window

    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("step", step).groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("step") <= slack), F.lit(True)).alias("falls"))
