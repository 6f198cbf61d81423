"""Price sources, and sinks of tables and scenario sets.

A source gives (date, asset, raw); an empty answer is an error, at the latest when it
is stored (``staged``), never a substitute.
Scenario sets are stored as one row a scenario, with its values as an array in the
order of the assets. Writing a table replaces the former one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from ..operators.panel import price_panel
from .tables import table


class PriceSource(Protocol):
    """What gives raw prices; a provider on a network would be one more of these."""

    def prices(self, spark: SparkSession, grain: str) -> DataFrame: ...


class OrderPrices:
    """Mean unit prices of part types, from the tables of a folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def prices(self, spark: SparkSession, grain: str) -> DataFrame:
        return price_panel(table(spark, self.folder, "lineitem"), table(spark, self.folder, "part"), grain)

    def tables(self) -> list[str]:
        return [f"{self.folder}/{name}.parquet" for name in ("lineitem", "part")]


class FieldPrices:
    """One field of a wide CSV whose two header rows name field and asset; only the asked assets, all of them, in their order."""

    def __init__(self, path: str, assets: list[str], name: str = "Close"):
        self.path, self.assets, self.name = path, list(assets), name

    def prices(self, spark: SparkSession, grain: str = "day") -> DataFrame:
        raw = spark.read.option("header", False).csv(self.path)
        head = raw.limit(2).collect()
        at = {asset: c for c, field, asset in zip(raw.columns[1:], list(head[0])[1:], list(head[1])[1:], strict=True) if field == self.name}
        checks.present(at, self.assets, "assets")
        cells = F.explode(F.array(*[F.struct(F.lit(a).alias("asset"), F.col(at[a]).try_cast("double").alias("raw")) for a in self.assets])).alias("e")
        day = F.to_date(F.try_to_timestamp(F.col(raw.columns[0]))).alias("date")
        out = raw.select(day, cells).where("date is not null").select(F.trunc("date", grain).alias("date") if grain != "day" else F.col("date"), "e.asset", "e.raw")
        return checks.some_rows(out, "prices")


@contextmanager
def staged(df: DataFrame, path: str, rules: dict[str, Column]) -> Iterator[DataFrame]:
    """Write df beside the target, observing its rows as they pass; the block may look at what was written, then it takes the target's place.

    One evaluation of df: rows, and rows that break a rule, are counted while they are
    written. No rows, a broken rule (null counts as broken) or an error in the block
    leave the target as it was.
    """
    spark = df.sparkSession
    seen, names = Observation(), list(rules)
    counts = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"broken_{k}") for k, ok in enumerate(rules.values())]
    draft, former = f"{path}.draft-{uuid4().hex}", f"{path}.former-{uuid4().hex}"
    fs, at = _file_system(spark, draft)
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n"), *counts).write.parquet(draft)
        found = seen.get
        if not found["n"]:
            raise ValueError(f"no rows: {path}")
        broken = {name: found[f"broken_{k}"] for k, name in enumerate(names) if found[f"broken_{k}"]}
        if broken:
            raise ValueError(f"rows that break a rule of {path}: {broken}")
        yield spark.read.parquet(draft)
        _, target = _file_system(spark, path)
        _, aside = _file_system(spark, former)
        if fs.exists(target):
            fs.rename(target, aside)
        if not fs.rename(at, target):
            raise OSError(f"could not place {path}")
        fs.delete(aside, True)
    finally:
        fs.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_table(df: DataFrame, path: str, csv: str | None = None) -> str:
    """A result table as Parquet, and as CSV if asked."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        df.sparkSession.read.parquet(path).write.mode("overwrite").option("header", True).csv(csv)
    return path


def write_scenarios(scen: DataFrame, path: str) -> str:
    """(scenario, asset, p, x) as (scenario, p, assets, x)."""
    row = F.sort_array(F.collect_list(F.struct("asset", "x")))
    packed = scen.groupBy("scenario").agg(F.max("p").alias("p"), row.alias("row"))  # one entry an asset
    part = lambda name: F.transform("row", lambda e: e[name]).alias({"asset": "assets"}.get(name, name))
    return write_table(packed.select("scenario", "p", part("asset"), part("x")), path)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, asset, p, x); values that are missing or not finite are an error."""
    rows = spark.read.parquet(path).select("scenario", "p", F.explode(F.arrays_zip("assets", "x")).alias("e"))
    return checks.finite(rows.select("scenario", F.col("e.assets").alias("asset"), "p", F.col("e.x").alias("x")), "p", "x")
