"""Readers: named Parquet tables, long price panels from CSV, and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = T.StructType([T.StructField("date", T.DateType(), False), T.StructField("asset", T.StringType(), False), T.StructField("raw_price", T.DoubleType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_wide_csv(spark: SparkSession, path: str, labels: list[str], suffix: str = "") -> DataFrame:
    """A wide CSV (date, one column per label) as (date, asset, value): labels in any order, all required, all finite."""
    wide = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    wide = wide.select("date", *[F.col(f"`{c}`").alias(c.removesuffix(suffix) if suffix else c) for c in wide.columns if c != "date"])
    missing = sorted(set(labels) - set(wide.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    typed = wide.select(F.to_date("date").alias("date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in labels])
    long = typed.unpivot("date", labels, "asset", "value")
    bad = long.where("value is null or isnan(value) or abs(value) = double('infinity')").limit(1).count()
    if bad:
        raise ValueError("values are missing or not finite")
    return long


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one of largest order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
