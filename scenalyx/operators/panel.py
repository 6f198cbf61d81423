"""Panel operators: prices, bounded filling, returns, compounding, quality.

A panel is long: (date, asset, ...). Windows are partitioned by asset, so their
work grows with the number of dates of one asset; asset universes are broadcast
only because a universe is a configured list.

Defined cases: a missing price stays null where no raw price stands within the
limit; a price of 0 or less gives no return (``positive`` refuses it); a return of
-1 or less makes every window that holds it null (``compoundable`` refuses it);
equal (date, asset) rows have to be folded first (``keep_last``); no rows give no
rows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT = "1999-12-31"


def by_asset():
    """Rows of one asset by date."""
    return Window.partitionBy("asset").orderBy("date")


def price_panel(lineitem: DataFrame, part: DataFrame, grain: str = "day") -> DataFrame:
    """(date, asset, raw): mean unit price by calendar grain and part type, on the full grid of dates and assets."""
    px = lineitem.select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity").join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    px = px.groupBy(F.date_trunc(grain, "l_shipdate").cast("date").alias("date"), F.col("p_type").alias("asset")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("raw"))
    return on_grid(px)


def on_grid(px: DataFrame) -> DataFrame:
    """Every date for every asset; raw is null where nothing was observed."""
    cell = F.struct("asset", "raw")
    by_date = px.groupBy("date").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    universe = px.select("asset").distinct()
    grid = by_date.join(F.broadcast(universe.agg(F.sort_array(F.collect_set("asset")).alias("assets"))))
    return grid.select("date", "cells", F.explode("assets").alias("asset")).select("date", "asset", F.element_at("cells", F.col("asset")).alias("raw"))


def cleaned(panel: DataFrame) -> DataFrame:
    """Infinite prices are missing."""
    return panel.withColumn("raw", F.when(F.abs("raw") == float("inf"), None).otherwise(F.col("raw")))


def fill(panel: DataFrame, limit: int = 2) -> DataFrame:
    """price: raw, or the last raw price of at most ``limit`` rows before."""
    return panel.withColumn("price", F.last("raw", ignorenulls=True).over(by_asset().rowsBetween(-limit, 0)) if limit else F.col("raw"))


def complete(panel: DataFrame) -> DataFrame:
    """Dates on which every asset has a price."""
    w = Window.partitionBy("date")
    return panel.withColumn("have", F.count("price").over(w)).withColumn("all", F.count(F.lit(1)).over(w)).where(F.col("have") == F.col("all")).drop("have", "all")


def longest_run(df: DataFrame, keys: list[str], flag: Column, name: str) -> DataFrame:
    """Longest run of rows with flag, by date within keys (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy("date")
    marked = df.withColumn("flag", flag.cast("int")).withColumn("rn", F.row_number().over(w))
    island = marked.withColumn("island", F.col("rn") - F.row_number().over(Window.partitionBy(*keys, "flag").orderBy("date")))
    runs = island.groupBy(*keys, "flag", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.max(F.when(F.col("flag") == 1, F.col("n")).otherwise(0)).alias(name))


def coverage(panel: DataFrame) -> DataFrame:
    """Per asset: dates, observations, coverage, first and last observation, imputed and unresolved cells."""
    seen = F.col("raw").isNotNull()
    return panel.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.count("raw").alias("n_obs"),
        F.avg(seen.cast("double")).alias("coverage"),
        F.min(F.when(seen, F.col("date"))).alias("first_obs"),
        F.max(F.when(seen, F.col("date"))).alias("last_obs"),
        F.count_if(~seen & F.col("price").isNotNull()).alias("imputed"),
        F.count_if(F.col("price").isNull()).alias("unresolved"),
    )


def returns(panel: DataFrame, split: str = SPLIT, exclude_imputed: bool = True, begin: str | None = None) -> DataFrame:
    """(date, asset, ret, segment): lag-1 returns; a date goes if an end point of any asset was imputed.

    In sample up to and with ``split``; out of sample from ``begin`` on (the day after, if
    none is given). What lies between belongs to neither and goes.
    """
    seen = F.col("raw").isNotNull()
    r = panel.select("date", "asset", "price", seen.alias("obs"), F.lag("price").over(by_asset()).alias("p0"), F.lag(seen).over(by_asset()).alias("obs0")).where("p0 is not null")
    r = r.withColumn("ret", F.try_divide(F.col("price"), F.when(F.col("p0") > 0, F.col("p0"))) - 1).where("ret is not null")
    if exclude_imputed:
        r = r.withColumn("ok", F.min((F.col("obs") & F.col("obs0")).cast("int")).over(Window.partitionBy("date"))).where("ok = 1")
    if begin is not None:
        r = r.where((F.col("date") <= F.lit(split).cast("date")) | (F.col("date") >= F.lit(begin).cast("date")))
    return r.select("date", "asset", "ret", F.when(F.col("date") <= F.lit(split).cast("date"), "is").otherwise("oos").alias("segment"))


def terminal(rets: DataFrame, horizon: int = 5, keys: tuple[str, ...] = ("segment",)) -> DataFrame:
    """Compounded returns of every window of ``horizon`` rows within keys and asset; stride marks the non-overlapping ones."""
    w = Window.partitionBy(*keys, "asset").orderBy("date")
    out = rets.withColumn("rn", F.row_number().over(w)).withColumn("s", F.when(F.min("ret").over(w.rowsBetween(1 - horizon, 0)) > -1, F.sum(F.log1p(F.greatest("ret", F.lit(-1 + 1e-15)))).over(w.rowsBetween(1 - horizon, 0))))
    return out.where(F.col("rn") >= horizon).select(*keys, "asset", "date", "rn", F.expm1("s").alias("tret"), (F.pmod(F.col("rn") - horizon, F.lit(horizon)) == 0).alias("is_nonoverlap"))


def quality(panel: DataFrame, rets: DataFrame) -> DataFrame:
    """Per asset and segment: rows, share and longest run of zero returns, volatility."""
    zero = F.col("ret") == 0
    run = longest_run(rets, ["asset", "segment"], zero, "max_zero_run")
    base = rets.groupBy("asset", "segment").agg(F.count(F.lit(1)).alias("n"), F.avg(zero.cast("double")).alias("zero_rate"), F.stddev_pop("ret").alias("vol"))
    return base.join(run, ["asset", "segment"])


def flags(q: DataFrame, max_rate: float, max_run: int) -> DataFrame:
    """Wide flags by asset with strict limits on the share and the longest run of zero returns; whether an asset deteriorates out of sample."""
    bad = (F.col("zero_rate") > max_rate) | (F.col("max_zero_run") > max_run)
    of = lambda segment: F.coalesce(F.max(F.when(F.col("segment") == segment, F.col("bad"))), F.lit(False))
    wide = q.withColumn("bad", bad).groupBy("asset").agg(of("is").alias("flag_is"), of("oos").alias("flag_oos"))
    return wide.withColumn("deteriorates", F.col("flag_oos") & ~F.col("flag_is"))


def universe(q: DataFrame, max_rate: float, max_run: int, least: int = 2) -> DataFrame:
    """Assets chosen on in-sample columns alone (zero rate and zero run), with reasons; out-of-sample figures join after the choice."""
    own = q.where("segment = 'is'").select("asset", "zero_rate", "max_zero_run")
    reason = F.concat_ws("+", F.when(F.col("zero_rate") > max_rate, "zero_rate"), F.when(F.col("max_zero_run") > max_run, "zero_run"))
    chosen = own.select("asset", (reason == "").alias("selected"), reason.alias("reason"))
    later = q.where("segment = 'oos'").select("asset", F.col("zero_rate").alias("zero_rate_oos"), F.col("vol").alias("vol_oos"))
    return chosen.withColumn("enough", F.sum(F.col("selected").cast("int")).over(Window.partitionBy()) >= least).join(later, "asset", "left")


def price_profile(panel: DataFrame) -> DataFrame:
    """Per asset: observed prices, share of distinct ones, smallest and largest."""
    return panel.where("raw is not null").groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_obs"),
        (F.count_distinct("raw") / F.count(F.lit(1)).cast("double")).alias("unique_ratio"),
        F.min("raw").alias("low"),
        F.max("raw").alias("high"),
    )


def with_full_segment(rets: DataFrame) -> DataFrame:
    """Every return in its own segment and in ``full``."""
    return rets.withColumn("segment", F.explode(F.array(F.col("segment"), F.lit("full"))))
