"""Running sums over series of any length, and series dealt into blocks with their neighbours' edges.

A running sum is no window over its series: rows are sorted into ranges of (keys,
order) by sampled splitters, every task sums its own range as it streams by, and what
carries over from range to range is one row each. A series of all rows is so dealt over
all tasks. Where rows tie in ``order``, sum by value first (``value_sums``): a value
that many rows share is one row before anything is sorted.

Defined cases: null keys are keys like others; a null summand adds nothing; rows that
tie in keys and order are summed in an order of their own, the same for all sums; no
rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, partitions, ship

#: Fewest rows of a block of a series.
BLOCK = 4096


def _differs(column: pa.Array) -> np.ndarray:
    """For each place from the second on: whether the value is not that before it; nulls are equal to one another."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unequal | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _running(n_keys: int, names: list[str]):
    """Sorted batches (keys, ..., summands) with the sums so far of each run of equal keys; run counts the key changes of the task."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.Array] = []
        carry, run = np.zeros(len(names)), -1
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for k in range(n_keys):
                joined = pa.concat_arrays([last[k] if last else b.column(k).slice(0, 1), b.column(k)])
                new |= _differs(joined)
            new[0] |= not last
            runs = run + new.cumsum()
            first = np.append(new.nonzero()[0], b.num_rows)
            sums = []
            for k, name in enumerate(names):
                x = np.nan_to_num(b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(float), nan=0.0)
                total = np.empty(len(x))
                total[: first[0]] = carry[k] + x[: first[0]].cumsum()
                for i, j in zip(first[:-1], first[1:]):
                    total[i:j] = x[i:j].cumsum()
                carry[k] = total[-1]
                sums.append(pa.array(total))
            last, run = [b.column(k).slice(b.num_rows - 1) for k in range(n_keys)], int(runs[-1])
            yield pa.record_batch([*b.columns, *sums, pa.array(runs, pa.int64())], [*b.schema.names, *(f"{n}__sum" for n in names), "__run"])

    return fn


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], adaptive: bool = False) -> DataFrame:
    """df with a column for each of ``sums``: its running sum within keys, in order, the row's own included.

    Ranges are as many as shuffle partitions, or, if ``adaptive``, fewer where Spark joins neighbours that hold little.
    """
    spark = df.sparkSession
    ship(spark)
    names = [f"__{k}" for k in range(len(sums))]
    rest = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, *rest, *(F.coalesce(v, F.lit(0.0)).cast("double").alias(n) for n, v in zip(names, sums.values())))
    cols = [F.col(c) for c in (*keys, *order)]
    ranges = (rows.repartitionByRange(*cols) if adaptive else rows.repartitionByRange(partitions(spark), *cols)).sortWithinPartitions(*cols)
    doubles = [T.StructField(f"{n}__sum", T.DoubleType()) for n in names]
    schema = T.StructType([*ranges.schema.fields, *doubles, T.StructField("__run", T.LongType())])
    local = ranges.mapInArrow(_running(len(keys), names), schema).drop(*names)
    local = cut(local.withColumn("__range", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()))
    # one row a range: the first key, the last one, and what of the last one's sums goes on to later ranges
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
    ends = local.groupBy("__range").agg(F.min_by(key, "__place").alias("head"), F.max_by(F.struct(key.alias("key"), *(F.col(f"{n}__sum") for n in names)), "__place").alias("tail")).orderBy("__range").collect()
    carries, now, total = [], None, [0.0] * len(names)
    for r in ends:
        if r["head"] != now:
            total = [0.0] * len(names)
        carries.append((r["__range"], *total))
        own = [r["tail"][f"{n}__sum"] for n in names]
        # a range of one key hands on what came before it, too
        total = [t + x for t, x in zip(total, own)] if r["head"] == r["tail"]["key"] else own
        now = r["tail"]["key"]
    carried = spark.createDataFrame(carries, T.StructType([T.StructField("__range", T.IntegerType()), *(T.StructField(f"{n}__carry", T.DoubleType()) for n in names)]))
    out = local.join(F.broadcast(carried), "__range")
    whole = [(F.col(f"{n}__sum") + F.when(F.col("__run") == 0, F.col(f"{n}__carry")).otherwise(0.0)).alias(name) for n, name in zip(names, sums)]
    return out.select(*df.columns, *whole)


def value_sums(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """(keys, value, <sum> and <sum>_upto): one row for each distinct value, its own sums and those of all values up to it."""
    own = df.groupBy(*keys, value).agg(*(F.sum(v).alias(n) for n, v in sums.items()))
    # sets of scenarios are summed again and again, and small ones are not to be a task for every shuffle partition
    return running_sums(own, keys, [value], {f"{n}_upto": F.col(n) for n in sums}, adaptive=True)


def placed(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """df with each row's place in its series, from 1."""
    return running_sums(df, keys, order, {name: F.lit(1.0)}).withColumn(name, F.col(name).cast("long"))


def haloed(df: DataFrame, keys: list[str], rn: str, block: Column, halo: Column) -> DataFrame:
    """Rows of (keys, block_no, own, rn, ...): every series in blocks of ``block`` places; each block also gets (own = false) the first ``halo`` places of the next one.

    ``halo`` may not be over ``block``.
    """
    d = df.withColumn("block_no", F.floor((F.col(rn) - 1) / block)).withColumn("__at", (F.col(rn) - 1) % block)
    to = F.array(F.struct(F.col("block_no").alias("no"), F.lit(True).alias("own")), F.struct((F.col("block_no") - 1).alias("no"), F.lit(False).alias("own")))
    d = d.withColumn("__to", F.explode(F.slice(to, F.lit(1), F.when((F.col("__at") < halo) & (F.col("block_no") > 0), 2).otherwise(1))))
    return d.withColumn("block_no", F.col("__to.no")).withColumn("own", F.col("__to.own")).drop("__to", "__at")
