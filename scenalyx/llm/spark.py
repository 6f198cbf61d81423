"""Spark plumbing shared by the text operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, however they were started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="package-")
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, else one of our own on a single machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"checkpoint-{spark.sparkContext.applicationId}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


@contextmanager
def free_shuffles(spark: SparkSession):
    """Executions in this block drop their shuffle files at their end: their results are in shared files by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def owned_checkpoints(spark: SparkSession):
    """Checkpoints made in this block are deleted once no frame on this driver reads them.

    Spark looks at the setting when it makes a checkpoint, so others are left as the
    deployment wants them.
    """
    key, conf = "spark.cleaner.referenceTracking.cleanCheckpoints", spark.sparkContext._jsc.sc().conf()
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint; its files go when the frame and all that was made from it do."""
    spark = session_of(df)
    checkpoint_dir(spark)
    with free_shuffles(spark), owned_checkpoints(spark):
        return df.checkpoint(eager=True)


class Scratch:
    """Tables of one call in the shared folder: they cut lineage, and go once what needs them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame | Sliced, str]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table: smaller than a checkpoint for packed columns."""
        path = f"{checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        with free_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def size(self, frame: DataFrame) -> int:
        """Bytes of a table's files."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(next(path for f, path in self.held if f is frame))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def drop(self, *frames: DataFrame | Sliced) -> None:
        """Delete the tables of the given frames, or all."""
        for frame, path in list(self.held):
            if not frames or any(frame is f for f in frames):
                delete(self.spark, path)
                self.held.remove((frame, path))


class Sliced:
    """A table of a Scratch in numbered slices, which are added to, read and dropped by themselves."""

    def __init__(self, tables: Scratch, name: str, schema: str):
        self.spark, self.schema = tables.spark, schema
        self.path = f"{checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        tables.held.append((self, self.path))

    def add(self, df: DataFrame, number: Column) -> None:
        with free_shuffles(self.spark):
            df.withColumn("slice", number).write.mode("append").partitionBy("slice").parquet(self.path)

    def read(self, *numbers: int) -> DataFrame:
        """Rows of the given slices."""
        jvm, out = self.spark.sparkContext._jvm, self.spark.createDataFrame([], self.schema)
        at = [f"{self.path}/slice={k}" for k in numbers]
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        at = [p for p in at if fs.exists(jvm.org.apache.hadoop.fs.Path(p))]  # a slice without rows has no folder
        return self.spark.read.schema(self.schema).parquet(*at) if at else out

    def drop(self, *numbers: int) -> None:
        for k in numbers:
            delete(self.spark, f"{self.path}/slice={k}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can reach."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle width: a setting of the deployment, in proportion to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB: a worker's memory then follows the kernels' chunks, not ten thousand whole texts."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key, None)
        now = int(now) if now and now.isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return what a task has freed to the system: its worker idles beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(session_of(df))
    small_batches(session_of(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def targets(spark: SparkSession, n: int) -> np.ndarray:
    """n integer keys that hash partitioning by an int column deals one to each of n partitions."""
    found: dict[int, int] = {}
    step, at = 16 * n + 64, 0
    while len(found) < n:
        rows = spark.range(at, at + step).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()
        for r in rows:
            found.setdefault(r["p"], r["k"])
        at += step
    return np.array([found[p] for p in range(n)], np.int32)


def target_column(keys: np.ndarray, of: F.Column) -> F.Column:
    """The key at the position that a 0-based column gives."""
    return F.element_at(F.array(*[F.lit(int(k)) for k in keys]), (of + 1).cast("int"))


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


#: Edges of which a side may be broadcast: 16 bytes each.
BROADCAST_EDGES = 200_000


def components(edges: DataFrame, tables: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable, for every node of an undirected edge list (self links are dropped).

    Large-star and small-star steps by turns. Each is a grouped minimum (combined
    before the shuffle) joined back to the edges, so no neighbourhood is ever
    gathered; a table in the shared folder after each round cuts the lineage, and
    replaces that of the round before. The minima are broadcast while a count of the
    edges bounds them, and joined by shuffle otherwise (adaptive execution splits hot
    nodes). An edge has 16 bytes where a document has kilobytes, so these tables are
    written by an eighth of the shuffle's tasks.
    """
    few = max(1, partitions(session_of(edges)) // 8)
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = tables.written(e.coalesce(few), "components")

    def star(e: DataFrame, large: bool, small: bool) -> DataFrame:
        both = e.where("u <> v")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        side = F.broadcast(low) if small else low
        if large:  # edges to smaller neighbours come back from those neighbours' side
            return both.where("v > u").join(side, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = both.join(side, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(e)
    while True:
        before, last = now, e
        # one round at most doubles the edges on the way
        e = tables.written(star(star(e, True, before[0] <= BROADCAST_EDGES), False, before[0] <= BROADCAST_EDGES).coalesce(few), "components")
        tables.drop(last)
        now = state(e)
        if before == now:
            break
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
