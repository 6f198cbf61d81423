"""Hash trees of files: leaves are the SHA-256 of byte ranges, roots stand for whole files.

A file is cut into leaves of ``LEAF`` bytes. Tasks read spans of consecutive leaves, so
a file of any size spreads over as many tasks as it has spans, and a task holds one
leaf at a time. Leaves of a file are hashed together ``FAN`` at a time, level by level,
until one is left; the root is the hash of the file's length and that one. Roots do not
depend on spans or on who reads: stores that Python cannot read by range are read whole
by Spark's ``binaryFile`` and give the same leaves.

Two tables of leaves tell which ranges of which files differ (``changes``), without
reading what is equal a second time.

Defined cases: files of no bytes are passed over, as Spark's readers do, so one that is
emptied counts as gone; folders without files give no rows; files in folders below a table carry their path from the table on; files whose
length changes while they are read are an error; no paths are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import ship

#: Bytes of a leaf, leaves of a task's span, and nodes that are hashed together.
LEAF, SPAN, FAN = 1 << 22, 64, 4096
#: Spans that a task takes beyond the cluster's first few waves.
SPANS_A_TASK = 16
_COLUMNS = "table string, file string, bytes long, leaf long, sha256 string"


def _load(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(paths)


def _placed(spark: SparkSession, paths: list[str], *more: str) -> DataFrame:
    """(table, file, path, bytes, more) in one scan; a file below several of the paths has a row for each."""
    if not paths:
        raise ValueError("no paths")
    every, tables = sorted(set(paths)), []
    for p in every:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
        tables.append(F.struct(F.lit(p).alias("table"), F.lit(root).alias("root")))
    within = lambda t: (F.col("path") == t["root"]) | F.startswith(F.col("path"), F.concat(t["root"], F.lit("/")))
    rows = _load(spark, every).select("path", F.col("length").alias("bytes"), *more, F.explode(F.filter(F.array(*tables), within)).alias("t"))
    # a path that is a file has nothing below it
    below = F.when(F.col("path") == F.col("t.root"), F.element_at(F.split("path", "/"), -1)).otherwise(F.expr("substring(path, length(t.root) + 2)"))
    return rows.select("t.table", below.alias("file"), "path", "bytes", *more)


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(table, file, path, bytes) of every data file below the paths. Contents are not read."""
    # of paths that lie within each other files are listed more than once
    return _placed(spark, paths).dropDuplicates(["table", "file"])


def _open(path: str):
    """The file for reading by position."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    store, inside = fs.FileSystem.from_uri(quote("s3:" + rest if scheme == "s3a" else path, safe=":/@"))
    return store.open_input_file(inside)


def _readable(path: str) -> bool:
    """Whether Python reads the path's store. Only tells which of two ways that agree is taken."""
    if path.startswith("file:"):
        return True
    try:
        with _open(path):
            return True
    except Exception:  # every store fails in its own way
        return False


def _hashed(leaf: int, span: int):
    """Leaves of each span of a batch."""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                out = []
                with _open(row.path) as f:
                    f.seek(row.first * leaf)
                    for k in range(row.first, min(row.first + span, -(-row.bytes // leaf))):
                        data = f.read(leaf)
                        if len(data) != min(leaf, row.bytes - k * leaf):
                            raise OSError(f"{row.path} changed while it was read")
                        out.append((row.table, row.file, row.bytes, k, sha256(data).hexdigest()))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _COLUMNS.split(", ")])

    return fn


def _last(leaf: int):
    return F.ceil(F.col("bytes") / leaf) - 1


def _survey(listed: DataFrame, leaf: int, span: int) -> list:
    """Spans, a path and the greatest length of each kind of store: a row each."""
    return listed.groupBy(F.substring_index("path", ":", 1).alias("scheme")).agg(F.min("path").alias("path"), F.sum(F.floor(_last(leaf) / span) + 1).alias("spans"), F.max("bytes").alias("longest")).collect()


def _leaves(spark: SparkSession, paths: list[str], listed: DataFrame, stores: list, leaf: int, span: int, by_range: bool) -> DataFrame:
    ranged = {r["scheme"]: r["spans"] for r in stores if by_range and _readable(r["path"])}
    mine = F.substring_index("path", ":", 1).isin(*ranged) if ranged else F.lit(False)
    out = None
    if ranged:
        ship(spark)
        spans = sum(ranged.values())
        tasks = min(spans, max(4 * spark.sparkContext.defaultParallelism, -(-spans // SPANS_A_TASK)))
        spread = listed.where(mine).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), _last(leaf), F.lit(span).cast("long"))))
        # a fixed number, as rows are tiny beside what they stand for
        out = spread.repartition(tasks, "path", "first").mapInPandas(_hashed(leaf, span), _COLUMNS)
    if len(ranged) < len(stores) or out is None:
        at = F.sequence(F.lit(0).cast("long"), _last(leaf))
        each = F.transform(at, lambda k: F.sha2(F.substring(F.col("content"), (k * leaf + 1).cast("int"), F.lit(leaf)), 256))
        # hashed where they are scanned, so that no contents are shuffled
        rows = _placed(spark, paths, "content").where(~mine).select("table", "file", "bytes", F.posexplode(each).alias("leaf", "sha256"))
        rows = rows.withColumn("leaf", F.col("leaf").cast("long")).dropDuplicates(["table", "file", "leaf"])
        out = rows if out is None else out.unionByName(rows)
    return out


def leaves(spark: SparkSession, paths: list[str], leaf: int = LEAF, span: int = SPAN, by_range: bool = True) -> DataFrame:
    """(table, file, bytes, leaf, sha256): a row a leaf. Without ``by_range`` files are read whole, 2 GB at most each."""
    listed = files(spark, paths)
    return _leaves(spark, paths, listed, _survey(listed, leaf, span), leaf, span, by_range)


def hashed(spark: SparkSession, paths: list[str], leaf: int = LEAF) -> DataFrame:
    """(table, file, sha256, bytes, leaves) of every data file below the paths."""
    listed = files(spark, paths)
    stores = _survey(listed, leaf, SPAN)
    return roots(_leaves(spark, paths, listed, stores, leaf, SPAN, True), max((r["longest"] for r in stores), default=0), leaf)


def roots(found: DataFrame, biggest: int, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(table, file, sha256, bytes, leaves): a row a file; ``biggest`` is the length of the longest one."""
    node = found.select("table", "file", "bytes", F.col("leaf").alias("at"), "sha256")
    width = max(1, -(-biggest // leaf))
    while width > 1:
        width = -(-width // fan)
        own = F.sort_array(F.collect_list(F.struct("at", "sha256")))  # ``fan`` entries at most
        up = node.groupBy("table", "file", "bytes", F.floor(F.col("at") / fan).alias("at")).agg(own.alias("own"))
        # a node alone stands for itself, so depths of other files do not matter
        joined = F.array_join(F.transform("own", lambda s: s["sha256"]), ",")
        node = up.select("table", "file", "bytes", "at", F.when(F.size("own") == 1, F.col("own")[0]["sha256"]).otherwise(F.sha2(joined, 256)).alias("sha256"))
    top = F.sha2(F.concat_ws(":", F.col("bytes").cast("string"), "sha256"), 256)
    return node.select("table", "file", top.alias("sha256"), "bytes", F.ceil(F.col("bytes") / leaf).alias("leaves"))


def changes(before: DataFrame, after: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(table, file, start, end): the byte ranges whose leaves differ, neighbours as one; ends are exclusive.

    What only one side has counts as different. Both sides are tables of ``leaves``.
    """
    keys = ["table", "file", "leaf"]
    side = lambda df, name: df.select(*keys, F.col("bytes").alias(f"bytes_{name}"), F.col("sha256").alias(name))
    unlike = side(before, "old").join(side(after, "new"), keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    island = F.col("leaf") - F.row_number().over(Window.partitionBy("table", "file").orderBy("leaf"))
    sized = unlike.withColumn("bytes", F.greatest("bytes_old", "bytes_new")).withColumn("island", island)
    out = sized.groupBy("table", "file", "island").agg(F.min("leaf").alias("low"), F.max("leaf").alias("high"), F.max("bytes").alias("bytes"))
    return out.select("table", "file", (F.col("low") * leaf).alias("start"), F.least((F.col("high") + 1) * leaf, F.col("bytes")).alias("end"))
