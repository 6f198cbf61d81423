"""Session factory and shipping of this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="core-")
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


_owning = threading.Lock()
#: Blocks of owned_checkpoints that are open, and the deployment's own setting while there are any.
_open: list[str] = []


@contextmanager
def owned_checkpoints(spark: SparkSession):
    """Checkpoints made in this block are deleted once no frame on this driver reads them.

    Spark looks at the setting when it makes a checkpoint, so others are left as the
    deployment wants them. Blocks of several threads may overlap: the last one puts the
    setting back.
    """
    key, conf = "spark.cleaner.referenceTracking.cleanCheckpoints", spark.sparkContext._jsc.sc().conf()
    with _owning:
        _open.append(_open[-1] if _open else conf.get(key, "false"))
        conf.set(key, "true")
    try:
        yield
    finally:
        with _owning:
            before = _open.pop()
            if not _open:
                conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """A table that several branches of a plan read: made once, in the shared folder, with its lineage cut.

    Its files go when the frame and all that was made from it do.
    """
    checkpoint_dir(df.sparkSession)
    with owned_checkpoints(df.sparkSession):
        return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """Shuffle width: a setting of the deployment, in proportion to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
