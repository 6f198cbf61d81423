"""Lineage of stages: a manifest per stage with the hash of every file it read and wrote.

Tables are folders of Parquet files. Their hashes are roots of hash trees over byte
ranges (``fingerprints``), so nothing but the manifest is read by the driver. The
leaves are kept in a table beside the manifest, and a changed file is told with its
first changed range. A manifest is written last, as one JSON file that replaces the
former one in a single rename; it names its table of leaves, and those of former
manifests go afterwards. Files of no bytes are passed over, and one
that is emptied is told as missing; a manifest without inputs or outputs is an error.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints as T

VERSION = 2


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(table, file, sha256, bytes, leaves) of every data file below the paths."""
    return T.hashed(spark, paths)


def _records(roots: DataFrame) -> list[dict]:
    return [r.asDict() for r in roots.select("table", "file", "sha256", "bytes").orderBy("table", "file").collect()]  # a row a file


def fingerprints(spark: SparkSession, paths: list[str]) -> list[dict]:
    """(table, sha256): one hash over the hashes of a table's files, in the order of their names."""
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "sha256"))), lambda s: s["sha256"]), ",")  # one entry a file
    return [r.asDict() for r in file_hashes(spark, paths).groupBy("table").agg(F.sha2(every, 256).alias("sha256")).collect()]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write beside the target, then rename over it in one call: readers see the old file or the new one, never none."""
    fs, at = _fs(spark, path)
    _, draft = _fs(spark, path + ".draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(draft, at, over)


def read_json(spark: SparkSession, path: str):
    """The value, or None where there is no file."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _leaves_of(path: str, name: str = "") -> str:
    return f"{path}.leaves/{name}".rstrip("/")


def write_manifest(spark: SparkSession, path: str, stage: str, inputs: list[str], outputs: list[str], metadata: dict | None = None) -> dict:
    if not inputs or not outputs:
        raise ValueError("a stage has one input and one output at least")
    every, name = sorted({*inputs, *outputs}), uuid.uuid4().hex
    T.leaves(spark, every).write.parquet(_leaves_of(path, name))
    stored = spark.read.parquet(_leaves_of(path, name))
    records = _records(T.roots(stored, stored.agg(F.max("bytes")).first()[0] or 0))
    read, wrote = ([r for r in records if r["table"] in tables] for tables in (set(inputs), set(outputs)))
    fs, folder = _fs(spark, _leaves_of(path))
    if not read or not wrote:
        fs.delete(_fs(spark, _leaves_of(path, name))[1], True)
        raise ValueError("a stage has one input and one output at least")
    manifest = {"version": VERSION, "stage": stage, "created": datetime.now(UTC).isoformat(), "leaves": name, "inputs": read, "outputs": wrote, "metadata": metadata or {}}
    write_json(spark, path, manifest)
    for old in fs.listStatus(folder):
        if old.getPath().getName() != name:
            fs.delete(old.getPath(), True)
    return manifest


def _changed_ranges(spark: SparkSession, path: str, manifest: dict, tables: list[str]) -> dict[tuple[str, str], tuple[int, int]]:
    """First changed range of each file of the tables; empty where the leaves are gone."""
    kept = _leaves_of(path, manifest.get("leaves", ""))
    fs, at = _fs(spark, kept)
    if not manifest.get("leaves") or not fs.exists(at):
        return {}
    before = spark.read.parquet(kept).where(F.col("table").isin(tables))
    first = T.changes(before, T.leaves(spark, tables)).groupBy("table", "file").agg(F.min(F.struct("start", "end")).alias("at"))
    return {(r["table"], r["file"]): (r["at"]["start"], r["at"]["end"]) for r in first.collect()}  # a row a changed file


def validate(spark: SparkSession, path: str, metadata: dict | None = None) -> list[str]:
    """What a manifest says and the files do not, as short texts; empty if all is as it was. With metadata, that has to agree, too."""
    try:
        manifest = read_json(spark, path)
    except ValueError:
        return ["the manifest is no JSON"]
    if manifest is None:
        return ["no manifest"]
    if manifest.get("version") != VERSION:
        return ["another version of manifests"]
    found = [] if metadata is None or manifest.get("metadata") == json.loads(json.dumps(metadata)) else ["other settings"]
    known = {group: manifest.get(group) or [] for group in ("inputs", "outputs")}
    found += [f"no {group}" for group, records in known.items() if not records]
    records = list({(r["table"], r["file"]): r for group in known.values() for r in group}.values())
    tables = [t for t in sorted({r["table"] for r in records}) if (at := _fs(spark, t))[0].exists(at[1])]
    there = {(r["table"], r["file"]): r for r in _records(file_hashes(spark, tables))} if tables else {}
    unlike = [r for r in records if (now := there.get((r["table"], r["file"]))) and (now["bytes"], now["sha256"]) != (r["bytes"], r["sha256"])]
    ranges = _changed_ranges(spark, path, manifest, sorted({r["table"] for r in unlike})) if unlike else {}
    for r in records:
        key = r["table"], r["file"]
        if there.pop(key, None) is None:
            found.append(f"missing: {r['file']}")
        elif r in unlike:
            found.append(f"changed: {r['file']}" + (" from byte {} to {}".format(*ranges[key]) if key in ranges else ""))
    found += [f"new: {file}" for _, file in there]
    return found


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions of what a run depends on."""
    import importlib.metadata as meta
    import platform

    found = {name: meta.version(name) for name in ("numpy", "pandas", "pyarrow")}
    return found | {"python": platform.python_version(), "spark": spark.version, "system": platform.platform()}


def code_fingerprint() -> str:
    """SHA-256 over the names and bytes of the package's modules."""
    root, seen = Path(__file__).resolve().parent, hashlib.sha256()
    for p in sorted(root.rglob("*.py")):
        seen.update(str(p.relative_to(root)).encode() + b"\0" + p.read_bytes() + b"\0")
    return seen.hexdigest()


def require(spark: SparkSession, path: str) -> None:
    """An error unless the stage's files are those of its manifest."""
    found = validate(spark, path)
    if found:
        raise RuntimeError(f"{path} is not current: {', '.join(found)}")
