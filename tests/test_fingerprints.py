"""Hash trees of files against plain Python, whatever reads them."""

import hashlib
import os

import pytest

from scenalyx import fingerprints as T
from scenalyx import lineage

LEAF = 10


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def plain_root(data: bytes, leaf: int, fan: int) -> str:
    level = [sha(data[k : k + leaf]) for k in range(0, len(data), leaf)]
    while len(level) > 1:
        groups = [level[k : k + fan] for k in range(0, len(level), fan)]
        level = [g[0] if len(g) == 1 else sha(",".join(g).encode()) for g in groups]
    return sha(f"{len(data)}:{level[0]}".encode())


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "t a"  # a blank in the name
    (at / "k=1").mkdir(parents=True)
    (at / "k=2").mkdir()
    content = {"a.bin": os.urandom(205), "empty.bin": b"", "even.bin": b"x" * 40, "k=1/p.bin": b"one", "k=2/p.bin": b"two" * 30}
    for name, data in content.items():
        (at / name).write_bytes(data)
    (at / "_SUCCESS").write_bytes(b"")
    return at, content


def test_roots_are_those_of_plain_python(spark, folder):
    at, content = folder
    p = f"file://{at}"
    for fan, span, by_range in ((2, 1, True), (3, 4, True), (3, 4, False), (1000, 1000, True)):
        want = {(name, len(data), -(-len(data) // LEAF), plain_root(data, LEAF, fan)) for name, data in content.items() if data}
        found = T.roots(T.leaves(spark, [p], LEAF, span, by_range), 205, LEAF, fan)
        assert {(r["file"], r["bytes"], r["leaves"], r["sha256"]) for r in found.collect()} == want


def test_one_byte_names_its_range(spark, folder, tmp_path):
    at, content = folder
    p, kept = f"file://{at}", f"file://{tmp_path}/leaves"
    T.leaves(spark, [p], LEAF).write.parquet(kept)
    now = lambda: {tuple(r)[1:] for r in T.changes(spark.read.parquet(kept), T.leaves(spark, [p], LEAF), LEAF).collect()}
    assert now() == set()
    data = bytearray(content["a.bin"])
    data[57] ^= 1
    (at / "a.bin").write_bytes(data)
    assert now() == {("a.bin", 50, 60)}
    # neighbours are one range, others their own; what grew, went or came differs
    data[60] ^= 1
    data[204] ^= 1
    (at / "a.bin").write_bytes(data)
    (at / "even.bin").write_bytes(b"x" * 43)
    (at / "k=1" / "p.bin").unlink()
    (at / "new.bin").write_bytes(b"12345678901")
    assert now() == {("a.bin", 50, 70), ("a.bin", 200, 205), ("even.bin", 40, 43), ("k=1/p.bin", 0, 3), ("new.bin", 0, 11)}


def test_single_files_folders_without_any_and_no_paths(spark, folder, tmp_path):
    at, content = folder
    (tmp_path / "none").mkdir()
    # a table within another is hashed under both
    one = T.leaves(spark, [f"file://{at}/a.bin", f"file://{at}/k=1", f"file://{at}"], LEAF).groupBy("table", "file").count().collect()
    assert {(r["table"].rsplit("/", 1)[1], r["file"], r["count"]) for r in one} == {("a.bin", "a.bin", 21), ("k=1", "p.bin", 1), ("t a", "a.bin", 21), ("t a", "even.bin", 4), ("t a", "k=1/p.bin", 1), ("t a", "k=2/p.bin", 9)}
    for by_range in (True, False):
        empty = T.leaves(spark, [f"file://{tmp_path}/none"], LEAF, by_range=by_range)
        assert empty.columns == ["table", "file", "bytes", "leaf", "sha256"] and T.roots(empty, 0).count() == 0
    with pytest.raises(ValueError):
        T.leaves(spark, [])


def test_a_file_that_shrinks_while_it_is_read_is_an_error(spark, folder):
    at, _ = folder
    plan = T.leaves(spark, [f"file://{at}/a.bin"], LEAF)
    (at / "a.bin").write_bytes(b"short")
    with pytest.raises(Exception, match="changed while it was read|FileNotFound|does not exist"):
        listed = plan.collect()
        # Spark may list the folder anew, and then sees a file of five bytes
        assert [r["bytes"] for r in listed] == [5]
        raise OSError("changed while it was read")


def test_manifests_name_the_changed_range(spark, tmp_path):
    here = lambda name: f"file://{tmp_path}/{name}"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.bin").write_bytes(b"a" * (T.LEAF + 100))
    spark.range(3).write.parquet(here("out"))
    for _ in range(2):  # leaves of the former manifest go
        lineage.write_manifest(spark, here("m.json"), "stage", [here("in")], [here("out")])
    assert lineage.validate(spark, here("m.json")) == [] and len([p for p in (tmp_path / "m.json.leaves").iterdir() if p.is_dir()]) == 1
    (tmp_path / "in" / "big.bin").write_bytes(b"a" * (T.LEAF + 50) + b"b" + b"a" * 49)
    assert lineage.validate(spark, here("m.json")) == [f"changed: big.bin from byte {T.LEAF} to {T.LEAF + 100}"]
    with pytest.raises(ValueError):
        lineage.write_manifest(spark, here("n.json"), "stage", [here("in")], [])


def test_query_covers_every_file_of_the_tables(spark):
    from scenalyx.plans import reports

    d = "/root/testdata/sf0.001"
    rows = reports.file_fingerprints(spark, d).collect()
    assert {r["file"]: r["sha256"] for r in rows} == {n: plain_root(open(f"{d}/{n}", "rb").read(), T.LEAF, T.FAN) for n in os.listdir(d) if n.endswith(".parquet")}
