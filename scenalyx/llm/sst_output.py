"""Token ids in sorted-string-table shards.

File format. Integers are little-endian unless said otherwise. Each record opens
with a letter and ends with the dataset's marker (32 hexadecimal digits, drawn
anew for each dataset), so readers can start anywhere; offsets count both.

    D  data block   number u32, documents before u64, ids before u64, then entries in key
                    order: shared u8, the other key bytes, n u32, n ids (u16 or u32 each, as
                    the letter after says: u16 where the vocabulary fits; shared counts
                    leading bytes in common with the entry before, 0 opens a block)
    I  index        per data block: last key (9 bytes), offset u64, size u64
    B  Bloom filter u32 bits, u8 probes, the filter
    F  footer       "SSTF", version u32, index offset u64 and size u64, Bloom offset u64 and
                    size u64, documents u64, ids u64, bytes of an id u8, first and last key

A key is 9 bytes, big-endian: 0 for a null identifier, else 1 and the identifier
with its sign bit flipped, so bytes sort as identifiers do. Shards are ranges of
identifiers. Spark's text sink writes the records (its committer keeps only whole
attempts when executors are lost), and its text source reads them block by block,
so a shard may be of any size and several tasks share it. ``lookup`` reads by
ranges: footers by binary search over the shards, one Bloom filter, one index and
one block. Both work on any file system that Spark has.

Defined cases: null text is empty and has the end id only; equal identifiers are
stored one after the other, in order of a hash of their texts, over several shards
where they are many; other columns are ignored; no rows make no documents.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from . import kernels as K
from .spark import checkpoint_dir, cut, delete, free_shuffles, map_arrow, partitions, session_of

BLOCK_BYTES = 1 << 16
BITS_PER_KEY, PROBES = 10, 7
FOOTER = struct.Struct("<c4sIQQQQQQB9s9s")
BLOCK = struct.Struct("<cBIQQ")
MARK = 32


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + ((doc_id ^ (1 << 63)) & (1 << 64) - 1 if doc_id >= 0 else doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _slots(key: bytes, bits: int):
    one, two = zlib.crc32(key), zlib.adler32(key[::-1]) * 2654435761 & 0xFFFFFFFF | 1
    return [(one + k * two) % bits for k in range(PROBES)]


class Writer:
    """Turns (key, ids) in key order into the records of one shard."""

    def __init__(self, id_bytes: int = 4):
        self.id_bytes = id_bytes
        self.at, self.block, self.last, self.index, self.keys, self.ids = 0, [], b"", [], [], 0
        self.size, self.before = 0, (0, 0)

    def _record(self, raw: bytes) -> bytes:
        self.at += len(raw) + MARK
        return raw

    def add(self, key: bytes, ids: np.ndarray) -> bytes | None:
        shared = 0
        while self.block and shared < 9 and key[shared] == self.last[shared]:
            shared += 1
        entry = bytes([shared]) + key[shared:] + struct.pack("<I", len(ids)) + ids.astype(f"<u{self.id_bytes}").tobytes()
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        return self._close() if self.size >= BLOCK_BYTES else None

    def _close(self) -> bytes:
        raw = BLOCK.pack(b"D", self.id_bytes, len(self.index), *self.before) + b"".join(self.block)
        self.index.append(self.last + struct.pack("<QQ", self.at, len(raw)))
        self.block, self.size, self.before = [], 0, (len(self.keys), self.ids)
        return self._record(raw)

    def finish(self):
        if self.block:
            yield self._close()
        index_at, index = self.at, b"I" + b"".join(self.index)
        yield self._record(index)
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for s in _slots(key, bits):
                bloom[s >> 3] |= 1 << (s & 7)
        bloom_at, raw = self.at, b"B" + struct.pack("<IB", bits, PROBES) + bytes(bloom)
        yield self._record(raw)
        yield FOOTER.pack(b"F", b"SSTF", 2, index_at, len(index), bloom_at, len(raw), len(self.keys), self.ids, self.id_bytes, self.keys[0], self.keys[-1])


def ids_before(raw: bytes) -> int:
    """Ids of the shard before a data block."""
    return BLOCK.unpack_from(raw)[4]


def entries(raw: bytes):
    """(key, ids) of a data block."""
    view, key = memoryview(raw), b""
    at, width = BLOCK.size, raw[1]
    while at < len(raw):
        shared = view[at]
        key = key[:shared] + bytes(view[at + 1 : at + 10 - shared])
        at += 10 - shared
        (n,) = struct.unpack_from("<I", view, at)
        at += 4
        yield key, np.frombuffer(view[at : at + width * n], f"<u{width}").astype("<u4")
        at += width * n


class Reader:
    """Access to one shard by ranges: fetch(offset, size) gives bytes; index and filter are read when needed."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int):
        self.fetch = fetch
        letter, magic, version, *self.places, self.documents, self.ids, self.id_bytes, self.first, self.last = FOOTER.unpack(fetch(size - MARK - FOOTER.size, FOOTER.size))
        if (letter, magic, version) != (b"F", b"SSTF", 2):
            raise ValueError("not a token shard")
        self.marker = fetch(size - MARK, MARK).decode()

    @cached_property
    def index(self) -> list[tuple[bytes, int, int]]:
        raw = self.fetch(*self.places[:2])
        return [(raw[i : i + 9], *struct.unpack_from("<QQ", raw, i + 9)) for i in range(1, len(raw), 25)]

    @cached_property
    def bloom(self) -> tuple[int, bytes]:
        raw = self.fetch(*self.places[2:])
        return struct.unpack_from("<I", raw, 1)[0], raw[6:]

    def may_hold(self, key: bytes) -> bool:
        bits, filter_ = self.bloom
        return all(filter_[s >> 3] >> (s & 7) & 1 for s in _slots(key, bits))

    def entries(self):
        for _, at, size in self.index:
            yield from entries(self.fetch(at, size))

    def lookup(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of the first document of that identifier: Bloom filter, binary search of the index, one block."""
        key = key_of(doc_id)
        if not self.first <= key <= self.last or not self.may_hold(key):
            return None
        _, at, size = self.index[bisect.bisect_left(self.index, key, key=lambda entry: entry[0])]
        return next((ids for k, ids in entries(self.fetch(at, size)) if k == key), None)


def open_shards(spark: SparkSession, path: str) -> list[Callable[[], Reader]]:
    """An opener for each shard below path, in the order of their ranges; nothing is read yet."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())

    def opener(status):
        def fetch(at: int, size: int) -> bytes:
            stream = fs.open(status.getPath())
            try:
                stream.seek(at)
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
            finally:
                stream.close()

        return lambda: Reader(fetch, status.getLen())

    return [opener(s) for s in found]


def lookup(spark: SparkSession, path: str, doc_id: int | None) -> np.ndarray | None:
    """Ids of the first stored document of that identifier, read by ranges; None if there is none."""
    shards, key = open_shards(spark, path), key_of(doc_id)
    at = bisect.bisect_left(shards, key, key=lambda open_: open_().last)
    return shards[at]().lookup(doc_id) if at < len(shards) else None


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> None:
    """Encode every row's text and write the shards below path, in ascending doc_id order."""
    shards = shards or partitions(session_of(docs))
    mark = uuid.uuid4().hex

    def run(batches):
        model = bpe.load(tokenizer, library=True)
        writer = Writer(2 if max(model.width - 1, end_id) < 1 << 16 else 4)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in K.chunks(batch, "text"):
                tokens, at = model.encode(data, offsets)
                out = []
                for i in range(b - a):
                    raw = writer.add(key_of(ids[a + i]), np.append(tokens[at[i] : at[i + 1]], end_id).astype("<u4"))
                    if raw is not None:
                        out.append(raw)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if writer.keys:
            yield pa.RecordBatch.from_arrays([pa.array(list(writer.finish()), pa.binary())], ["value"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    # equal rows may fill several ranges
    placed = source.repartitionByRange(shards, "doc_id", "tie", "deal").sortWithinPartitions("doc_id", "tie").drop("tie", "deal")
    # a string column holds any bytes, and the text sink writes them as they are
    records = map_arrow(placed, run, "value binary").select(F.col("value").cast("string").alias("value"))
    with free_shuffles(session_of(docs)):
        records.write.option("lineSep", mark).option("compression", "none").text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, before (ids of the shard before it), n_tokens, ids_crc32 of each stored document, block by block."""

    def run(batches):
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                if not raw.startswith(b"D"):
                    continue
                before = ids_before(raw)
                ids, sizes, crc = [], [], []
                for key, stored in entries(raw):
                    ids.append(id_of(key))
                    sizes.append(len(stored))
                    crc.append(zlib.crc32(stored.data))
                n = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids)), pa.array(ids, pa.int64()), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["shard", "doc_id", "before", "n_tokens", "ids_crc32"])

    shards = open_shards(spark, path)
    names = "shard string, doc_id long, before long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], names)
    records = spark.read.option("lineSep", shards[0]().marker).text(path)
    return map_arrow(records.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("shard"), F.col("value").cast("binary").alias("value")), run, names)


def sst_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = session_of(docs)
    path = f"{checkpoint_dir(spark)}/token-shards-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    write_shards(docs, path, tokenizer, end_id)
    stored = cut(read_shards(spark, path))
    delete(spark, path)
    totals = stored.groupBy("shard").agg(F.regexp_extract(F.col("shard"), r"part-(\d+)", 1).cast("long").alias("part"), F.sum("n_tokens").alias("n"))
    # one row a shard, in the order of the ranges
    order = Window.orderBy("part")
    totals = totals.select("shard", (F.sum("n").over(order) - F.col("n")).alias("skip"))
    return stored.join(totals, "shard").select("doc_id", (F.col("skip") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
