"""Sums over the blocks that a moving-block bootstrap draws, for series of any length.

A sum over a block is the difference of two running sums, so a sample of a series is
two look-ups a block. A series shorter than a bucket is one row, and every sample is
made beside it. A longer one is a table of wide buckets of its running sums (made over
ranges, see ``ordered``); draws are made by samples and spans of blocks, dealt to the
buckets that their ends fall into as packed places, and each bucket streams the places
past its sums. Rows and bytes of that grow with samples x blocks, and a task holds the
sums of one bucket and one span of draws. Both ways give the same sums.

Draws are keyed hashes of seed, stream, tags, sample and block, as in ``expr.hash32``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, partitions, ship
from .ordered import running_sums

#: Running sums of one row.
BUCKET = 4096
#: Samples of a short series, and blocks of a sample of a long one, that one row makes.
SAMPLES_A_ROW, BLOCKS_A_ROW = 250, 1 << 18
#: A bucket of a long series is so many times as wide, and wider where there would be more than so many; places of one row.
WIDER, MOST_BUCKETS, PLACES = 16, 1024, 4096
#: Fewest numbers that are hashed side by side, and most at a time.
MANY, AT_ONCE = 64, 1 << 14

#: Fixed values of MD5: turns by round, and the sines.
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(head: bytes, first: int, count: int) -> np.ndarray:
    """First four bytes, as a number, of the md5 of head and each decimal number of a run of equally many digits: one block, side by side."""
    digits = len(str(first))
    size = len(head) + digits
    text = np.zeros((64, count), np.uint8)
    text[: len(head)] = np.frombuffer(head, np.uint8)[:, None]
    number = np.arange(first, first + count)
    for k in range(size - 1, len(head) - 1, -1):
        number, text[k] = number // 10, number % 10 + 48
    text[size] = 128
    text[56], text[57] = size * 8 & 255, size * 8 >> 8
    words = np.ascontiguousarray(text.reshape(16, 4, count).transpose(0, 2, 1)).view("<u4")[:, :, 0]
    a, b, c, d = (np.full(count, x, np.uint32) for x in _START)
    for i in range(64):
        turn, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        f = d ^ (b & (c ^ d)) if turn == 0 else c ^ (d & (b ^ c)) if turn == 1 else b ^ c ^ d if turn == 2 else c ^ (b | ~d)
        f += a
        f += np.uint32(_SINES[i])
        f += words[at]
        s = _TURNS[turn][i % 4]
        high = f << np.uint32(s)
        f >>= np.uint32(32 - s)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return (a + np.uint32(_START[0])).astype("<u4").view(">u4").astype(np.int64)


def drawn(prefix: str, sample: int, blocks: range, room: int) -> np.ndarray:
    """First places of the blocks of a sample, from 0 to room - 1."""
    text = f"{prefix}|{sample}|".encode()
    out = np.empty(len(blocks), np.int64)
    if len(blocks) >= MANY and len(text) + len(str(blocks.stop)) < 56:
        at = blocks.start
        while at < blocks.stop:
            count = min(AT_ONCE, 10 ** len(str(at)) - at, blocks.stop - at)
            out[at - blocks.start : at - blocks.start + count] = _first_words(text, at, count)
            at += count
        return out % room
    head = md5(text)
    for k, b in enumerate(blocks):
        h = head.copy()
        h.update(b"%d" % b)
        out[k] = int.from_bytes(h.digest()[:4], "big")
    return out % room


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)))
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _short(n_seg: int, names: list[str], samples: int):
    """Rows (seg..., prefix, n, size, low, <name> running sums) as (seg..., sample, <name>)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)  # contrasts that share tags, lengths and samples share their draws
        for b in batches:
            prefixes, ns, sizes, lows = (b.column(n_seg + k).to_pylist() for k in range(4))
            cums = [_lists(b.column(n_seg + 4 + k)) for k in range(len(names))]
            for i, (prefix, n, size, low) in enumerate(zip(prefixes, ns, sizes, lows)):
                own = range(low, min(low + SAMPLES_A_ROW, samples))
                blocks = range(-(-n // size))
                if held[0] != (prefix, n, size, low):
                    held = ((prefix, n, size, low), np.stack([drawn(prefix, s, blocks, n - size + 1) for s in own]))
                start = held[1]
                end = start + np.minimum(size, n - size * np.arange(len(blocks)))
                sums = []
                for cum in cums:
                    full = np.append(0.0, cum[i])
                    sums.append(pa.array((full[end] - full[start]).sum(1)))
                at = pa.array(np.full(len(own), i))
                yield pa.record_batch([*(b.column(k).take(at) for k in range(n_seg)), pa.array(list(own), pa.int32()), *sums], [*b.schema.names[:n_seg], "sample", *names])

    return fn


def _ends(n_seg: int):
    """Rows (seg..., prefix, n, size, width, sample, low) as (seg..., bucket, sample, sign, places): ends and begins of the row's blocks by bucket."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (prefix, n, size, width, sample, low) in enumerate(zip(*(b.column(n_seg + k).to_pylist() for k in range(6)))):
                blocks = range(low, min(low + BLOCKS_A_ROW, -(-n // size)))
                start = drawn(prefix, sample, blocks, n - size + 1)
                end = start + np.minimum(size, n - size * np.arange(blocks.start, blocks.stop))
                for sign, place in ((1, end), (-1, start)):
                    place.sort()
                    edges = np.searchsorted(place, np.arange(place[0] // width, place[-1] // width + 2) * width)
                    cuts = np.unique(np.concatenate([edges, np.arange(0, len(place), PLACES)]))
                    bucket = place[cuts[:-1]] // width
                    packed = (place % width).astype("<u2" if width <= 1 << 16 else "<u4").tobytes()
                    step = 2 if width <= 1 << 16 else 4
                    lists = pa.array([packed[step * x : step * y] for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())
                    at, same = pa.array(np.full(len(bucket), i)), lambda v: pa.array(np.full(len(bucket), v), pa.int32())
                    yield pa.record_batch([*(b.column(k).take(at) for k in range(n_seg)), pa.array(bucket, pa.int64()), same(sample), same(sign * step), lists], [*b.schema.names[:n_seg], "bucket", "sample", "sign", "places"])

    return fn


def _looked_up(n_seg: int, names: list[str]):
    """Sorted rows (seg..., bucket, sample, sign, places, <name> running sums), a bucket's sums before its places, as (seg..., sample, <name>)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] = []
        for b in batches:
            samples, signs, places = (b.column(n_seg + k) for k in (1, 2, 3))
            at, found = [], []
            for i, (sign, blob) in enumerate(zip(signs.to_pylist(), places)):
                if not sign:
                    sums = [b.column(n_seg + 4 + k)[i].values.to_numpy() for k in range(len(names))]
                    continue
                place = np.frombuffer(blob.as_buffer(), "<u2" if abs(sign) == 2 else "<u4")
                at.append(i)
                found.append([(1 if sign > 0 else -1) * x[place].sum() for x in sums])
            if at:
                own, values = pa.array(at), np.array(found)
                yield pa.record_batch([*(b.column(k).take(own) for k in range(n_seg)), samples.take(own), *(pa.array(values[:, k]) for k in range(len(names)))], [*b.schema.names[:n_seg], "sample", *names])

    return fn


def block_sums(df: DataFrame, seg: list[str], order: list[str], values: dict[str, Column], blocks: DataFrame, on: list[str], samples: int, seed: int, stream: str, tags: list[str], bucket: int = BUCKET) -> DataFrame:
    """(seg, sample, n, <value>): each sample's sums over blocks of a segment, which keeps its length.

    ``blocks`` has (on, block) with ``on`` among seg; a block is cut to its segment.
    ``tags`` are the columns of seg whose values draw apart.
    """
    spark = df.sparkSession
    ship(spark)
    fields, names = [df.schema[c] for c in seg], list(values)
    prefix = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[F.col(t).cast("string") for t in tags])
    means = {c: f"__mean_{c}" for c in names}
    sizes = df.groupBy(*seg).agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.coalesce(v, F.lit(0.0))).alias(means[c]) for c, v in values.items())).join(blocks.select(*on, "block"), on)
    sizes = cut(sizes.select(*seg, *means.values(), prefix.alias("prefix"), "n", F.greatest(F.least(F.col("block").cast("long"), "n"), F.lit(1)).alias("size")))
    most = sizes.agg(F.max("n"), F.min("n")).first()
    doubles = [T.StructField(c, T.DoubleType()) for c in names]
    parts = []
    rows = df.select(*seg, *order, *(v.alias(c) for c, v in values.items()))
    if most[1] is None or most[1] < bucket:
        # a window over at most a bucket of rows
        short = rows.join(sizes.where(F.col("n") < bucket), seg)
        w = Window.partitionBy(*seg).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        short = short.select(*seg, "prefix", "n", "size", F.struct(F.row_number().over(w).alias("rn"), *(F.sum(c).over(upto).alias(c) for c in names)).alias("at"))
        packed = short.groupBy(*seg, "prefix", "n", "size").agg(F.sort_array(F.collect_list("at")).alias("at"))
        packed = packed.withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(SAMPLES_A_ROW))))
        # rows of a series are dealt over tasks: they only repeat its arrays
        packed = packed.select(*seg, "prefix", "n", "size", "low", *(F.col(f"at.{c}").alias(c) for c in names)).repartition("prefix", "n", "size", "low")
        packed = packed.sortWithinPartitions("prefix", "n", "size", "low")
        schema = T.StructType([*fields, T.StructField("sample", T.IntegerType()), *doubles])
        parts.append(packed.mapInArrow(_short(len(seg), names, samples), schema))
    if most[0] is not None and most[0] >= bucket:
        long = sizes.where(F.col("n") >= bucket)
        long = long.withColumn("width", F.greatest(F.lit(bucket * WIDER).cast("long"), F.ceil(F.col("n") / MOST_BUCKETS)))
        # sums about the mean stay small, and so do their rounding errors
        sums = running_sums(rows.join(long.select(*seg, "width", *means.values()), seg), seg, order, {"__rn": F.lit(1.0)} | {f"__{c}": F.coalesce(c, F.lit(0.0)) - F.col(m) for c, m in means.items()})
        at = F.struct(F.col("__rn").alias("rn"), *(F.col(f"__{c}").alias(c) for c in names))
        table = sums.groupBy(*seg, F.floor(F.col("__rn") / F.col("width")).alias("bucket")).agg(F.sort_array(F.collect_list(at)).alias("at"))
        # the running sum before the first row is 0
        zero = F.when(F.col("bucket") == 0, F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
        none = (F.lit(-1).alias("sample"), F.lit(0).alias("sign"), F.lit(None).cast("binary").alias("places"))
        table = table.select(*seg, "bucket", *none, *(F.concat(zero, F.col(f"at.{c}")).alias(c) for c in names))
        draws = long.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("size")) - 1, F.lit(BLOCKS_A_ROW).cast("long"))))
        draws = draws.repartition(partitions(spark), "prefix", "sample", "low").select(*seg, "prefix", "n", "size", "width", "sample", "low")
        lists = [T.StructField("bucket", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("sample", "sign")), T.StructField("places", T.BinaryType())]
        ends = draws.mapInArrow(_ends(len(seg)), T.StructType([*fields, *lists])).select("*", *(F.lit(None).cast("array<double>").alias(c) for c in names))
        # a bucket's sums come first, as sample -1
        both = table.unionByName(ends).repartition(partitions(spark), *seg, "bucket").sortWithinPartitions(*seg, "bucket", "sample")
        met = both.mapInArrow(_looked_up(len(seg), names), T.StructType([*fields, T.StructField("sample", T.IntegerType()), *doubles]))
        met = met.groupBy(*seg, "sample").agg(*(F.sum(c).alias(c) for c in names)).join(long.select(*seg, "n", *means.values()), seg)
        parts.append(met.select(*seg, "sample", *((F.col(c) + F.col("n") * F.col(m)).alias(c) for c, m in means.items())))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.join(sizes.select(*seg, "n"), seg)
