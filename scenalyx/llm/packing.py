"""Best-fit packing by length-histogram planning.

Texts become pieces of at most ``capacity`` tokens. The histogram of piece
lengths (at most ``capacity`` rows, whatever the corpus) is all that the planner
sees. It packs best fit, longest lengths first, over *counts*: open sequences are
kept as numbers of sequences by remaining room, and all pieces of a length go at
once into the smallest rooms that take them, as item-wise best fit would place
them one by one. Pieces then take the planned slots by joining on their rank
within their length. Ranks are counted in two steps, within (length, bucket) and
over the buckets, so a length that a third of all pieces share is spread over all
tasks.

The plan's runs are bounded by the capacity, not by the corpus: a length splits at
most one group of open sequences and opens two, and a sequence has at most about
``sqrt(2 * capacity)`` distinct lengths.

Defined cases: null text is empty and still ends with the end id (one token);
equal rows take slots of their own; equal doc_ids are packed row by row; null
doc_ids are packed too; no rows, no plan; other columns are ignored.
"""

from __future__ import annotations

import bisect
import collections
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import kernels as K
from .spark import cut, map_arrow, partitions, session_of


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, pieces per sequence, first offset)."""
    rooms: list[int] = []  # sorted; those with open sequences
    open_: dict[int, collections.deque] = {}  # room: (first sequence, number of sequences)
    runs, sequences = [], 0

    def keep(room: int, first: int, count: int) -> None:
        if room and count > 0:
            if room not in open_:
                open_[room] = collections.deque()
                bisect.insort(rooms, room)
            open_[room].append((first, count))

    for n in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        rank, left = 0, histogram[n]

        def fill(room: int, first: int, count: int, n: int = n) -> None:
            """Best fit stays with a sequence while it takes another piece, as its room only gets smaller."""
            nonlocal rank, left
            each = room // n
            full = min(count, left // each)
            for start, number, m in ((first, full, each), (first + full, min(1, count - full), left - full * each)):
                if number and m:
                    runs.append((n, rank, rank + number * m, start, m, capacity - room))
                    rank += number * m
                    left -= number * m
                    keep(room - n * m, start, number)
                elif number:
                    keep(room, start, number)
            keep(room, first + full + 1, count - full - 1)

        while left:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                break
            room = rooms[at]
            first, count = open_[room].popleft()
            if not open_[room]:
                del open_[room], rooms[at]
            fill(room, first, count)
        if left:
            count = -(-left // (capacity // n))
            first, sequences = sequences, sequences + count
            fill(capacity, first, count)
    return runs


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: cut only what is longer, the first piece taking the remainder."""

    def run(batches):
        model = bpe.load(path, library=True)
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in K.chunks(batch, "text"):
                tokens, at = model.encode(data, offsets)
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(b - a):
                    own = np.append(tokens[at[i] : at[i + 1]], end_id).astype("<u4")
                    whole = len(own)
                    cut_at = [0, *range(whole % capacity or capacity, whole + 1, capacity)]
                    for k in range(len(cut_at) - 1):
                        row.append(i)
                        piece.append(k)
                        start.append(cut_at[k])
                        length.append(cut_at[k + 1] - cut_at[k])
                        crc.append(zlib.crc32(own[cut_at[k] : cut_at[k + 1]].data))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(source, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = session_of(docs)
    buckets = partitions(spark)
    pieces = cut(pieces_of(docs, path, capacity, end_id).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")))
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    runs = plan({r["length"]: r["n"] for r in by_length}, capacity)
    before = counts.withColumn("skip", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", (F.col("skip") + F.col("nth")).cast("long"))
    return map_arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), _place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _place(runs: list[tuple[int, int, int, int, int, int]]):
    """Join pieces to the plan's slots on their rank within their length."""
    # the plan's size is bounded by the capacity alone, so it may go to every task
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        key = (table[:, 0].astype(np.uint64) << K.U64(44)) | table[:, 1].astype(np.uint64)
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(key, (length.astype(np.uint64) << K.U64(44)) | rank.astype(np.uint64), "right") - 1
            _, low, _, first, each, offset = table[at].T
            within = rank - low
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(first + within // each), pa.array(offset + within % each * length)], names)

    return run
