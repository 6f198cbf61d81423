"""Mixing of sources to target weights that vary over the training run.

Each source has a weight schedule over training time from 0 to 1: a line through
knots. Its integral is the source's share; its running integral, scaled to the words
the mix takes from the source, is that source's cumulative demand. A document that
begins after c words of its source is due when the demand reaches c, so inverting the
demand (a quadratic within a piece of the line) gives its position; the range sort by
position is the order of training.

Order within a source is that of a hash of the doc_id. The words before a document
are a prefix sum over range partitions: rows are sorted into ranges of (source, hash),
every task sums its own range as it streams by, and the ranges' totals, one row for
each range and source, carry over to later ranges. A source of a third of all rows
lies in a third of the ranges. A second reading of a source begins where the first
ends, and the last document is cut where the target is reached.

Defined cases: a null text has no words, takes none and has no position; a null source
is a source, the last one; equal rows share an order key and are dealt places among
themselves, which leaves the rows of the result the same; repeated and null doc_ids
are rows like others; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark import Scratch, cut, map_arrow, partitions, session_of

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many rows of 40 bytes are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Schedule:
    """Weight over training time: straight between knots (time, weight), from time 0 to time 1."""

    knots: tuple[tuple[float, float], ...]

    def __post_init__(self):
        times = [t for t, _ in self.knots]
        if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])) or any(w < 0 for _, w in self.knots):
            raise ValueError("knots go from time 0 to time 1 with rising times and weights of 0 or more")

    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """Begin, integral up to it, weight there, slope, and the integral at the piece's end."""
        out, before = [], 0.0
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:]):
            after = before + (w0 + w1) / 2 * (t1 - t0)
            out.append((t0, before, w0, (w1 - w0) / (t1 - t0), after))
            before = after
        return out

    @property
    def share(self) -> float:
        """The integral over the whole run."""
        return self.pieces()[-1][-1]

    def inverse(self, part: Column) -> Column:
        """The time at which ``part`` (0 to 1) of the whole integral is reached."""
        need, found = part * F.lit(self.share), F.lit(1.0)
        for t0, before, w0, slope, after in reversed(self.pieces()):
            rest = F.greatest(need - F.lit(before), F.lit(0.0))
            # 2 r / (w + sqrt(w^2 + 2 s r)) is the root of w x + s x^2 / 2 = r for any slope, also 0
            root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            at = F.lit(t0) + F.when(root > 0, 2 * rest / root).otherwise(0.0)
            found = F.when(need < F.lit(after), at).otherwise(found)
        return found


#: Weights 3, 1 and 2: the first falls over the run, the second is level, the third rises.
CYCLE = (Schedule(((0.0, 4.5), (1.0, 1.5))), Schedule(((0.0, 1.0), (1.0, 1.0))), Schedule(((0.0, 1.0), (0.5, 2.0), (1.0, 3.0))))


def ordered(docs: DataFrame, seed: int, tables: Scratch) -> DataFrame:
    """(doc_id, source, size, range, run, before): rows in order of source and hash.

    ``run`` numbers the sources within a range, ``before`` counts the words of the
    source that precede in the range.
    """
    spark = session_of(docs)
    # texts are read once, here: the range sort samples its input before it reads it
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = tables.written(sized.withColumn("place", F.xxhash64(F.lit(seed), "doc_id")).withColumn("nth", F.monotonically_increasing_id()), "mix-sizes")
    # the number only parts rows that are equal otherwise, so that a range may end between them
    keys = [F.col("source").asc_nulls_last(), "place", "doc_id", "size", "nth"]
    ranges = sized.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "source", "size", F.spark_partition_id().alias("range"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, total = None, -1, 0
        for b in batches:
            sources, sizes, runs, before = b.column(1).to_pylist(), b.column(2).to_pylist(), [], []
            for source, size in zip(sources, sizes):
                if last != (source,):
                    last, run, total = (source,), run + 1, 0
                runs.append(run)
                before.append(total)
                total += size
            yield pa.record_batch([*b.columns, pa.array(runs, pa.int32()), pa.array(before, pa.int64())], [*b.schema.names, "run", "before"])

    return cut(map_arrow(ranges, running, "doc_id long, source string, size long, range int, run int, before long"))


def targets(sources: DataFrame, cycle: Sequence[Schedule], share: float, most: float, tables: Scratch) -> DataFrame:
    """(source, source_size, class, target) from (source, source_size).

    A source's weight is its schedule's integral. Shares are dealt by weight among
    sources below their limit, until none is above it: at least one more reaches its
    limit in each round, and the driver sees sums only.
    """
    spark = session_of(sources)
    # sources are numbered by ranges too: counts of earlier ranges, then the place within
    ranges = sources.repartitionByRange(max(1, partitions(spark) // 8), F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    numbered = tables.written(ranges.select("source", "source_size", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "mix-sources")
    counts = numbered.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("skip", F.sum("n").over(Window.orderBy("range")) - F.col("n")).select("range", "skip")  # one row a range
    kind = ((F.col("skip") + F.col("at")) % len(cycle)).cast("int")
    weight = F.element_at(F.array(*[F.lit(s.share) for s in cycle]), F.col("class") + 1)
    found = numbered.join(F.broadcast(before), "range").select("source", "source_size", kind.alias("class")).withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, F.lit(False)
    while True:
        # what is left for the open sources, and their weight
        left, open_weight, n = found.agg(F.lit(share * total) - F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)), F.sum(full.cast("long"))).first()
        if level is not None and n == known or not open_weight:
            break
        level, known = max(left, 0.0) / open_weight, n
        full = F.col("limit") < F.lit(level) * F.col("weight")
    target = F.when(full, F.col("limit")).otherwise(F.lit(level or 0.0) * F.col("weight"))
    return tables.written(found.select("source", "source_size", "class", target.alias("target")), "mix-targets")


def curriculum(docs: DataFrame, cycle: Sequence[Schedule] = CYCLE, share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target and ``takes`` (reading, first_word, words, position) of every row of docs.

    A document is in the mix once for each reading of its source that reaches it:
    ``words`` of its words from the first on, at ``position`` between 0 and 1 of the run.
    """
    spark = session_of(docs)
    tables = Scratch(spark)
    rows = ordered(docs, seed, tables)
    tables.drop()
    totals = tables.written(rows.groupBy("range", "run").agg(F.first("source").alias("source"), F.sum("size").alias("n")), "mix-ranges")
    goals = targets(totals.groupBy("source").agg(F.sum("n").alias("source_size")), cycle, share, most, tables)
    skip = totals.withColumn("skip", F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n"))
    carried = cut(skip.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("range", "run", "skip", "source_size", "class", "target"))
    tables.drop()
    # 40 bytes for each range and source: as many as ranges and sources together at most
    out = rows.join(F.broadcast(carried) if carried.count() <= BROADCAST_ROWS else carried, ["range", "run"])
    begin, goal = F.col("skip") + F.col("before"), F.floor(F.col("target"))
    takes = []
    for reading in range(int(-(-most // 1))):
        at = begin + reading * F.col("source_size")
        words = F.least(F.greatest(goal - at, F.lit(0)), F.col("size"))
        due = F.element_at(F.array(*[s.inverse(F.try_divide(at, F.col("target"))) for s in cycle]), F.col("class") + 1)
        takes.append(F.struct(F.lit(reading).alias("reading"), F.lit(0).cast("long").alias("first_word"), words.cast("long").alias("words"), due.alias("position")))
    out = out.withColumn("takes", F.filter(F.array(*takes), lambda t: t["words"] > 0))
    return out.select("doc_id", "source", "size", "source_size", "target", "takes")


def training_order(mixed: DataFrame) -> DataFrame:
    """(position, doc_id, source, reading, first_word, words): one row a take, range-sorted by position."""
    take = mixed.select("doc_id", "source", F.explode("takes").alias("t"))
    return take.select("t.position", "doc_id", "source", "t.reading", "t.first_word", "t.words").orderBy("position", "source", "doc_id", "reading")


def mix(docs: DataFrame, cycle: Sequence[Schedule] = CYCLE, share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, position and last_position of every document, sorted by position.

    ``position`` is that of the first reading that takes the document; documents that none takes come last.
    """
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"])
    out = curriculum(docs, cycle, share, most, seed).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "source", F.try_element_at("takes.position", F.lit(1)).alias("position"), F.try_element_at("takes.position", F.lit(-1)).alias("last_position")
    )
    # the number parts rows that are equal otherwise: the sort may deal them to several ranges
    return out.withColumn("nth", F.monotonically_increasing_id()).orderBy(F.col("position").asc_nulls_last(), "doc_id", "nth").drop("nth")
