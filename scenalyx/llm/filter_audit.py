"""Audit of how filters interact over all their orders.

Every filter is a condition on the document alone, so an order of filters removes a
document at its first filter that the document fails. Five filters make 32 sets of
failures and 120 orders: the step of the first failure is a table of 32 by 120 numbers,
made once. Tasks look their documents' failures up in it and count removals by part,
order, step and label with ``bincount``; the partial arrays are summed by a grouped
sum, and each part's 600 rows are made from at most some two thousand sums.

Filters A to D are columns of the text. E compares a text with all others: the least
doc_id of every text that occurs twice is found by a grouped minimum over digests of
the texts, and joined back to the narrow rows; labels are joined alike. Both sides of
these joins come from tables, so that adaptive execution can split a text or doc_id of
a third of all rows.

Defined cases: a null text is an empty one; a null part is an empty string; a null
doc_id is not larger than any, so it never fails E, and is no smaller one either; rows
of one doc_id and text do not make each other fail; several labels of a doc_id count
if one of them holds; a document without labels is neither good nor toxic; no rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import Scratch, cut, map_arrow, session_of, ship

SPACE = r"[\x20\x09-\x0D]+"
#: Parts whose arrays a task holds before it passes them on.
HELD = 256


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def first_failures(letters: str) -> np.ndarray:
    """steps[failures, order]: the step (from 1) whose filter is the first to be failed; 0 where none is. Bit k of failures is letter k."""
    out = np.zeros((1 << len(letters), len(orders(letters))), np.int64)
    for k, order in enumerate(orders(letters)):
        for step in range(len(letters), 0, -1):
            fails = (np.arange(len(out)) >> letters.index(order[step - 1])) & 1 == 1
            out[fails, k] = step
    return out


def conditions(text: Column) -> dict[str, Column]:
    """Failure of each filter that looks at one text only."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, part: str, tables: Scratch) -> DataFrame:
    """(doc_id, part, mask) of every row: bit k of mask is set where filter k of ABCDE is failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fails = [c.cast("int") * F.lit(1 << k) for k, c in enumerate(conditions(F.col("t")).values())]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = tables.written(rows.select("doc_id", "part", sum(fails[1:], fails[0]).alias("own"), F.unhex(F.sha2("t", 256)).alias("digest")), "audit-rows")
    twice = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    twice = tables.written(twice, "audit-texts")
    late = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return rows.join(twice, "digest", "left").select("doc_id", "part", (F.col("own") + late * 16).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame, tables: Scratch) -> DataFrame:
    """(part, mask, good, toxic) of every row."""
    holds = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    known = tables.written(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*holds), "audit-labels")
    return rows.join(known, "doc_id", "left").select("part", "mask", *[F.coalesce(n, F.lit(False)).alias(n) for n in ("good", "toxic")])


def counter(letters: str):
    """Batches of (part, mask, good, toxic) as partial counts: (part, measure, cell, n).

    Measures 0 to 2 count removals of all, good and toxic rows in cells order x steps +
    step, measures 3 and 4 a filter's failures and sole failures in its cell.
    """
    table, n = first_failures(letters), len(letters)
    cells = table.shape[1] * (n + 1)
    base = np.arange(table.shape[1]) * (n + 1)
    single = 1 << np.arange(n)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for part, counts in held.items():
                at = counts.nonzero()[0]
                measure = np.minimum(at // cells, 3)
                cell = at - measure * cells
                measure, cell = measure + (cell >= n) * (measure == 3), np.where((measure == 3) & (cell >= n), cell - n, cell)
                yield pa.record_batch([pa.array([part] * len(at)), pa.array(measure, pa.int32()), pa.array(cell, pa.int32()), pa.array(counts[at], pa.int64())], ["part", "measure", "cell", "n"])
            held.clear()

        for b in batches:
            parts = b.column(0).dictionary_encode()
            part, names = parts.indices.to_numpy(zero_copy_only=False), parts.dictionary.to_pylist()
            mask, good, toxic = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            width = 3 * cells + 2 * n
            counts = np.zeros((len(names), width), np.int64)
            where = part[:, None] * cells + base + table[mask]
            for k, rows in enumerate((slice(None), good.astype(bool), toxic.astype(bool))):
                counts[:, k * cells : (k + 1) * cells] = np.bincount(where[rows].ravel(), minlength=len(names) * cells).reshape(-1, cells)
            for k in range(n):
                fails = part[mask & single[k] > 0]
                counts[:, 3 * cells + k] = np.bincount(fails, minlength=len(names))
                counts[:, 3 * cells + n + k] = np.bincount(part[mask == single[k]], minlength=len(names))
            for name, add in zip(names, counts):
                held[name] = held[name] + add if name in held else add
            if len(held) > HELD:
                yield from passed_on()
        yield from passed_on()

    return fn


def reporter(letters: str):
    """One part's sums as a row for each order and step."""
    names, n = orders(letters), len(letters)

    def fn(sums: pd.DataFrame) -> pd.DataFrame:
        cells = len(names) * (n + 1)
        flat = np.zeros((5, cells), np.int64)
        flat[sums["measure"], sums["cell"]] = sums["n"]
        removed, good, toxic = flat[:3].reshape(3, len(names), n + 1)
        filters = np.array([[letters.index(c) for c in order] for order in names])
        shapley = np.bincount(filters.ravel(), weights=removed[:, 1:].ravel(), minlength=n).astype(np.int64)
        left = removed.sum(1, keepdims=True) - removed[:, 1:].cumsum(1)
        columns = {"kept": left, "removed": removed[:, 1:], "redundant": flat[3][filters] - removed[:, 1:], "unique_fails": flat[4][filters], "good_lost": good[:, 1:], "toxic_lost": toxic[:, 1:], "shapley": shapley[filters]}
        head = {"part": [sums["part"].iloc[0]] * filters.size, "filter_order": np.repeat(names, n), "step": np.tile(np.arange(1, n + 1), len(names))}
        return pd.DataFrame(head | {k: v.ravel() for k, v in columns.items()})

    return fn


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", letters: Sequence[str] = "ABCDE") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: 600 rows for each part.

    ``letters`` are the names of the five filters, in the order of their bits.
    """
    spark, letters = session_of(docs), "".join(letters)
    ship(spark)
    tables = Scratch(spark)
    rows = labelled(failures(docs, part, tables), labels, tables)
    parts = map_arrow(rows, counter(letters), "part string, measure int, cell int, n long")
    sums = cut(parts.groupBy("part", "measure", "cell").agg(F.sum("n").alias("n")))
    tables.drop()
    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return sums.groupBy("part").applyInPandas(reporter(letters), f"part string, filter_order string, step int, {longs}")
