"""Benchmark decontamination with DataFrame functions only.

Words are maximal runs of letters, digits and non-ASCII characters, with A-Z
lower-cased. A benchmark item's windows are its runs of ``n`` words (an item of
fewer words is one window). The normalised n-grams of the benchmark are a hash
set that documents scan in two steps:

* a window of k words holds a run of m = ceil(k / 2) words that begins at a
  multiple of k - m + 1 in the document, so documents probe the set of all m-word
  runs of the windows at these places only;
* around a probe that meets, the windows themselves are looked up and compared
  word by word, and the words inside them are hit.

The set is broadcast while windows, the items that have them and the probes' runs
take at most ``broadcast_bytes`` (added up first), beyond that the probes are joined
by a shuffle on their hash. Hits are combined per (document, position) before
they are shuffled; a position has at most one window per length, so no group
grows with the corpus.

Defined cases: null text has no words; a document without words has no hits;
items of null text or without words have no windows; equal doc_ids are told
apart by a hash of their texts, and equal rows stay as many as they were; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import cut

#: The ASCII characters that separate words before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(s: Column) -> Column:
    """A-Z lower-cased, nothing else; lower() does that faster where all is ASCII."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """Words of a text as they are written; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """(window, k, items): distinct windows as words joined by spaces, their length, the items that have them."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(n))
    each = words.select("item_id", "words", size.alias("k"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("i"))
    each = each.select("item_id", "k", lower_az(F.array_join(F.slice("words", F.col("i"), F.col("k")), " ")).alias("window"))
    return each.groupBy("window", "k").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _steps(k: int) -> tuple[int, int]:
    m = (k + 1) // 2
    return m, k - m + 1


def _run_hash(words: Column, at: Column, m: int) -> Column:
    return F.xxhash64(lower_az(F.array_join(F.slice(words, at, m), " ")))


def _probe(words: Column, k: int, m: int):
    return lambda q: F.struct(F.lit(k).alias("k"), q.alias("q"), _run_hash(words, q, m).alias("h"))


def scan(source: DataFrame, windows: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """A line with k = 0 for every row, and a line for each probe that meets.

    (doc_id, row, n_words, k, at, context): context holds the words of every
    window of k words around the probe, the first of them the at-th word.
    """
    words = F.col("words")
    base = source.select("doc_id", "row", word_array(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    probes = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("q"), F.lit(None).cast("bigint").alias("h")))
    runs = None
    for k in lengths:
        m, step = _steps(k)
        places = F.sequence(F.lit(step), F.col("n_words") - m + 1, F.lit(step))
        own = F.when(F.col("n_words") - m + 1 >= step, F.transform(places, _probe(words, k, m)))
        probes = F.concat(probes, F.coalesce(own, F.array().cast("array<struct<k:int,q:int,h:bigint>>")))
        each = windows.where(F.col("k") == k).select(F.split("window", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.lit(step))).alias("i"))
        each = each.select(F.xxhash64(F.array_join(F.slice("w", F.col("i"), m), " ")).alias("run"), F.lit(k).alias("run_k")).distinct()
        runs = each if runs is None else runs.unionByName(each)
    if runs is None:
        return base.select("doc_id", "row", "n_words", F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("context"))
    first = F.greatest(F.lit(1), F.col("p.q") - (F.col("p.k") - F.floor((F.col("p.k") + 1) / 2)).cast("int"))
    spread = base.select("doc_id", "row", "n_words", "words", F.explode(probes).alias("p"))
    on = (F.col("p.h") == F.col("run")) & (F.col("p.k") == F.col("run_k"))
    if small:
        met = spread.join(F.broadcast(runs), on, "left").where("p.k = 0 or run is not null")
        return met.select("doc_id", "row", "n_words", "p.k", first.alias("at"), F.when(F.col("p.k") > 0, F.slice("words", first, F.col("p.q") - first + F.col("p.k"))).alias("context"))
    # too many windows to broadcast: probes travel without their texts, and what meets goes back for them
    lines = spread.where("p.k = 0").select("doc_id", "row", "n_words", F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("context"))
    found = spread.where("p.k > 0").select("doc_id", "row", "p").join(runs, on, "left_semi").select("doc_id", "row", "p").distinct()
    back = base.dropDuplicates(["doc_id", "row"]).alias("b")
    back = back.join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.row") == F.col("f.row")))
    back = back.select("b.doc_id", "b.row", "n_words", "words", "p")
    return lines.unionByName(back.select("doc_id", "row", "n_words", "p.k", first.alias("at"), F.slice("words", first, F.col("p.q") - first + F.col("p.k")).alias("context")))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash, spans of every row of docs.

    ``spans`` lists the hit runs of words as (first word, number of words), from 1.
    """
    windows = cut(item_windows(items, n))
    size = F.octet_length("window") + F.octet_length(F.array_join("items", ",")) + 64
    runs = 40 * (F.col("k") - F.floor((F.col("k") + 1) / 2) + 1)
    stats = windows.agg(F.coalesce(F.sum(size + runs), F.lit(0)).alias("bytes"), F.collect_set("k").alias("lengths")).first()
    small = stats["bytes"] <= broadcast_bytes
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    met = cut(scan(source, windows, sorted(stats["lengths"]), small))
    count = met.where("k = 0").select("doc_id", "row", F.col("n_words").cast("long").alias("n_words"))
    seen = met.where("k > 0").select("doc_id", "row", "k", "at", F.split(lower_az(F.array_join("context", " ")), " ").alias("context"))
    seen = seen.where(F.size("context") >= F.col("k"))
    each = seen.select("doc_id", "row", "k", "at", "context", F.explode(F.sequence(F.lit(1), F.size("context") - F.col("k") + 1)).alias("i"))
    each = each.select("doc_id", "row", "k", (F.col("at") + F.col("i") - 1).alias("pos"), F.array_join(F.slice("context", F.col("i"), F.col("k")), " ").alias("window")).distinct()
    hits = each.join(F.broadcast(windows) if small else windows, ["window", "k"])
    per = hits.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("pos", "k"))).alias("found"), F.collect_set("items").alias("items"))
    per = per.withColumn("items", F.sort_array(F.array_distinct(F.flatten("items"))))
    return digest(count, per)


def digest(count: DataFrame, per: DataFrame) -> DataFrame:
    end = lambda x: x["pos"] + x["k"]
    zero = F.struct(F.array().cast("array<struct<first:int,n:int>>").alias("spans"), F.lit(0).alias("first"), F.lit(0).alias("end"))

    def step(acc, x):
        opens = x["pos"] > acc["end"]
        closed = F.when(opens & (acc["end"] > 0), F.concat(acc["spans"], F.array(F.struct(acc["first"].alias("first"), (acc["end"] - acc["first"]).alias("n"))))).otherwise(acc["spans"])
        return F.struct(closed.alias("spans"), F.when(opens, x["pos"]).otherwise(acc["first"]).alias("first"), F.when(opens, end(x)).otherwise(F.greatest(acc["end"], end(x))).alias("end"))

    close = lambda acc: F.when(acc["end"] > 0, F.concat(acc["spans"], F.array(F.struct(acc["first"].alias("first"), (acc["end"] - acc["first"]).alias("n"))))).otherwise(acc["spans"])
    per = per.withColumn("spans", F.aggregate("found", zero, step, close)).drop("found")
    null_safe = count["doc_id"].eqNullSafe(per["doc_id"]) & (count["row"] == per["row"])
    out = count.join(per, null_safe, "left").select(count["doc_id"], count["row"], "n_words", F.coalesce("spans", F.array().cast("array<struct<first:int,n:int>>")).alias("spans"), "items")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"]), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col("row").alias("text_hash"), "spans")
