"""Host-level quality rules with DataFrame functions only.

Rules are judged on every text (words that repeat in windows, too few words);
failures are counted per host, the hosts' failure rates are shrunk towards a beta
prior fitted to the hosts themselves (method of moments over all hosts), and the
hosts' verdicts are joined back to their documents.

A host fails if its shrunk rate is over ``host_limit``; its documents then go
even where they pass on their own. Texts are read once: the per-document figures
are cut into a checkpoint of a few numbers a row. Host counts are combined before
they are shuffled. The join back moves figures only; while there are at most
``broadcast_hosts`` hosts they are broadcast (counted first), beyond that the
failing hosts are joined by a shuffle that adaptive execution splits at hot hosts.

Defined cases: null and blank texts have no words and fail; a null host is a host
of its own; equal rows count each; no rows, no hosts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import cut

#: Word separators and symbols.
BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def window_hashes(words: Column, n: Column, size: int) -> Column:
    """The hash of every window of ``size`` words, in order."""
    each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(n >= size, each).otherwise(F.array().cast("array<bigint>"))


def base_figures(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", BLANKS), "")).withColumn("n", F.size("words"))
    d = d.withColumn("h", window_hashes(F.col("words"), F.col("n"), window))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)
    d = d.select(
        "doc_id",
        "host",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.when(F.instr("text", "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long").alias("n_dup_lines"),
        "h",
    )
    # only texts with an equal pair of windows are sorted
    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs)).drop("h")
    at = F.transform(
        F.filter(
            F.transform("s", lambda x, i: F.struct(x["i"].alias("i"), ((x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"])).alias("twice"))),
            lambda x: F.coalesce(x["twice"], F.lit(False)),
        ),
        lambda x: x["i"],
    )
    covered = F.aggregate(
        F.sort_array(at),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["sum"] + i + window - F.greatest(a["end"], i)).alias("sum"), (i + window).alias("end")),
        lambda a: a["sum"],
    )
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("s").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def host_rates(figures: DataFrame) -> DataFrame:
    """host, n, fails, rate: failure rates shrunk by a beta prior with the moments of all hosts' rates."""
    hosts = figures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails"))
    raw = F.col("fails") / F.col("n").cast("double")
    m = hosts.agg(F.avg(raw).alias("mean"), F.var_pop(raw).alias("var"), F.avg(F.lit(1.0) / F.col("n")).alias("inv"))
    # spread beyond what counts of this size show by themselves; at least a weak prior of one document
    own = F.greatest(F.col("var") - F.col("mean") * (1 - F.col("mean")) * F.col("inv"), F.lit(1e-9))
    weight = F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / own - 1, F.lit(1.0)), F.lit(1e6))
    prior = m.select((F.col("mean") * weight).alias("a"), ((1 - F.col("mean")) * weight).alias("b"))
    return hosts.join(F.broadcast(prior)).select("host", "n", "fails", ((F.col("fails") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b"))).alias("rate"))


def quality_rules(docs: DataFrame, host_limit: float = 0.5, broadcast_hosts: int = 500_000) -> DataFrame:
    """doc_id, the figures, base_failed, kept, host_rate of every row."""
    figures = cut(base_figures(docs).withColumn("base_failed", base_failed()))
    rates = cut(host_rates(figures))
    hosts = rates.select(F.col("host").alias("of"), F.col("rate").alias("host_rate"))
    if rates.count() <= broadcast_hosts:
        hosts = F.broadcast(hosts)
    out = figures.join(hosts, figures["host"].eqNullSafe(hosts["of"]), "left")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= host_limit)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")
