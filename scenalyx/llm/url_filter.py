"""URL filters: rules first, then logistic regression on hashed character n-grams.

Everything that touches the corpus is a map of DataFrame functions, without
Python; only the sample shuffles, as it takes each labelled url once, those of
smallest hash. Only that small table reaches the driver (at most ``max_labelled``
rows, a documented bound), where plain full-batch gradient descent fits the
weights; these go back into the plan as one array literal of ``2 ** bits`` numbers.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: then up to ``?``, ``#`` or the end. A null url or one without
``://`` has neither. A rule fits its host and all subdomains if the path starts
with the rule's; the longest rule wins. What no rule fits is for the model.

Defined cases: an empty host and path have no n-grams and take the model's bias;
without labelled rows of both kinds all weights are 0, the score is 0.5 and
everything that no rule fits is allowed;
rows are judged alike whatever their page_id (null, repeated); other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules as (verdict, host and path).
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, key in sorted(RULES if rules is None else rules, key=lambda r: len(r[1])):  # later, longer ones win
        at = key.index("/")
        own, begin = key[:at], key[at:]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(begin))
        rule, verdict = F.when(fits, F.lit(key)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def ngram_slots(host: Column, path: Column, n: int, bits: int) -> Column:
    """Hashed character n-grams of host and path, marked apart; one for each place."""

    def grams(s: Column, mark: str) -> Column:
        s = F.concat(F.lit("^"), s, F.lit("$"))
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(s, i, F.lit(n))), F.lit(1 << bits)).cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.concat(grams(host, "h"), grams(path, "p"))


def fit(labelled: list[tuple[list[int], int]], bits: int, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[float, list[float]]:
    """Bias and weights for P(block), from (slots, 1 to block) rows; features are shares of the n-grams."""
    size = 1 << bits
    y = np.array([b for _, b in labelled], float)
    if len(labelled) == 0 or y.min() == y.max():
        return 0.0, [0.0] * size
    row = np.repeat(np.arange(len(labelled)), [len(s) for s, _ in labelled])
    slot = np.concatenate([np.asarray(s, np.int64) for s, _ in labelled])
    value = 1.0 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))[row]
    # both verdicts weigh the same, however many rows either has
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(size), 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[slot] * value, len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        w -= rate * (np.bincount(slot, error[row] * value, size) + decay * w)
        b -= rate * error.sum()
    return round(float(b), 9), [round(float(x), 9) for x in w]


def score(slots: Column, bias: float, weights: list[float]) -> Column:
    """P(block) of a row."""
    table = F.lit(weights)
    z = F.aggregate(slots, F.lit(0.0), lambda a, i: a + F.element_at(table, i + 1))
    return 1 / (1 + F.exp(-(z / F.sqrt(F.greatest(F.size(slots), F.lit(1))) + F.lit(bias))))


def labelled_by_rules(pages: DataFrame, max_labelled: int) -> DataFrame:
    """A small labelled URL table (url, block): what the rules decide, the distinct urls of smallest hash."""
    host, path = parts(F.col("url"))
    rule, verdict = rule_columns(host, path)
    known = pages.select("url").where(rule.isNotNull()).select("url", (verdict == "block").cast("int").alias("block"))
    return known.distinct().orderBy(F.xxhash64("url"), "url").limit(max_labelled)


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, n: int = 3, bits: int = 12, max_labelled: int = 2000, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row.

    labelled (url, block) holds the training rows; without it, a sample of what the rules decide.
    """
    labelled = labelled_by_rules(pages, max_labelled) if labelled is None else labelled.select("url", F.col("block").cast("int").alias("block")).where("block is not null").distinct().orderBy(F.xxhash64("url"), "url", "block").limit(max_labelled)
    host, path = parts(F.col("url"))
    train = labelled.select(ngram_slots(host, path, n, bits).alias("slots"), "block").collect()
    bias, weights = fit([(r["slots"], r["block"]) for r in train], bits)
    learned = len({r["block"] for r in train}) > 1
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"))
    base = base.withColumn("rule", rule).withColumn("said", verdict).withColumn("slots", ngram_slots(F.col("host"), F.col("path"), n, bits))
    base = base.withColumn("block_score", score(F.col("slots"), bias, weights))
    return base.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.lit(learned) & (F.col("block_score") >= threshold), "block").otherwise("allow")).alias("verdict"), "block_score")
