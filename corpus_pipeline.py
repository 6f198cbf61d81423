"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``docs``. A stage's decision takes effect on the rows (or texts) it returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from scenalyx.llm.cotraining import score_rows, train
from scenalyx.llm.decontaminate import decontaminate
from scenalyx.llm.jaccard_join import jaccard_components
from scenalyx.llm.packing import pack
from scenalyx.llm.spark import Scratch, checkpoint_dir, delete
from scenalyx.llm.suffix_dedup import suffix_dedup

#: The stages include a packing and a trained classifier, which SQL cannot express.
ORACLE_SQL = None


#: Tables that the result of the last stage reads.
_left: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    _left.append(Scratch(spark))
    return _left[-1]


def _clear() -> None:
    """Drop what earlier stages left: a stage begins when its predecessor's result has been written."""
    while _left:
        _left.pop().drop()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers of quality and toxicity reject go, as do texts without words.

    Rows of any doc_id (null, repeated) are judged by themselves; no rows give no rows.
    """
    _clear()
    models = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(docs, models).where("keep").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word Jaccard similarity of 0.8 or more, the smallest doc_id stays.

    Where rows repeat a doc_id, each text counts by itself: of equal ones, and then of
    linked ones, the first by doc_id, text and the other columns stays. Rows without
    words or doc_id are linked to nothing and stay; no rows give no rows.
    """
    _clear()
    number = F.col("doc_id").cast("long")
    if not docs.where(number.isNotNull()).groupBy(number).count().where("count > 1").limit(1).count():
        found = jaccard_components(docs.select("doc_id", "text"), n=5, num=80, den=100)
        gone = found.where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    tables = _scratch(spark)
    linked = number.isNotNull() & F.coalesce(F.col("text").cast("string").rlike(r"[^ \x09-\x0D]"), F.lit(False))
    # a row travels as one column, so no name of its own can clash
    rows = docs.where(linked).groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("row"))
    rows = tables.written(rows.orderBy(number, "text").select("row", "text", F.monotonically_increasing_id().alias("key")), "near-duplicates")
    found = jaccard_components(rows.select(F.col("key").alias("doc_id"), "text"), n=5, num=80, den=100)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct()
    kept = rows.join(gone, "key", "left_anti").select("row.*")
    return kept.unionByName(docs.where(~linked))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a smaller doc_id holds leave the text; documents of nothing else go.

    Null and empty texts and rows without a doc_id stay as they are; rows of one doc_id do not affect one another.
    """
    _clear()
    # a text travels once: where nothing goes, kept_text is the text
    plain = isinstance(docs.schema["text"].dataType, T.StringType)
    rest = [c for c in docs.columns if not (plain and c == "text")]
    out = suffix_dedup(docs, keep_text=True, carry=F.struct(*rest), tables=_scratch(spark))
    out = out.where("n_removed = 0 or length(trim(kept_text)) > 0")
    text = F.col("kept_text").cast(docs.schema["text"].dataType)
    values = {c: F.col(f"carry.`{c}`") for c in rest}
    values["text"] = text if plain else F.when(F.col("n_removed") > 0, text).otherwise(values["text"])
    if "n_chars" in values:
        values["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(values["n_chars"])
    return out.select(*(values[c].alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; equal rows go together, rows of other texts under the same id stay."""
    _clear()
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("contaminated").select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("text_hash"))
    return rows.join(hit, same, "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placement of every piece of every document in sequences of 1024 tokens; a null text is its end token."""
    _clear()
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again, so a lost executor costs one stage.

    A stage's input goes once its result stands.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tag, before = spark.range(1).select(F.expr("uuid()")).first()[0], None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{checkpoint_dir(spark)}/pipeline-{tag}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        _clear()
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
