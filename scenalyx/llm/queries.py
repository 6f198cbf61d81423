"""Registered queries of the text operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .centroids import cluster
from .cotraining import document_scores
from .curriculum import mix
from .decontaminate import decontaminate
from .filter_audit import audit
from .jaccard_join import jaccard_components
from .packing import pack
from .quality_rules import quality_rules
from .sharding import shard
from .sst_output import sst_round_trip
from .suffix_dedup import suffix_dedup
from .token_count import token_counts
from .url_filter import filter_urls

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1(spark, d):
    return jaccard_components(_read(spark, d, "documents"), n=4, num=85, den=100)


def op2(spark, d):
    return pack(_read(spark, d, "documents"), public_tokenizers.path(TOKENIZER), capacity=1024, end_id=2)


def op3(spark, d):
    return token_counts(_read(spark, d, "documents"), public_tokenizers.path(TOKENIZER), limit=512)


def op4(spark, d):
    return decontaminate(_read(spark, d, "documents"), _read(spark, d, "benchmark"), n=10).drop("text_hash", "spans")


def op5(spark, d):
    return suffix_dedup(_read(spark, d, "documents"), width=50)


def op6(spark, d):
    return sst_round_trip(_read(spark, d, "documents"), public_tokenizers.path(TOKENIZER), end_id=0)


def op7(spark, d):
    return quality_rules(_read(spark, d, "documents")).drop("host_rate")


def op8(spark, d):
    return shard(_read(spark, d, "documents"), shards=16)


def op9(spark, d):
    return filter_urls(_read(spark, d, "pages"))


def op10(spark, d):
    return document_scores(_read(spark, d, "documents"), _read(spark, d, "labels"))


def op11(spark, d):
    return cluster(_read(spark, d, "embeddings"), clusters=16, rounds=3, dims=64, scale=64)


def op12(spark, d):
    return mix(_read(spark, d, "documents"))


def op13(spark, d):
    return audit(_read(spark, d, "documents"), _read(spark, d, "labels"), part="lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1,
        "op2_best_fit_packing": op2,
        "op3_token_counts": op3,
        "op4_benchmark_decontamination": op4,
        "op5_suffix_array_dedup": op5,
        "op6_token_id_output": op6,
        "op7_quality_rules": op7,
        "op8_sharding": op8,
        "op9_url_filter": op9,
        "op10_quality_classifier": op10,
        "op11_centroid_clustering": op11,
        "op12_source_mix": op12,
        "op13_filter_interaction_audit": op13,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
