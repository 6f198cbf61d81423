"""Token counts of every whole text under a public vocabulary file.

A map over the rows: nothing is shuffled. Plain byte-level BPE files
(.json) are counted by rank-synchronous array merging (see ``bpe``); other files go to
their own library (tokenizers for .json, sentencepiece for .model).

Defined cases: null text counts as empty (0 tokens); equal rows count alike;
null doc_ids and other columns pass or are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import kernels as K
from .spark import map_arrow


def counter(path: str):
    """(data, offsets) -> tokens of each text."""
    if path.endswith(".json"):
        return bpe.load(path).count
    from sentencepiece import SentencePieceProcessor

    piece = SentencePieceProcessor(model_file=path)
    return lambda data, offsets: np.array([len(piece.encode(data[a:b].tobytes().decode("utf-8", "replace"))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def run(batches):
        count = counter(path)
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch, "text"):
                n = count(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
