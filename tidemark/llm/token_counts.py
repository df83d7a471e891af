"""Token counts (whole-token shortcut, see bpe.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import forgetting, slices, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, without added special tokens: doc_id, n_bytes, n_tokens, over_limit.

    A narrow map over the scan: no shuffle, one Arrow batch in memory at a time. Null and empty
    texts have 0 bytes and 0 tokens; rows that repeat an id are counted one by one; a null id stays
    null; an empty table gives an empty result. Text length is unbounded.
    """

    def run(batches):
        counter = bpe.load(vocabulary)
        for b in slices(batches):
            text = b.column(1)
            n = pa.array([counter.count(t) for t in text.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(text), pa.int64()), n, pc.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs, id_col, text_col).mapInArrow(forgetting(run, lambda: bpe.load(vocabulary)), SCHEMA)


def token_count(vocabulary: str, text_col: str = "text") -> Column:
    """The tokens of a text as a column; a null text has none."""

    def run(batches):
        counter = bpe.load(vocabulary)
        for text in batches:
            parts = slices([pa.RecordBatch.from_arrays([text], ["text"])], 0)
            yield pa.array([counter.count(t) for part in parts for t in part.column(0).to_pylist()], pa.int64())

    task = forgetting(run, lambda: bpe.load(vocabulary))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return task(batches)

    return count(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
