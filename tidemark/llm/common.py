"""Shared plumbing: input hygiene, bounded memory in Python workers, and the library's written intermediate tables."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.scratch import drop, drop_table, outlasting, reread, scope, write_table
from tidemark.plans.scratch import settled as written

__all__ = ["Memo", "drop", "drop_table", "forgetting", "labelled_texts", "one_of_each", "outlasting", "reread", "scope", "sha", "slices", "table", "texts", "write_table", "written"]

#: Rows and bytes of text that a worker holds as Python objects at once.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Bytes that a worker's table of remembered values may take, and the longest key remembered.
MEMO_BYTES, MEMO_KEY = 16 << 20, 64
#: Bytes of a dict entry beside its key and value.
_ENTRY = 104


class Memo(dict):
    """A dict that computes missing values and forgets them, but not its ``fixed`` entries, once they take ``most`` bytes."""

    def __init__(self, compute: Callable, fixed: dict | None = None, most: int = MEMO_BYTES):
        super().__init__(fixed or {})
        self.compute, self.fixed, self.most, self.held = compute, fixed or {}, most, 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= MEMO_KEY:
            if self.held > self.most:
                self.forget()
            self.held += sys.getsizeof(key) + sys.getsizeof(value) + _ENTRY
            self[key] = value
        return value

    def forget(self) -> None:
        if self.held:
            self.clear()
            self.update(self.fixed)
            self.held = 0


def forgetting(run: Callable[..., Iterator], *memos: Callable[[], Memo]) -> Callable[..., Iterator]:
    """``run``, a task's generator, after whose end its worker, which Spark keeps for the next task, gives back what it remembered."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            for memo in memos:
                memo().forget()
            pa.default_memory_pool().release_unused()

    return task


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: at most ``rows`` rows, and unless one text alone is longer at most ``size`` bytes in column ``text``."""
    for b in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(b.column(text)), pa.int64()), 0)).to_numpy(zero_copy_only=False)
        at, done = 0, 0
        while at < b.num_rows:
            end = max(at + 1, min(at + rows, int(ends.searchsorted(done + size, "right"))))
            yield b.slice(at, end - at)
            at, done = end, int(ends[end - 1])


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of a table; a null text counts as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def sha(text: Column) -> Column:
    """32 bytes that tell whole texts apart; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def one_of_each(held: DataFrame, keys: list[str]) -> DataFrame:
    """A row of ``held`` (keys and a struct ``row``) for each value of the keys: of several the one whose JSON text hashes lowest."""
    if held.groupBy(*keys).count().where("count > 1").isEmpty():
        return held
    return held.groupBy(*keys).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))


def labelled_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, label), a bounded sample, with the text of each, settled so that the corpus is read for them once.

    Of several texts of one id the one that hashes lowest counts, so that the result is as bounded as the sample.
    """
    met = docs.join(F.broadcast(rows), "doc_id")
    one = met.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return written(one.repartition(8), "training")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
