"""Packing by concatenate and cut."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import forgetting, reread, slices, texts, write_table

TOKENS = "part int, first long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"

#: Rows and bytes of text that the first pass encodes together.
ENCODED_ROWS, ENCODED_BYTES = 8192, 8 << 20


def pack(
    docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs all documents into sequences of ``size`` tokens; one row per piece of a document.

    Pass 1 tokenizes each partition, notes where each document begins within its partition and
    writes ids (2 bytes each for vocabularies up to 65,536) to the shared folder, which fixes the order. The
    partition totals, one row per task, are prefix-summed on the driver. Pass 2 adds the
    partition's offset and cuts at multiples of ``size``; a document crossing a cut gives a boundary
    record on each side. Padding occurs only after the very last id.

    ids_crc32 is over unsigned little-endian 32-bit ids; doc_tokens counts the closing ``end_id``.
    A null or empty text is the end id alone. Repeated rows and ids are packed separately. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    path = write_table(_tokenize(texts(docs, id_col, text_col), vocabulary, end_id), "pack")
    ids = reread(spark, path, TOKENS)
    width = bpe_width(vocabulary)
    totals = ids.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per task of pass 1
    ends = np.cumsum([r["n"] for r in totals], dtype=np.int64)
    begins = {r["part"]: int(e) - r["n"] for r, e in zip(totals, ends)}
    return ids.mapInArrow(lambda batches: _cut(batches, begins, width, size), PIECES)


def bpe_width(vocabulary: str) -> int:
    return bpe.load(vocabulary).width


def _tokenize(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    def run(batches):
        tok, part, first = bpe.load(vocabulary), TaskContext.get().partitionId(), 0
        for b in slices(batches, rows=ENCODED_ROWS, size=ENCODED_BYTES):
            ids, ends = tok.encode_all(b.column(1).to_pylist())
            ids = np.insert(ids, ends, end_id)
            upto = ends + np.arange(1, len(ends) + 1)
            n = np.diff(upto, prepend=0)
            offsets = pa.array(np.append(0, upto) * tok.width).cast(pa.int32())  # raises beyond 2 GB
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(first + upto - n), b.column(0), pa.array(n), pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(ids)])],
                ["part", "first", "doc_id", "n", "ids"],
            )
            first += len(ids)

    return docs.mapInArrow(forgetting(run, lambda: bpe.load(vocabulary)), TOKENS)


def _cut(batches, begins: dict[int, int], width: int, size: int):
    for b in slices(batches, 4):
        col = [b.column(i).to_pylist() for i in range(4)]
        out, which = [], []
        for k, (part, first, n, ids) in enumerate(zip(col[0], col[1], col[3], b.column(4))):
            wide = np.frombuffer(ids.as_buffer(), dtype=f"<u{width}").astype("<u4")
            at, start = begins[part] + first, 0
            while start < n:
                length = min(n - start, size - at % size)
                out.append((start, length, zlib.crc32(wide[start : start + length]), n, at // size, at % size, length < n))
                which.append(k)
                start, at = start + length, at + length
        if out:
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [b.column(2).take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in c[:6]), pa.array(c[6], pa.bool_())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"],
            )
