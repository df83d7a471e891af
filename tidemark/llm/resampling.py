"""Resampling towards a target distribution: bucketed word runs by running checksums."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.log import with_seq

from .common import drop, slices, texts, written

BUCKETS = 10_000
#: Bytes of a text whose words are held at once.
PIECE = 1 << 18

#: A-Z to a-z, digits and all bytes of longer characters as they are, everything else to a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: str) -> Iterator[list[bytes]]:
    """A text's words, those of about PIECE bytes at a time."""
    data, at = text.encode("utf-8").translate(_LETTERS), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = end if end >= 0 else len(data)
        yield data[at:end].split()
        at = end


class Ring:
    """The checksum states of the runs that began at the last ``n`` words.

    Each state goes on by a space and the next word, so no run is ever put together.
    """

    def __init__(self, n: int):
        self.others, self.states = n - 1, []

    def take(self, words: list[bytes]) -> list[int]:
        """The unsigned crc32 of every run of 1 to n words that ends in ``words``, joined by one space; goes on from the words taken before."""
        out, states, others = [], self.states, self.others
        for word in words:
            more = b" " + word
            states = [crc32(word), *[crc32(more, state) for state in states[:others]]]
            out += states
        self.states = states
        return out


def bucket_counts(text: str, n: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A text's words, the distinct buckets of its runs, ascending, and the runs in each: at most ``buckets`` of them however long the text is."""
    ring, n_words, counts = Ring(n), 0, None
    for i, words in enumerate(pieces(text)):
        here = np.array(ring.take(words), np.int64) % buckets
        n_words += len(words)
        if not i:
            at, found = np.unique(here, return_counts=True)
            continue
        if counts is None:
            counts = np.zeros(buckets, np.int64)
            counts[at] = found
        counts += np.bincount(here, minlength=buckets)
    if not n_words:
        return 0, np.empty(0, np.int64), np.empty(0, np.int64)
    if counts is not None:
        at = np.nonzero(counts)[0]
        found = counts[at]
    return n_words, at, found


def emitted(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, buckets, counts) of (doc_id, text): a narrow map, the one scan of the texts."""

    def run(batches):
        for b in slices(batches):
            n_words, at, found = zip(*(bucket_counts(t, n, buckets) for t in b.column(1).to_pylist()))
            ends = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((at, pa.int32()), (found, pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), *lists], ["doc_id", "n_words", "buckets", "counts"])

    return docs.mapInArrow(run, "doc_id long, n_words long, buckets array<int>, counts array<long>")


def totals(rows: DataFrame, buckets: int) -> np.ndarray:
    """Runs in each bucket over all rows of ``emitted``: at most ``buckets`` rows from each task and to the driver."""

    def add(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(n, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    got = rows.select("buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(buckets, np.int64)
    n[got["bucket"]] = got["n"]
    return n


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in raw text, with one more run in every bucket."""
    k, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of ``emitted`` rows."""

    def run(batches):
        for b in batches:
            at, n = b.column(2), b.column(3).flatten().to_numpy()
            ends = at.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            sums = (np.concatenate([[0], np.cumsum(x)])[ends] for x in (n, n * gain[at.flatten().to_numpy()]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.diff(x)) for x in sums)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int):
    """Gumbel noise in thousandths from the sha256 of seed and doc_id, the same wherever a row is computed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample_to_target(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """A draw of ``percent`` of the documents of at least ``least_words`` words, by importance for the texts of ``target``: doc_id, n_features, weight, score, rank.

    Features are all runs of 1 to ``n`` words, hashed to ``buckets``; a text's weight is the sum of its buckets' gains, its score that plus Gumbel
    noise. Ranks count from 1 by falling score, ties by doc_id; rows that are not drawn have none.

    The texts are scanned once, by tasks that write what they find (at most ``buckets`` numbers for a text); counts and weights come from that table.
    A row for each bucket goes to the driver and back. Scores are ranked by a range sort and sums of partition sizes.

    Null and empty texts have no features, weight 0 and no rank; a null doc_id stays null, its noise is that of the empty id, and it is the first among equals;
    rows that repeat an id are drawn one by one, equal ones in any order; an empty table gives no rows, an empty target weighs all buckets alike;
    other columns are not read.
    """
    rows = written(emitted(texts(docs, id_col, text_col), n, buckets), "buckets")
    raw = totals(rows, buckets)
    wanted = totals(emitted(target.select(F.lit(0).cast("long"), F.coalesce(F.col(target_col).cast("string"), F.lit(""))), n, buckets), buckets)
    scored = written(weighed(rows, gains(raw, wanted)).withColumn("score", F.col("weight") + noise(seed)), "scores")
    drop(rows)
    able = F.col("n_words") >= F.lit(least_words)
    drawn = scored.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.desc("weight"), F.asc("n_features")]
    ranked = with_seq(scored.where(able), order, name="rank", one_task=0)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.lit(drawn), F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")
