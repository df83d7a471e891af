"""Quality classifier by importance resampling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, drop, forgetting, labelled_texts, sha, slices, texts, written

#: Labelled rows that the models are fitted on at most (those of the smallest hashes of doc_id).
SAMPLE = 20_000
BUCKETS = 1 << 16
#: Pseudo-counts of the share of good text in each bucket.
PRIOR = 20.0

_STEP, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SAME = np.uint64(0x51ED270B27B4F3CF)


def _hash_word(w: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(w, 1), xxhash.xxh64_intdigest(w[-3:], 2)


_words = Memo(_hash_word)


def remembered() -> Memo:
    """The worker's hashes of words and of their endings."""
    return _words


def features(text: str) -> np.ndarray:
    """Buckets of a text's n-grams: words, pairs of words (a repeated word is one and the same pair), last three bytes of words."""
    words = text.encode("utf-8").split()
    if not words:
        return np.empty(0, np.int64)
    h = np.array([x for w in words for x in _words[w]], np.uint64).reshape(-1, 2)
    first, second = h[:-1, 0], h[1:, 0]
    pairs = np.where(first == second, _SAME, (first * _STEP + second) ^ _SALT)
    every = np.concatenate([h[:, 0], h[:, 1], pairs])
    every = (every ^ (every >> np.uint64(29))) * _STEP
    return (every >> np.uint64(48)).astype(np.int64)


@dataclass
class Weights:
    """Log ratio of the target's bucket probabilities to raw text's, and the target's share of labelled rows."""

    ratio: np.ndarray
    share: float

    def log_weight(self, text: str) -> float:
        return float(self.ratio[features(text)].sum())


def ratio(raw: np.ndarray, good: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """Log ratio of the target model to the raw model in each bucket.

    The raw model are the counts of all text. The target model are the same counts, each bucket's tilted by the share of its n-grams that lies in good rows
    among the labelled ones (with PRIOR pseudo-counts of the overall share), and normalised over raw text. So an n-gram that the
    labelled rows lack, as most rare ones of a large corpus, says next to nothing.
    """
    tilt = (good + PRIOR * good.sum() / labelled.sum()) / (labelled + PRIOR)
    return np.log(tilt / ((raw * tilt).sum() / raw.sum()))


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How often each bucket's n-grams occur in the texts of (doc_id, text): at most BUCKETS rows from a task and to the driver."""

    def count(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            n += np.bincount(np.concatenate([features(t) for t in b.column(1).to_pylist()]), minlength=BUCKETS)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    got = rows.mapInArrow(forgetting(count, remembered), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(BUCKETS, np.int64)
    n[got["bucket"]] = got["n"]
    return n


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> Weights:
    """Generative bucket models of target text (tilted by a bounded sample of labelled rows) and of raw text (all rows of ``docs``)."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = written(rows, "labelled")  # so that it is drawn once
    known = labelled_texts(docs, rows)
    of = lambda marked: bucket_counts(known.where(marked).select("doc_id", "text"))
    total, n = known.agg(F.count("*"), F.count(F.when(F.col("label") > 0, 1))).first()
    target, rest = (of("label > 0"), of("label <= 0")) if 0 < n < total else (np.zeros(1), np.zeros(1))
    drop(rows, known)
    if not target.any() or not rest.any():
        return Weights(np.zeros(BUCKETS), 1.0)
    return Weights(ratio(bucket_counts(docs), target, target + rest), n / total)


def gumbel(seed: int, key: Column) -> Column:
    """Gumbel noise from a hash, the same whenever a row is computed again."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """The exact k-th largest value, by counting in ever narrower bins: no sort, a thousand rows to the driver a pass."""
    x = df.select(F.col(col).alias("x"))
    n, lo, hi = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while lo < hi:
        step = (hi - lo) / 1024
        bins = x.where(F.col("x").between(lo, hi)).groupBy(F.floor((F.col("x") - lo) / step).alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r["b"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def _scored(docs: DataFrame, weights: Weights, seed: int) -> DataFrame:
    """(doc_id, sha, n_words, log_weight, key) of (doc_id, text)."""

    def run(batches):
        for b in slices(batches):
            got = b.column(1).to_pylist()
            log_weight = pa.array([weights.log_weight(t) for t in got], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(t.encode().split()) for t in got], pa.int64()), log_weight], ["doc_id", "sha", "n_words", "log_weight"])

    scored = docs.select("doc_id", "text", sha(F.col("text")).alias("sha"))
    scored = scored.mapInArrow(forgetting(run, remembered), "doc_id long, sha binary, n_words long, log_weight double")
    return written(scored.withColumn("key", F.col("log_weight") + gumbel(seed, F.col("doc_id"))), "quality")


def threshold(scored: DataFrame, weights: Weights, keep: int | None) -> float:
    """The ``keep``-th largest key; by default as many as the expected number of target documents."""
    if keep is None:
        keep = round(scored.agg(F.sum(_posterior(weights))).first()[0] or 0)
    return kth_largest(scored, "key", keep)


def _posterior(weights: Weights) -> Column:
    return F.least(F.lit(1.0), F.lit(float(weights.share)) * F.exp(F.least(F.col("log_weight"), F.lit(50.0))))


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11, keep: int | None = None) -> DataFrame:
    """Importance resampling of all documents: doc_id, n_words, log_weight, key, probability, kept.

    A document's log-weight is the log ratio of its hashed n-grams' likelihood under the target model to that under the raw model: counts
    over all rows of ``docs``, which the target model tilts by what at most ``sample`` labelled rows show. Gumbel noise is added and the
    ``keep`` largest keys stay: a draw without replacement in proportion to the weights. By default ``keep`` is the expected number
    of target documents: the sum of share x weight, at most 1 each. The k-th key is found by counting. n-grams are of words between ASCII white space.

    Null and empty texts have weight 1; rows repeating an id have equal noise; equal keys at the threshold all stay. Without labels of
    both kinds all weights are 1 and all documents stay. An empty table gives no rows.
    """
    rows = texts(docs)
    weights = fit(rows, labels, sample)
    scored = _scored(rows, weights, seed)
    least = threshold(scored, weights, keep)
    return scored.select("doc_id", "n_words", "log_weight", "key", _posterior(weights).alias("probability"), (F.col("key") >= F.lit(least)).alias("kept"))


def filter_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11, keep: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with all their columns.

    Texts are scored once. The threshold is known only after all have a key, so rows meet the ids and hashes of what goes afterwards, their columns
    carried in a struct, so that no name clashes.
    """
    rows = texts(docs)
    weights = fit(rows, labels, sample)
    scored = _scored(rows, weights, seed)
    least = threshold(scored, weights, keep)
    gone = scored.where(F.col("key") < F.lit(least)).select("doc_id", "sha")
    held = docs.select(F.col("doc_id").cast("long").alias("id"), sha(F.col("text")).alias("text_sha"), F.struct("*").alias("row"))
    kept = held.join(gone, held["id"].eqNullSafe(gone["doc_id"]) & (held["text_sha"] == gone["sha"]), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
