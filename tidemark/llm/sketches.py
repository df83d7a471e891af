"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, forgetting, slices, texts

SHINGLE = 5
#: Every shingle hash below 2^32 / SCALE is retained.
SCALE = 4
#: A sketch that would hold fewer than FLOOR hashes holds its FLOOR smallest instead.
FLOOR = 64
TOP = 1 << 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _hash_word(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w, 7)


_words = Memo(_hash_word)


def remembered() -> Memo:
    """The worker's hashes of words."""
    return _words


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8").lower().split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of all shingles; a shorter text is one shingle, an empty one has none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint32)
    k = min(shingle, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _STEP + words[i : n - k + 1 + i]
    for shift, mult in zip((30, 27), _MIX):
        h = (h ^ (h >> np.uint64(shift))) * mult
    return (h >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Sketch:
    """All distinct hashes of a document below ``limit``."""

    hashes: np.ndarray
    limit: int

    @classmethod
    def of(cls, shingles: np.ndarray) -> Sketch:
        fixed = TOP // SCALE
        low = np.unique(shingles[shingles < fixed])
        if len(low) >= FLOOR:
            return cls(low, fixed)
        every = np.unique(shingles)
        if len(every) <= FLOOR:
            return cls(every, TOP)
        return cls(every[:FLOOR], int(every[FLOOR - 1]) + 1)

    def text(self) -> str:
        return f"{self.limit:x}:" + base64.b64encode(self.hashes.astype("<u4").tobytes()).decode("ascii")

    @classmethod
    def parse(cls, text: str) -> Sketch:
        limit, _, body = text.partition(":")
        return cls(np.frombuffer(base64.b64decode(body), "<u4"), int(limit, 16))

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both documents' shingles together, retained up to the lower limit."""
        limit = min(self.limit, other.limit)
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(both[both < limit], limit)

    def _common(self, other: Sketch) -> tuple[int, int, int]:
        limit = min(self.limit, other.limit)
        a, b = self.hashes[self.hashes < limit], other.hashes[other.hashes < limit]
        return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)

    def likeness(self, other: Sketch) -> float:
        """Estimate of the Jaccard similarity, from the hashes that both would retain; exactly 1 for equal sketches."""
        both, a, b = self._common(other)
        if not a and not b:
            return float(self.limit == other.limit and np.array_equal(self.hashes, other.hashes))
        return both / (a + b - both)

    def containment(self, other: Sketch) -> float:
        """Estimate of the share of this document's shingles that the other has, however unequal they are."""
        both, a, _ = self._common(other)
        return both / a if a else float(not len(self.hashes))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "contained_in_edited double, contained_in_next double"
)


#: Sampled rows for each range bound: ranges then vary by about a quarter of their size.
OVERSAMPLING = 16
_LEAST = -(1 << 63)


def fingerprint_with_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 2000, most_ranges: int = 1 << 18
) -> DataFrame:
    """Sketches of every whole text and of its edited text (see SCHEMA).

    The edited text replaces the last floor(n_chars / 4) code points by as many, or all, of the first of the
    next document in ascending doc_id; the last document is followed by the first. A sketch retains
    every 5-word shingle hash below a fixed fraction of the hash range, so sketches of unequal documents
    compare and merge without their texts; a short text's holds its FLOOR smallest hashes. Hashes have 32 bits: of two documents of n and m different
    shingles n * m / 2^32 pairs agree by chance, 0.0002 for 1,000 each, so likeness is too high by at most that over n + m.

    Rows are ordered by (doc_id, text hash) and cut into ranges of about ``rows_per_range`` rows, of which there are at most ``most_ranges``;
    the bounds come from a hash sample and decide nothing but balance. A hot or null id is cut by the hash of its texts; only rows that repeat id
    and text stay together. Each range is sorted on its own and also gets the first row of the range after it: one shuffle of the
    texts, rows streamed one by one, no single-partition window; the driver sees one row per range and OVERSAMPLING sampled ones (16 bytes each).

    Null texts count as empty; a null id counts as the least long and stays null; of rows of equal id that of the lower text hash comes first; an
    empty table gives no rows; a single row is followed by itself.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(_LEAST)).alias("code"), F.xxhash64("text").alias("tie"), "text")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    bounds = _bounds(rows, n, min(most_ranges, -(-n // rows_per_range)))
    placed = rows.withColumn("range", _range_of(bounds)(F.col("code"), F.col("tie")))
    firsts = np.zeros((len(bounds) + 1, 2), np.int64)  # no range is empty: each holds its upper bound, and the last one rows beyond all bounds
    for r in placed.groupBy("range").agg(F.min(F.struct("code", "tie")).alias("f")).collect():  # a row for each range
        firsts[r["range"]] = r.f
    placed = rows.withColumn("at", _range_of(bounds, firsts)(F.col("code"), F.col("tie")))
    at, first = F.shiftright("at", 1), F.col("at").bitwiseAND(F.lit(1)) == 1
    here, there = F.struct(at.alias("b"), F.lit(0).alias("role")), F.struct(F.pmod(at - 1, F.lit(len(firsts))).cast("int").alias("b"), F.lit(1).alias("role"))
    return (
        placed.select(F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))).alias("to"), "doc_id", "code", "tie", "text")
        .select("to.b", "to.role", "doc_id", "code", "tie", "text")
        .repartition("b")
        .sortWithinPartitions("b", "role", "code", "tie")
        .select("b", "role", "doc_id", "text")
        .mapInArrow(forgetting(_walk, remembered), SCHEMA)
    )


def _bounds(rows: DataFrame, n: int, ranges: int) -> np.ndarray:
    """(code, tie) of the last row of each range but the last, from rows whose hash is low."""
    share = min(1.0, OVERSAMPLING * ranges / n)
    picked = rows.where(F.pmod(F.xxhash64("code", "tie"), F.lit(1 << 20)) < F.lit(max(1, round(share * (1 << 20)))))
    picked = picked.groupBy("code", "tie").agg(F.count("*").alias("n")).toPandas() if ranges > 1 else ()
    if len(picked) < 2:
        return np.empty((0, 2), np.int64)
    picked = picked.sort_values(["code", "tie"])
    ends = picked["n"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, ranges) / ranges))
    return picked[["code", "tie"]].to_numpy(np.int64)[at[at < len(ends) - 1]]


def _range_of(bounds: np.ndarray, firsts: np.ndarray | None = None):
    """UDF (code, tie) -> the number of bounds below a row; with ``firsts``, the first row of each range, twice that plus whether the row is one."""
    codes, ties = bounds[:, 0].copy(), bounds[:, 1].copy()

    @F.arrow_udf("int")
    def at(code: pa.Array, tie: pa.Array) -> pa.Array:
        c, t = code.to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(codes, c, "left"), np.searchsorted(codes, c, "right")
        out = lo.copy()
        for k in np.unique(lo[hi > lo]):  # ids that are bounds themselves
            same = (lo == k) & (hi > lo)
            out[same] += np.searchsorted(ties[k : hi[same][0]], t[same], "left")
        if firsts is not None:
            out = 2 * out + ((firsts[out, 0] == c) & (firsts[out, 1] == t))
        return pa.array(out, pa.int32())

    return at


class _Row:
    def __init__(self, bucket, doc_id, text: str):
        self.bucket, self.doc_id, self.text = bucket, doc_id, text
        self.sketch = sketch(text)

    def with_next(self, following: _Row) -> tuple:
        n = len(self.text)
        edited = self.text[: n - n // 4] + following.text[: n // 4]
        changed, mine = sketch(edited), self.sketch
        return (
            self.doc_id, n, hashlib.sha256(edited.encode("utf-8")).hexdigest(), mine.text(), changed.text(),
            mine.likeness(changed), mine.likeness(following.sketch), mine.containment(changed), mine.containment(following.sketch),
        )


def sketch(text: str) -> Sketch:
    return Sketch.of(shingle_hashes(word_hashes(text)))


def _walk(batches):
    """Rows of a range in order; the row of role 1 after them only follows the last."""
    held: _Row | None = None
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for b in slices(batches, 3):
        out = []
        for bucket, role, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if role and (held is None or held.bucket != bucket):
                continue  # a copy of the row that followed the last one already
            row = _Row(bucket, doc_id, text)
            if held is not None:
                out.append(held.with_next(row))
            held = None if role else row
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
