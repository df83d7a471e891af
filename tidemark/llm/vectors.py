"""Vector code compression: product codes of integer vectors, whose nearest entries are found behind segment-mean lower bounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that are compared at once in a task.
ROWS = 4096
#: Bounds are computed in doubles; this share of them, and this much, is allowed for rounding (components are below 2^32).
SLACK, LEAST_SLACK = 1e-9, 1.0
_MOST_LONG = (1 << 63) - 1


def segments(width: int) -> list[np.ndarray]:
    """Starts of the segments of each level, coarse to fine: one segment, then halves of it as long as they hold two components."""
    out, count = [], 1
    while count == 1 or width // count >= 2:
        out.append(np.unique(np.arange(count) * width // count))
        count *= 2
    return out


class Codebook:
    """Integer entries (entry, component) of one part, with their segment means and the norms of what those leave, for each level."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = segments(entries.shape[1]) if entries.shape[1] else []
        self.shapes = [_shape(entries, starts) for starts in self.levels]

    def nearest(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and exact squared distance of each row's nearest entry (ties to the lower index), and how many exact distances that took.

        In each segment the squared difference of means times the length, plus the squared difference of residual norms, is at most the true squared distance; so is
        their sum. An entry stays while that bound is not above the least exact distance of the entries that each level's bound put first. Whatever stays is measured in integers.
        """
        n, k = len(part), len(self.entries)
        if not self.levels:
            return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        rows, cols = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
        best, measured = np.full(n, _MOST_LONG), 0
        for (means, rest, lengths), starts in zip(self.shapes, self.levels):
            own, own_rest, _ = _shape(part, starts)
            gap = own[rows] - means[cols]
            bound = (gap * gap * lengths + (own_rest[rows] - rest[cols]) ** 2).sum(axis=1)
            best = np.minimum(best, _distance(part, self.entries[cols[_first_least(rows, bound, n)]]))
            stays = bound * (1 - SLACK) - LEAST_SLACK <= best[rows]
            rows, cols, measured = rows[stays], cols[stays], measured + n
        exact = _distance(part[rows], self.entries[cols])
        at = _first_least(rows, exact, n)
        return cols[at], exact[at], measured + len(rows)


def _first_least(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The place of the first least value of each of ``n`` rows; ``rows`` ascends and lacks none of them."""
    least = np.minimum.reduceat(values, np.searchsorted(rows, np.arange(n)))
    at = np.nonzero(values == least[rows])[0]
    return at[np.searchsorted(rows[at], np.arange(n))]


def _shape(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.diff(np.append(starts, x.shape[1])).astype(np.float64)
    means = np.add.reduceat(x, starts, axis=1) / lengths
    rest = x - np.repeat(means, lengths.astype(np.int64), axis=1)
    return means, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1)), lengths


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def largest(width: int) -> int:
    """The greatest magnitude of a component with which squared distances of ``width`` components still fit a long."""
    return math.isqrt(_MOST_LONG // max(1, width)) // 2


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, zeros after the shorter ones, no component beyond ``largest``."""
    flat, lengths, most = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()), largest(width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.clip(flat, -most, most)
    return out


def _parts(column: pa.Array, width: int, parts: int):
    """Slices of at most ROWS rows, each cut into its parts."""
    for at in range(0, len(column), ROWS):
        yield at, np.split(_matrix(column.slice(at, ROWS), width), parts, axis=1)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, vector as integers floor(scale * x)) of the rows whose vector is not null and holds finite components only."""
    x = F.col(vector_col).cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    ints = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), ints.alias("x"))


def train(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds: each is one pass over the rows, of which every task sends one sum for an entry."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries)
    first = pa.array([r.x for r in first.collect()], pa.list_(pa.int64()))  # ``entries`` rows
    books = np.split(_matrix(first, width), parts, axis=1)
    names = "part int, entry int, n long, sums array<long>"
    for _ in range(rounds):
        made = [Codebook(b) for b in books]

        def add(batches, made=made):
            sums = [np.zeros(b.entries.shape, np.int64) for b in made]
            counts = np.zeros((parts, len(books[0])), np.int64)
            for b in batches:
                for _, cut in _parts(b.column(0), width, parts):
                    for p, part in enumerate(cut):
                        at = made[p].nearest(part)[0]
                        np.add.at(sums[p], at, part)
                        counts[p] += np.bincount(at, minlength=len(counts[p]))
            at = np.nonzero(counts)
            found = [sums[p][e] for p, e in zip(*at)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in at), pa.array(counts[at]), pa.array(found, pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        got = rows.select("x").mapInArrow(add, names).select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        got = got.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        books = [b.copy() for b in books]
        for r in got.collect():  # a row for each component of each entry
            books[r.part][r.entry, r["at"]] = int(r.s) // r.n
    return books


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(vec_id, label, code, error): a narrow map."""

    def run(batches):
        made = [Codebook(b) for b in books]
        for b in batches:
            for at, cut in _parts(b.column(2), width, len(books)):
                found = [book.nearest(part) for book, part in zip(made, cut)]
                code = np.stack([f[0] for f in found], axis=1)
                error = np.sum([f[1] for f in found], axis=0)
                n = len(code)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(["".join(f"{i:02x}" for i in row) for row in code.tolist()]), pa.array(error, pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return rows.select("vec_id", "label", "x").mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Product codes of all whole vectors: vec_id, code, error, label_error, codebooks_sha256.

    Components become integers floor(scale * x). Vectors are cut into ``parts`` equal parts; each part's codebook starts as that part of the ``entries`` smallest
    vec_ids and goes through ``rounds`` of assignment and componentwise floored means, unused entries staying. All distances that decide are exact integers; lower bounds
    by segment means and residual norms leave most entries unmeasured (Codebook.nearest). A round is one narrow pass over the written integers; ``parts * entries``
    sums from each task meet in an aggregate, and so many rows go to the driver. Errors are summed over equal labels, nulls together, in decimals.

    Rows whose vector is null or holds a null or a non-finite component are dropped. A shorter vector, and a length that ``parts`` does not divide, counts as
    filled up with zeros; an empty one is all zeros. Components beyond ``largest`` of the width (95 million in 64 components, so 23,170 before scaling) count as that, so that distances fit a long; sums by
    label beyond a long count as the greatest one. Of rows that repeat a vec_id the one of the smaller vector is taken first for the codebook; null ids come last. Fewer rows than ``entries`` give
    as many entries. An empty table gives no rows. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = written(whole_vectors(vectors, id_col, vector_col, label_col, scale), "vectors")
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = -(-longest // parts) * parts
    books = train(rows, width, parts, entries, rounds)
    coded = written(encode(rows, books, width), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(_MOST_LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    met = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
