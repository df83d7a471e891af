"""Toxicity by maximum-scoring segments."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, forgetting, labelled_texts, slices, texts

_CUT = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: Labelled rows that a model is fitted on at most (those of the smallest hashes of doc_id).
SAMPLE = 30_000
#: Entries of the word table and of the prefix table at most, the most frequent first.
VOCABULARY = 100_000
PREFIX = 5
#: Weight of the prior in tokens, cost of each token, significance of a log-odds in deviations, its range.
PRIOR, DRIFT, DEVIATIONS, RANGE = 2000.0, 0.5, 2.5, (-2.0, 8.0)
#: A segment is significant if fewer than this many are expected by chance in a clean text of that length.
EXPECT = 0.05


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters; anything beyond ASCII counts as a letter."""
    return text.lower().encode("utf-8").translate(_CUT).split()


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior_toxic: np.ndarray, prior_clean: np.ndarray) -> np.ndarray:
    """Log-odds of rates under Dirichlet priors (pseudo-counts), shrunk by significance: nought within DEVIATIONS.

    Significance is the likelihood ratio statistic of a word's counts against the prior's split.
    """
    at, ac = prior_toxic.sum(), prior_clean.sum()
    x = np.log((toxic + prior_toxic) / (toxic.sum() + at)) - np.log((clean + prior_clean) / (clean.sum() + ac))
    odds = prior_toxic / prior_clean * (toxic.sum() / clean.sum())
    share = odds / (1 + odds)
    n = toxic + clean
    g2 = 2 * (_xlogy(toxic, toxic / (n * share)) + _xlogy(clean, clean / (n * (1 - share))))
    return x * np.maximum(0, 1 - DEVIATIONS**2 / np.maximum(g2, 1e-12)) + np.log(prior_toxic / at / (prior_clean / ac)) * (g2 < DEVIATIONS**2)


def _xlogy(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(y, 1e-300)), 0.0)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear time.

    Every positive score opens a candidate, which then absorbs the candidates back to the last one with a lower
    left sum, as long as its own right sum is higher; the rest are maximal.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list[float]] = []  # start, end, left sum, right sum, last candidate of lower left sum
    for i in np.nonzero(scores > 0)[0].tolist():
        start, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right, j])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
            j -= 1
    return [(int(s), int(e), r - l) for s, e, l, r, _ in found]


@dataclass
class Model:
    words: dict[bytes, float]
    prefixes: dict[bytes, float]
    rate: float  # of the extreme-value law
    log_k: float
    slope: float
    offset: float

    def score_words(self, doc: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._table.__getitem__, doc), np.float64, len(doc))

    def __post_init__(self):
        """Scores of words; an unknown word has its prefix's, an unknown prefix none; each token costs DRIFT."""
        self._table = Memo(lambda w: self.prefixes.get(w[:PREFIX], 0.0) - DRIFT, {w: x - DRIFT for w, x in self.words.items()})

    def __reduce__(self):
        return Model, (self.words, self.prefixes, self.rate, self.log_k, self.slope, self.offset)

    def evidence(self, doc: list[bytes]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The calibrated statistic, and significant segments (start, end, score, expected number by chance).

        The sum of the significant segments, or else the best one, in units of the law that the best segment of a clean text follows.
        """
        found = segments(self.score_words(doc))
        size = self.log_k + math.log(max(1, len(doc)))
        rated = [(s, e, x, math.exp(min(50.0, size - self.rate * x))) for s, e, x in found]
        sure = [r for r in rated if r[3] < EXPECT]
        best = max((x for _, _, x in found), default=0.0)
        total = self.rate * best - size + sum(max(0.0, self.rate * r[2] - size) for r in sure if r[2] < best)
        return total, sure

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.slope * math.asinh(statistic) + self.offset))))


def training_rows(labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic) of labelled rows outside the held-out fold crc32(doc_id) mod 5 = 0; at most ``sample``."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (held_out() == F.lit(False)))
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit(docs: DataFrame, train: DataFrame) -> Model:
    """Log-odds of words and prefixes, counted once a document so that one document's pet words weigh little, the extreme-value law of clean rows, and a logistic calibration.

    ``train`` is bounded, so it is broadcast; texts stay on the executors. Without rows of both labels, every score is the base rate.
    """
    known = labelled_texts(docs, train.withColumnRenamed("toxic", "label")).select(F.col("label").alias("toxic"), "text")

    def count(batches):
        n: dict[tuple[bool, bytes], list[int]] = {}
        for b in slices(batches):
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = set(words(text))
                for key in [(False, w) for w in found] + [(True, w) for w in {w[:PREFIX] for w in found}]:
                    n.setdefault(key, [0, 0])[1 if toxic else 0] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in n], pa.bool_()), pa.array([k[1] for k in n], pa.binary()), *(pa.array([c[i] for c in n.values()], pa.int64()) for i in (0, 1))],
            ["prefix", "w", "clean", "toxic"],
        )

    counts = known.mapInArrow(count, "prefix boolean, w binary, clean long, toxic long")
    counts = counts.groupBy("prefix", "w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic > 1")
    top = lambda prefix: counts.where(F.col("prefix") == prefix).orderBy(F.desc(F.col("clean") + F.col("toxic")), "w").limit(VOCABULARY).toPandas()
    p, w = top(True), top(False)
    if not len(p) or not p["toxic"].sum() or not p["clean"].sum():
        return _base_rate(train)
    pt, pc = p["toxic"].to_numpy(float), p["clean"].to_numpy(float)
    share = (pt + pc) / (pt + pc).sum()
    px = log_odds(pt, pc, PRIOR * share, PRIOR * share)
    prefix_scores = dict(zip(map(bytes, p["w"]), np.clip(px, *RANGE).tolist()))
    wt, wc = w["toxic"].to_numpy(float), w["clean"].to_numpy(float)
    share = (wt + wc) / (wt + wc).sum()
    lean = np.exp(np.array([prefix_scores.get(bytes(x)[:PREFIX], 0.0) for x in w["w"]]) / 2)
    wx = log_odds(wt, wc, PRIOR * share * lean, PRIOR * share / lean)
    scored = dict(zip(map(bytes, w["w"]), np.clip(wx, *RANGE).tolist()))
    model = Model(scored, prefix_scores, 1.0, 0.0, 1.0, 0.0)
    return _calibrate(model, known, wc, np.clip(wx, *RANGE) - DRIFT)


def _base_rate(train: DataFrame) -> Model:
    r = train.agg(F.avg("toxic")).first()[0] or 0.0
    r = min(0.999, max(0.001, r))
    return Model({}, {}, 1.0, 0.0, 0.0, math.log(r / (1 - r)))


def _calibrate(model: Model, known: DataFrame, clean: np.ndarray, x: np.ndarray) -> Model:
    q = clean / clean.sum()
    lo, hi = 1e-3, 20.0
    for _ in range(60):  # the positive root of sum q exp(rate x) = 1, if any
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (q * np.exp(mid * x)).sum() > 1 else (mid, hi)
    model = Model(model.words, model.prefixes, min(lo, 2.0), 0.0, 1.0, 0.0)

    def best(batches):
        for b in slices(batches):
            docs = [words(t) for t in b.column(1).to_pylist()]
            found = [segments(model.score_words(d)) for d in docs]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(d) for d in docs], pa.int64()), pa.array([max((s for _, _, s in f), default=0.0) for f in found])], ["toxic", "n", "best"]
            )

    rows = known.mapInArrow(best, "toxic int, n long, best double").where("toxic = 0").toPandas()  # at most SAMPLE rows
    expected = np.sort(np.maximum(1, rows["n"].to_numpy()) * np.exp(-model.rate * rows["best"].to_numpy()))  # sorted: sums that any run repeats
    log_k = math.log(max(1, len(expected)) / max(expected.sum(), 1e-9))
    model = Model(model.words, model.prefixes, model.rate, log_k, 1.0, 0.0)

    def statistic(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.evidence(words(t))[0] for t in b.column(1).to_pylist()], pa.float64())], ["toxic", "x"])

    got = known.mapInArrow(statistic, "toxic int, x double").toPandas().sort_values(["x", "toxic"])  # at most SAMPLE pairs
    slope, offset = _logistic(np.arcsinh(got["x"].to_numpy()), (got["toxic"] > 0).to_numpy(float))
    return Model(model.words, model.prefixes, model.rate, log_k, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, on targets pulled in a little, so that separable rows have a finite fit."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = x.std() or 1.0
    a = np.column_stack([(x - x.mean()) / scale, np.ones(len(x))])
    b = np.array([1.0, math.log((n1 + 1) / (n0 + 1))])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (target - p) - 1e-4 * b)
        b = b + step * min(1.0, 2 / abs(step).max())
        if abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1] - b[0] * x.mean() / scale)


SCHEMA = (
    "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first_word:int,end_word:int,score:double,expected:double>>"
)
_PASSAGE = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text, learned from labelled rows outside the held-out fold.

    It learns from at most ``sample`` labelled rows; words and prefixes that only one of them has are left out, and the model's tables hold the VOCABULARY
    most frequent of each. Scoring reads all words of all texts. Words carry log-odds of toxic against clean rows under Dirichlet priors: a word's prior follows its 5-byte
    prefix, whose prior is the corpus rate. Maximal scoring segments are found in linear time; the law of the
    best segment of clean rows (extreme value) turns their scores into chances, those expected less than 0.05
    times are reported as passages, and a logistic fit maps their sum to a probability.

    A null or empty text has no segment and gets a low score of its own; repeated rows get equal scores; null
    ids are never held out. Without usable labels every score is the base rate. An empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col)
    model = fit(rows, training_rows(labels, sample, id_col))

    def run(batches):
        for b in slices(batches):
            got = [model.evidence(words(t)) for t in b.column(1).to_pylist()]
            score = [model.probability(x) for x, _ in got]
            spans = [[dict(first_word=s, end_word=e, score=x, expected=v) for s, e, x, v in sure] for _, sure in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(spans, pa.list_(_PASSAGE))],
                ["doc_id", "held_out", "score", "predicted", "passages"],
            )

    return rows.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")).mapInArrow(forgetting(run), SCHEMA)
