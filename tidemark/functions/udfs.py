"""The few functions that built-in expressions cannot give: opcode text diffs, full case folding, the shortest text of a double."""

from __future__ import annotations

import difflib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from tidemark.plans.model import REFINE_CHARS

#: Types, not DDL text: workers import this module without a Spark context.
STATS = StructType([StructField("added", IntegerType()), StructField("removed", IntegerType())])


def change_stats(old: str | None, new: str | None) -> tuple[int, int]:
    """(added, removed) characters: whole lines, except that small replaced chunks are compared character by character."""
    return change_stats_of([(old, new)])[0]


def change_stats_of(pairs: Iterable[tuple[str | None, str | None]]) -> list[tuple[int, int]]:
    """change_stats of each pair; the small chunks of all pairs are compared together."""
    out, chunks, of = [], [], []
    for old, new in pairs:
        gained = lost = 0
        if old != new:
            a = old.splitlines(keepends=True) if isinstance(old, str) else []
            b = new.splitlines(keepends=True) if isinstance(new, str) else []
            for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                if op == "equal":
                    continue
                was, now = "".join(a[i:j]), "".join(b[k:m])
                gained, lost = gained + len(now), lost + len(was)
                if op == "replace" and len(was) + len(now) <= REFINE_CHARS:
                    chunks.append((was, now))
                    of.append(len(out))
        out.append([gained, lost])
    for p, same in zip(of, kept_of_chunks(chunks)):
        out[p] = [n - same for n in out[p]]
    return [(gained, lost) for gained, lost in out]


#: Characters compared together and matches listed at once: what bounds the arrays.
CHARACTERS, MOST_MATCHES = 1 << 17, 1 << 20
#: Common runs are looked for from this length downwards, each time only between the blocks found so far; single characters come last.
RUNS = (4, 2)
#: The last place within a chunk that can be told, above REFINE_CHARS.
LATEST = (1 << 20) - 1


def kept_of_chunks(chunks: list[tuple[str, str]]) -> list[int]:
    """kept_characters of each chunk, many chunks by the same array operations."""
    out, some, n = [], [], 0
    for was, now in chunks:
        if some and n + len(was) + len(now) > CHARACTERS:
            out += _kept(some)
            some, n = [], 0
        some.append((was, now))
        n += len(was) + len(now)
    return out + _kept(some)


def _kept(chunks: list[tuple[str, str]]) -> list[int]:
    was, now = ("".join(c[side] for c in chunks) for side in (0, 1))
    letters, codes = np.unique(np.frombuffer((was + now).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    codes, total = codes.astype(np.int64), np.zeros(len(chunks), np.int64)
    grams, g, base = {}, codes, len(letters)
    for k in sorted(RUNS):  # the number of the k characters at each place; for the last places of a chunk it is never read
        g, base = g * base + np.append(g, np.zeros(k // 2, np.int64))[k // 2 :], base * base
        if base >= 1 << 28:
            seen, g = np.unique(g, return_inverse=True)
            base = len(seen)
        grams[k] = g
    ends = [np.cumsum([len(c[side]) for c in chunks], dtype=np.int64) for side in (0, 1)]
    begins = [np.append(0, e)[:-1] for e in ends]
    todo = [(0, np.stack([np.arange(len(chunks)), begins[0], ends[0], begins[1], ends[1]]))]
    while todo:
        step, rects = todo.pop()
        rects = rects[:, (rects[2] > rects[1]) & (rects[4] > rects[3])]
        if step == len(RUNS):
            for p, i0, i1, j0, j1 in rects.T.tolist():
                total[p] += _singles(was[i0:i1], now, j0, j1)
        elif (found := _runs(codes[: len(was)], codes[len(was) :], grams[RUNS[step]], RUNS[step], rects)) is not None:
            todo.append((step + 1, _split(rects, found, RUNS[step], total)))
        elif rects.shape[1] > 1:
            half = rects.shape[1] // 2
            todo += [(step, rects[:, :half]), (step, rects[:, half:])]
        else:  # nearly everything matches: row by row
            p, i0, i1, j0, j1 = rects[:, 0].tolist()
            total[p] += kept_characters(was[i0:i1], now[j0:j1])
    return total.tolist()


def _singles(was: str, now: str, j: int, end: int) -> int:
    """Matching blocks where no two characters in a row match: each is the first character that occurs in the rest, where it first does."""
    n = 0
    for c in was:
        at = now.find(c, j, end)
        if at >= 0:
            n, j = n + 1, at + 1
    return n


def _places(lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of a range and the place, for each place in a range that k characters can start at."""
    n = np.maximum(hi - lo - k + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + np.repeat(lo - (np.cumsum(n) - n), n)


def _runs(x: np.ndarray, y: np.ndarray, grams: np.ndarray, k: int, rects: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(rectangle, place in x, place in y, length) of the common runs, as long as they go, of k characters or more; None: too many at once."""
    (_, i0, i1, j0, j1), base, bits = rects, int(grams.max(initial=0)) + 1, len(y).bit_length()
    r, i = _places(i0, i1, k)
    q, j = _places(j0, j1, k)
    a, b = r * base + grams[i], np.sort((q * base + grams[len(x) + j]) << bits | j)
    b, j = b >> bits, b & (1 << bits) - 1
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])
    size, names = np.diff(np.append(first, len(b))), b[first]
    hit = np.minimum(np.searchsorted(names, a), max(len(names) - 1, 0))
    ok = np.flatnonzero(names[hit] == a) if len(names) else np.zeros(0, np.int64)
    r, i, hit = r[ok], i[ok], hit[ok]
    n = size[hit]
    m = int(n.sum())
    if m > MOST_MATCHES:
        return None
    j = j[np.arange(m) + np.repeat(first[hit] - (np.cumsum(n) - n), n)]
    r, i = np.repeat(r, n), np.repeat(i, n)
    begins = (i == i0[r]) | (j == j0[r]) | (x[i - 1] != y[j - 1])
    stops = (i + k == i1[r]) | (j + k == j1[r]) | (x[np.minimum(i + k, len(x) - 1)] != y[np.minimum(j + k, len(y) - 1)])
    line = (i - j + len(y)) * len(x) + i  # along diagonals, beginnings and ends take turns
    begins = np.flatnonzero(begins)
    begins = begins[np.argsort(line[begins])]
    return r[begins], i[begins], j[begins], np.sort(line[stops]) - line[begins] + k


def _split(rects: np.ndarray, runs: tuple[np.ndarray, ...], k: int, total: np.ndarray) -> np.ndarray:
    """Takes the longest run of each rectangle, the first of equally long ones, into ``total`` and goes on before and after it; returns what holds no run any more.

    No run reaches to both sides of the longest one, as it would be longer.
    """
    (r, i, j, n), left = runs, []
    while True:
        some = np.zeros(rects.shape[1], bool)
        some[r] = True
        left.append(rects[:, ~some])
        if not len(r):
            return np.concatenate(left, axis=1)
        rects, r = rects[:, some], (np.cumsum(some) - 1)[r]
        p, i0, i1, j0, j1 = rects
        best = np.zeros(len(p), np.int64)
        np.maximum.at(best, r, n << 40 | (LATEST - (i - i0[r])) << 20 | (LATEST - (j - j0[r])))
        size, bi, bj = best >> 40, i0 + LATEST - (best >> 20 & LATEST), j0 + LATEST - (best & LATEST)
        np.add.at(total, p, size)
        before = np.minimum(np.minimum(bi[r] - i, bj[r] - j), n)
        skip = np.maximum(np.maximum((bi + size)[r] - i, (bj + size)[r] - j), 0)
        after = n - skip
        rects = np.concatenate([np.stack([p, i0, bi, j0, bj]), np.stack([p, bi + size, i1, bj + size, j1])], axis=1)
        goes_on = after > before
        keep = np.flatnonzero(np.maximum(before, after) >= k)
        skip = np.where(goes_on, skip, 0)[keep]
        n = np.maximum(before, after)[keep]
        r, i, j = (r + goes_on * len(p))[keep], i[keep] + skip, j[keep] + skip


#: Product of lengths below which the library's matcher is faster than rows of arrays.
SMALL_CHUNK = 120_000


def kept_characters(was: str, now: str) -> int:
    """Characters in the matching blocks of two texts: the longest block, the first of equally long ones, then those on either side of it.

    The same blocks as difflib's; in a large chunk the longest is found with one array operation for each character of ``was``.
    """
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (was, now))
    at = {c: (y == c).astype(np.int16) for c in np.unique(x).tolist()} if len(x) * len(y) > SMALL_CHUNK else {}
    codes, total, todo = x.tolist(), 0, [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if (i1 - i0) * (j1 - j0) <= SMALL_CHUNK:
            if i0 < i1 and j0 < j1:
                blocks = difflib.SequenceMatcher(None, was[i0:i1], now[j0:j1], autojunk=False).get_matching_blocks()
                total += sum(block.size for block in blocks)
            continue
        best, i, j = 0, 0, 0
        above, row = np.zeros(j1 - j0 + 1, np.int16), np.zeros(j1 - j0 + 1, np.int16)
        for k in range(i0, i1):  # row[m + 1]: the length of the common run that ends at was[k], now[j0 + m]
            np.add(above[:-1], 1, out=row[1:])
            np.multiply(row[1:], at[codes[k]][j0:j1], out=row[1:])
            top = int(row.max())
            if top > best:
                best, i, j = top, k - top + 1, j0 + int(row.argmax()) - top
            above, row = row, above
        if best:
            total += best
            todo += [(i0, i, j0, j), (i + best, i1, j + best, j1)]
    return total


@F.pandas_udf(STATS)
def text_change(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """change_stats by batches; call it in a branch that only long, changed texts reach."""
    return pd.DataFrame(change_stats_of(zip(old, new)), columns=["added", "removed"])


@F.arrow_udf(StringType())
def float_text(x: pa.Array) -> pa.Array:
    """The shortest decimal text that reads back as the same double, in the usual notation between 1e-4 and 1e16: 10000000.0, 1e+16, nan, -inf."""
    return pa.array([None if v is None else repr(v) for v in x.to_pylist()], pa.string())


@F.pandas_udf(BooleanType())
def folded_contains(text: pd.Series, part: pd.Series) -> pd.Series:
    """Substring under full Unicode case folding; null contains nothing."""
    return pd.Series([isinstance(t, str) and p.casefold() in t.casefold() for t, p in zip(text, part)])
