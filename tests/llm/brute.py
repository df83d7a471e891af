"""Plain versions of the operators that SQL cannot express, one row at a time."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def spark_hash(*values):
    """xxhash64 of longs, ints given as ("i", n), and strings, as Spark chains them; nulls are passed over."""
    h = 42
    for v in values:
        if v is None:
            continue
        raw = struct.pack("<i", v[1]) if isinstance(v, tuple) else v.encode() if isinstance(v, str) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


# --- op4 ------------------------------------------------------------------------------------------------------------------

MASK = (1 << 64) - 1


def bucket_list(text):
    """The buckets of all n-grams of a text, with repeats."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    hashes = [xxhash.xxh64_intdigest(w, 1) for w in words]
    grams = hashes + [xxhash.xxh64_intdigest(w[-3:], 2) for w in words]
    for a, b in zip(hashes, hashes[1:]):
        grams.append(0x51ED270B27B4F3CF if a == b else ((a * 0x9E3779B97F4A7C15 + b) & MASK) ^ 0xD6E8FEB86659FD93)
    return [((g ^ (g >> 29)) * 0x9E3779B97F4A7C15 & MASK) >> 48 for g in grams]


def quality(rows, labels, seed=11, keep=None):
    """{(id, text): (log weight, key, probability, kept)} of (id, text) rows and {id: label}; ids of the labels are unique here."""
    good, bad, raw = Counter(), Counter(), Counter()
    texts = defaultdict(list)
    for i, t in rows:
        raw.update(bucket_list(t))
        texts[i].append(t)
    known = {i: min(texts[i], key=spark_hash) for i in labels if i in texts}
    for i, t in known.items():
        (good if labels[i] else bad).update(bucket_list(t))
    n_good = sum(labels[i] for i in known)
    share, log_ratio = 1.0, defaultdict(float)
    if good and bad:
        share = n_good / len(known)
        pi = good.total() / (good.total() + bad.total())
        tilt = {b: (good[b] + 20 * pi) / (good[b] + bad[b] + 20) for b in raw}
        z = sum(n * tilt[b] for b, n in raw.items()) / raw.total()
        log_ratio = {b: math.log(x / z) for b, x in tilt.items()}
    scored = []
    for i, t in rows:
        w = sum(log_ratio[b] for b in bucket_list(t))
        u = (((spark_hash(i, ("i", seed)) & MASK) >> 11) + 0.5) / 2.0**53
        scored.append((i, t, w, w - math.log(-math.log(u)), min(1.0, share * math.exp(min(w, 50)))))
    keep = round(sum(x[4] for x in scored)) if keep is None else keep
    keys = sorted((x[3] for x in scored), reverse=True)
    least = -math.inf if keep >= len(keys) else math.inf if keep <= 0 else keys[keep - 1]
    return [(i, t, w, k, p, k >= least) for i, t, w, k, p in scored]


# --- op8 ------------------------------------------------------------------------------------------------------------------


def schedule(rows, a, seed=5, block_tokens=1 << 20):
    """(block, doc_id, source, epoch, tokens) of (id, source, text, tokens) rows under exponent a."""
    rows = sorted(set(rows), key=str)
    has = Counter()
    for _, s, _, n in rows:
        has[s] += n
    some = {s: n for s, n in has.items() if n}
    if not some:
        return Counter((0, i, s, 0, n) for i, s, _, n in rows)
    top = max(some.values())
    share = {s: (n / top) ** a for s, n in some.items()}
    total = sum(share.values())
    whole = top * total
    blocks = max(1, math.ceil(whole / block_tokens))
    out = Counter()
    for s, n in has.items():
        budget = share[s] / total * whole if n else 0.0
        for epoch in range(math.ceil(round(budget / n, 9)) if n else 1):
            place = lambda r: (spark_hash(r[0], spark_hash(r[2]), ("i", epoch), ("i", seed)) & MASK, (r[0] is not None, r[0] or 0))  # noqa: E731, B023
            at = epoch * n
            for i, _, _, tokens in sorted((r for r in rows if r[1] == s), key=place):
                if not n or at < budget or (epoch == 0 and tokens == 0):
                    out[min(math.floor(at / budget * blocks), blocks - 1) if n else 0, i, s, epoch, tokens] += 1
                at += tokens
    return out


# --- op9 ------------------------------------------------------------------------------------------------------------------


def maximal(scores):
    """Every maximal scoring segment by definition: recursively the best one, then the rests."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    _, _, _, i, j = best
    return maximal(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in maximal(scores[j:])]


def _odds(toxic, clean, prior_toxic, prior_clean):
    """{key: log-odds} from counts and pseudo-counts of each key."""
    t_all, c_all, pt_all, pc_all = (math.fsum(d.values()) for d in (toxic, clean, prior_toxic, prior_clean))
    out = {}
    for k in toxic:
        t, c, pt, pc = toxic[k], clean[k], prior_toxic[k], prior_clean[k]
        x = math.log((t + pt) / (t_all + pt_all)) - math.log((c + pc) / (c_all + pc_all))
        odds = pt / pc * t_all / c_all
        p = odds / (1 + odds)
        g2 = 2 * ((t * math.log(t / ((t + c) * p)) if t else 0) + (c * math.log(c / ((t + c) * (1 - p))) if c else 0))
        x *= max(0.0, 1 - 2.5**2 / max(g2, 1e-12))
        out[k] = min(8.0, max(-2.0, x + (math.log(pt / pt_all / (pc / pc_all)) if g2 < 2.5**2 else 0.0)))
    return out


def toxicity(rows, labels):
    """[(id, score)] of (id, text) rows with unique ids and {id: toxic}; the held-out fold is left out of all fitting."""
    cut = lambda t: [w.encode() for w in re.findall("[a-z\x80-\U0010ffff]+", t.lower())]
    docs = {i: cut(t) for i, t in rows}
    train = [(i, labels[i]) for i in labels if i in docs and zlib.crc32(str(i).encode()) % 5]
    n = {(False, 0): Counter(), (False, 1): Counter(), (True, 0): Counter(), (True, 1): Counter()}
    for i, y in train:
        n[False, y].update(set(docs[i]))
        n[True, y].update({w[:5] for w in docs[i]})
    both = [{k: (n[p, 1][k], n[p, 0][k]) for k in n[p, 0] | n[p, 1] if n[p, 1][k] + n[p, 0][k] > 1} for p in (False, True)]

    def score(table, lean):
        t, c = {k: x[0] for k, x in table.items()}, {k: x[1] for k, x in table.items()}
        total = sum(t.values()) + sum(c.values())
        share = {k: (t[k] + c[k]) / total for k in table}
        return _odds(t, c, {k: 2000 * share[k] * lean(k) for k in table}, {k: 2000 * share[k] / lean(k) for k in table})

    prefixes = score(both[1], lambda k: 1.0)
    words = score(both[0], lambda k: math.exp(prefixes.get(k[:5], 0.0) / 2))
    of = lambda w: words.get(w, prefixes.get(w[:5], 0.0)) - 0.5
    clean = {k: c for k, (_, c) in both[0].items()}
    q = {k: c / sum(clean.values()) for k, c in clean.items()}
    lo, hi = 1e-3, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if math.fsum(x * math.exp(mid * (words[k] - 0.5)) for k, x in q.items()) > 1 else (mid, hi)
    rate = min(lo, 2.0)
    segments = {}
    for i, d in docs.items():
        x = [of(w) for w in d]
        segments[i] = [sum(x[a:b]) for a, b in maximal(x)]
    chance = [max(1, len(docs[i])) * math.exp(-rate * max(segments[i], default=0.0)) for i, y in train if not y]
    log_k = math.log(len(chance) / max(math.fsum(chance), 1e-9))

    def statistic(i):
        size = log_k + math.log(max(1, len(docs[i])))
        best = max(segments[i], default=0.0)
        return rate * best - size + sum(max(0.0, rate * x - size) for x in segments[i] if x < best and math.exp(min(50.0, size - rate * x)) < 0.05)

    x, y = np.arcsinh([statistic(i) for i, _ in train]), np.array([float(t > 0) for _, t in train])
    slope, offset = _logistic(x, y)
    return {i: 1 / (1 + math.exp(-min(50.0, max(-50.0, slope * math.asinh(statistic(i)) + offset)))) for i in docs}


def _logistic(x, y):
    """Slope and offset of least penalised cross-entropy against smoothed targets, by gradient descent with momentum."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target, scale = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), x.std() or 1.0
    z = (x - x.mean()) / scale
    b, v = np.zeros(2), np.zeros(2)
    for _ in range(400_000):
        p = 1 / (1 + np.exp(-(b[0] * z + b[1])))
        g = np.array([((p - target) * z).sum(), (p - target).sum()]) + 1e-4 * b
        v = 0.9 * v - 0.4 / len(x) * g
        b = b + v
        if abs(g).max() < 1e-10:
            break
    return b[0] / scale, b[1] - b[0] * x.mean() / scale


# --- op10 -----------------------------------------------------------------------------------------------------------------


def best_path(emissions, transitions):
    """The tags of the highest sum, by trying all; emissions (place, tag), transitions (tag or begin, tag)."""
    n, tags = emissions.shape
    best = (-math.inf, ())
    stack = [((), 0.0)]
    while stack:
        path, x = stack.pop()
        if len(path) == n:
            best = max(best, (x, path))
            continue
        before = path[-1] if path else tags
        stack += [((*path, t), x + transitions[before, t] + emissions[len(path), t]) for t in range(tags)]
    return best


# --- op11 -----------------------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def run_buckets(text, n, buckets):
    w = [x.encode() for x in words_of(text)]
    return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, n=1, buckets=10_000, least_words=20, percent=10, seed=2024):
    """[id, words, features, weight, score, rank] of (id, text) rows, in their order."""
    import hashlib

    found = [run_buckets(t, n, buckets) for _, t in rows]
    raw, wanted = Counter(b for f in found for b in f), Counter(b for t in target for b in run_buckets(t, n, buckets))
    s, t = raw.total(), wanted.total()
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in raw}
    out = []
    for (i, text), f in zip(rows, found):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, -r[3], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return out


# --- op13 -----------------------------------------------------------------------------------------------------------------


def vector_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """({row index: (code, error)}, codebooks) of (id, vector, label) rows, in Python's integers."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    width = -(-max((len(r[1]) for _, r in kept), default=0) // parts) * parts
    most = math.isqrt((2**63 - 1) // max(1, width)) // 2
    ints = {i: [max(-most, min(most, math.floor(scale * c))) for c in r[1]] for i, r in kept}
    order = sorted(kept, key=lambda x: (x[1][0] is None, x[1][0] or 0, [math.floor(scale * c) for c in x[1][1]]))
    ints = {i: x + [0] * (width - len(x)) for i, x in ints.items()}
    w = width // parts
    books = [[ints[i][p * w : (p + 1) * w] for i, _ in order[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for x in ints.values():
                x = x[p * w : (p + 1) * w]
                met[nearest(books[p], x)[1]].append(x)
            books[p] = [[sum(c) // len(met[k]) for c in zip(*met[k])] if k in met else e for k, e in enumerate(books[p])]
    out = {}
    for i, x in ints.items():
        found = [nearest(books[p], x[p * w : (p + 1) * w]) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)
    return out, books
