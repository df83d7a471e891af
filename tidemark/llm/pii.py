"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, forgetting, slices, texts

# The kinds in their order, and the pattern of each.
KINDS = ("email", "ip", "card", "phone")
#: Those, and what only the field finds: keys and passwords.
ALL_KINDS = (*KINDS, "secret")
# Possessive and look-behind forms of the given patterns: the same leftmost matches, found in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches that pass their kind's test, in order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = _digits(m.group()) if 14 <= m.end() - m.start() <= 37 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# The labelled table. [kind text] marks a span; everything else is outside. Values are invented.
LABELLED = (
    "write to [email ann.lee@example.org] today",
    "mail [email bo_22@post.example.net] or call",
    "contact: [email sales+eu@shop-7.example.com].",
    "<[email x9@example.com]> wrote",
    "reply [email j.doe@intranet] soon",
    "ask [email root@localhost] about it",
    '{"user":"[email kai7@lists.example.org]","age":31}',
    "id;[email mona@buero];12;yes",
    "call [phone +1 (415) 555-0134] now",
    "phone [phone +44 20 7946 0958] please",
    "tel. [phone +49-30-555-0199], office",
    "fax [phone +33.1.55.50.01.23] only",
    "call [phone (415) 555-0187] now",
    "or [phone (212) 555-0100] after five",
    "ring [phone 415-555-0123] later",
    "dial [phone 020-7946-0321] first",
    "phone: [phone 415.555.0188]",
    "mobile [phone 07700 900123] any time",
    "tel [phone 030 5550 1234] berlin",
    "call [phone 4155550142] today",
    '{"phone":"[phone 212-555-0177]","n":2}',
    "host [ip 10.0.0.17] is down",
    "from [ip 192.168.1.254] to [ip 172.16.0.9]",
    "server [ip 203.0.113.5:8080] answered",
    "ping [ip 198.51.100.23/24] failed",
    '"ip":"[ip 203.0.113.77]","ok":1',
    "http://[ip 198.51.100.8:9000]/a read",
    "card [card 4111 1111 1111 1111] expired",
    "paid with [card 4012888888881881] yesterday",
    "number [card 5555-5555-5555-4444] is",
    "card [card 4222.2222.2222.2222] was",
    "amex [card 3782 822463 10005] used",
    "visa [card 4111.1111.1111.1111] kept",
    "card no. [card 4539 1488 0343 6468] on file",
    "key [secret QZVMTRWBKXNP7HLDSJGC] leaked",
    "password=[secret 53ab19cc02de87f1a2] set",
    'token = "[secret 07fe55b0c1a9d3aa20]" here',
    'token = "[secret b3d1f09a77c2e8450d1a6bb39e20cc41]" there',
    "api_key: [secret sk_demo_7hR21MqZtxLVaWbnU3fkq9gv]",
    "secret=[secret ZmFrZS1rZXktMTIzNDU2Nzg5MA]",
    "password: [secret hunter2x9] for all",
    "export TOKEN=[secret pat_27D8f53G303d7023F8821d949458Bf289C5b]",
    "in 1998 there were 12 of them",
    "version 2.0.1 of 2021 has 300 pages",
    "release 10.2.1.5 notes, section 4.1.2.3 and 1.2.3.4",
    "chapter 12 section 3.4 page 77",
    "cost 1,250.00 in total for 25 items",
    "sha 9f86d081884c7d659a2feaa0c55ad015 ok",
    "commit 7c211433f02071597741e6ff5a8ea34789abbf43 merged",
    "md5 d41d8cd98f00b204e9800998ecf8427e of the file",
    "on 2024-01-31 at 10:45:00 sharp",
    "from 01/02/2023 until 28.02.2024 open",
    "order 000123456 of lot 9988 shipped",
    "order 4415550142 and item 9807915762804490 left",
    "ticket 20240131 0012 of batch 5550 1234 closed",
    "see @home and @work for 3 days",
    "thanks @ann_lee22 and @bo for it",
    "it rose 3.5% to 120.75 in 2020",
    "room 101 floor 7 building 12b",
    "isbn 978-3-16-148410-0 listed",
    "issn 2049-3630 and part 415-555",
    "h2o and co2 at 37c in b12",
    "range 10-20 or 1000-2000 units",
    "the 2nd and 3rd of 1st",
    "id 550e8400-e29b-41d4-a716-446655440000 used",
    "rows 3 4 5 6 7 of it",
    "years 1999 2000 2001 listed",
    "scores 7 12 9 in games",
    "lines 1 2 3 and 10 11 12",
    "between 1914 1918 it was",
    "a1b2 c3d4 e5f6 seats",
    "key 3 of 12 and token 7 of 9",
    "password of 12 characters, secret no. 4",
    "call 2 of 3 or phone 12 people",
)

# Words that announce a kind.
LEADS = {
    "email": "mail email e-mail contact write reply ask user from to",
    "ip": "ip host server ping address http https from to",
    "card": "card visa amex paid number mastercard",
    "phone": "call phone tel fax ring dial mobile cell telephone",
    "secret": "key password token secret api_key apikey passwd pwd",
}
_LEADS = {w: kind for kind, words in LEADS.items() for w in words.split()}

TAGS = ("O", *(f"{p}-{k}" for k in ALL_KINDS for p in "BI"))
_OUTSIDE, _N = 0, len(TAGS)
_TRIM = ".,;:!?\"'<>[]{}"
_ALPHA = re.compile(r"[^\W\d_]")
_LEAD = re.compile(r"([A-Za-z_-]+)[\s.:=/\"'(<\[{|]*\Z")
#: Characters before a run in which its announcing word is sought.
_BEFORE = 32


def _features(token: str) -> tuple[str, ...]:
    """Shape features of a whole token, however long; the last is its class, all that its neighbours see."""
    core = token.strip(_TRIM)
    if not _MARK.search(core):
        return ("plain",)
    shape = _ALPHA.sub("a", _DIGIT.sub("9", core))
    short = re.sub(r"(.)\1+", r"\1", shape)
    n, dots = shape.count("9"), core.count(".")
    kind = "@" if "@" in core else "a9" if "a" in short else f"9:{min(n, 17)}" if short == "9" else short if len(short) < 8 else "mixed"
    return (
        "shape=" + short[:16],
        "long=" + shape[:20],
        f"digits={min(n, 20)}",
        f"dots={min(dots, 4)}",
        f"dashes={min(core.count('-'), 4)}",
        f"length={min(len(core) // 8, 6)}",
        "first=" + shape[:1],
        "alpha" if "a" in shape else "no-alpha",
        "turns" if "a" in shape and len(short) >= 6 else "no-turns",
        "bracket" if core[:1] == "(" or core[-1:] == ")" else "no-bracket",
        "named" if re.fullmatch(r"[^@]+@[a9_.-]+", shape) else "not-named",
        "quad" if re.match(r"(9{1,3}\.){3}9{1,3}([^9.]|$)", shape) else "no-quad",
        kind,
    )


_known = Memo(_features)


def remembered() -> Memo:
    """The worker's features of tokens."""
    return _known


def features(token: str) -> tuple[str, ...]:
    return _known[token]


def annotated(line: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of a labelled table as plain text and spans (start, kind, end)."""
    text, spans, at = "", [], 0
    for m in re.finditer(rf"\[({'|'.join(ALL_KINDS)}) ([^\]]*)\]", line):
        text += line[at : m.start()]
        spans.append((len(text), ALL_KINDS.index(m[1]), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


def _tagged(text: str, spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """The tags of each run of a labelled text: a token belongs to the span that its trimmed core lies in."""
    out = []
    for run in marked_runs(text):
        tags = []
        for a, b in run:
            core = text[a:b].strip(_TRIM)
            start = text.index(core, a)
            of = next(((s, k) for s, k, e in spans if s < start + len(core) and start < e), None)
            tags.append(_OUTSIDE if of is None else 1 + 2 * of[1] + (of[0] < start))
        out.append(tags)
    return out


class Crf:
    """Emissions from a token's features, its neighbours' classes and the word before its run, and transitions between tags.

    A token without a digit or an at sign is outside by constraint, so it parts a text into
    independent runs: decoding the runs alone is decoding the whole text.
    """

    def __init__(self, table: tuple[str, ...] = LABELLED, steps: int = 300, rate: float = 0.1, decay: float = 0.01):
        rows = [annotated(line) for line in table]
        runs = [(obs, tags) for text, spans in rows for obs, tags in zip(observations(text), _tagged(text, spans))]
        names = sorted({f for obs, _ in runs for o in obs for f in o})
        self.at = {f: i for i, f in enumerate(names)}
        self.w, self.t = np.zeros((len(names), _N)), np.zeros((_N + 1, _N))  # the last row of t begins a run
        self.allowed = np.array([[not (b and b % 2 == 0 and a not in (b - 1, b)) for b in range(_N)] for a in [*range(_N), _OUTSIDE]])
        self._train(runs, steps, rate, decay)

    def _batch(self, runs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions (run, place, tag), and which places there are."""
        longest = max(map(len, runs))
        e, there = np.zeros((len(runs), longest, _N)), np.zeros((len(runs), longest), bool)
        for r, obs in enumerate(runs):
            for i, o in enumerate(obs):
                e[r, i], there[r, i] = self.w[[self.at[f] for f in o if f in self.at]].sum(axis=0), True
        return e, there

    def _forward_backward(self, runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, forward and backward sums of each place of each run, and the log of each run's partition function."""
        t = np.where(self.allowed, self.t, -1e9)
        e, there = self._batch([o for o, _ in runs])
        n, longest = there.shape
        alpha, beta = np.full((n, longest, _N), -1e9), np.zeros((n, longest, _N))
        alpha[:, 0] = t[_N] + e[:, 0]
        for i in range(1, longest):
            alpha[:, i] = np.where(there[:, i, None], _logsum(alpha[:, i - 1, :, None] + t[None, :_N], 1) + e[:, i], alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            beta[:, i] = np.where(there[:, i + 1, None], _logsum(t[None, :_N] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        return e, alpha, beta, _logsum(alpha[:, -1], 1)

    def likelihood(self, runs) -> float:
        """Log-likelihood of tagged runs."""
        e, _, _, z = self._forward_backward(runs)
        of = lambda r, tags: sum(e[r, i, x] + self.t[tags[i - 1] if i else _N, x] for i, x in enumerate(tags))
        return float(sum(of(r, tags) - z[r] for r, (_, tags) in enumerate(runs)))

    def gradient(self, runs) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the likelihood in feature weights and transitions: what is seen less what is expected."""
        t = np.where(self.allowed, self.t, -1e9)
        e, alpha, beta, z = self._forward_backward(runs)
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for r, (obs, tags) in enumerate(runs):
            for i, o in enumerate(obs):
                grad = -np.exp(alpha[r, i] + beta[r, i] - z[r])
                grad[tags[i]] += 1
                np.add.at(gw, [self.at[f] for f in o if f in self.at], grad)
                gt[tags[i - 1] if i else _N, tags[i]] += 1
                if i:
                    gt[:_N] -= np.exp(alpha[r, i - 1][:, None] + t[:_N] + (e[r, i] + beta[r, i])[None] - z[r])
                else:
                    gt[_N] -= np.exp(t[_N] + e[r, 0] + beta[r, 0] - z[r])
        return gw, gt

    def _train(self, runs, steps: int, rate: float, decay: float) -> None:
        """Maximum likelihood by Adam, over the whole table at once."""
        held = [self.w, self.t]
        m, v = [np.zeros_like(x) for x in held], [np.zeros_like(x) for x in held]
        for step in range(1, steps + 1):
            for j, (x, g) in enumerate(zip(held, self.gradient(runs))):
                g = g - decay * x
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                x += rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
        self.t = np.where(self.allowed, self.t, -1e9)

    def decode(self, runs: list[list[list[str]]], batch: int = 2048) -> list[list[int]]:
        """The best tags of each run, by Viterbi over batches of runs of like length."""
        out: list[list[int]] = [[]] * len(runs)
        order = sorted(range(len(runs)), key=lambda r: len(runs[r]))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            e, there = self._batch([runs[r] for r in part])
            n, longest = there.shape
            best, back = self.t[_N] + e[:, 0], np.zeros((longest, n, _N), np.int8)
            for i in range(1, longest):
                step = best[:, :, None] + self.t[None, :_N]
                back[i] = np.where(there[:, i, None], step.argmax(axis=1), np.arange(_N))
                best = np.where(there[:, i, None], step.max(axis=1) + e[:, i], best)
            tag = best.argmax(axis=1)
            path = np.zeros((longest, n), np.int8)
            for i in range(longest - 1, -1, -1):
                path[i] = tag
                tag = back[i][np.arange(n), tag]
            for j, r in enumerate(part):
                out[r] = path[: len(runs[r]), j].tolist()
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@functools.lru_cache(maxsize=1)
def trained() -> Crf:
    """The field trained on LABELLED, the same in every process."""
    return Crf()


_SPACE = " \t\n\r\x0b\x0c"
# What parts tokens beside white space, as in JSON, CSV, markup and assignments.
_PARTS = "\"'<>{}[]|;=,"
_TOKEN = re.compile(f"[^{re.escape(_SPACE + _PARTS)}]+")
_APART = frozenset(_SPACE + _PARTS)


def marked_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens that hold a digit or an at sign, with only white space between them, as spans; in linear time."""
    runs: list[list[tuple[int, int]]] = []
    at, end = 0, -1
    while m := _MARK.search(text, at):
        start = m.start()
        while start > max(end, 0) and text[start - 1] not in _APART:
            start -= 1
        stop = _TOKEN.match(text, m.start()).end()
        if features(text[start:stop])[-1] != "plain":
            if runs and end >= 0 and runs[-1][-1][1] == end and not text[end:start].strip(_SPACE):
                runs[-1].append((start, stop))
            else:
                runs.append([(start, stop)])
        at = end = stop
    return runs


def observations(text: str) -> list[list[list[str]]]:
    """The features of each token of each run."""
    out = []
    for run in marked_runs(text):
        got = [features(text[a:b]) for a, b in run]
        m = _LEAD.search(text[max(0, run[0][0] - _BEFORE) : run[0][0]])
        lead = "lead=" + (_LEADS.get(m[1].lower(), "other") if m else "none")
        side = ["plain", *(f[-1] for f in got), "plain"]
        out.append([[*f, "before=" + side[i], "after=" + side[i + 2], lead, f"{lead},{f[-1]}", "bias"] for i, f in enumerate(got)])
    return out


def field_spans(batch: list[str], crf: Crf | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the spans that the field finds in each text."""
    crf = crf or trained()
    where, runs = [], []
    for k, text in enumerate(batch):
        if _MARK.search(text):
            where += [(k, run) for run in marked_runs(text)]
            runs += observations(text)
    out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    for (k, run), tags in zip(where, crf.decode(runs) if runs else []):
        i = 0
        while i < len(tags):
            if tags[i] == _OUTSIDE:
                i += 1
                continue
            kind, j = (tags[i] - 1) // 2, i + 1
            while j < len(tags) and tags[j] == 2 + 2 * kind:
                j += 1
            start, end, text = run[i][0], run[j - 1][1], batch[k]
            while start < end and text[start] in _TRIM:
                start += 1
            while end > start and text[end - 1] in _TRIM:
                end -= 1
            out[k].append((start, kind, end))
            i = j
    return out


def _joined(spans) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: Fewest and most digits of an added span, by kind.
PLAUSIBLE = ((0, 256), (4, 17), (13, 19), (7, 15), (1, 256))


def _added(text: str, base: list[tuple[int, int, int]], field: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The field's spans that touch no base span and have a plausible number of digits."""
    fits = lambda a, k, b: PLAUSIBLE[k][0] <= len(_digits(text[a:b])) <= PLAUSIBLE[k][1]
    return [s for s in field if fits(*s) and not any(s[0] < b and a < s[2] for a, _, b in base)]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, has_any boolean"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data and secrets in every whole text.

    Patterns give the base spans, in linear time; the conditional random field, trained on the labelled table of this
    module and decoded by Viterbi in batches, adds the spans it finds that overlap none of them: numbers and
    addresses in other layouts, and keys and passwords that a word announces (kind ``secret``). n_added counts the field's spans, has_any tells whether
    there are any at all. Offsets are code points, end exclusive.

    The field looks at whole tokens of any length, parted by white space and by the quotes, brackets, commas and signs of markup. By
    constraint a token without an ASCII digit or an at sign is outside; an added span whose digits are too many or too few for its kind (PLAUSIBLE) is
    none. Null and empty texts have none; repeated rows are scanned one by one; an empty table gives no rows. A narrow map: no shuffle.
    """

    def run(batches):
        for b in slices(batches):
            got = b.column(1).to_pylist()
            rows = []
            for text, base, field in zip(got, map(base_spans, got), field_spans(got)):
                n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                added = _added(text, base, field)
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added)), len(added), bool(base or added)))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [c.split()[0] for c in SCHEMA.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(forgetting(run, remembered), SCHEMA)
