"""What consumers call: digest, get, acknowledge, status. Texts are fitted to a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions import lines as L
from tidemark.functions.text import minute, quoted
from tidemark.operators import log, score
from tidemark.plans.model import NAME, PRIORITY_WEIGHTS, SCHEME, SERVED, SOURCE_ID
from tidemark.plans.scratch import scope, settled
from tidemark.plans.store import Commit, Conflict, Store, stamp, unstamp

# The sentences of the responses.
SAYS = {
    "note_foot": "after handling: ack(cursor={0})",
    "filtered": "filtered view: take the digest without source before ack",
    "nothing": "no new events after cursor {0}",
    "stale": "warning: daemon heartbeat stale ({0} ago; shortest schedule {1}); data may be stale",
    "expired": "warning: events {0}-{1} expired (retention) before this agent read them",
    "no_source": "error: unknown source {0}",
    "no_handle": "error: unknown handle {0}; expected {1}://evt/<seq>, {1}://rec/<source_id>/<key> or {1}://batch/<from>-<to>?source=<id>",
    "no_event": "error: event {0} not found (expired or never existed)",
    "no_record": "error: record not found",
    "no_agent": "error: invalid agent_id {0}; use letters, digits, _ . -",
    "behind": "error: cursor {0} is behind current cursor {1} for agent={2}",
    "beyond": "error: cursor {0} is beyond the latest event {1}",
    "moved": "ok: agent={0} cursor {1} -> {2}",
    "recovered": "recovered; error from {0}: {1}",
    "selectors": "selectors matching 0 elements:",
    "truncated": "truncated: {0} more {1}",
    "no_daemon": "daemon not running (no heartbeat)",
    "daemon_stale": "daemon heartbeat stale ({0} ago; shortest schedule {1})",
    "daemon": "daemon heartbeat {0} ago",
    "in_error": "error from {0}; latest {1}: {2}",
    "never_tried": "never collected",
    "never_worked": "never succeeded",
    "dropped": "not in config",
}

LEAST_BUDGET, DEFAULT_BUDGET = 200, 800
#: Generations of the served log beyond which a response compacts them, where no daemon does.
MOST_SERVED = 128
#: Shortest event line with its line end: bounds how many lines a budget can hold.
LEAST_LINE = 20
_AGENT = re.compile(r"[A-Za-z0-9_.-]{1,64}")
_SOURCE = SOURCE_ID


def estimate(text: str) -> int:
    return (2 * len(text) + 6) // 7


def age_text(seconds: float) -> str:
    s = max(0, int(seconds))
    for most, unit, size in ((60, "s", 1), (3600, "m", 60), (48 * 3600, "h", 3600)):
        if s < most:
            return f"{s // size}{unit}"
    return f"{s // 86400}d"


@dataclass(frozen=True)
class Handle:
    """evt (seq), rec (source, key) or batch (lo, hi, source, after)."""

    kind: str
    seq: int = 0
    source: str | None = None
    key: str | None = None
    lo: int = 0
    hi: int = 0
    after: int | None = None

    def __str__(self) -> str:
        if self.kind == "evt":
            return f"{SCHEME}://evt/{self.seq}"
        if self.kind == "rec":
            return f"{SCHEME}://rec/{self.source}/{quote(self.key, safe='/|')}"
        query = [f"source={self.source}"] * (self.source is not None) + [f"after={self.after}"] * (self.after is not None)
        return f"{SCHEME}://batch/{self.lo}-{self.hi}" + ("?" + "&".join(query) if query else "")


def parse_handle(text: str) -> Handle | None:
    """Strict: whole positive numbers without leading zeros, each parameter once."""
    n = r"([1-9][0-9]{0,18})"
    if m := re.fullmatch(rf"{SCHEME}://evt/{n}", text):
        return Handle("evt", int(m[1])) if int(m[1]) < 1 << 63 else None
    if m := re.fullmatch(rf"{SCHEME}://rec/({_SOURCE})/(.+)", text, re.S):
        try:
            return Handle("rec", source=m[1], key=unquote(m[2], errors="strict"))
        except UnicodeDecodeError:
            return None
    if m := re.fullmatch(rf"{SCHEME}://batch/{n}-{n}(?:\?(.*))?", text, re.S):
        lo, hi, params = int(m[1]), int(m[2]), [p.partition("=") for p in m[3].split("&")] if m[3] else []
        got = {k: v for k, _, v in params}
        if lo > hi or hi >= 1 << 63 or len(got) != len(params) or set(got) - {"source", "after"}:
            return None
        if "source" in got and not re.fullmatch(_SOURCE, got["source"]) or "after" in got and not re.fullmatch(n, got["after"]):
            return None
        return Handle("batch", source=got.get("source"), lo=lo, hi=hi, after=int(got["after"]) if "after" in got else None)
    return None


def longest_fit(count: int, text: Callable[[int], str], budget: int, least: int = 0) -> int:
    """The largest k of at most ``count`` whose text fits; sizes are not monotone, so larger ones are tried first."""
    return next((k for k in range(count, least, -1) if estimate(text(k)) <= budget), least)


class Digest:
    """A selection of events, ranked on the cluster; only the lines that a budget can hold and a row per source come to the driver."""

    def __init__(self, events: DataFrame, sources: dict[str, dict], budget: int):
        spark = events.sparkSession
        rows = [(s, r.get("priority"), r.get("key_label", "")) for s, r in sources.items()]
        dim = F.broadcast(spark.createDataFrame(rows, "source_id string, priority string, key_label string"))  # a row for each configured source
        met = events.join(dim, "source_id", "left")
        weight = F.when(F.col("priority").isNotNull(), score.priority_weight(F.coalesce("priority", F.lit("low"))))
        met = log.effective_importance(met, F.col("priority"), weight, score.kind_weight(F.col("kind")))
        met = settled(met, "digest")
        cap = budget * 7 // 2 // LEAST_LINE + 1
        top = met.orderBy(F.desc("effective"), "seq").limit(cap)
        self.lines: list[Row] = top.select("seq", "source_id", "effective", L.line(F.coalesce("key_label", F.lit("")), F.col("resolved")).alias("line")).orderBy(F.desc("effective"), "seq").collect()
        totals = met.groupBy("source_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
        below = met.join(top.select("seq"), "seq", "left_anti").groupBy("source_id").agg(F.max("effective").alias("rest"))
        self.totals = {r.source_id: r for r in totals.join(below, "source_id", "left").collect()}  # a row for each source with events
        self.count = sum(r.n for r in self.totals.values())
        self.first, self.last = min((r["first"] for r in self.totals.values()), default=0), max((r["last"] for r in self.totals.values()), default=0)
        self.sources, self.budget = sources, budget

    def text(self, k: int, agent: str, source: str | None, warnings: list[str]) -> str:
        shown: dict[str, list[Row]] = {}
        for r in self.lines[:k]:
            shown.setdefault(r.source_id, []).append(r)
        worst = {s: r.rest for s, r in self.totals.items() if r.rest is not None}
        for r in self.lines[k:]:
            worst[r.source_id] = max(worst.get(r.source_id, r.effective), r.effective)
        head = [f"{NAME} · agent={agent}", *([f"source={source}"] if source else []), f"events {self.first}-{self.last} ({self.count})" + (f", showing {k}" if k < self.count else ""), f"budget {self.budget}"]
        out = [" · ".join(head if source else [*head, f"next_cursor={self.last}"]), *warnings, L.NOTE]
        for s in sorted(shown, key=lambda s: (-shown[s][0].effective, s)):
            n, got = self.totals[s].n, len(shown[s])
            out.append(f"[{(self.sources.get(s) or {}).get('priority', '?')}] {s} ({n if got == n else f'{n}, showing {got}'})")
            out += [r.line for r in shown[s]]
        for s in sorted(worst, key=lambda s: (-worst[s], s)):
            out.append(f"omitted: {s} {self.totals[s].n - len(shown.get(s, []))} {Handle('batch', source=s, lo=self.first, hi=self.last)}")
        out.append(SAYS["filtered"] if source else SAYS["note_foot"].format(self.last))
        return "\n".join(out)


class Service:
    def __init__(self, store: Store, now: Callable[[], datetime], via: str = "api"):
        self.store, self.now, self.via = store, now, via

    def digest(self, agent: str = "default", budget: int = DEFAULT_BUDGET, source: str | None = None) -> str:
        """A ranked digest of everything past the agent's cursor; the cursor does not move."""
        return self._logged(agent, "digest", {"budget": budget, "source": source}, lambda: self._digest(agent, max(LEAST_BUDGET, budget), source))

    def _digest(self, agent: str, budget: int, source: str | None) -> str:
        m = self.store.manifest()
        if source is not None and source not in m.sources:
            return SAYS["no_source"].format(_q(source))
        cursor = m.cursors.get(agent, {}).get("seq", 0)
        warnings = self._warnings(m, cursor)
        with scope(self.store.spark):
            d = Digest(log.after(self.store.read("events", m, source, cursor + 1), cursor, source), m.sources, budget)
        if not d.count:
            floor = max(cursor, m.pruned_through)
            head = f"{NAME} · agent={agent}" + (f" · source={source}" if source else "") + " · " + SAYS["nothing"].format(cursor)
            foot = [SAYS["note_foot"].format(floor)] if floor > cursor and not source else []
            return "\n".join([head + ("" if source else f" · next_cursor={floor}"), *warnings, *foot])
        text = lambda k: d.text(k, agent, source, warnings)
        return text(longest_fit(len(d.lines), text, budget))

    def _warnings(self, m, cursor: int) -> list[str]:
        out, (beat, age, shortest) = [], self._heartbeat(m)
        if beat and shortest is not None and age > 2 * shortest:
            out.append(SAYS["stale"].format(age_text(age), age_text(shortest)))
        if cursor < m.pruned_through:
            out.append(SAYS["expired"].format(cursor + 1, m.pruned_through))
        return out

    def _heartbeat(self, m) -> tuple[bool, float, int | None]:
        at = unstamp(m.meta.get("heartbeat"))
        schedules = [r["schedule"] for r in m.sources.values() if r.get("configured") and r.get("schedule")]
        return at is not None, (self.now() - at).total_seconds() if at else 0.0, min(schedules, default=None)

    def get(self, handle: str, agent: str = "default", budget: int = DEFAULT_BUDGET) -> str:
        return self._logged(agent, "get", {"handle": handle, "budget": budget}, lambda: self._get(handle.strip(), max(LEAST_BUDGET, budget)))

    def _get(self, text: str, budget: int) -> str:
        h = parse_handle(text)
        if h is None:
            return SAYS["no_handle"].format(_q(text), SCHEME)
        return {"evt": self._event, "rec": self._record, "batch": self._batch}[h.kind](h, budget)

    def _event(self, h: Handle, budget: int) -> str:
        m = self.store.manifest()
        found = self.store.read("events", m, None, h.seq, h.seq).where(F.col("seq") == h.seq)
        added = F.col("kind") == "added"
        long = lambda c: c["added_chars"].isNotNull() | c["removed_chars"].isNotNull()
        each = lambda c: F.when(added & ~long(c), F.concat(c["field"], F.lit(": "), quoted(c["new"]["v"], L.VIEW_CAP))).otherwise(L.change_text(c, added, L.VIEW_CAP))
        source = m.sources
        cols = found.select(
            "source_id", "kind", "record_key", "importance", minute(F.col("created_at")).alias("at"), "detail",
            F.transform("field_changes", each).alias("changes"),
            L.record_label(F.lit(""), L.VIEW_CAP, L.VIEW_CAP).alias("label"), quoted(F.col("detail.error"), L.VIEW_CAP).alias("error"), quoted(F.col("detail.last_error"), L.VIEW_CAP).alias("last_error"),
            quoted(F.col("detail.hint"), L.VIEW_CAP).alias("hint"), minute(F.col("detail.error_from")).alias("began"), F.transform("detail.selectors", lambda s: quoted(s, L.VIEW_CAP)).alias("selectors"),
        ).limit(1).collect()
        if not cols:
            return SAYS["no_event"].format(h.seq)
        r = cols[0]
        head = [f"{h} · {r.source_id} · {r.kind} · importance {r.importance} · {r['at'] or 'unknown'}", L.NOTE]
        if r.kind in ("added", "modified", "removed"):
            name = (source.get(r.source_id) or {}).get("key_label") or ""
            titled = bool(r.detail and r.detail.title)
            label = r.label if titled or not name else f"{name} {r.label}"
            body = [f"record: {label}{' (removed)' if r.kind == 'removed' else ''}  {Handle('rec', source=r.source_id, key=r.record_key)}", *r.changes]
        elif r.kind == "baseline":
            n = r.detail.record_count or 0
            body = [f"baseline: {n} record{'' if n == 1 else 's'}"]
        elif r.kind == "source_error":
            body = [f"error: {r.error}" + (L.NEEDS_A_HUMAN + r.hint[1:-1] if r.detail.hint else "")]
        elif r.kind == "source_recovered":
            body = [SAYS["recovered"].format(r.began or "unknown", r.last_error)]
        else:
            body = [SAYS["selectors"], *r.selectors] if r.selectors else [L.LAYOUT_CHANGED]
        return _prefix(head, body, budget, "change")

    def _record(self, h: Handle, budget: int) -> str:
        pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit(": "), quoted(e["value"]["v"], L.VIEW_CAP)))
        rows = self.store.read("records", None, h.source, h.key, h.key).where((F.col("source_id") == h.source) & (F.col("key") == h.key)).select("present", minute(F.col("updated_at")).alias("at"), pairs.alias("body")).limit(1).collect()
        if not rows:
            return SAYS["no_record"]
        r = rows[0]
        return _prefix([f"{h} · {h.source} · {'present' if r.present else 'removed'} · updated {r['at'] or 'unknown'}", L.NOTE], r.body, budget, "field")

    def _batch(self, h: Handle, budget: int) -> str:
        m = self.store.manifest()
        if h.source is not None and h.source not in m.sources:
            return SAYS["no_source"].format(_q(h.source))
        base = Handle("batch", source=h.source, lo=h.lo, hi=h.hi)
        events = self.store.read("events", m, h.source, h.lo, h.hi)
        total = log.in_range(events, h.lo, h.hi, h.source).count()
        if not total:
            return f"{base} · 0 events"
        dim = F.broadcast(self.store.spark.createDataFrame([(s, r.get("key_label", "")) for s, r in m.sources.items()], "source_id string, key_label string"))  # a row for each configured source
        page = log.in_range(events, h.lo, h.hi, h.source, h.after).join(dim, "source_id", "left")
        cap = budget * 7 // 2 // LEAST_LINE + 2
        rows = page.orderBy("seq").limit(cap).select("seq", L.line(F.coalesce("key_label", F.lit(""))).alias("line")).orderBy("seq").collect()
        if not rows:
            return f"{base} · {total} events · showing none"
        left = page.count()

        def text(k: int) -> str:
            out = [f"{base} · {total} events · showing {rows[0].seq}-{rows[k - 1].seq}", L.NOTE, *(r.line for r in rows[:k])]
            if k < left:
                out.append(f"more: {Handle('batch', source=h.source, lo=h.lo, hi=h.hi, after=rows[k - 1].seq)}")
            return "\n".join(out)

        return text(longest_fit(len(rows), text, budget, 1))

    def ack(self, agent: str, cursor: int) -> str:
        """Moves the agent's cursor forward, to at most the highest number ever given."""
        if not _AGENT.fullmatch(agent):
            return SAYS["no_agent"].format(_q(agent))

        def change(commit: Commit) -> str:
            m = commit.manifest
            current = m.cursors.get(agent, {}).get("seq", 0)
            if cursor < current:
                return SAYS["behind"].format(cursor, current, agent)
            if cursor > m.max_seq:
                return SAYS["beyond"].format(cursor, m.max_seq)
            if cursor != current:
                m.cursors[agent] = {"seq": cursor, "updated_at": stamp(self.now())}
            return SAYS["moved"].format(agent, current, cursor)

        return self.store.update(change)

    def status(self) -> str:
        m = self.store.manifest()
        beat, age, shortest = self._heartbeat(m)
        if not beat:
            daemon = SAYS["no_daemon"]
        elif shortest is not None and age > 2 * shortest:
            daemon = SAYS["daemon_stale"].format(age_text(age), age_text(shortest))
        else:
            daemon = SAYS["daemon"].format(age_text(age))
        order = list(PRIORITY_WEIGHTS)
        rows = sorted(m.sources.items(), key=lambda x: (order.index(x[1]["priority"]) if x[1]["priority"] in order else len(order), x[0]))
        return "\n".join([f"{NAME} status · {daemon}", L.NOTE, *(self._status_line(s, r) for s, r in rows)])

    @staticmethod
    def _status_line(source: str, r: dict) -> str:
        at = lambda k: unstamp(r[k]).strftime("%Y-%m-%dT%H:%MZ") if r.get(k) else "unknown"
        parts = [f"[{r['priority']}] {source} ({r['type']})"]
        if not r.get("last_success_at") and not r.get("last_error_at"):
            parts.append(SAYS["never_tried"])
        else:
            parts += [f"records {r.get('record_count', 0)}", f"last success {at('last_success_at')}" if r.get("last_success_at") else SAYS["never_worked"]]
            parts.append(SAYS["in_error"].format(at("error_from"), at("last_error_at"), _q(r.get("last_error"))) if r.get("in_error") else "ok")
        return " · ".join(parts if r.get("configured", True) else [*parts, SAYS["dropped"]])

    def _logged(self, agent: str, tool: str, args: dict, make: Callable[[], str]) -> str:
        """The exact text, appended to the served log with the arguments as requested."""
        text = make() if _AGENT.fullmatch(agent) else SAYS["no_agent"].format(_q(agent))

        def change(commit: Commit) -> None:
            n = commit.manifest.next_served
            row = (n, agent, tool, {k: str(v) for k, v in args.items() if v is not None}, text, self.via, self.now())
            commit.manifest.next_served += 1
            commit.append("served", self.store.spark.createDataFrame([row], SERVED), known=(n, n, 1, self.now()))

        self.store.update(change)
        if len(self.store.manifest().tables["served"]) > MOST_SERVED:
            try:
                self.store.compact()
            except Conflict:  # someone else does
                pass
        return text

    def consumers(self) -> DataFrame:
        m = self.store.manifest()
        rows = [(a, c["seq"], unstamp(c["updated_at"])) for a, c in m.cursors.items()]
        return log.consumers(self.store.spark.createDataFrame(rows, "agent_id string, seq long, updated_at timestamp"), self.store.read("served", m).select("agent_id", "at"))


def _q(value: object, cap: int = L.LINE_CAP) -> str:
    """A value on one line in quotes, on the driver."""
    if value is None:
        return "null"
    import unicodedata

    flat = " ".join("".join(" " if unicodedata.category(c) in ("Cc", "Cf", "Zl", "Zp", "Co", "Cs") else c for c in str(value)).split())
    flat = flat if len(flat) <= cap else flat[: cap - 1] + "…"
    return '"' + flat.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _prefix(head: list[str], body: list[str], budget: int, what: str) -> str:
    def text(k: int) -> str:
        rest = len(body) - k
        return "\n".join([*head, *body[:k], *([SAYS["truncated"].format(rest, what + "s" * (rest != 1))] if rest else [])])

    return text(longest_fit(len(body), text, budget))
