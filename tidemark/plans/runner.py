"""One collection, end to end: collect outside the commit, then diff, score, append and publish at once."""

from __future__ import annotations

import copy
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.lines import titles
from tidemark.functions.udfs import text_change
from tidemark.operators import log, outcomes, score, snapshot
from tidemark.operators.snapshot import CollectError, LoginRequired
from tidemark.plans import buckets, model
from tidemark.plans.scratch import folder, noted, scope, settled
from tidemark.plans.store import ORDER, TABLES, TIMES, Commit, Store, stamp, unstamp
from tidemark.sources.base import Collected, Collector, Window

MOST_MESSAGE = 500
#: What a collection is settled as.
HASHED = T.StructType([model.RECORDS[f] for f in ("key", "fields", "content_hash")])


@dataclass(frozen=True)
class Result:
    source_id: str
    first_seq: int | None
    last_seq: int | None
    failed: str | None = None
    superseded: bool = False


def register(store: Store, configs: list[model.SourceConfig]) -> None:
    """Writes what the configuration says of each source; collected state stays, and sources that left are marked."""
    known = {c.id for c in configs}

    def change(commit: Commit) -> None:
        for c in configs:
            row = commit.manifest.sources.setdefault(c.id, {})
            row |= {"type": c.type, "priority": c.priority, "key_label": c.key_label, "schedule": c.schedule, "configured": True}
        for name, row in commit.manifest.sources.items():
            row["configured"] = name in known

    store.update(change)


def _state(row: dict) -> outcomes.State:
    return outcomes.State(
        row.get("baselined", False),
        row.get("in_error", False),
        unstamp(row.get("error_from")),
        row.get("announced"),
        tuple(row.get("broken", ())),
        row.get("fingerprint"),
        row.get("last_error"),
        unstamp(row.get("last_error_at")),
        unstamp(row.get("last_success_at")),
    )


def _save(row: dict, s: outcomes.State) -> None:
    row.update({k: stamp(v) if isinstance(v, datetime) else list(v) if isinstance(v, tuple) else v for k, v in asdict(s).items()})


#: Attempts at a commit whose numbers another run took first.
TRIES = 5


def run(store: Store, config: model.SourceConfig, source: Collector, now: datetime, notes: dict[str, str] | None = None) -> Result:
    """Collects and commits, with ``notes`` on the manifest. A failure is an outcome, not an exception; the snapshot is untouched by it."""
    spark, new = store.spark, None
    with scope(spark), buckets.tables(spark):
        try:
            got = source.collect(spark, now)
            new = _collected(store, config, got)
            broken = tuple(got.broken)
            message = f"{len(broken)} selectors match nothing" if broken else None
            outcome = outcomes.Outcome("broken" if broken else "ok", now, message, None, broken, got.fingerprint, 0 if broken else new.rows)
        except LoginRequired as e:
            got, outcome = None, outcomes.Outcome("login", now, _cut(str(e)), e.hint)
        except CollectError as e:
            got, outcome = None, outcomes.Outcome("fail", now, _cut(str(e)))
        except Exception as e:  # a collector's own fault is a failed run as well
            got, outcome = None, outcomes.Outcome("fail", now, _cut(f"{type(e).__name__}: {e}".splitlines()[0]))

        def change(commit: Commit) -> Result:
            out = _commit(commit, config, source, got, new, outcome)
            commit.manifest.meta.update(notes or {})
            return out

        return store.update(change, TRIES)


class New(NamedTuple):
    """What a run collected: (key, fields, content_hash) in ``buckets`` by key, and how many there are."""

    records: DataFrame
    rows: int
    buckets: int


def _collected(store: Store, config: model.SourceConfig, got: Collected) -> New:
    """Settles the records, dealt by key as the stored ones are, and checks them by what is noted on the way."""
    spark, held = store.spark, store.manifest().tables.get("records", [])
    n = max((g.get("buckets") or buckets.count_for(g["rows"]) for g in held if g["source"] == config.id), default=1)
    placed, notes = snapshot.marked(_hashed(got.records).repartition(n, "key"))
    watched, seen = noted(placed, notes)
    path = folder(spark, "collected")
    buckets.write(watched.select("key", "fields", "content_hash"), path, "key", n)
    rows = snapshot.checked(seen())
    new = New(buckets.read(spark, path, HASHED, "key", n), rows, n)
    _check(new.records, got)
    return new


def _commit(commit: Commit, config: model.SourceConfig, source: Collector, got: Collected | None, new: New | None, outcome: outcomes.Outcome) -> Result:
    """A run's events, records and state on top of the newest manifest; all of it again if another run commits first."""
    row = commit.manifest.sources.setdefault(config.id, {"type": config.type, "priority": config.priority, "key_label": config.key_label, "schedule": config.schedule, "configured": True})
    before = _state(row)
    after, told, counts = outcomes.step(before, outcome)
    if not counts:
        commit.manifest.sources = copy.deepcopy(commit.base.sources)
        return Result(config.id, None, None, superseded=True)
    first, now = commit.manifest.next_seq, outcome.at
    _announce(commit, config, told, now)
    if outcome.kind == "ok":
        row["record_count"] = _store(commit, config, source, got, new, before.baselined, now)
    _save(row, after)
    last = commit.manifest.max_seq
    failed = outcome.message if outcome.kind != "ok" else None
    return Result(config.id, first if last >= first else None, last if last >= first else None, failed)


def _check(records: DataFrame, got: Collected) -> None:
    """Raises unless what the collector says beside its records is whole, and what could not be read is no record as well."""
    for what, value in (("broken", got.broken), ("unavailable", [] if isinstance(got.unavailable, DataFrame) else got.unavailable)):
        if isinstance(value, str) or not all(isinstance(x, str) for x in value):
            raise CollectError(f"{what} is not a list of texts")
    if got.fingerprint is not None and not (isinstance(got.fingerprint, str) and got.fingerprint):
        raise CollectError("the fingerprint is not a text")
    w = got.window
    if w is not None:
        starts = [w.start, *w.starts.values()]
        if not w.field or not all(isinstance(t, datetime) and t.tzinfo for t in starts) or w.starts and not w.scope_field:
            raise CollectError("the window needs a field, times with a zone, and a scope field if it has starts of its own")
    lost = _lost(records.sparkSession, got)
    both = records.join(lost, "key", "left_semi").select("key").first() if lost is not None else None
    if both:
        raise CollectError(f"key {both.key!r} is both a record and unavailable")


def _lost(spark: SparkSession, got: Collected) -> DataFrame | None:
    """Keys that could not be read, if there may be any."""
    if isinstance(got.unavailable, DataFrame):
        return got.unavailable.select("key")
    return spark.createDataFrame([(k,) for k in got.unavailable], "key string") if got.unavailable else None


def _cut(message: str) -> str:
    return message if len(message) <= MOST_MESSAGE else message[: MOST_MESSAGE - 1] + "…"


def _hashed(records: DataFrame) -> DataFrame:
    entries = F.array_sort(F.map_entries("fields"))
    text = F.transform(entries, lambda e: F.concat_ws("\x1f", e["key"], e["value"]["t"], F.coalesce(e["value"]["v"], F.lit("\x1e"))))
    return records.select("key", "fields", F.sha2(F.array_join(text, "\x1d"), 256).alias("content_hash"))


def _announce(commit: Commit, config: model.SourceConfig, told: list[tuple[str, dict]], now: datetime) -> None:
    rows = []
    for kind, detail in told:
        d = {f: detail.get(f) for f in model.DETAIL.fieldNames()}
        weight = model.PRIORITY_WEIGHTS[config.priority] * model.KIND_WEIGHTS[kind]
        rows.append((commit.manifest.next_seq, config.id, kind, None, [], weight, tuple(d[f] for f in model.DETAIL.fieldNames()), now))
        commit.manifest.next_seq += 1
    if rows:
        commit.append("events", commit.store.spark.createDataFrame(rows, model.EVENTS), config.id, (rows[0][0], rows[-1][0], len(rows), now))


def _store(commit: Commit, config: model.SourceConfig, source: Collector, got: Collected, new: New, baselined: bool, now: datetime) -> int:
    """Appends the diff's events and writes the next records; returns how many are present.

    Stored and collected records meet on their buckets, so neither is shuffled: once for what changed, once for the next records, which are
    written only if anything did.
    """
    store, m = commit.store, commit.manifest
    named = lambda df: df.withColumn("source_id", F.lit(config.id))
    if not baselined:
        first = new.records.withColumns({"present": F.lit(True), "updated_at": F.lit(now)})
        n = buckets.count_for(new.rows)
        entry = commit.replace("records", named(first.repartition(n, "key")), config.id, n)
        return entry["rows"] if entry else 0
    mine, held = store.snapshot(config.id, m)
    met = snapshot.meet(mine, new.records, _lost(store.spark, got))
    aged = _aged(got.window)
    track = config.track if config.track is not None else source.default_track
    moved = _drafts(met, aged, config, track)
    moved, seen = noted(moved, {"rows": F.count("*"), "events": F.count("kind")})
    moved = settled(moved, "moved")
    n_moved, n_events = (seen().get(k) or 0 for k in ("rows", "events"))
    if n_events:
        events = log.with_seq(moved.where("kind is not null"), ["key"], m.next_seq - 1, rows=n_events)
        m.next_seq += commit.append("events", _events(events, config, config.title or source.default_title, now), config.id)
    if n_moved or held is None:
        n = buckets.count_for(max(new.rows, held["rows"] if held else 0))
        after = named(snapshot.next_records(met, aged, now))
        held = commit.replace("records", after if n == new.buckets else after.repartition(n, "key"), config.id, n)
    return held["rows"] - held["gone"] if held else 0


def _aged(w: Window | None) -> Column:
    """Whether a record that is not in a collection left because it is dated before what that reached."""
    if w is None:
        return F.lit(False)
    value = lambda name: F.try_element_at("old", F.lit(name))["v"]
    start = F.lit(w.start)
    if w.scope_field is not None and w.starts:
        starts = F.create_map(*(x for scope, at in w.starts.items() for x in (F.lit(scope), F.lit(at))))
        start = F.coalesce(F.try_element_at(starts, value(w.scope_field)), start)
    return F.coalesce(F.try_to_timestamp(value(w.field)) < start, F.lit(False))


def _drafts(met: DataFrame, aged: Column, config: model.SourceConfig, track) -> DataFrame:
    """What moved between ``meet``'s two sides: kind, key, fields (the last known), changes with long text told in counts, importance.

    A record that aged out or changed in fields that are not tracked only has no kind: it is no event, but the records are to be written.
    """
    old, fresh = F.col("old"), F.col("new.fields")
    both = old.isNotNull() & F.col("new").isNotNull()
    same = F.col("stored.content_hash") == F.col("new.content_hash")
    changes = F.when(both, snapshot.changes_of(old, fresh, track))
    d = met.where((F.col("new").isNotNull() & ~(both & same)) | (old.isNotNull() & F.col("new").isNull()))
    d = d.withColumn("changes", changes).withColumn("kind", snapshot.kind_of(old, F.col("new"), F.col("changes")))
    d = d.withColumn("kind", F.when(~((F.col("kind") == "removed") & aged), F.col("kind")))
    d = d.select("key", "kind", "changes", "old", fresh.alias("new"))
    fields = F.coalesce("new", "old")
    none = F.lit(None).cast(model.SCALAR)
    if config.track is not None:  # only a configured list decorates added records
        listed = F.transform(F.array(*map(F.lit, config.track)), lambda f: F.struct(f.alias("field"), none.alias("old"), F.try_element_at("new", f).alias("new")))
        listed = F.filter(listed, lambda c: F.array_contains(F.map_keys("new"), c["field"]))
    else:
        listed = F.array().cast("array<struct<field:string,old:struct<t:string,v:string>,new:struct<t:string,v:string>>>")
    d = d.withColumn("changes", F.when(F.col("kind") == "added", listed).when(F.col("kind") == "modified", F.col("changes")).otherwise(F.array().cast(d.schema["changes"].dataType)))
    long = lambda s: (s["t"] == "str") & (F.length(s["v"]) > model.LONG_TEXT)
    is_long = lambda c: F.coalesce(long(c["old"]), F.lit(False)) | F.coalesce(long(c["new"]), F.lit(False))
    counted = d.select("key", F.posexplode(F.filter("changes", is_long)).alias("i", "c")).withColumn("n", text_change(_str("c.old"), _str("c.new")))
    counted = counted.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("c.field", "n"))).alias("counts"))
    d = d.join(counted, "key", "left")

    def told(c):
        n = F.when(is_long(c), F.try_element_at("counts", c["field"]))
        return F.struct(
            c["field"].alias("field"),
            F.when(~is_long(c), c["old"]).alias("old"),
            F.when(~is_long(c), c["new"]).alias("new"),
            n["added"].alias("added_chars"),
            n["removed"].alias("removed_chars"),
        )

    d = d.withColumn("fields", fields).withColumn("changes", F.transform("changes", told))
    flat = F.transform("changes", lambda c: F.struct(c["field"].alias("field"), c["new"]["v"].alias("new"), c["added_chars"].alias("added_chars")))
    d = d.withColumn("flat", flat)
    value = lambda f: F.try_element_at("fields", F.lit(f))["v"]
    return d.withColumn("importance", F.when(F.col("kind").isNotNull(), score.importance(F.lit(config.priority), F.col("kind"), F.col("flat"), config.rules, value))).select("kind", "key", "fields", "changes", "importance")


def _str(side: str):
    return F.when(F.col(f"{side}.t") == "str", F.col(f"{side}.v"))


def _events(drafts: DataFrame, config: model.SourceConfig, title, now: datetime) -> DataFrame:
    pairs = titles(F.col("fields"), title)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in model.DETAIL.fields if f.name != "title"}
    detail = F.struct(*(blank[f].alias(f) if f in blank else pairs.alias(f) for f in model.DETAIL.fieldNames()))
    return drafts.select(
        "seq", F.lit(config.id).alias("source_id"), "kind", F.col("key").alias("record_key"), F.col("changes").alias("field_changes"), F.col("importance").cast("int"), detail.alias("detail"), F.lit(now).alias("created_at")
    )


def prune(store: Store, cutoff: datetime, now: datetime | None = None) -> tuple[int, int]:
    """Drops events and served texts older than the cutoff, then removed records nothing refers to. (events, records) dropped.

    Generations note the times that they hold: those that are older go unread, those that are not stay untouched, and only those that the cutoff
    cuts are written again. Of the records only those of sources that hold some that were gone before the cutoff are looked at.
    """

    def change(commit: Commit) -> tuple[int, int]:
        m, before = commit.manifest, round(cutoff.timestamp() * 1e6)
        rows = {name: sum(g["rows"] for g in m.tables.get(name, [])) for name in ("events", "records")}
        m.pruned_through = max([m.pruned_through, *_cut_off(commit, "events", before, cutoff)])
        _cut_off(commit, "served", before, cutoff)
        for g in [g for g in m.tables.get("records", []) if g.get("gone") is None or g["gone"] and g["gone_begin"] < before]:
            records = store.spark.read.schema(TABLES["records"]).parquet(f"{store.root}/{g['path']}")
            left = log.prune_records(records, store.read("events", m, g["source"]))
            n = g.get("buckets")
            commit.swap("records", [g["path"]], left.repartition(n, "key") if n else left, g["source"], n)
        if now is not None:
            m.meta["last_pruned"] = stamp(now)
        return tuple(rows[name] - sum(g["rows"] for g in m.tables.get(name, [])) for name in ("events", "records"))

    with scope(store.spark):
        return store.update(change)


def _cut_off(commit: Commit, name: str, before: int, cutoff: datetime) -> list[int]:
    """Drops the rows of a table that are older; the highest numbers that went."""
    went, at = [], F.col(TIMES[name])
    for g in list(commit.manifest.tables.get(name, [])):
        if g.get("end") is not None and g["end"] < before:
            commit.swap(name, [g["path"]], None)
            went.append(g["hi"])
        elif g.get("begin") is None or g["begin"] < before:
            rows = commit.store.spark.read.schema(TABLES[name]).parquet(f"{commit.store.root}/{g['path']}")
            last = rows.where(at < F.lit(cutoff)).agg(F.max(ORDER[name])).first()[0]
            if last is not None:
                commit.swap(name, [g["path"]], log.prune(rows, F.lit(cutoff)) if name == "events" else rows.where(at >= F.lit(cutoff)), g["source"])
                went.append(last)
    return went


def tick(store: Store, sources: list[tuple[model.SourceConfig, Collector]], now: datetime, every: bool = False, put_off: dict[str, datetime] | None = None, clock=None, log=None, alive=None, ended=None) -> list[Result]:
    """Runs the sources that are due, soonest first; one that fails stops no other.

    A run that raises could not commit: its source is due again after its schedule only, as ``put_off``, the caller's, says. ``alive`` is told the time before each
    run and at the end (by default it writes the heartbeat); once ``ended`` holds, what is left is left.
    """
    put_off, alive = {} if put_off is None else put_off, alive or (lambda at: beat(store, at))
    known, waiting = store.manifest().sources, []
    for config, source in sources:
        at = due_at(known.get(config.id, {}), config.schedule, now)
        at = max(at, put_off.get(config.id, at))
        if every or at <= now:
            waiting.append((at, config.id, config, source))
    out = []
    for _, name, config, source in sorted(waiting, key=lambda x: x[:2]):
        if ended and ended():
            break
        began = max(now, clock()) if clock else now
        alive(began)
        told = None
        try:
            out.append(run(store, config, source, began))
            put_off.pop(name, None)
            told = out[-1].failed and f"{name}: collection failed: {out[-1].failed}"
        except Exception as e:  # the store's, and so of no source
            put_off[name] = now + timedelta(seconds=config.schedule)
            told = f"{name}: run failed: {type(e).__name__}: {e}"
        if told and log:
            log(told)
    alive(max(now, clock()) if clock else now)
    return out


def due_at(row: dict, schedule: int, now: datetime) -> datetime:
    """When a source is due: its last attempt and its schedule later, or now if it was never tried."""
    tried = [t for t in (unstamp(row.get("last_success_at")), unstamp(row.get("last_error_at"))) if t]
    return max(tried) + timedelta(seconds=schedule) if tried else now


def beat(store: Store, now: datetime) -> None:
    store.update(lambda commit: commit.manifest.meta.update(heartbeat=stamp(now)))
