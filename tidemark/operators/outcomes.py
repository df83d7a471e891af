"""Runs of a source and what they announce: error streaks, recovery, broken extraction, late results."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.model import PRIORITY_WEIGHTS


@dataclass(frozen=True)
class State:
    baselined: bool = False
    in_error: bool = False
    error_from: datetime | None = None
    announced: str | None = None
    broken: tuple[str, ...] = ()
    fingerprint: str | None = None
    last_error: str | None = None
    last_error_at: datetime | None = None
    last_success_at: datetime | None = None


@dataclass(frozen=True)
class Outcome:
    """How a run ended: ok, fail, login (needs a person) or broken (selectors that matched nothing)."""

    kind: str
    at: datetime
    message: str | None = None
    hint: str | None = None
    selectors: tuple[str, ...] = ()
    fingerprint: str | None = None
    record_count: int = 0


def step(state: State, run: Outcome) -> tuple[State, list[tuple[str, dict]], bool]:
    """The state after a run, the source-level events it announces in order, and whether it counts at all.

    A run older than a stored attempt is dropped; times count in whole seconds, and an equal time is not older.
    """
    at = run.at.replace(microsecond=0)
    if any(t is not None and t > at for t in (state.last_success_at, state.last_error_at)):
        return state, [], False
    if run.kind == "ok":
        return _success(state, run, at)
    first, message = not state.in_error, run.message or ""
    told = replace(state, in_error=True, error_from=at if first else state.error_from, last_error=message, last_error_at=at)
    if run.kind == "broken" and state.baselined:
        names = tuple(sorted(set(run.selectors)))
        if names == state.broken and message == state.announced:
            return told, [], True
        return replace(told, broken=names, announced=message), [("schema_changed", {"selectors": list(names)})], True
    if first or (run.kind == "login" and message != state.announced):
        return replace(told, announced=message), [("source_error", {"error": message, "hint": run.hint})], True
    return told, [], True


def _success(state: State, run: Outcome, at: datetime) -> tuple[State, list[tuple[str, dict]], bool]:
    events: list[tuple[str, dict]] = []
    if state.in_error:
        events.append(("source_recovered", {"error_from": state.error_from, "last_error": state.last_error}))
    if not state.baselined:
        events.append(("baseline", {"record_count": run.record_count}))
    elif run.fingerprint and state.fingerprint and run.fingerprint != state.fingerprint:
        events.append(("schema_changed", {"selectors": []}))
    after = replace(
        state, baselined=True, in_error=False, error_from=None, announced=None, broken=(), fingerprint=run.fingerprint or state.fingerprint, last_success_at=at
    )
    return after, events, True


def streaks(runs: DataFrame) -> DataFrame:
    """Announcements of plain runs (source_id, run, failed): source_error at the first failure of a streak, source_recovered at the first success
    after one, baseline at the first success. One window per source over the previous outcome."""
    w = W.partitionBy("source_id").orderBy("run")
    before = F.coalesce(F.lag("failed").over(w), F.lit(False))
    earlier = F.coalesce(F.max(F.when(~F.col("failed"), 1)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("failed") & ~before, "source_error"),
            F.when(~F.col("failed") & before, "source_recovered"),
            F.when(~F.col("failed") & (earlier == 0), "baseline"),
        )
    )
    return runs.withColumn("kinds", kinds).where(F.size("kinds") > 0).select("source_id", "run", F.posexplode("kinds").alias("step", "kind"))


def error_streaks(runs: DataFrame) -> DataFrame:
    """(source_id, first_run, last_run, failures) of each unbroken series of failures of (source_id, run, failed)."""
    w = W.partitionBy("source_id").orderBy("run")
    starts = F.col("failed") & ~F.coalesce(F.lag("failed").over(w), F.lit(False))
    numbered = runs.withColumn("__starts", starts.cast("int")).withColumn("__streak", F.sum("__starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = numbered.where("failed").groupBy("source_id", "__streak").agg(F.min("run").alias("first_run"), F.max("run").alias("last_run"), F.count("*").alias("failures"))
    return found.drop("__streak")


def stale(last, now, schedule):
    """Whether a heartbeat is older than twice the schedule, strictly, in whole seconds."""
    return F.unix_timestamp(now) - F.unix_timestamp(last) > 2 * schedule


def by_priority(sources: DataFrame) -> DataFrame:
    """Sources (source_id, priority) with their place in a listing: by priority, unknown ones last, then by name. A row for each source."""
    at = F.array_position(F.array(*map(F.lit, PRIORITY_WEIGHTS)), F.col("priority"))
    return sources.withColumn("place", F.row_number().over(W.orderBy(F.when(at == 0, len(PRIORITY_WEIGHTS) + 1).otherwise(at), "source_id")))


def soonest(sources: DataFrame, now, most: int = 5) -> DataFrame:
    """Seconds to sleep until a source is due: 0 to ``most``, and ``most`` if there is none."""
    last = F.greatest("last_success_at", "last_error_at")
    at = F.coalesce(last + F.make_dt_interval(secs=F.col("schedule")), now)
    left = F.unix_timestamp(F.min(at)) - F.unix_timestamp(now)
    return sources.agg(F.coalesce(F.least(F.greatest(left, F.lit(0)), F.lit(most)), F.lit(most)).cast("long").alias("seconds"))


def late(runs: DataFrame) -> DataFrame:
    """Runs dated before an attempt that arrived earlier (strictly, in whole seconds)."""
    w = W.partitionBy("source_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    seconds = F.date_trunc("second", F.col("at"))
    return runs.withColumn("latest", F.max(seconds).over(w)).where(F.col("latest") > seconds).drop("latest")


def due(sources: DataFrame, now) -> DataFrame:
    """Sources whose last attempt plus schedule has come, or that were never tried: due time, then id."""
    last = F.greatest("last_success_at", "last_error_at")
    at = F.coalesce(last + F.make_dt_interval(secs=F.col("schedule")), now)
    return sources.withColumn("due_at", at).where(F.col("due_at") <= now)
