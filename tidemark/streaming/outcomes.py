"""The run-outcome state machine over a stream of runs: one value of state and one timer for each source."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.outcomes import Outcome, State, step

RUNS = "source_id string, run long, kind string, at timestamp, message string, hint string, selectors array<string>, fingerprint string, record_count long, schedule long"
ANNOUNCED = "source_id string, run long, step int, kind string, text string"
_STATE = (
    "baselined boolean, in_error boolean, error_from long, announced string, broken string, fingerprint string, last_error string, last_error_at long, last_success_at long, run long, due long"
)
#: What a state holds for a time that is not.
_NEVER = -1
#: How much later than the newest of earlier batches a run may come.
LATENESS = timedelta(hours=1)


class Machine(StatefulProcessor):
    """Announces what ``step`` does, run by run, and when a source is due: its schedule after its last attempt.

    A timer tells that a source is due once the watermark has passed it; a run that comes first tells it itself, so it does not depend on how runs are cut into batches.
    """

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """The runs of one source in a batch, in order of their number. One that began before a later attempt of its source was stored is passed over."""
        s, last, due = self._held()
        timer = due
        for r in sorted(rows, key=lambda r: r.run):
            outcome = Outcome(r.kind, r.at.astimezone(timezone.utc), r.message, r.hint, tuple(r.selectors or ()), r.fingerprint, r.record_count or 0)
            now, events, counts = step(s, outcome)
            if not counts:
                continue
            at = int(outcome.at.timestamp())
            if due != _NEVER and at >= due:
                yield _due(key[0], last, due)
            s, last, due = now, r.run, at + r.schedule if r.schedule else _NEVER
            for i, (kind, detail) in enumerate(events):
                yield Row(source_id=key[0], run=r.run, step=i, kind=kind, text=_told(kind, detail))
        if timer != due:
            if timer != _NEVER:
                self.handle.deleteTimer(timer * 1000)
            if due != _NEVER:
                self.handle.registerTimer(due * 1000)
        self._hold(s, last, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, last, due = self._held()
        if due * 1000 == expiredTimerInfo.getExpiryTimeInMs():
            self._hold(s, last, _NEVER)
            yield _due(key[0], last, due)

    def _held(self) -> tuple[State, int, int]:
        if not self.state.exists():
            return State(), _NEVER, _NEVER
        b, e, began, told, broken, layout, error, bad, good, last, due = self.state.get()
        return State(b, e, _time(began), json.loads(told), tuple(json.loads(broken)), json.loads(layout), json.loads(error), _time(bad), _time(good)), last, due

    def _hold(self, s: State, last: int, due: int) -> None:
        told, broken, layout, error = (json.dumps(x) for x in (s.announced, s.broken, s.fingerprint, s.last_error))  # null and '' stay apart
        self.state.update((s.baselined, s.in_error, _number(s.error_from), told, broken, layout, error, _number(s.last_error_at), _number(s.last_success_at), last, due))


def _time(x: int) -> datetime | None:
    return None if x == _NEVER else datetime.fromtimestamp(x, timezone.utc)


def _number(t: datetime | None) -> int:
    return _NEVER if t is None else int(t.timestamp())


def _due(source: str, run: int, at: int) -> Row:
    return Row(source_id=source, run=run, step=-1, kind="due", text=f"{_time(at):%Y-%m-%dT%H:%M:%SZ}")


def _told(kind: str, detail: dict) -> str:
    """What an announcement says: an error and its hint, the error that is over, the selectors that match nothing, or the number of records."""
    if kind == "baseline":
        return str(detail["record_count"])
    if kind == "schema_changed":
        return ",".join(detail["selectors"])
    return "; ".join(filter(None, (detail.get("error") or detail.get("last_error"), detail.get("hint"))))


def announcements(runs: DataFrame, lateness: timedelta = LATENESS) -> DataFrame:
    """Events that a stream of runs (RUNS: kind ok, fail, login or broken) announces, and a ``due`` row, with the run that it follows, whenever a source is due.

    State and timers are kept by source in the checkpoint; a run of no schedule sets no timer. Runs later than ``lateness`` after the newest of
    earlier batches are dropped. Start the query within ``keyed_state``.
    """
    dated = runs.withWatermark("at", f"{int(lateness.total_seconds())} seconds")
    return dated.groupBy("source_id").transformWithState(Machine(), ANNOUNCED, "append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the store that keeps it on disk."""
    name, on_disk = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, on_disk)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replay(spark: SparkSession, folder: str, checkpoint: str, sink: str, files_per_batch: int = 1, lateness: timedelta = LATENESS) -> None:
    """Feeds tick files (Parquet, RUNS) through ``announcements`` one batch a tick, appending to ``sink``; ends when all are read."""
    ticks = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    with keyed_state(spark):
        query = announcements(ticks, lateness).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()


def acknowledged(events: DataFrame, last_look) -> int:
    """The cursor of a consumer whose last look was at ``last_look``: the highest number of an event stored by then, 0 if there is none."""
    return events.where(F.col("created_at") <= last_look).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
