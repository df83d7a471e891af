"""Replay: collections of every source over ticks of a simulated clock, as a stream of ticks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import model, runner
from tidemark.plans.service import Service
from tidemark.plans.store import Store, stamp
from tidemark.sources.base import Collector

TICKS = "at timestamp, look boolean"


class Replay:
    """Collects every source at each tick, with the tick as the time, and acknowledges for ``agent`` all that is stored by the last tick that is a ``look``.

    Each run's commit notes its tick under the source, and an acknowledgement its tick under the agent. So a tick that is taken again, as the stream was cut off
    before its batch ended, goes on where it stopped, and the log is the same however often that happens. Ticks are few: they pass through the driver.
    """

    def __init__(self, store: Store, sources: Sequence[tuple[model.SourceConfig, Collector]], agent: str = "replay"):
        self.store, self.sources, self.agent = store, sorted(sources, key=lambda x: x[0].id), agent

    def start(self, ticks: DataFrame, checkpoint: str):
        """The streaming query that takes ``ticks`` (TICKS), all that there are now; each batch's in order of time."""
        runner.register(self.store, [c for c, _ in self.sources])
        return ticks.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def take(self, ticks: DataFrame, number: int = 0) -> None:
        for r in ticks.select("at", F.coalesce("look", F.lit(False)).alias("look")).distinct().orderBy("at", "look").collect():
            now = r["at"].astimezone(timezone.utc).replace(microsecond=0)
            for config, source in self.sources:
                note = f"replayed {config.id}"
                if (self.store.manifest().meta.get(note) or "") < stamp(now):
                    runner.run(self.store, config, source, now, {note: stamp(now)})
            if r.look:
                self._look(now)

    def _look(self, now) -> None:
        m, note = self.store.manifest(), f"looked {self.agent}"
        if (m.meta.get(note) or "") >= stamp(now):
            return
        said = Service(self.store, lambda: now, "replay").ack(self.agent, m.max_seq)
        if said.startswith("error: "):
            raise RuntimeError(said)
        self.store.update(lambda commit: commit.manifest.meta.update({note: stamp(now)}))
