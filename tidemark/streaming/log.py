"""The event log as a data source: ``spark.readStream.format("tidemark_log").load(store)``, and delivery to a consumer past its cursor.

Offsets are sequence numbers, so a stream neither sees how the log is laid out nor that it is compacted: a batch is what lies between
two numbers, whenever it is read. Executors need to reach the store (see sources/tree.py).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.plans import model
from tidemark.plans.scratch import folder
from tidemark.plans.service import Service
from tidemark.sources.tree import opened

NAME = "tidemark_log"


class Pruned(RuntimeError):
    """Events that were asked for are gone by retention."""


class Log(DataSource):
    """Rows of model.EVENTS, past ``after`` (0 by default), of ``source`` if one is given.

    With ``on_gap`` fail, a batch that begins before the number through which retention has dropped events is an error; by default it holds what is left.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return model.EVENTS

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStream(self.options)


@dataclass
class Stretch(InputPartition):
    """The rows of a file with numbers past ``start`` and up to ``end``."""

    path: str
    start: int
    end: int


class _Reading:
    def __init__(self, options):
        self.root, self.source = options["path"].rstrip("/"), options.get("source")
        self.begin, self.strict = int(options.get("after", 0)), options.get("on_gap", "skip") == "fail"

    def _manifest(self) -> dict:
        """The newest manifest that is whole."""
        store, root = opened(self.root)
        names = [name for name, _ in store.entries(f"{root}/manifests") if name.endswith(".json") and name[:-5].isdigit()]
        for name in sorted(names, reverse=True):
            try:
                return json.loads(store.read(f"{root}/manifests/{name}"))
            except (ValueError, FileNotFoundError):  # of a writer that died, or cleared away meanwhile
                continue
        return {"next_seq": 1, "pruned_through": 0, "tables": {}}

    def _stretches(self, start: int, end: int) -> list[Stretch]:
        """A partition for each file of the generations that hold some of the numbers."""
        m = self._manifest()
        if self.strict and start < m["pruned_through"]:
            raise Pruned(f"events through {m['pruned_through']} are gone, and {start + 1} was to be read")
        store, root = opened(self.root)
        out = []
        for g in m["tables"].get("events", []):
            if g["hi"] > start and g["lo"] <= end and (self.source is None or g["source"] in (None, self.source)):
                files = [name for name, _ in store.entries(f"{root}/{g['path']}") if name.endswith(".parquet")]
                out += [Stretch(f"{self.root}/{g['path']}/{name}", start, end) for name in files]
        return out

    def read(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        store, path = opened(stretch.path)
        wanted = (ds.field("seq") > stretch.start) & (ds.field("seq") <= stretch.end)
        if self.source is not None:
            wanted &= ds.field("source_id") == self.source
        shape = to_arrow_schema(model.EVENTS)
        for b in ds.dataset(path, format="parquet", filesystem=store.arrow()).to_batches(columns=shape.names, filter=wanted):
            if b.num_rows:
                yield from pa.Table.from_batches([b]).cast(shape, safe=False).to_batches()  # times in files may be finer than Spark's


class LogReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return self._stretches(self.begin, self._manifest()["next_seq"] - 1) or [Stretch("", 0, 0)]

    def read(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        return super().read(stretch) if stretch.path else iter(())


class LogStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"seq": self.begin}

    def latestOffset(self) -> dict:
        return {"seq": max(self.begin, self._manifest()["next_seq"] - 1)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return self._stretches(start["seq"], end["seq"])


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Log)
    return spark


def deliver(service: Service, agent: str, handle: Callable[[DataFrame], None], source: str | None = None) -> int:
    """Hands the events past ``agent``'s cursor to ``handle``, and acknowledges them when it returns; returns the cursor then.

    At least once: the cursor in the store is all that is kept, so whatever ``handle`` did not return from comes again. With a ``source``
    nothing is acknowledged, as a cursor is over all sources.
    """
    store = service.store
    spark = registered(store.spark)
    begin = store.manifest().cursors.get(agent, {}).get("seq", 0)

    def each(batch: DataFrame, number: int) -> None:
        last = batch.agg(F.max("seq")).first()[0]
        if last is None:
            return
        handle(batch)
        if source is None:
            said = service.ack(agent, last)
            if said.startswith("error: "):
                raise RuntimeError(said)

    stream = spark.readStream.format(NAME).option("after", begin)
    stream = (stream if source is None else stream.option("source", source)).load(store.root)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", folder(spark, "delivery")).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.manifest().cursors.get(agent, {}).get("seq", 0)
