"""What an audit of the store shows: sources, consumers, event and served pages, one event in full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import iso
from tidemark.operators import log
from tidemark.plans.model import CHANGE, DETAIL, PRIORITY_WEIGHTS
from tidemark.plans.service import Service
from tidemark.plans.store import Store

PAGE = 50


def home(store: Store, service: Service) -> dict:
    """Sources by priority, consumers, the 20 latest served texts and the highest number ever given."""
    m = store.manifest()
    order = list(PRIORITY_WEIGHTS)
    return {
        "sources": sorted(m.sources.items(), key=lambda x: (order.index(x[1]["priority"]) if x[1]["priority"] in order else len(order), x[0])),
        "consumers": service.consumers(),
        "served": store.read("served", m).orderBy(F.desc("id")).limit(20),
        "max_seq": m.max_seq,
    }


def events_page(store: Store, before: int | None = None, source: str | None = None, size: int = PAGE) -> tuple[DataFrame, int | None]:
    """A page of events, newest first, and where the next one begins (None if there is none): a row more than shown is asked for."""
    rows = log.newest(store.read("events"), size + 1, before, source)
    seqs = [r.seq for r in rows.select("seq").collect()]  # at most a page
    return rows.orderBy(F.desc("seq")).limit(size), seqs[size - 1] if len(seqs) > size else None


def served_page(store: Store, before: int | None = None, size: int = PAGE) -> tuple[DataFrame, int | None]:
    rows = store.read("served")
    if before is not None:
        rows = rows.where(F.col("id") < before)
    ids = [r.id for r in rows.orderBy(F.desc("id")).limit(size + 1).select("id").collect()]  # at most a page
    return rows.orderBy(F.desc("id")).limit(size), ids[size - 1] if len(ids) > size else None


def stored(store: Store, seq: int) -> DataFrame:
    """An event's stored data as JSON texts."""
    e = store.read("events", None, None, seq, seq).where(F.col("seq") == seq)
    return e.select("seq", "source_id", "kind", "record_key", "importance", iso(F.col("created_at")).alias("created_at"), F.to_json("field_changes").alias("changes"), F.to_json("detail").alias("detail"))


def decoded(raw: DataFrame, changes: str = "changes", detail: str = "detail") -> DataFrame:
    """Imported rows whose JSON may be damaged: decoded columns, the raw texts kept, and whether both could be read."""
    array = F.from_json(F.concat(F.lit('{"x":'), F.coalesce(changes, F.lit("null")), F.lit("}")), f"x array<{CHANGE.simpleString()}>, bad string", {"columnNameOfCorruptRecord": "bad"})
    obj = F.from_json(detail, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in DETAIL.fields)}, bad string", {"columnNameOfCorruptRecord": "bad"})
    out = raw.withColumn("__c", array).withColumn("__d", obj)
    readable = F.col("__c.bad").isNull() & F.col("__d.bad").isNull() & F.col("__d").isNotNull()
    return out.select(*raw.columns, F.col("__c.x").alias("field_changes"), F.col("__d").dropFields("bad").alias("decoded_detail"), readable.alias("readable"))
