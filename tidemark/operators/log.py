"""The event log: sequence numbers, range reads, pages, ranking, retention and consumers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.scratch import is_settled, settled


#: Rows that one task numbers; more are range-sorted and numbered by partition.
ONE_TASK = 100_000


def with_seq(drafts: DataFrame, order: Sequence, base: int = 0, name: str = "seq", one_task: int | None = None, rows: int | None = None) -> DataFrame:
    """Consecutive numbers base + 1, ... in a total order, without a window over all rows.

    The rows are settled once, and counted unless ``rows`` says how many there are. Beyond ``one_task`` of them (ONE_TASK by default), a range sort deals them out and is settled as a table with each row's partition and place;
    partition sizes, a row each, are summed up on the driver and added to the places.
    """
    first = F.lit(base).cast("long")
    most = ONE_TASK if one_task is None else one_task
    if rows is None or rows > most:
        drafts = drafts if is_settled(drafts) else settled(drafts, "drafts")
    if (drafts.count() if rows is None else rows) <= most:
        return drafts.withColumn(name, first + F.row_number().over(W.orderBy(*order)))
    placed = drafts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = settled(placed, "seq")
    part = F.shiftright("__at", 33).cast("int")
    sizes = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    rows, total = [], base
    for p, n in sizes:
        rows.append((p, total))
        total += n
    starts = F.broadcast(placed.sparkSession.createDataFrame(rows, "__part int, __start long"))  # a row for each partition
    return placed.join(starts, part == F.col("__part")).withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__start")


def after(events: DataFrame, cursor: int, source: str | None = None) -> DataFrame:
    out = events.where(F.col("seq") > cursor)
    return out if source is None else out.where(F.col("source_id") == source)


def in_range(events: DataFrame, lo: int, hi: int, source: str | None = None, past: int | None = None) -> DataFrame:
    out = events.where(F.col("seq").between(lo, hi))
    if source is not None:
        out = out.where(F.col("source_id") == source)
    return out if past is None else out.where(F.col("seq") > past)


def newest(events: DataFrame, limit: int, before: int | None = None, source: str | None = None) -> DataFrame:
    """A page, newest first; ask for limit + 1 to learn whether another follows."""
    out = events if before is None else events.where(F.col("seq") < before)
    if source is not None:
        out = out.where(F.col("source_id") == source)
    return out.orderBy(F.desc("seq")).limit(limit)


def effective_importance(events: DataFrame, priority: Column, weight: Column, kind_weight: Column) -> DataFrame:
    """Adds ``resolved`` and ``effective``: an error, or a schema change that lists selectors, with a later recovery of its source
    among the rows weighs what the recovery does. The last recovery of each source is settled and joined back, so AQE splits a hot source."""
    last = settled(latest_recovery(events).select(F.col("source_id").alias("__source"), F.col("seq").alias("__recovered")), "recovered")
    mendable = (F.col("kind") == "source_error") | ((F.col("kind") == "schema_changed") & (F.size(F.coalesce(F.col("detail.selectors"), F.array())) > 0))
    resolved = mendable & F.coalesce(F.col("__recovered") > F.col("seq"), F.lit(False))
    lowered = F.coalesce(F.when(priority.isNotNull(), weight), F.floor(F.col("importance") / kind_weight).cast("int"))
    met = events.join(last, F.col("source_id") == F.col("__source"), "left").withColumn("resolved", resolved)
    return met.withColumn("effective", F.when(F.col("resolved"), lowered).otherwise(F.col("importance"))).drop("__source", "__recovered")


def latest_recovery(events: DataFrame) -> DataFrame:
    """(source_id, seq) of the last recovery of each source that has one."""
    return events.where("kind = 'source_recovered'").groupBy("source_id").agg(F.max("seq").alias("seq"))


def rank(events: DataFrame, importance: str = "effective", ordinal: bool = False) -> DataFrame:
    """Adds ``rank`` over all rows and, if asked for, ``ordinal`` within each source: importance descending, then seq.

    Both are places in a total order of all rows; the ordinal is counted from its source's first, so no window holds a source.
    """
    order = [F.desc(importance), F.asc("seq")]
    ranked = with_seq(events, order, name="rank")
    if not ordinal:
        return ranked
    placed = settled(with_seq(ranked, [F.asc("source_id"), *order], name="__place"), "places")
    first = placed.groupBy(F.col("source_id").alias("__source")).agg(F.min("__place").alias("__first"))
    met = placed.join(first, F.col("source_id").eqNullSafe(F.col("__source")))
    return met.withColumn("ordinal", (F.col("__place") - F.col("__first") + 1).cast("int")).drop("__place", "__source", "__first")


def following(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each row with a struct ``next``, the row after it in ``order`` among those that agree in ``by``; without one for the last.

    Rows are numbered over all groups and joined on the number, so a hot group is as good as any; give light rows, texts can be joined to them.
    """
    placed = settled(with_seq(rows, [*map(F.asc, by), *map(F.asc, order)], name="__place"), "placed")
    after = placed.select((F.col("__place") - 1).alias("__place"), F.struct(*rows.columns).alias("next"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"next.{c}"))
    return placed.join(after, "__place", "left").withColumn("next", F.when(same, F.col("next"))).drop("__place")


def bounds(events: DataFrame) -> DataFrame:
    """First and last number and count of a selection: one row."""
    return events.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))


def page(events: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows by number, each with the ``total`` of the selection."""
    return events.orderBy("seq").limit(size).withColumn("total", F.lit(events.count()).cast("long"))


def offset_page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def omitted(grouped: DataFrame) -> DataFrame:
    """Sources of ``groups`` with omitted rows and their place: the greatest omitted importance first, then by name. A row for each source."""
    return grouped.where("omitted > 0").withColumn("place", F.row_number().over(W.orderBy(F.desc("max_omitted"), "source_id")))


def behind(cursors: DataFrame, last: int, pruned: int) -> DataFrame:
    """How far each consumer (agent_id, seq) is behind the log's end, and whether it missed events that were pruned."""
    return cursors.select("agent_id", (F.lit(last).cast("long") - F.col("seq")).alias("lag"), (F.col("seq") < pruned).alias("gap"))


def running_size(lines: DataFrame, length: Column, order: Sequence[Column]) -> DataFrame:
    """Adds ``size_so_far``: line lengths plus one for each line end."""
    return lines.withColumn("size_so_far", F.sum(length + 1).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def groups(ranked: DataFrame, shown: int) -> DataFrame:
    """Per source: total, shown, omitted, and the greatest shown and omitted importance, for the first ``shown`` ranks."""
    top = F.col("rank") <= shown
    return ranked.groupBy("source_id").agg(
        F.count("*").alias("total"),
        F.count(F.when(top, 1)).alias("shown"),
        F.count(F.when(~top, 1)).alias("omitted"),
        F.max(F.when(top, F.col("effective"))).alias("max_shown"),
        F.max(F.when(~top, F.col("effective"))).alias("max_omitted"),
    )


def prune(events: DataFrame, cutoff: Column) -> DataFrame:
    """Events kept by retention: created at the cutoff or later."""
    return events.where(F.col("created_at") >= cutoff)


def prune_records(records: DataFrame, kept_events: DataFrame) -> DataFrame:
    """Present records, and removed ones that a kept event still refers to."""
    refs = kept_events.where("record_key is not null").select("source_id", F.col("record_key").alias("key")).distinct()
    gone = records.where("not present").join(refs, ["source_id", "key"], "left_anti").select("source_id", "key")
    return records.join(gone, ["source_id", "key"], "left_anti")


def pruned_through(events: DataFrame, cutoff: Column, floor: Column) -> DataFrame:
    """The highest sequence number removed so far; it never falls."""
    return events.where(F.col("created_at") < cutoff).agg(F.greatest(floor, F.coalesce(F.max("seq"), F.lit(0))).alias("pruned_through"))


def consumers(cursors: DataFrame, served: DataFrame) -> DataFrame:
    """Every consumer with a cursor or a served row: cursor, its time, and how often and when last served."""
    every = cursors.select("agent_id").union(served.select("agent_id")).distinct()
    used = served.groupBy("agent_id").agg(F.count("*").alias("served_count"), F.max("at").alias("last_served"))
    return every.join(cursors, "agent_id", "left").join(used, "agent_id", "left").withColumn("served_count", F.coalesce("served_count", F.lit(0)))
