"""Snapshots of keyed records: validation, diff, delta, ageing and carrying forward.

A snapshot is a DataFrame with one row per key. On the wide path each field is a typed column, so a
null-safe comparison is type-aware by construction; on the dynamic path ``fields`` is a map of tagged
scalars. Nothing here runs an action except ``check_keys`` and ``check_names``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import python_text
from tidemark.functions.udfs import text_change
from tidemark.plans.model import LONG_TEXT


class CollectError(Exception):
    """A collection that failed: its text becomes an error event."""


class LoginRequired(CollectError):
    """A failure that a person has to mend; ``hint`` says how."""

    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.hint = hint


#: Columns of what ``marked`` notes about records while they are written (see ``checked``).
NOTES = ("rows", "blank", "repeated", "first", "most", "unnamed")


def marked(records: DataFrame, key: str = "key", fields: str | None = "fields") -> tuple[DataFrame, dict[str, Column]]:
    """``records`` with each one's place among those of its key, and the aggregates that tell whether all keys are whole and unique and all names allowed.

    They are meant for an Observation on the write of the records, so nothing is read twice; places come from the partitioning by key that the write needs
    anyway. Records that are told apart by nothing but an equal key are an error, so one key is one task here.
    """
    k = F.col(key)
    placed = records.withColumn("__place", F.row_number().over(W.partitionBy(key).orderBy(key)))
    blank = k.isNull() | (k.cast("string") == "")
    again = ~blank & (F.col("__place") > 1)
    return placed, {
        "rows": F.count("*"),
        "blank": F.count(F.when(blank, 1)),
        "repeated": F.count(F.when(again & (F.col("__place") == 2), 1)),
        "first": F.min_by(F.when(again, k.cast("string")), F.when(again, F.struct(-F.col("__place"), k))),
        "most": F.max(F.when(again, F.col("__place"))),
        "unnamed": F.min(_unnamed(fields)) if fields else F.lit(None).cast("string"),
    }


def checked(notes: dict) -> int:
    """The number of records that the notes of ``marked`` are about; CollectError if they are no snapshot."""
    if notes.get("blank"):
        raise CollectError(f"{notes['blank']} records have an empty key")
    if notes.get("repeated"):
        raise CollectError(f"{notes['repeated']} keys occur more than once, {notes['first']!r} {notes['most']} times")
    if notes.get("unnamed") is not None:
        raise CollectError(f"field name {notes['unnamed']!r} is not allowed")
    return notes.get("rows") or 0


def check_keys(records: DataFrame, key: str = "key") -> None:
    """Raises on null, empty or repeated keys: one aggregate, one row to the driver."""
    per_key = records.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    r = per_key.agg(
        F.sum(F.when(F.col("k").isNull() | (F.col("k").cast("string") == ""), F.col("n"))).alias("blank"),
        F.count(F.when(F.col("k").isNotNull() & (F.col("n") > 1), 1)).alias("repeated"),
        F.min_by("k", F.struct(-F.col("n"), F.col("k"))).alias("first"),
        F.max("n").alias("most"),
    ).first()
    checked(r.asDict())


#: Characters that no field name may hold: all of the categories "other" and "separator" but the space.
_UNPRINTABLE = r"(?! )[\p{C}\p{Z}]"


def _unnamed(fields: str = "fields", most: int = 64) -> Column:
    """The first field name of a record that is empty, longer than ``most`` or not printable, if any."""
    return F.array_min(F.filter(F.map_keys(fields), lambda n: (n == "") | (F.length(n) > most) | n.rlike(_UNPRINTABLE)))


def check_names(records: DataFrame, fields: str = "fields") -> None:
    """Raises on a field name that is not allowed, in any record: one aggregate, one row to the driver."""
    checked(records.agg(F.min(_unnamed(fields)).alias("unnamed")).first().asDict())


def composite_key(*columns: Column) -> Column:
    """Key columns joined by a bar; null if any of them is, which concat_ws alone would hide."""
    some = columns[0].isNull()
    for c in columns[1:]:
        some = some | c.isNull()
    return F.when(~some, F.concat_ws("|", *(c.cast("string") for c in columns)))


def duplicate_keys(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_wins(records: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order: an aggregate of structs, combined before the shuffle."""
    rest = [c for c in records.columns if c not in keys]
    first = records.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*records.columns)


def content_hash(columns: dict[str, str]) -> Column:
    """SHA-256 over fields by name, each tagged with its type, so that 1, true and 1.0 differ and null is not ''."""
    parts = []
    for name in sorted(columns):
        x = F.col(name)
        text = F.when(F.isnan(x), F.lit("NaN")).otherwise(x.cast("string")) if columns[name] in ("double", "float") else x.cast("string")
        body = F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("null"))
        parts.append(F.concat(F.lit(f"{name}:{columns[name]}="), body))
    return F.sha2(F.concat_ws("\n", *parts), 256)


def _change(name: str, dtype: str, old: Column, new: Column) -> Column:
    """Null unless the field differs; a string longer than LONG_TEXT on either side is told in character counts."""
    differs = ~old.eqNullSafe(new)
    plain = F.struct(
        F.lit(name).alias("field"),
        python_text(old, dtype).alias("old"),
        python_text(new, dtype).alias("new"),
        F.lit(None).cast("int").alias("added_chars"),
        F.lit(None).cast("int").alias("removed_chars"),
    )
    if dtype != "string":
        return F.when(differs, plain)
    long = differs & ((F.coalesce(F.length(old), F.lit(0)) > LONG_TEXT) | (F.coalesce(F.length(new), F.lit(0)) > LONG_TEXT))
    n = text_change(F.when(long, old), F.when(long, new))
    none = F.lit(None).cast("string")
    counts = F.struct(F.lit(name).alias("field"), none.alias("old"), none.alias("new"), n["added"].alias("added_chars"), n["removed"].alias("removed_chars"))
    return F.when(long, counts).when(differs, plain)


def diff(
    old: DataFrame,
    new: DataFrame,
    key: str,
    track: Sequence[str] | None = None,
    decorate_added: bool = False,
    long_text: bool = True,
) -> DataFrame:
    """key, kind, changes, old, new: one row per key that appeared, changed in a tracked field, or left.

    One full outer join on the key. Changes of an added record list its tracked fields if ``decorate_added``. ``old`` and ``new`` are
    structs of all fields, null on the missing side. With ``long_text`` off, long strings are shown whole and no Python runs.
    """
    names = [c for c in new.columns if c != key]
    kinds = dict(new.dtypes)
    track = list(dict.fromkeys(names if track is None else track))
    side = lambda df, s: df.select(F.col(key).alias("key"), F.struct(*names).alias(s))
    met = side(old, "old").join(side(new, "new"), "key", "full_outer")
    make = lambda n: _change(n, kinds[n] if long_text or kinds[n] != "string" else "text", F.col(f"old.{n}"), F.col(f"new.{n}"))
    changes = F.array_compact(F.array(*(make(n) for n in track))) if track else F.array()
    out = met.withColumn("changes", changes).withColumn(
        "kind", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size("changes") > 0, "modified")
    )
    shown = F.col("kind") == "modified"
    if decorate_added:
        shown = shown | (F.col("kind") == "added")
    return out.where("kind is not null").select("key", "kind", F.when(shown, F.col("changes")).otherwise(F.slice("changes", 1, 0)).alias("changes"), "old", "new")


def changes_of(old: Column, new: Column, track: Sequence[str] | None = None) -> Column:
    """What differs between two maps of tagged scalars: (field, old, new), a field that one of them lacks counting as null."""
    names = F.array(*map(F.lit, track)) if track is not None else F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    each = F.transform(names, lambda f: F.struct(f.alias("field"), F.try_element_at(old, f).alias("old"), F.try_element_at(new, f).alias("new")))
    blank = lambda x: F.coalesce(x["t"], F.lit("null"))
    return F.filter(each, lambda c: ~(blank(c["old"]).eqNullSafe(blank(c["new"])) & c["old"]["v"].eqNullSafe(c["new"]["v"])))


def kind_of(old: Column, new: Column, changes: Column) -> Column:
    return F.when(old.isNull() & new.isNotNull(), "added").when(old.isNotNull() & new.isNull(), "removed").when(F.size(changes) > 0, "modified")


def diff_maps(old: DataFrame, new: DataFrame, track: Sequence[str] | None = None) -> DataFrame:
    """diff for (key, fields, content_hash) with fields a map of tagged scalars: equal hashes are skipped before any field is looked at."""
    o = old.select("key", F.col("fields").alias("old"), F.col("content_hash").alias("old_hash"))
    n = new.select("key", F.col("fields").alias("new"), F.col("content_hash").alias("new_hash"))
    met = o.join(n, "key", "full_outer").where("old_hash is distinct from new_hash")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    out = met.withColumn("changes", F.when(both, changes_of(F.col("old"), F.col("new"), track)))
    return out.withColumn("kind", kind_of(F.col("old"), F.col("new"), F.col("changes"))).where("kind is not null").select("key", "kind", "changes", "old", "new")


def meet(stored: DataFrame, new: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """One row for each key of the stored records (key, fields, content_hash, present, updated_at), gone ones included, and of a collection (key, fields, content_hash).

    ``stored`` and ``new`` are structs, null on the side that lacks the key; ``old`` are the fields of a record that is present and not among the ``lost``,
    the keys that could not be read. One full outer join on the key, which bucketed sides need no shuffle for.
    """
    s = stored.select("key", F.struct("fields", "content_hash", "present", "updated_at").alias("stored"))
    met = s.join(new.select("key", F.struct("fields", "content_hash").alias("new")), "key", "full_outer")
    seen = F.col("stored.present")
    if lost is not None:
        met = met.join(lost.select(F.col("key").alias("__lost")).distinct(), F.col("key") == F.col("__lost"), "left")
        seen = seen & F.col("__lost").isNull()
    return met.withColumn("old", F.when(seen, F.col("stored.fields"))).select("key", "stored", "new", "old")


def next_records(met: DataFrame, aged: Column, now) -> DataFrame:
    """The records to store after a run, from ``meet``: (key, fields, content_hash, present, updated_at).

    A record that is new, back or of another hash is stored as of ``now``, untracked changes included; one that left is kept as gone; one that ``aged`` out is not kept;
    one that could not be read stays as it is.
    """
    same = F.col("stored.present") & (F.col("stored.content_hash") == F.col("new.content_hash"))
    fresh = F.struct(F.col("new.fields").alias("fields"), F.col("new.content_hash").alias("content_hash"), F.lit(True).alias("present"), F.lit(now).alias("updated_at"))
    gone = F.struct(F.col("stored.fields").alias("fields"), F.col("stored.content_hash").alias("content_hash"), F.lit(False).alias("present"), F.lit(now).alias("updated_at"))
    left = F.col("old").isNotNull() & F.col("new").isNull()
    kept = F.when(F.col("new").isNotNull() & ~F.coalesce(same, F.lit(False)), fresh).when(left & ~aged, gone).when(~left, F.col("stored"))
    return met.select("key", kept.alias("r")).where("r is not null").select("key", "r.*")


def delta(old: DataFrame, new: DataFrame, key: str = "key", hash_col: str = "content_hash") -> DataFrame:
    """Rows to store: new to the snapshot or of another hash, untracked changes included."""
    was = old.select(F.col(key).alias("__key"), F.col(hash_col).alias("__hash"))
    return new.join(was, F.col(key) == F.col("__key"), "left").where(F.col("__hash").isNull() | (F.col("__hash") != F.col(hash_col))).select(*new.columns)


def carried(old: DataFrame, unavailable: DataFrame, key: str = "key") -> DataFrame:
    """Snapshot rows whose key could not be read this time: they stay as they are, without events."""
    return old.join(unavailable.select(key).distinct(), key, "left_semi")


def visible(old: DataFrame, unavailable: DataFrame, key: str = "key") -> DataFrame:
    return old.join(unavailable.select(key).distinct(), key, "left_anti")


def aged_out(old: DataFrame, new: DataFrame, key: str, date: Column, start: Column, scopes: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Rows of ``old`` that are absent from ``new`` and dated before the window's start.

    ``scopes`` (scope, start) gives starts of its own to some values of the ``scope`` column. The start itself is inside;
    a date that is null (or did not parse) never ages out, so it stays a removal.
    """
    gone = old.join(new.select(key), key, "left_anti")
    begin = start
    if scopes is not None:
        gone = gone.join(scopes.select(F.col("scope").alias("__scope"), F.col("start").alias("__start")), F.col(scope) == F.col("__scope"), "left")
        begin = F.coalesce(F.col("__start"), start)
    return gone.where(date < begin).select(*old.columns)
