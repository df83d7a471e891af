"""Kinds, priorities, weights and schemas of the change log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Kinds with their weight and line symbol, priorities with their weight, in display order.
KIND_WEIGHTS = {
    "source_error": 5,
    "schema_changed": 5,
    "modified": 4,
    "removed": 4,
    "added": 3,
    "baseline": 1,
    "source_recovered": 1,
}
KIND_SYMBOLS = {
    "added": "+",
    "removed": "-",
    "modified": "~",
    "baseline": "=",
    "schema_changed": "!",
    "source_error": "!",
    "source_recovered": "^",
}
PRIORITY_WEIGHTS = {"high": 3, "normal": 2, "low": 1}
RECORD_KINDS = ("added", "modified", "removed")
DEFAULT_BONUS = 10
LONG_TEXT = 200
REFINE_CHARS = 5000

# Fixed value: what a source may be called.
SOURCE_ID = r"[a-z0-9][a-z0-9_-]{0,63}"

#: Scheme of handles and the name that opens texts.
SCHEME = "tide"
NAME = "tidemark"

SCALAR = T.StructType([T.StructField("t", T.StringType()), T.StructField("v", T.StringType())])
FIELDS = T.MapType(T.StringType(), SCALAR)
CHANGE = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("old", SCALAR),
        T.StructField("new", SCALAR),
        T.StructField("added_chars", T.IntegerType()),
        T.StructField("removed_chars", T.IntegerType()),
    ]
)
TITLE = T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType())]))
DETAIL = T.StructType(
    [
        T.StructField("record_count", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("hint", T.StringType()),
        T.StructField("error_from", T.TimestampType()),
        T.StructField("last_error", T.StringType()),
        T.StructField("selectors", T.ArrayType(T.StringType())),
        T.StructField("title", TITLE),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("record_key", T.StringType()),
        T.StructField("field_changes", T.ArrayType(CHANGE)),
        T.StructField("importance", T.IntegerType()),
        T.StructField("detail", DETAIL),
        T.StructField("created_at", T.TimestampType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("fields", FIELDS),
        T.StructField("content_hash", T.StringType()),
        T.StructField("present", T.BooleanType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
SERVED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("args", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("via", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)


@dataclass(frozen=True)
class Rule:
    """A highlight: op is equals, contains or changed_to; a negative bonus lowers."""

    field: str
    op: str
    value: str
    bonus: int = DEFAULT_BONUS

    def __post_init__(self):
        if self.op not in ("equals", "contains", "changed_to"):
            raise ValueError(f"unknown rule op {self.op!r}")


@dataclass(frozen=True)
class SourceConfig:
    id: str
    type: str
    schedule: int = 900
    priority: str = "normal"
    key_label: str = ""
    track: tuple[str, ...] | None = None
    title: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.priority not in PRIORITY_WEIGHTS:
            raise ValueError(f"unknown priority {self.priority!r}")
        if self.schedule < 10:
            raise ValueError("schedule is shorter than 10 seconds")
