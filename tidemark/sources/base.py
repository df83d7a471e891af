"""What a collector is, and the registry of the known ones."""

from __future__ import annotations

import importlib
import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.udfs import float_text
from tidemark.operators.snapshot import CollectError

# Source types and where their collectors are.
TYPES = {
    "dir": "tidemark.sources.directory:Directory",
    "sql": "tidemark.sources.tables:Query",
    "imap": "tidemark.sources.mail:Mailbox",
    "web": "tidemark.sources.pages:Page",
    "changedetection": "tidemark.sources.watches:Watches",
    "format": "tidemark.sources.tables:Format",
    "versions": "tidemark.sources.tables:Versions",
}


@dataclass(frozen=True)
class Window:
    """How far back a collection reaches: records whose ``field`` is dated earlier leave silently."""

    field: str
    start: datetime
    scope_field: str | None = None
    starts: dict[str, datetime] = field(default_factory=dict)


@dataclass(frozen=True)
class Collected:
    """records: key, fields (map of tagged scalars)."""

    records: DataFrame
    unavailable: Sequence[str] | DataFrame = ()  # keys, or a table (key) of them where there may be many
    window: Window | None = None
    fingerprint: str | None = None
    broken: Sequence[str] = ()


class Collector:
    """``collect`` raises on failure: an empty result means that there are no records."""

    default_track: tuple[str, ...] | None = None
    default_title: tuple[str, ...] = ()
    key_label = ""
    options: dict[str, type | tuple] = {}
    required: tuple[str, ...] = ()
    ranges: dict[str, tuple[int, int]] = {}

    def __init__(self, **options):
        unknown = sorted(set(options) - set(self.options))
        if unknown:
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        missing = [k for k in self.required if k not in options]
        if missing:
            raise ValueError(f"missing options: {', '.join(missing)}")
        for k, v in options.items():
            if not isinstance(v, self.options[k]) or isinstance(v, bool) and self.options[k] is int:
                raise ValueError(f"option {k} has the wrong type")
            lo, hi = self.ranges.get(k, (None, None))
            if lo is not None and not lo <= v <= hi:
                raise ValueError(f"option {k} must lie between {lo} and {hi}")
        self.given = options

    def secret(self, name: str) -> str | None:
        """The value of option ``name``, or of the environment variable that option ``name``_env names, read when it is needed and kept nowhere."""
        if name in self.given:
            return self.given[name]
        variable = self.given.get(f"{name}_env")
        if variable is not None and not os.environ.get(variable):
            raise CollectError(f"environment variable {variable} is not set")
        return os.environ[variable] if variable is not None else None

    def collect(self, spark: SparkSession, now: datetime) -> Collected:
        raise NotImplementedError


_added: dict[str, type[Collector]] = {}


def add_type(kind: str, made: type[Collector]) -> None:
    """Makes a source type of one's own known, to configurations as well; the known ones cannot be replaced."""
    if kind in TYPES or _added.get(kind, made) is not made:
        raise ValueError(f"source type {kind!r} is taken")
    _added[kind] = made


def known_types() -> list[str]:
    return [*TYPES, *_added]


def collector_type(kind: str) -> type[Collector]:
    if kind in _added:
        return _added[kind]
    if kind not in TYPES:
        raise ValueError(f"unknown source type {kind!r}")
    module, _, name = TYPES[kind].partition(":")
    return getattr(importlib.import_module(module), name)


def collector(kind: str, **options) -> Collector:
    return collector_type(kind)(**options)


def tagged(x: Column, dtype: str) -> Column:
    """A tagged scalar: type and text, so that 1, true and 1.0 stay apart; decimals, dates and times are text, bytes a marker."""
    kind = dtype.split("(")[0]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        tag, text = "int", x.cast("string")
    elif kind in ("float", "double"):
        tag, text = "float", float_text(x.cast("double"))
    elif kind == "boolean":
        tag, text = "bool", F.when(x, F.lit("True")).otherwise(F.lit("False"))
    elif kind in ("timestamp", "timestamp_ntz"):
        tag, text = "str", F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss" + ("'Z'" if kind == "timestamp" else ""))
    elif kind == "binary":
        tag, text = "str", F.concat(F.lit("<"), F.octet_length(x).cast("string"), F.lit(" bytes, sha256 "), F.substring(F.sha2(x, 256), 1, 12), F.lit(">"))
    elif kind in ("string", "char", "varchar", "date", "decimal"):
        tag, text = "str", x.cast("string")
    else:
        raise CollectError(f"a field of type {dtype} is not a scalar")
    return F.struct(F.when(x.isNull(), "null").otherwise(tag).alias("t"), F.when(x.isNotNull(), text).alias("v"))


def as_records(rows: DataFrame, key: Column, names: Sequence[str] | None = None) -> DataFrame:
    """(key, fields) of typed rows."""
    kinds = dict(rows.dtypes)
    pairs = [y for n in (rows.columns if names is None else names) for y in (F.lit(n), tagged(F.col(f"`{n}`"), kinds[n]))]
    return rows.select(key.cast("string").alias("key"), F.create_map(*pairs).alias("fields"))
