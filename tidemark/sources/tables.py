"""A query's rows as records."""

from __future__ import annotations

import os
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.snapshot import CollectError, composite_key
from tidemark.sources.base import Collected, Collector, as_records


def scrubbed(message: str, secrets: list[str]) -> str:
    """The first line, without secrets."""
    line = message.splitlines()[0] if message else ""
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        line = line.replace(s, "***")
    return re.sub(r"(?<=://)[^/@\s]+@", "***@", line)


class Query(Collector):
    """``query`` over registered views, or over a JDBC ``url`` pushed down whole; ``key`` names one or more columns.

    ``url``, ``user`` and ``password`` may be named by environment variable (url_env and so on); a configuration names them no other way.
    """

    options = {"query": str, "key": (str, list), **{k + end: str for k in ("url", "user", "password") for end in ("", "_env")}}
    required = ("query", "key")

    def collect(self, spark: SparkSession, now: datetime) -> Collected:
        o = self.given
        keys = [o["key"]] if isinstance(o["key"], str) else o["key"]
        login = {k: v for k in ("url", "user", "password") if (v := self.secret(k)) is not None}
        try:
            if "url" in login:
                rows = spark.read.format("jdbc").options(query=o["query"], **login).load()
            else:
                if not re.match(r"\s*(select|with)\b", o["query"], re.I):
                    raise CollectError("only SELECT and WITH queries are run")
                rows = spark.sql(o["query"])
        except CollectError:
            raise
        except Exception as e:
            raise CollectError(scrubbed(str(e), [login.get("password", ""), login.get("url", "")])) from None
        return Collected(keyed(rows, keys))


def keyed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as records by their key columns; CollectError if a name occurs twice or a key column is missing."""
    names = [c.lower() for c in rows.columns]
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        raise CollectError(f"column {twice[0]} occurs more than once")
    missing = [k for k in keys if k.lower() not in names]
    if missing:
        raise CollectError(f"key column {missing[0]} is not in the result")
    return as_records(rows, composite_key(*(F.col(f"`{k}`") for k in keys)))


class Format(Collector):
    """What a Spark data source gives, of Spark's own formats or one that was registered in Python: ``format``, its ``with`` options, ``path``, ``schema``.

    ``columns`` names those to keep, which the source then need not read; ``key`` names one or more of them. An option ``x_env`` in ``with`` names the environment variable that holds ``x``.
    """

    options = {"format": str, "with": dict, "path": str, "schema": str, "columns": list, "key": (str, list)}
    required = ("format", "key")

    def collect(self, spark: SparkSession, now: datetime) -> Collected:
        o = self.given
        keys = [o["key"]] if isinstance(o["key"], str) else o["key"]
        given, secrets = dict(o.get("with", {})), []
        for k in [k for k in given if k.endswith("_env")]:
            variable = given.pop(k)
            if not os.environ.get(variable):
                raise CollectError(f"environment variable {variable} is not set")
            given[k.removesuffix("_env")] = os.environ[variable]
            secrets.append(os.environ[variable])
        reader = spark.read.format(o["format"]).options(**{k: str(v) for k, v in given.items()})
        if "schema" in o:
            reader = reader.schema(o["schema"])
        try:
            rows = reader.load(o["path"]) if "path" in o else reader.load()
            if "columns" in o:
                rows = rows.select(*(f"`{c}`" for c in o["columns"]))
        except Exception as e:
            raise CollectError(scrubbed(str(e), secrets)) from None
        return Collected(keyed(rows, keys))


class Versions(Collector):
    """The rows of ``view`` that hold at the time of the collection: from column ``since`` on, and before column ``until`` where that is not null."""

    options = {"view": str, "key": (str, list), "since": str, "until": str}
    required = ("view", "key", "since", "until")

    def collect(self, spark: SparkSession, now: datetime) -> Collected:
        o, at = self.given, F.lit(now)
        keys = [o["key"]] if isinstance(o["key"], str) else o["key"]
        try:
            rows = spark.table(o["view"])
            rows = rows.where((F.col(o["since"]) <= at) & (F.col(o["until"]).isNull() | (F.col(o["until"]) > at))).drop(o["since"], o["until"])
        except Exception as e:
            raise CollectError(scrubbed(str(e), [])) from None
        return Collected(keyed(rows, keys))


def read_only(spark: SparkSession, sql: str, limit: int = 500):
    """Rows of a SELECT or WITH statement, and whether there are more than ``limit``."""
    if not re.match(r"\s*(select|with)\b", sql, re.I):
        raise CollectError("only SELECT and WITH queries are run")
    rows = spark.sql(sql).limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit
