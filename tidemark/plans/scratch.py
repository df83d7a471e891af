"""Written intermediate tables in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: list[str] = []
_scopes: list[list[str]] = []
#: Where each settled table lies: kept beside the frames, as an attribute of a frame is also any column of that name.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder. Where the setting is unset, a fresh local folder serves a driver that is its own only executor; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _own[0]


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What is written there goes when its scope ends, when it is dropped, or when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    for made in _scopes[-1:]:
        made.append(path)
    return path


def write_table(df: DataFrame, label: str) -> str:
    """Writes df as Parquet to a new folder and returns where."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return path


def outlasting(df: DataFrame, label: str) -> DataFrame:
    """settled, but the table outlives the scope that it is made in."""
    out = settled(df, label)
    for made in _scopes[-1:]:
        made.remove(_places[out])
    return out


def reread(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def settled(df: DataFrame, label: str) -> DataFrame:
    """Evaluates df once, as a table: later reads agree on it and a lost executor costs nothing upstream."""
    path = write_table(df, label)
    out = reread(df.sparkSession, path, df.schema)
    _places[out] = path
    return out


def noted(df: DataFrame, notes: dict[str, Column]) -> tuple[DataFrame, Callable[[], dict]]:
    """df, and what the aggregates ``notes`` come to in the first action on it, once that is over: no job of their own."""
    seen = Observation()
    return df.observe(seen, *(c.alias(name) for name, c in notes.items())), lambda: seen.get


def is_settled(df: DataFrame) -> bool:
    return df in _places


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table made by write_table, through Hadoop's file system so that any store works."""
    fs, at = _file(spark, path)
    fs.delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by settled, once nothing that is still to run reads them."""
    for t in tables:
        drop_table(t.sparkSession, _places[t])


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end, whether or not it ended well; nothing that reads them may outlive it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_table(spark, path)


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
