"""Parquet folders dealt into buckets by a key, so that what is joined on the key again is not shuffled again.

A bucketed folder is read through an external table of the session's catalog, as Spark keeps the layout there and not with the files. Such a table has
a name of its own, goes at the end of ``tables`` and never takes its files along.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_made: list[list[str]] = []


@contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """Folders are read as buckets inside; nothing that reads them may outlive it."""
    _made.append([])
    try:
        yield
    finally:
        for name in _made.pop():
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def count_for(rows: int, most_rows: int = 500_000) -> int:
    """Buckets for so many rows: the least power of two of which one holds at most ``most_rows`` on average."""
    n = 1
    while rows > n * most_rows:
        n *= 2
    return n


def write(df: DataFrame, path: str, key: str, n: int) -> None:
    """Writes df in ``n`` buckets sorted by the key. Nothing is shuffled: a task writes a file for each bucket that it has rows of, so deal df by the key before."""
    name = f"tidemark_{uuid.uuid4().hex}"
    try:
        df.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def read(spark: SparkSession, path: str, schema: StructType, key: str, n: int) -> DataFrame:
    """A folder that ``write`` made, with its buckets; outside ``tables`` as plain Parquet."""
    if not _made:
        return spark.read.schema(schema).parquet(path)
    name = f"tidemark_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    at = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {n} BUCKETS LOCATION '{at}'")
    _made[-1].append(name)
    return spark.table(name)
