"""A directory tree as records: relative path to size and text, or size and hash."""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.snapshot import CollectError
from tidemark.plans.scratch import settled
from tidemark.sources import tree
from tidemark.sources.base import Collected, Collector, tagged

MOST_TEXT = 65_536
READ = "key string, size long, text string, sha256 string, unread boolean"


class Directory(Collector):
    """Files below ``path``: size, and text if short valid UTF-8 without NUL, else a hash.

    Tasks list the folders (see tree.py) and read the files, dealt out anew by path; a folder that cannot be listed fails the run, one that ``exclude`` covers whole is never
    entered. A file that is there and cannot be read is unavailable, one that has gone meanwhile is absent. On a disk that all executors mount files are read in
    pieces, names that begin with a dot or an underscore included unless ``hidden`` is false; in any other store Spark's binaryFile reader lists and reads, which passes such names over.
    """

    options = {"path": str, "include": list, "exclude": list, "max_text_bytes": int, "hidden": bool}
    required = ("path",)
    ranges = {"max_text_bytes": (0, 1 << 31)}

    def __init__(self, **options):
        super().__init__(**options)
        self.include = [tree.glob_regex(p) for p in options.get("include", ["**"])]
        self.exclude = [tree.glob_regex(p) for p in options.get("exclude", [])]

    def collect(self, spark: SparkSession, now: datetime) -> Collected:
        root = self.given["path"].rstrip("/") or "/"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
            raise CollectError(f"{root} is not a directory")
        limit = self.given.get("max_text_bytes", MOST_TEXT)
        base = fs.getFileStatus(at).getPath()
        read = self._from_disk(spark, base.toUri().getPath(), limit) if fs.getScheme() == "file" else self._through_spark(spark, base.toString().rstrip("/"), limit)
        size = F.create_map(F.lit("size"), tagged(F.col("size"), "bigint"))
        body = F.when(F.col("text").isNotNull(), F.create_map(F.lit("text"), tagged(F.col("text"), "string"))).otherwise(F.create_map(F.lit("sha256"), tagged(F.col("sha256"), "string")))
        return Collected(read.where("not unread").select("key", F.map_concat(size, body).alias("fields")), unavailable=read.where("unread").select("key"))

    def _from_disk(self, spark: SparkSession, root: str, limit: int) -> DataFrame:
        o = self.given
        listing = tree.registered(spark).read.format(tree.NAME).option("include", json.dumps(o.get("include", ["**"]))).option("exclude", json.dumps(o.get("exclude", [])))
        listed = settled(listing.option("hidden", str(o.get("hidden", True)).lower()).load(root), "listed")
        lost = listed.where("error is not null").orderBy("key").first()
        if lost:
            raise CollectError(f"cannot list {lost.key or 'the directory'}: {lost.error}")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number that is not coalesced: paths are small and files are not
        paths = listed.select("key", "path").repartition(tasks, F.xxhash64("path"))
        return settled(paths.mapInArrow(lambda batches: _read_all(batches, limit), READ), "files")

    def _through_spark(self, spark: SparkSession, root: str, limit: int) -> DataFrame:
        """Lists and reads with binaryFile, which leaves out what it cannot read; that is unavailable if a second listing still finds it."""

        def found() -> DataFrame:
            files = spark.read.format("binaryFile").options(recursiveFileLookup="true", ignoreCorruptFiles="true", ignoreMissingFiles="true").load(root)
            files = files.withColumn("key", F.substring("path", len(root) + 2, 1 << 30))
            wanted = F.lit(False)
            for r in self.include:
                wanted = wanted | F.col("key").rlike(f"(?s)\\A(?:{r})\\z")
            for r in self.exclude:
                wanted = wanted & ~F.col("key").rlike(f"(?s)\\A(?:{r})\\z")
            hidden = F.col("key").rlike(r"(?:\A|/)[._]") if self.given.get("hidden", True) is False else F.lit(False)
            return files.where(wanted & ~hidden)

        listed = settled(found().select("key"), "listed")
        text = F.col("content").cast("string")
        plain = (F.col("length") <= limit) & F.is_valid_utf8(text) & (F.instr(text, "\0") == 0)
        rows = found().select("key", F.col("length").alias("size"), F.when(plain, text).alias("text"), F.when(~plain, F.sha2("content", 256)).alias("sha256"), F.lit(False).alias("unread"))
        rows = settled(rows, "read")
        missed = settled(listed.join(rows, "key", "left_anti"), "missed")
        if missed.isEmpty():
            return rows
        lost = missed.join(found().select("key"), "key", "left_semi")
        return rows.unionByName(lost.withColumn("unread", F.lit(True)), allowMissingColumns=True)


def _read_all(batches, limit: int):
    for b in batches:
        rows = [r for key, path in zip(*(c.to_pylist() for c in b.columns)) if (r := _read(key, path, limit))]
        key, size, text, sha, unread = zip(*rows) if rows else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((key, size, text, sha, unread), kinds)], ["key", "size", "text", "sha256", "unread"])


def _read(key: str, path: str, limit: int) -> tuple | None:
    """A row of READ; None for a file that is not there, or is none. At most ``limit`` bytes and a piece are held."""
    size, held, digest = 0, b"", hashlib.sha256()
    path = re.sub(r"^file:(//)?", "", path)
    try:
        if not stat.S_ISREG(os.stat(path).st_mode):
            return None
        with open(path, "rb") as f:
            while piece := f.read(1 << 20):
                size += len(piece)
                digest.update(piece)
                held = held + piece if size <= limit else b""
    except FileNotFoundError:
        return None
    except OSError:
        return key, None, None, None, True
    text = None
    if size <= limit and b"\0" not in held:
        try:
            text = held.decode("utf-8")
        except UnicodeDecodeError:
            pass
    return key, size, text, None if text is not None else digest.hexdigest(), False
