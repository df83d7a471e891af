"""A file tree as a data source: ``spark.read.format("tidemark_tree").load(folder)`` lists it, ``df.write.format("tidemark_tree")`` writes one file a row.

The planner lists folders only until it knows enough of them to deal out; tasks list the rest, each its own part. Executors need to reach the
tree: a disk that all of them mount, or a store that Arrow's file systems know (hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "tidemark_tree"
LISTED = "key string, path string, error string"
FILES = "key string, content binary"
#: Folders that the planner wants to know before it deals them out, and rows of a batch.
FOLDERS, BATCH = 256, 4096


def glob_regex(pattern: str) -> str:
    """A pattern as a regular expression for a whole relative path: ``**`` alone in a segment spans directories, ``*`` and ``?`` stay
    within one and match leading dots, ``[!x]`` never matches a slash."""
    out = []
    segments = pattern.split("/")
    for n, segment in enumerate(segments):
        last = n + 1 == len(segments)
        if segment == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
        else:
            out.append(re.sub(r"\*+|\?|\[!?\]?[^\]]*\]|.", _glob_part, segment, flags=re.S) + ("" if last else "/"))
    regex = "".join(out)
    try:
        re.compile(regex)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from None
    return regex


def _glob_part(m: re.Match) -> str:
    part = m.group()
    if part[0] == "*":
        return "[^/]*"
    if part == "?":
        return "[^/]"
    if part[0] == "[" and len(part) > 2:
        inner = part[1:-1]
        negated, inner = inner[0] == "!", inner.removeprefix("!")
        return "[" + ("^/" if negated else "") + re.sub(r"[^\w-]", lambda c: "\\" + c.group(), inner) + "]"
    return re.escape(part)


def pruned(exclude: list[str]) -> list[str]:
    """Regular expressions of the folders that a pattern ending in /** covers whole, so that they need not be listed."""
    return [".*" if p == "**" else glob_regex(p[: -len("/**")]) for p in exclude if p == "**" or p.endswith("/**")]


class Disk:
    """A mounted disk. Links to folders are not followed, links to files are."""

    def entries(self, folder: str) -> Iterator[tuple[str, bool]]:
        """(name, whether it is a folder) of what is to be looked at; names that are no text are left out."""
        with os.scandir(folder) as found:
            for e in found:
                if not e.name.isascii() and any("\ud800" <= c <= "\udfff" for c in e.name):
                    continue
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True
                elif not e.is_symlink() or not e.is_dir():
                    yield e.name, False

    def read(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    def arrow(self):
        from pyarrow.fs import LocalFileSystem

        return LocalFileSystem()

    def write(self, path: str, content: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(own, "wb") as f:
            f.write(content)
        os.replace(own, path)

    def delete(self, path: str) -> None:
        os.unlink(path)


class Remote:
    """A store that Arrow knows by its address."""

    def __init__(self, fs):
        self.fs = fs

    def entries(self, folder: str) -> Iterator[tuple[str, bool]]:
        from pyarrow.fs import FileSelector, FileType

        for info in self.fs.get_file_info(FileSelector(folder)):
            if info.type != FileType.NotFound:
                yield info.base_name, info.type == FileType.Directory

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(path) as f:
            return f.read()

    def arrow(self):
        return self.fs

    def write(self, path: str, content: bytes) -> None:
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(own) as f:
            f.write(content)
        self.fs.move(own, path)

    def delete(self, path: str) -> None:
        self.fs.delete_file(path)


def opened(path: str) -> tuple[Disk | Remote, str]:
    """The store of an address, and the path within it."""
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", path)
    if scheme is None or scheme[1] == "file":
        return Disk(), re.sub(r"^file:(//)?", "", path).rstrip("/") or "/"
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    return Remote(fs), at.rstrip("/") or "/"


class Tree(DataSource):
    """Reading gives LISTED: a row for each file (key: its path below the folder), and one with an ``error`` for each folder that cannot be listed.

    Options: ``include`` and ``exclude``, JSON lists of patterns; ``hidden`` false leaves out names that begin with a dot or an underscore; ``folders``. A folder
    that ``exclude`` covers whole is never entered. Writing takes FILES: each row's bytes under its key, visible whole or not at all.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["path"])


@dataclass
class Share(InputPartition):
    """Folders to list, with all that is below them or by themselves."""

    folders: list[str]
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.include = [glob_regex(p) for p in json.loads(options.get("include", '["**"]'))]
        excluded = json.loads(options.get("exclude", "[]"))
        self.exclude, self.prune = [glob_regex(p) for p in excluded], pruned(excluded)
        self.hidden = options.get("hidden", "true").lower() != "false"
        self.folders = int(options.get("folders", FOLDERS))

    def partitions(self) -> list[Share]:
        """Breadth first: folders whose subfolders are known are listed by themselves, the ones further down with all below them."""
        store, root = opened(self.root)
        known, todo = [], deque([""])
        while todo and len(known) + len(todo) < self.folders:
            folder = todo.popleft()
            known.append(folder)
            try:
                todo.extend(folder + name + "/" for name, is_folder in store.entries(f"{root}/{folder}") if is_folder and self._enters(folder + name))
            except OSError:  # the task that lists it will say so
                pass
        groups = min(len(todo), 4 * self.folders)
        return [Share([f], False) for f in known] + [Share(list(todo)[i::groups], True) for i in range(groups)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.root)
        rows, todo = [], list(share.folders)
        while todo:
            folder = todo.pop()
            try:
                for name, is_folder in store.entries(f"{root}/{folder}"):
                    key = folder + name
                    if not is_folder:
                        if self._wants(key):
                            rows.append((key, f"{self.root.rstrip('/')}/{key}", None))
                    elif share.deep and self._enters(key):
                        todo.append(key + "/")
                    if len(rows) >= BATCH:
                        yield _batch(rows)
                        rows = []
            except FileNotFoundError as e:
                if not folder:  # the root itself; a folder that went meanwhile holds nothing
                    rows.append((folder, None, type(e).__name__))
            except OSError as e:
                rows.append((folder.rstrip("/"), None, type(e).__name__))
        if rows:
            yield _batch(rows)

    def _enters(self, key: str) -> bool:
        return not _fits(self.prune, key) and (self.hidden or not is_hidden(key))

    def _wants(self, key: str) -> bool:
        return _fits(self.include, key) and not _fits(self.exclude, key) and (self.hidden or not is_hidden(key))


def is_hidden(key: str) -> bool:
    return any(part[:1] in "._" for part in key.split("/"))


def _fits(regexes: list[str], key: str) -> bool:
    return any(re.fullmatch(r, key, re.S) for r in regexes)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["key", "path", "error"])


@dataclass
class Wrote(WriterCommitMessage):
    keys: list[str]


class TreeWriter(DataSourceWriter):
    """A failed job takes back the files that its finished tasks wrote; a task that runs again writes the same files again."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows) -> Wrote:
        store, root = opened(self.root)
        keys = []
        for row in rows:
            parts = row.key.split("/")
            if not all(parts) or {".", ".."} & set(parts) or "\0" in row.key:
                raise ValueError(f"{row.key!r} is no path below a folder")
            store.write(f"{root}/{row.key}", bytes(row.content))
            keys.append(row.key)
        return Wrote(keys)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        store, root = opened(self.root)
        for message in messages:
            for key in message.keys if message else ():
                store.delete(f"{root}/{key}")


def registered(spark: SparkSession) -> SparkSession:
    """``spark``, which knows the source by its name from now on."""
    spark.dataSource.register(Tree)
    return spark
