"""Source trees: listing, contents, and the data source "tree".

A tree is listed in rounds over tasks. A task takes folders, lists them and what lies below until it has seen STEP
entries, and hands back the folders that are left; these are dealt out again in the next round. So a small tree takes one
round, and a deep or wide one is spread over the cluster, whatever its shape. Excluded names are dropped where they are
listed: nothing below an excluded folder is listed, no excluded file is opened. Contents are read only for files that
are asked for, in tasks that get about READ bytes each. All names count, those with a leading dot or underscore too.

A folder that cannot be listed and a file that cannot be read are rows with an error and without content; so are files
above LARGEST bytes, as a value of a row holds 2 GB at most.

Paths in rows are relative to the root, with / between names; uri is what the file system calls the file. Local paths
and whatever Arrow's file systems know by a URI (file, hdfs, s3, gs) can be read.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from weftline.functions.scalars import glob_regex
from weftline.functions.values import EXCLUDE
from weftline.sources.shared import release, written

#: Entries that a listing task sees before it hands the rest back; bytes that a reading task gets; bytes of a file at most.
STEP, READ, LARGEST = 20_000, 64 << 20, 1 << 30
LISTED = "path string, uri string, modificationTime timestamp, length long, error string"
RAW = "path string, uri string, modificationTime timestamp, length long, content binary, error string"


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root, and the root's path in it."""
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
    return pafs.LocalFileSystem(), root


def left_out(exclude: list[str] | None) -> Callable[[str], bool]:
    """Whether a name fits a glob; without globs the default ones, none for an empty list."""
    globs = EXCLUDE if exclude is None else exclude
    if not globs:
        return lambda name: False
    rx = re.compile("|".join(f"(?:{glob_regex(g).removeprefix('(?s)')})" for g in globs), re.DOTALL)
    return lambda name: rx.search(name) is not None


def is_link(fs: pafs.FileSystem, path: str) -> bool:
    """Links to folders are not followed; only local trees have them."""
    return isinstance(fs, pafs.LocalFileSystem) and os.path.islink(path)


def walk(fs: pafs.FileSystem, top: str, folders: deque, drop: Callable[[str], bool], budget: int) -> Iterator[tuple]:
    """(path, uri, mtime, length, error) of the files below `folders`, which are used up, breadth first, until `budget`
    entries were seen; then what is left in `folders` is not yet listed."""
    while folders and budget > 0:
        folder = folders.popleft()
        try:
            entries = fs.get_file_info(pafs.FileSelector(folder))
        except OSError as e:
            yield posixpath.relpath(folder, top), folder, None, None, f"{type(e).__name__}: {e}"
            continue
        budget -= 1 + len(entries)
        for entry in entries:
            if drop(entry.base_name):
                continue
            if entry.type == pafs.FileType.Directory:
                if not is_link(fs, entry.path):
                    folders.append(entry.path)
            elif entry.type == pafs.FileType.File:
                yield posixpath.relpath(entry.path, top), entry.path, entry.mtime, entry.size, None


def content_of(fs: pafs.FileSystem, uri: str, length: int | None) -> tuple[bytes | None, str | None]:
    """A file's bytes, or why there are none."""
    if length is not None and length > LARGEST:
        return None, f"larger than {LARGEST} bytes"
    try:
        with fs.open_input_stream(uri) as f:
            return f.read(), None
    except OSError as e:
        return None, f"{type(e).__name__}: {e}"


def listed(spark: SparkSession, root: str, exclude: list[str] | None = None, step: int = STEP) -> DataFrame:
    """The tree's files that are not excluded (LISTED), and an error row for each folder that cannot be listed."""
    folders = spark.createDataFrame([(file_system(root)[1].rstrip("/") or "/",)], "folder string")
    top = folders.first()["folder"]

    def lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop, fs, open_ = left_out(exclude), file_system(root)[0], deque()
        for frame in frames:
            open_.extend(frame["folder"])
        rows = []
        for row in walk(fs, top, open_, drop, step):
            rows.append((*row, None))
            if len(rows) == 5000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        rows += [(None, None, None, None, None, folder) for folder in open_]
        yield pd.DataFrame(rows, columns=names)

    names = ["path", "uri", "modificationTime", "length", "error", "folder"]
    rounds = []
    while True:
        rounds.append(written(folders.mapInPandas(lists, f"{LISTED}, folder string"), "listing"))
        # each round's open folders are dealt anew
        left = rounds[-1].where("folder is not null").select("folder")
        count = left.count()
        if not count:
            break
        folders = left.repartition(min(count, 4 * spark.sparkContext.defaultParallelism))
    out = rounds[0]
    for other in rounds[1:]:
        out = out.unionByName(other)
    found = written(out.where("folder is null").drop("folder"), "listed")
    for table in rounds:
        release(table)
    return found


def contents(files: DataFrame, root: str, read: int = READ) -> DataFrame:
    """RAW rows of files (LISTED), a written table, read in tasks that get about `read` bytes each."""
    total = files.agg(F.sum(F.coalesce("length", F.lit(0)) + 4096)).first()[0] or 0

    def reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = None
        for batch in batches:
            fs = fs or file_system(root)[0]
            for i in range(batch.num_rows):  # a file at a time: contents are large
                row = batch.slice(i, 1)
                uri, length, error = (row.column(c)[0].as_py() for c in ("uri", "length", "error"))
                content, error = (None, error) if error else content_of(fs, uri, length)
                kept = [row.column(c) for c in ("path", "uri", "modificationTime", "length")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([content], pa.binary()), pa.array([error], pa.string())], ["path", "uri", "modificationTime", "length", "content", "error"])

    return files.repartition(max(1, -(-total // read)), "path").mapInArrow(reads, RAW)


def one_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The RAW row of one file, none if there is no such file."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = file_system(folder)
        for frame in frames:
            for name in frame["name"]:
                info = fs.get_file_info(posixpath.join(top, name))
                if info.type == pafs.FileType.File:
                    content, error = content_of(fs, info.path, info.size)
                    yield pd.DataFrame([(name, info.path, info.mtime, info.size, content, error)], columns=["path", "uri", "modificationTime", "length", "content", "error"])

    return spark.createDataFrame([(name,)], "name string").mapInPandas(look, RAW)


class Folders(InputPartition):
    """Folders that one task lists; whether with all that is below them."""

    def __init__(self, folders: list[str], deep: bool):
        self.folders, self.deep = folders, deep


class TreeReader(DataSourceReader):
    """Lists from the root on until there are `folders` folders; each of these, with what is below it, is a partition,
    and the folders above them are one more."""

    def __init__(self, options: dict):
        self.root, self.wanted = options["path"], int(options.get("folders", "64"))
        self.exclude = json.loads(options["exclude"]) if "exclude" in options else None
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        (fs, top), drop, above = file_system(self.root), left_out(self.exclude), []
        top = top.rstrip("/") or "/"
        open_ = deque([top])
        while open_ and len(open_) < self.wanted:
            folder = open_.popleft()
            above.append(folder)
            try:
                open_.extend(e.path for e in fs.get_file_info(pafs.FileSelector(folder)) if e.type == pafs.FileType.Directory and not drop(e.base_name) and not is_link(fs, e.path))
            except OSError:
                pass  # becomes an error row where it is read
        return [Folders(above, False), *(Folders([f], True) for f in open_)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        (fs, top), drop = file_system(self.root), left_out(self.exclude)
        top, folders = top.rstrip("/") or "/", deque(partition.folders)
        groups = [folders] if partition.deep else [deque([f]) for f in folders]
        for group in groups:
            for path, uri, mtime, length, error in walk(fs, top, group, drop, 1 << 62 if partition.deep else 1):
                content, error = content_of(fs, uri, length) if self.content and not error else (None, error)
                yield path, uri, mtime, length, content, error


class TreeStream(DataSourceStreamReader):
    """Every batch is a sweep: all files, without contents, at the time of the batch."""

    def __init__(self, options: dict):
        self.reader = TreeReader({**options, "content": "false"})

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.reader.partitions()

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class TreeSource(DataSource):
    """Format "tree". Options: path; exclude (globs as a JSON list); folders (partitions, about); content (false: only
    names, times and lengths, as streams always do)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes format "tree" known to the session; a second time changes nothing."""
    spark.dataSource.register(TreeSource)
