"""A watcher of source trees: what was added, changed or deleted since the last sweep, across restarts.

Each batch of the stream is a sweep of the tree: names, times and lengths. The state of a path holds the time and length
seen last and the digest of its content; a file is opened only where time or length differ, and has changed only if the
digest does. Every sighting moves the path's timer on; a path that a sweep does not see keeps its old timer, which runs
out in that batch, and is deleted. So a folder that cannot be listed for a sweep counts as deleted, and as added again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weftline.sources.scan import scanned, wanted
from weftline.sources.shared import written
from weftline.sources.tree import content_of, contents, file_system, register

CHANGES = "path string, uri string, modificationTime timestamp, length long, change string, hash string, error string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sightings(StatefulProcessor):
    """Keyed by path: sightings in, changes out."""

    def __init__(self, root: str):
        self.root = root

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "modified timestamp, length long, hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)
        now = max((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: r.modificationTime)
        before = self.seen.get() if self.seen.exists() else None
        if before is not None and (pd.Timestamp(before[0]), before[1]) == (now.modificationTime, now.length):
            return
        content, error = content_of(file_system(self.root)[0], now.uri, int(now.length))
        digest = None if content is None else hashlib.sha256(content).hexdigest()
        self.seen.update((now.modificationTime.to_pydatetime(), int(now.length), digest))
        if before is None or digest != before[2]:
            yield self.row(key[0], now.uri, now.modificationTime, now.length, "added" if before is None else "changed", digest, error)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        modified, length, digest = self.seen.get()
        self.seen.clear()
        yield self.row(key[0], None, modified, length, "deleted", digest, None)

    def row(self, *values) -> pd.DataFrame:
        return pd.DataFrame([values], columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def tree_changes(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """The stream of changes (CHANGES) of the tree's included files."""
    register(spark)
    source = spark.readStream.format("tree")
    if exclude is not None:
        source = source.option("exclude", json.dumps(exclude))
    seen = source.load(root).where(F.col("error").isNull() & wanted(F.col("path"), exclude))
    seen = seen.select("path", "uri", "modificationTime", "length")
    return seen.groupBy("path").transformWithStateInPandas(Sightings(root), CHANGES, "Update", "ProcessingTime")


def watch_tree(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, DataFrame, int], None], exclude: list[str] | None = None) -> StreamingQuery:
    """Hands each sweep's changes (path, change, hash, error) and the files table's rows of added and changed files to
    `handle`, with the batch's number; one sweep a call, state and progress are kept in `checkpoint`.

    A batch that fails is handed out again with the same number, with the changes of a new sweep of what it had not
    finished."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def each(batch: DataFrame, number: int) -> None:
        changes = written(batch, "changes")
        fresh = changes.where("change <> 'deleted' and error is null").withColumn("error", F.lit(None).cast("string"))
        handle(changes.select("path", "change", "hash", "error"), scanned(contents(fresh, root)), number)

    writer = tree_changes(spark, root, exclude).writeStream.foreachBatch(each).outputMode("update")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
