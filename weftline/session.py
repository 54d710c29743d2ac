"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "weftline", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Bytes of the batches that tasks hand to Python: long texts come a few at a time.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, so that tasks can import it; bound Arrow batches, where
    the session has no smaller bound of its own.

    The archive holds only the package's own .py files; Spark's file server hands it out.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH, "64m") in ("64m", "64MB", "67108864b", "67108864"):
        spark.conf.set(BATCH, BATCH_BYTES)
    if getattr(sc, "_weftline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("weftline", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._weftline_shipped = True
