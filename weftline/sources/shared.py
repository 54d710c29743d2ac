"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; an own folder where it is unset and the session is local (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jsc.get() if jsc.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(spark.sparkContext, "_weftline_folder", None)
        if folder is None:
            folder = spark.sparkContext._weftline_folder = tempfile.mkdtemp(prefix="weftline-")
    return folder


#: Whether the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, *partitions: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors, and what
    later steps read of it is pruned and compressed. partitions: columns whose values get folders of their own. The
    write's shuffle files go with its end, as only the table is read from then on."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftline-{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partitions).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(df._weftline_path)
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
