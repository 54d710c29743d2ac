"""Task queues in layers and levels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.filters import archived_wildcard
from weftline.operators.results import validated
from weftline.sources.shared import written


def _targets(files: DataFrame, symbols: DataFrame, equations: DataFrame, kind: str) -> DataFrame:
    """target_id, path: the targets of a kind that exist, with their file's path."""
    paths = files.select(F.col("id").alias("file_id"), "path")
    if kind == "file":
        return paths.withColumnRenamed("file_id", "target_id")
    things = symbols if kind == "symbol" else equations
    return things.select(F.col("id").alias("target_id"), "file_id").join(paths, "file_id").select("target_id", "path")


def run_queue(tasks: DataFrame, files: DataFrame, symbols: DataFrame, equations: DataFrame, analyze: Callable, parallel: int = 2) -> DataFrame:
    """target_type, target_id, status, output_json, error: the pending tasks (target_type, target_id, status) after a
    run, and all others as they were (completed ones are not analyzed again).

    `analyze` takes an iterator of pandas frames (target_type, target_id, path) and gives frames with output_json (and
    error, if a call failed) beside target_type and target_id; a null output fails. Tasks whose file lies in an archive
    or whose target is gone fail without a call; results are validated against the fields of their kind. A layer is
    written before the next one begins: files, symbols, equations. `parallel` partitions run at a time within it."""
    done = [tasks.where("status <> 'pending'").select("target_type", "target_id", "status", F.lit(None).cast("string").alias("output_json"), F.lit(None).cast("string").alias("error"))]
    columns = ["target_type", "target_id", "status", "output_json", "error"]
    for kind in ("file", "symbol", "equation"):
        layer = tasks.where((F.col("target_type") == kind) & (F.col("status") == "pending")).select("target_type", "target_id")
        placed = layer.join(_targets(files, symbols, equations, kind), "target_id", "left")
        skipped = F.when(F.col("path").isNull(), f"{kind} record missing").when(archived_wildcard(F.col("path")), "skipped: the file is archived")
        placed = written(placed.withColumn("error", skipped), "queue")
        lost = placed.where("error is not null").select("target_type", "target_id", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("output_json"), "error")
        calls = placed.where("error is null").select("target_type", "target_id", "path").repartition(parallel)
        answers = calls.mapInPandas(analyze, "target_type string, target_id long, output_json string, error string")
        judged = validated(answers.withColumnRenamed("error", "failure"), kind)
        error = F.coalesce("failure", F.when(F.col("output_json").isNull(), "empty result"), "error")
        told = judged.select("target_type", "target_id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), "output_json", error.alias("error"))
        done.append(written(told.select(*columns).unionByName(lost), "layer"))
    return reduce(DataFrame.unionByName, done)


def run_levels(levelled: DataFrame, files: DataFrame, analyze: Callable, result: str, parallel: int = 2) -> DataFrame:
    """Results of `analyze` on files, level after level of their dependencies (node: path, level), each written before
    the next begins. `analyze` takes an iterator of pandas frames (path, level); its result has path and error among its
    columns. Nodes that are no file give a row with an error."""
    known = written(levelled.join(files.select(F.col("path").alias("node"), F.lit(True).alias("_file")), "node", "left"), "levelled")
    numbers = [r["level"] for r in known.select("level").distinct().orderBy("level").collect()]  # a number a level
    done = [known.where("_file is null").select(F.col("node").alias("path"), F.lit("File not found").alias("error"))]
    for level in numbers:
        group = known.where((F.col("level") == level) & F.col("_file")).select(F.col("node").alias("path"), "level").repartition(parallel)
        done.append(written(group.mapInPandas(analyze, result), "level"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)


def progress(records: DataFrame) -> DataFrame:
    """done, failed, skipped, pending of a run's records; skipped are the failed ones of archived files."""
    skipped = F.coalesce(F.col("error").startswith("skipped"), F.lit(False))
    failed = F.col("status") == "failed"
    return records.agg(
        F.count_if(F.col("status") == "completed").alias("done"), F.count_if(failed & ~skipped).alias("failed"), F.count_if(failed & skipped).alias("skipped"), F.count_if(F.col("status") == "pending").alias("pending")
    )
