"""A queue of analysis tasks that can be taken up again: batches with numbers, each written once.

Pending tasks are put in order (files, symbols, equations, each by id) and numbered; batch b holds tasks b * size to
(b + 1) * size - 1 of the order that was stored when the run began. What a batch gives is written to a folder of its
number in one step, so a batch is there as a whole or not at all: a run that ends early repeats the one batch it was in,
and no other call. A call that fails is a row with an error, not the end of the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.filters import archived_wildcard
from weftline.operators.results import validated
from weftline.streaming.rescan import _targets

LAYERS = ("file", "symbol", "equation")
RESULT = "target_type string, target_id long, status string, output_json string, error string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def enqueue(tasks: DataFrame, files: DataFrame, symbols: DataFrame, equations: DataFrame, store: str, size: int = 10) -> int:
    """Stores the pending tasks (target_type, target_id, status) with their files' paths and batches, unless the store has
    an order already; the number of batches. Tasks are numbered by range parts and prefix sums, not in one task."""
    spark = tasks.sparkSession
    if not _exists(spark, f"{store}/order/_SUCCESS"):
        layer = F.coalesce(*(F.when(F.col("target_type") == k, i) for i, k in enumerate(LAYERS)))
        paths = reduce(DataFrame.unionByName, [_targets(files, symbols, equations, k).withColumn("target_type", F.lit(k)) for k in LAYERS])
        pending = tasks.where("status = 'pending'").select("target_type", "target_id").distinct().withColumn("layer", layer).where("layer is not null")
        placed = pending.join(paths, ["target_type", "target_id"], "left")
        placed.repartitionByRange("layer", "target_id").sortWithinPartitions("layer", "target_id").withColumn("at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{store}/parts")
        at = spark.read.parquet(f"{store}/parts").withColumn("part", F.shiftright("at", 33))
        counts = sorted((r["part"], r["count"]) for r in at.groupBy("part").count().collect())  # a number a part
        starts = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
        start = spark.createDataFrame(starts, "part long, start long")
        number = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        at.join(F.broadcast(start), "part").select("target_type", "target_id", "path", F.floor(number / size).alias("batch")).write.partitionBy("batch").mode("overwrite").parquet(f"{store}/order")
    order = spark.read.schema("target_type string, target_id long, path string, batch long").parquet(f"{store}/order")
    return (order.agg(F.max("batch")).first()[0] or 0) + 1 if not order.isEmpty() else 0


def _safely(call: Callable[[str, int, str], str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    rows.append((r.target_type, r.target_id, call(r.target_type, r.target_id, r.path), None))
                except Exception as e:  # noqa: BLE001 - whatever a call raises is its result
                    rows.append((r.target_type, r.target_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["target_type", "target_id", "output_json", "failure"])

    return run


def run_batch(spark: SparkSession, call: Callable[[str, int, str], str], store: str, number: int, parallel: int = 2) -> None:
    """Runs one batch and writes its results; nothing if they are there."""
    if _exists(spark, f"{store}/done/batch={number}/_SUCCESS"):
        return
    batch = spark.read.schema("target_type string, target_id long, path string").parquet(f"{store}/order/batch={number}")
    skipped = F.when(F.col("path").isNull(), F.concat("target_type", F.lit(" record missing"))).when(archived_wildcard(F.col("path")), "skipped: the file is archived")
    batch = batch.withColumn("error", skipped)
    null = F.lit(None).cast("string").alias("output_json")
    parts = [batch.where("error is not null").select("target_type", "target_id", F.lit("failed").alias("status"), null, "error")]
    # a batch's calls are made once, before results are judged by kind
    answers = batch.where("error is null").select("target_type", "target_id", "path").repartition(parallel).mapInPandas(_safely(call), "target_type string, target_id long, output_json string, failure string")
    answers.write.mode("overwrite").parquet(f"{store}/answers/batch={number}")
    answers = spark.read.schema("target_type string, target_id long, output_json string, failure string").parquet(f"{store}/answers/batch={number}")
    for kind in LAYERS:
        judged = validated(answers.where(F.col("target_type") == kind), kind)
        error = F.coalesce("failure", F.when(F.col("output_json").isNull(), "empty result"), "error")
        parts.append(judged.select("target_type", "target_id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), "output_json", error.alias("error")))
    reduce(DataFrame.unionByName, parts).coalesce(1).write.mode("overwrite").parquet(f"{store}/done/batch={number}")


def run_stored(spark: SparkSession, batches: int, call: Callable[[str, int, str], str], store: str, parallel: int = 2) -> DataFrame:
    """Runs all batches of a stored queue that are not done, in order; RESULT of all. `call` takes a target's kind, id and
    path and gives its result as JSON text; `parallel` of them run at a time."""
    for number in range(batches):
        run_batch(spark, call, store, number, parallel)
    return results(spark, batches, store)


def results(spark: SparkSession, batches: int, store: str) -> DataFrame:
    """RESULT of the batches that are done so far."""
    done = [f"{store}/done/batch={n}" for n in range(batches) if _exists(spark, f"{store}/done/batch={n}/_SUCCESS")]
    return spark.read.schema(RESULT).parquet(*done) if done else spark.createDataFrame([], RESULT)
