"""What several corpus operators share: written intermediate tables, gapless ranks, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.sources.shared import release, shared_folder, written

__all__ = ["connected_components", "gapless_rank", "read_table", "release", "shared_folder", "written"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str, rows: int, share: int = 50_000) -> DataFrame:
    """Adds name: 0, 1, 2, ... within each group, without bringing a group into one task.

    Rows of a group fall into hash buckets, as many as keep about `share` of all `rows` in a bucket even if one group
    holds them all (at most 2**16 a group); bucket sizes are added up, and only a bucket's own rows are sorted
    together. Ties beyond `order` get an arbitrary order.
    """
    buckets = min(max(16, rows // share), 1 << 16)
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    ranked = bucketed.withColumn("_within", F.row_number().over(within) - 1)
    return (
        ranked.join(starts, [*group, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_within")).cast("long"))
        .drop("_bucket", "_start", "_within")
    )


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges (a, b: long).

    Alternates large-star and small-star steps (each two aggregations with map-side combine), written to the shared
    folder, until the edges are stars around their smallest member. Nothing but two numbers a round reaches the
    driver. Self loops are ignored; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = written(pairs, "edges"), None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        next_ = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, now = now, written(next_, "edges")
        release(before)
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
