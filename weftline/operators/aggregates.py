"""Aggregations, distinct sets, first-per-key, ordering and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.joins import first_of


def progress(records: DataFrame) -> DataFrame:
    """Counts of all, pending, completed and failed records in one scan."""
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "completed", "failed")),
    )


def pending_by_layer(records: DataFrame) -> DataFrame:
    return records.where("status = 'pending'").groupBy("target_type").agg(F.count(F.lit(1)).alias("pending"))


def coverage(files: DataFrame, keys: list[str]) -> DataFrame:
    done = (F.col("analysis_status") == "completed") | F.coalesce(F.col("llm_summary") != "", F.lit(False))
    return files.groupBy(*keys).agg(F.count_if(done).alias("analyzed"), F.count(F.lit(1)).alias("total"))


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table, by one aggregation over all of them."""
    names = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name")) for name, df in tables.items()])
    return names.agg(*(F.count_if(F.col("name") == name).alias(name) for name in tables))


def paths_of_tests(files: DataFrame) -> DataFrame:
    """Different paths that begin with "test"."""
    return files.where(F.col("path").startswith("test")).select("path").distinct()


def placed_in_file(entities: DataFrame) -> DataFrame:
    """Entities (id, file_id, start_line) with their place in the file, by line and id."""
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("start_line", "id"))
    return entities.withColumn("place", place.cast("long"))


def joined_names(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Distinct sorted values, joined by a comma."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(column)), ", ").alias(name))


def in_degree(edges: DataFrame) -> DataFrame:
    """Dependencies of each source, multi-edges counted."""
    return edges.groupBy("source").agg(F.count(F.lit(1)).alias("in_degree"))


def consistency(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence of several runs times 0.9, of one run itself, of none 0."""
    n, mean = F.count("confidence"), F.avg("confidence")
    return df.groupBy(*keys).agg(F.when(n == 0, 0.0).when(n == 1, mean).otherwise(mean * 0.9).alias("confidence"))


def first_result(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def first_imports(imports: DataFrame) -> DataFrame:
    """One import of each name per file, the first."""
    return first_of(imports, ["file_id", "name"], [F.col("place")])


def dedup_edges(edges: DataFrame, order: list[Column]) -> DataFrame:
    """One edge for each five-column key, the first by `order`."""
    return first_of(edges, ["source_type", "source_id", "target_type", "target_id", "edge_type"], order)


def staleness_action(diff: DataFrame) -> DataFrame:
    """Counts of the classes of a snapshot diff and a line that says what to do."""
    counts = diff.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("changed", "added", "deleted")))
    said = F.concat_ws(", ", *(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c}"))) for c in ("changed", "added", "deleted")))
    return counts.withColumn("is_stale", (F.col("changed") + F.col("added") + F.col("deleted")) > 0).withColumn(
        "action", F.when(F.col("is_stale"), F.concat(F.lit("rescan: "), said)).otherwise("up to date")
    )


def ranked_files(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Analyzed files with a summary first, then those with a summary, then others; by path. Ranked before the limit."""
    has = F.coalesce(F.col("llm_summary") != "", F.lit(False))
    rank = F.when((F.col("analysis_status") == "completed") & has, 0).when(has, 1).otherwise(2)
    ordered = found.withColumn("rank", rank).orderBy("rank", "path")
    return ordered if limit is None else ordered.limit(limit)


def take(df: DataFrame, limit: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def shortened(text: Column, limit: int = 80) -> Column:
    """The text's first characters, cut without a mark."""
    return F.substring(text, 1, limit)


def truncated(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)
