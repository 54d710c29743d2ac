"""Changes of tables as rewrites: upsert, insert-ignore, cascades, snapshots, schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Paths of a snapshot's JSON document, about.
DOCUMENT = 10000


def upsert(table: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """New keys are inserted; of known keys only the `updated` columns change."""
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    on = [table[k] == n[f"n_{k}"] for k in keys]
    joined = table.join(n, on, "full_outer")
    there = table[keys[0]].isNotNull()
    cells = []
    for c in table.columns:
        if f"n_{c}" not in n.columns:
            cells.append(table[c])
        elif c in updated:
            cells.append(F.when(n[f"n_{keys[0]}"].isNotNull(), n[f"n_{c}"]).otherwise(table[c]).alias(c))
        else:
            cells.append(F.when(there, table[c]).otherwise(n[f"n_{c}"]).alias(c))
    return joined.select(*cells)


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def nodes_of_files(dead: DataFrame, symbols: DataFrame, equations: DataFrame, variables: DataFrame) -> DataFrame:
    """(node_type, node_id) of the files (id) and of all they hold."""
    keys = dead.select(F.col("id").alias("file_id")).distinct()
    parts = [keys.select(F.lit("file").alias("node_type"), F.col("file_id").alias("node_id"))]
    for kind, table in (("symbol", symbols), ("equation", equations), ("variable", variables)):
        parts.append(table.join(keys, "file_id", "left_semi").select(F.lit(kind).alias("node_type"), F.col("id").alias("node_id")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def cascade_edges(edges: DataFrame, dead: DataFrame) -> DataFrame:
    """Edges that touch no dead node at either end."""
    s = dead.select(F.col("node_type").alias("source_type"), F.col("node_id").alias("source_id"))
    t = dead.select(F.col("node_type").alias("target_type"), F.col("node_id").alias("target_id"))
    return edges.join(s, ["source_type", "source_id"], "left_anti").join(t, ["target_type", "target_id"], "left_anti")


def without_node(edges: DataFrame, node_type: str, node_id: int) -> DataFrame:
    """Edges that do not touch the node."""
    s = (F.col("source_type") == node_type) & (F.col("source_id") == node_id)
    t = (F.col("target_type") == node_type) & (F.col("target_id") == node_id)
    return edges.where(~(s | t))


def symbols_in_order(functions: DataFrame, classes: DataFrame, variables: DataFrame) -> DataFrame:
    """One table of symbols (file_id, name, start_line) with kind and place: functions, then classes, then variables, each by file
    and line, as they are stored."""
    parts = [functions.withColumns({"kind": F.lit("function"), "_k": F.lit(0)}), classes.withColumns({"kind": F.lit("class"), "_k": F.lit(1)}), variables.withColumns({"kind": F.lit("variable"), "_k": F.lit(2)})]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("_k", "start_line", "id"))
    return rows.withColumn("place", place).drop("_k")


def stale_records(records: DataFrame, dead: DataFrame) -> DataFrame:
    """Records of dead nodes become stale."""
    d = dead.select(F.col("node_type").alias("target_type"), F.col("node_id").alias("target_id"), F.lit(True).alias("_dead")).distinct()
    joined = records.join(d, ["target_type", "target_id"], "left")
    return joined.withColumn("status", F.when(F.col("_dead"), "stale").otherwise(F.col("status"))).drop("_dead")


def snapshot_json(files: DataFrame) -> DataFrame:
    """JSON documents {"files": {path: hash}}, sorted by path: one for up to DOCUMENT paths, else one for each hash
    bucket of paths, with as many buckets as keep about DOCUMENT paths in each."""
    mapped = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "hash"))))
    buckets = max(1, -(-files.count() // DOCUMENT))
    grouped = files if buckets == 1 else files.groupBy(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket"))
    return grouped.agg(F.to_json(F.struct(mapped.alias("files"))).alias("snapshot")).select("snapshot")


def read_snapshot(documents: DataFrame, column: str = "snapshot") -> DataFrame:
    """(path, hash) of snapshot documents; a bare {path: hash} is read too, anything else gives no rows."""
    wrapped = F.from_json(F.col(column), "files map<string,string>")["files"]
    bare = F.from_json(F.col(column), T.MapType(T.StringType(), T.StringType()))
    return documents.select(F.explode(F.coalesce(wrapped, bare)).alias("path", "hash"))


def audit(operation: str, result: DataFrame, columns: list[str]) -> DataFrame:
    """An audit row: the operation, how many rows it gave, and their keys' digest (of sums over the different keys'
    hashes, so no task holds them all)."""
    keys = result.groupBy(F.xxhash64(*columns).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string")
    digest = F.sha2(F.concat_ws(",", total(F.col("h")), total(F.xxhash64("h", F.lit("audit")))), 256)
    return keys.agg(F.lit(operation).alias("operation_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("affected"), digest.alias("digest"))


def with_columns_added(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns that it lacks, as nulls."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})
