"""Predicates and projections on the graph's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.values import IMPACT_EDGES

SEARCHED = ["filename", "path", "purpose", "llm_summary", "key_concepts", "risk_notes"]


def by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def by_name_or_qualified(symbols: DataFrame, name: str | None, qualified: str | None) -> DataFrame:
    """Either name fits (OR); a name that is None fits nothing."""
    return symbols.where((F.col("name") == F.lit(name)) | (F.col("qualified_name") == F.lit(qualified)))


def contains_any(columns: list[str], query: str) -> Column:
    """Substring, case-insensitive, in any column; % and _ in the query stay wildcards; a null column does not fit."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in columns])


def search_files(files: DataFrame, query: str, only_analyzed: bool = False) -> DataFrame:
    found = files.where(contains_any(SEARCHED, query))
    return found.where(F.col("analysis_status") == "completed") if only_analyzed else found


def equations_with(equations: DataFrame, keyword: str, name: str | None = None) -> DataFrame:
    fits = F.col("expression").ilike(f"%{keyword}%")
    return equations.where(fits | (F.col("name") == F.lit(name)) if name is not None else fits)


def of_kinds(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(kinds))


def archived_wildcard(path: Column) -> Column:
    """_archive as a part below the root; _ is a wildcard, so any character may stand there."""
    return path.like("%/_archive/%") | path.like("%\\\\_archive\\\\%")


def archived_substring(path: Column) -> Column:
    """_archive/ anywhere, also at the root or as the end of a longer name."""
    return path.contains("_archive/") | path.contains("_archive\\")


def confident(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Null confidence does not fit."""
    return df.where(F.col("confidence") >= least)


def with_status(records: DataFrame, status: str) -> DataFrame:
    return records.where(F.col("status") == status)


def touching(edges: DataFrame, node_type: str, node_id: int) -> DataFrame:
    """Edges with the node at either end."""
    source = (F.col("source_type") == node_type) & (F.col("source_id") == node_id)
    target = (F.col("target_type") == node_type) & (F.col("target_id") == node_id)
    return edges.where(source | target)


def on_line(entities: DataFrame, line: int) -> DataFrame:
    """Entities whose lines hold the line."""
    return entities.where(F.lit(line).between(F.col("start_line"), F.col("end_line")))


def undone(joined: DataFrame) -> DataFrame:
    """After an outer join with records: no record, or a pending one."""
    return joined.where(F.col("record_id").isNull() | (F.col("status") == "pending"))


def impact_edges(edges: DataFrame) -> DataFrame:
    return of_kinds(edges, "edge_type", IMPACT_EDGES)


def file_output(files: DataFrame) -> DataFrame:
    """Files as searches give them; a missing summary is empty."""
    return files.select("id", "path", "language", "size_bytes", F.coalesce("llm_summary", F.lit("")).alias("summary"), "is_core")


def symbol_output(symbols: DataFrame) -> DataFrame:
    """Symbols as a file's query gives them."""
    return symbols.select("id", "name", "qualified_name", F.col("symbol_type").alias("type"), "start_line", "end_line")


def equation_output(equations: DataFrame) -> DataFrame:
    """Equations as a file's query gives them."""
    return equations.select("id", "name", F.col("equation_type").alias("type"), "expression", "start_line")
