"""Edge emission and resolution, analysis tasks and records, edges derived from analysis results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.values import BY_ANALYSIS, BY_EXTRACTION, DERIVED_EDGES, EQUATION_LISTS
from weftline.operators.filters import archived_wildcard, undone
from weftline.operators.joins import equations_by_name, first_of, imports_by_name, symbols_by_name, with_records

EDGE_KEY = ["source_type", "source_id", "target_type", "target_id", "edge_type"]


def edge(source_type, source_id, target_type, target_id, edge_type, evidence, confidence, by) -> list[Column]:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = [source_type, source_id, target_type, target_id, edge_type, evidence, confidence, by]
    names = [*EDGE_KEY, "evidence", "confidence", "created_by"]
    return [as_column(v).alias(n) for v, n in zip(values, names, strict=True)]


def static_edges(symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """DEFINES edges, and raw IMPORTS and CALLS edges with target 0 and the name in their evidence.

    symbols: id, file_id; imports: file_id, name; calls: caller_id, name."""
    by = BY_EXTRACTION
    return reduce(
        DataFrame.unionByName,
        [
            symbols.select(*edge("file", F.col("file_id"), "symbol", F.col("id"), "DEFINES", "static analysis", 1.0, by)),
            imports.select(*edge("file", F.col("file_id"), "file", F.lit(0).cast("long"), "IMPORTS", F.concat(F.lit("Import: "), "name"), 1.0, by)),
            calls.select(*edge("symbol", F.col("caller_id"), "symbol", F.lit(0).cast("long"), "CALLS", F.concat(F.lit("Call to "), "name"), 0.8, by)),
        ],
    )


def name_in(evidence: Column) -> Column:
    return F.trim(F.replace(F.replace(evidence, F.lit("Import: "), F.lit("")), F.lit("Call to "), F.lit("")))


def resolve_edges(raw: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Raw edges with targets found by name and confidence 0.9; unresolved ones go, equal keys become one. Edges of
    other types stay as they are. The answer is the same when resolved edges are resolved again."""
    open_ = raw.where((F.col("target_id") == 0) & F.col("edge_type").isin("IMPORTS", "CALLS")).withColumn("name", name_in(F.col("evidence")))
    imports = open_.where("edge_type = 'IMPORTS'")
    calls = open_.where("edge_type = 'CALLS'")
    found = imports.join(imports_by_name(imports, files).withColumnRenamed("file_id", "found"), "name").unionByName(
        calls.join(symbols_by_name(calls, symbols).withColumnRenamed("symbol_id", "found"), "name")
    )
    found = found.withColumns({"target_id": F.col("found"), "confidence": F.lit(0.9)}).drop("found", "name")
    rest = raw.where(~((F.col("target_id") == 0) & F.col("edge_type").isin("IMPORTS", "CALLS")))
    return first_of(rest.unionByName(found), EDGE_KEY, [F.col("evidence")])


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and those of new whose key is not there yet, each key once."""
    fresh = first_of(new, EDGE_KEY, [F.desc("confidence"), F.col("evidence")]).join(edges.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return edges.unionByName(fresh)


def new_variables(variables: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (file_id, symbol_id, name, role) that no variable has; null symbols are equal to each other."""
    wanted = wanted.dropDuplicates(["file_id", "symbol_id", "name", "role"])
    there = variables.alias("v")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("file_id", "symbol_id", "name", "role")]
    return wanted.alias("w").join(there, reduce(lambda a, b: a & b, same), "left_anti")


def trusted(confidence: Column) -> Column:
    """0 and null count as missing: 0.8."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 0.8).otherwise(confidence)


def parsed(records: DataFrame) -> DataFrame:
    """Records with `result`, strictly parsed JSON; invalid text gives null."""
    schema = "struct<" + ", ".join(f"{n}: array<string>" for n in ["related_equations", *(x[0] for x in EQUATION_LISTS)]) + ">"
    valid = F.expr("is_variant_null(try_parse_json(output_json)) is not null and try_parse_json(output_json) is not null")
    return records.withColumn("result", F.when(valid, F.from_json("output_json", schema)))


def derived_edges(results: DataFrame, symbols: DataFrame, equations: DataFrame, variables: DataFrame) -> DataFrame:
    """Edges that completed analysis results name: symbol -> equation, equation -> variable by role.

    Variables are known by (file, symbol, name, role); target_id of a variable edge is that of the variable found, else
    a hash of these four, which is the id under which new_variables would be stored."""
    done = parsed(results.where("status = 'completed'")).where("result is not null")
    of_symbols = done.where("target_type = 'symbol'").join(symbols.select(F.col("id").alias("target_id"), "file_id"), "target_id")
    named = of_symbols.select("target_id", "file_id", "confidence", F.explode("result.related_equations").alias("name")).where("name <> ''")
    uses = named.join(equations_by_name(named, equations), ["file_id", "name"]).select(
        *edge("symbol", F.col("target_id"), "equation", F.col("equation_id"), "USES_EQUATION", "symbol analysis", trusted(F.col("confidence")), BY_ANALYSIS)
    )
    of_equations = done.where("target_type = 'equation'").join(equations.select(F.col("id").alias("target_id"), "file_id", "symbol_id"), "target_id")
    lists = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.col(f"result.{field}").alias("names")) for field, role, kind in EQUATION_LISTS))
    roles = of_equations.select("target_id", "file_id", "symbol_id", "confidence", F.explode(lists).alias("l")).select(
        "target_id", "file_id", "symbol_id", "confidence", "l.role", "l.kind", F.explode("l.names").alias("name")
    ).where("name <> ''")
    v = variables.groupBy("file_id", "symbol_id", "name", "role").agg(F.min("id").alias("variable_id")).alias("v")
    r = roles.alias("r")
    on = [F.col("r.file_id") == F.col("v.file_id"), F.col("r.name") == F.col("v.name"), F.col("r.role") == F.col("v.role"), F.col("r.symbol_id").eqNullSafe(F.col("v.symbol_id"))]
    found = r.join(v, reduce(lambda a, b: a & b, on), "left").select(
        "r.target_id", "r.kind", "r.confidence", F.coalesce("v.variable_id", F.xxhash64("r.file_id", "r.symbol_id", "r.name", "r.role")).alias("variable_id"), "r.file_id", "r.symbol_id", "r.name", "r.role"
    )
    holds = found.select(*edge("equation", F.col("target_id"), "variable", F.col("variable_id"), F.col("kind"), "equation analysis", trusted(F.col("confidence")), BY_ANALYSIS))
    return first_of(uses.unionByName(holds), EDGE_KEY, [F.desc("confidence"), F.col("evidence")])


def without_derived(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("edge_type").isin(DERIVED_EDGES))


def new_tasks(records: DataFrame, files: DataFrame, symbols: DataFrame, equations: DataFrame) -> DataFrame:
    """A pending task (target_type, target_id) for each file, function-like symbol and equation without record."""
    wanted = reduce(
        DataFrame.unionByName,
        [
            files.select(F.lit("file").alias("target_type"), F.col("id").alias("target_id")),
            symbols.where(F.col("symbol_type").isin("function", "method", "class")).select(F.lit("symbol").alias("target_type"), F.col("id").alias("target_id")),
            equations.select(F.lit("equation").alias("target_type"), F.col("id").alias("target_id")),
        ],
    )
    return wanted.join(records.select("target_type", "target_id"), ["target_type", "target_id"], "left_anti").withColumn("status", F.lit("pending"))


def rescan_tasks(changes: DataFrame, files: DataFrame) -> DataFrame:
    """A pending task for each file that a snapshot diff (path, change) calls added or changed."""
    touched = changes.where("change in ('added', 'changed')").select("path")
    return files.join(touched, "path", "left_semi").select(F.lit("file").alias("target_type"), F.col("id").alias("target_id"), F.lit("pending").alias("status"))


def next_tasks(files: DataFrame, records: DataFrame, limit: int = 1) -> DataFrame:
    """The next pending file records outside archives, by record id."""
    open_ = with_records(files, records, "file", "inner").where("status = 'pending'").where(~archived_wildcard(F.col("path")))
    return open_.select("record_id", F.col("target_id").alias("file_id"), "path").orderBy("record_id").limit(limit)


def next_undone(things: DataFrame, files: DataFrame, records: DataFrame, kind: str, limit: int = 1) -> DataFrame:
    """The next symbols or equations without record or with a pending one, outside archives, by id."""
    placed = things.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    open_ = undone(with_records(placed, records, kind)).where(~archived_wildcard(F.col("path")))
    return open_.select("id", "file_id", "path", "record_id").orderBy("id", "record_id").limit(limit)


def latest_records(records: DataFrame) -> DataFrame:
    return first_of(records, ["target_type", "target_id"], [F.desc("id")])


def agreement(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """Self-consistency: share of the most frequent answer, and whether it is below two thirds."""
    counts = df.groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("agreement"))
    return best.withColumn("flagged", F.col("agreement") < 0.66)
