"""Indexing, rescans, deletions and edits as compositions of operators; every step gives new tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as fn
from weftline.functions.extract import extract
from weftline.functions.values import MANUAL
from weftline.operators import dml, enrich, joins
from weftline.operators.graph import find_target
from weftline.sources.scan import scan
from weftline.sources.shared import written


@dataclass
class Graph:
    """files; entities (all of extraction, kept so that edges can be resolved anew); symbols; equations; edges; records."""

    files: DataFrame
    entities: DataFrame
    symbols: DataFrame
    equations: DataFrame
    edges: DataFrame
    records: DataFrame


def symbols_of(entities: DataFrame) -> DataFrame:
    kinds = entities.where(F.col("kind").isin("function", "class", "variable"))
    return kinds.select(
        F.xxhash64("path", "kind", "qualified_name", "start_line").alias("id"), F.xxhash64("path").alias("file_id"), "path", "name", "qualified_name",
        F.col("kind").alias("symbol_type"), "start_line", "end_line", "docstring", "source",
    ).dropDuplicates(["id"])


def equations_of(symbols: DataFrame) -> DataFrame:
    """Functions whose text holds an equation word."""
    found = symbols.where((F.col("symbol_type") == "function") & fn.looks_like_equation(F.col("source")))
    return found.select(
        F.xxhash64("id", F.lit("equation")).alias("id"), "file_id", F.col("id").alias("symbol_id"), "name", F.lit("algorithmic").alias("equation_type"),
        F.substring("source", 1, 500).alias("expression"), "start_line", "end_line", F.lit(0.5).alias("confidence"), F.lit(True).alias("inferred"),
    )


def edges_of(files: DataFrame, entities: DataFrame, symbols: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """All edges, or those that come from the files `only` (path): uses in these files, resolved against all there is."""
    own = lambda df: df if only is None else df.join(only, "path", "left_semi")
    uses, here = own(entities), own(symbols)
    imports = uses.where("kind = 'import'").select(F.xxhash64("path").alias("file_id"), fn.unquoted(F.col("name")).alias("name"), "start_line")
    imports = joins.first_of(imports, ["file_id", "name"], [F.col("start_line")])
    calls = uses.where("kind = 'call'").select(F.xxhash64("path", "name", "start_line").alias("id"), F.xxhash64("path").alias("file_id"), F.col("start_line").alias("line"), "name")
    defs = "symbol_type in ('function', 'class')"
    called = joins.enclosing_symbols(calls.dropDuplicates(["id"]), here.where(defs)).select(F.col("symbol_id").alias("caller_id"), F.col("called").alias("name")).distinct()
    raw = enrich.static_edges(here, imports, called)
    return enrich.resolve_edges(raw, files.select("id", "path", "filename"), symbols.where(defs))


def affected_files(before: Graph, entities: DataFrame, symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """path: the files whose edges may differ after changes (path, change): those that changed, and those that import or
    call a name for which a changed file had or has a definition. Modules are defined by paths, so only files that came
    or went count for imports. entities and symbols are those after the changes."""
    touched = changes.where("change <> 'same'").select("path")
    moved = changes.where("change in ('added', 'deleted')").select("path")
    defined = before.symbols.unionByName(symbols).where("symbol_type in ('function', 'class')").join(touched, "path", "left_semi")
    names = defined.select(F.coalesce("qualified_name", "name").alias("name")).distinct()
    calling = entities.where("kind = 'call'").select("path", "name").join(names, "name", "left_semi")
    imports = entities.where("kind = 'import'").select("path", fn.unquoted(F.col("name")).alias("name"))
    modules = moved.select(joins.module_of(F.col("path")).alias("name")).distinct()
    stems = moved.select(F.replace(fn.filename(F.col("path")), F.lit(".py"), F.lit("")).alias("stem")).distinct()
    by_stem = imports.withColumn("stem", joins.last_part(F.col("name"))).join(stems, "stem", "left_semi")
    using = calling.select("path").unionByName(imports.join(modules, "name", "left_semi").select("path")).unionByName(by_stem.select("path"))
    return touched.unionByName(using).distinct()


def edges_after(before: Graph, files: DataFrame, entities: DataFrame, symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """The edges after changes: those of affected files are made and resolved anew, all others stay. Equal to edges_of()
    on everything; what is joined grows with the change and what uses it. The old edges are read once, against a
    set of affected nodes, not shuffled where that set is small."""
    affected = written(affected_files(before, entities, symbols, changes), "affected")
    gone = affected.select(F.lit("file").alias("source_type"), F.xxhash64("path").alias("source_id"))
    gone = gone.unionByName(before.symbols.join(affected, "path", "left_semi").select(F.lit("symbol").alias("source_type"), F.col("id").alias("source_id")))
    kept = before.edges.join(gone, ["source_type", "source_id"], "left_anti")
    return kept.unionByName(edges_of(files, entities, symbols, affected).select(*kept.columns))


def assembled(files: DataFrame, entities: DataFrame, records: DataFrame | None) -> Graph:
    """The graph of files and entities, all of it made anew."""
    files, entities = written(files, "files"), written(entities, "entities")
    symbols = written(symbols_of(entities), "symbols")
    return finished(files, entities, symbols, edges_of(files, entities, symbols), records)


def finished(files: DataFrame, entities: DataFrame, symbols: DataFrame, edges: DataFrame, records: DataFrame | None) -> Graph:
    equations = equations_of(symbols)
    if records is None:
        records = files.sparkSession.createDataFrame([], "target_type string, target_id long, status string")
    tasks = enrich.new_tasks(records, files.where("is_source"), symbols, equations)
    return Graph(files, entities, symbols, equations, written(edges, "edges"), written(records.unionByName(tasks), "records"))


def index(spark: SparkSession, root: str, exclude: list[str] | None = None) -> Graph:
    files = written(scan(spark, root, exclude), "scan")
    return assembled(files, extract(files), None)


def rescan(graph: Graph, current: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after the tree became `current` (a scan), and the changes (path, change).

    Only new and changed files are extracted, and only edges of files that they affect are made anew (edges_after)."""
    current = written(current, "scan")
    changes = written(joins.snapshot_diff(graph.files, current), "changes")
    touched = changes.where("change in ('changed', 'deleted')").select("path")
    fresh = current.join(changes.where("change in ('changed', 'added')"), "path", "left_semi")
    dead = dml.nodes_of_files(graph.files.join(touched, "path", "left_semi"), graph.symbols, graph.equations, no_variables(graph))
    same = changes.where("change = 'same'").select("path")
    files = written(graph.files.join(same, "path", "left_semi").unionByName(fresh), "files")
    found = written(extract(fresh), "extracted")
    entities = written(graph.entities.join(touched, "path", "left_anti").unionByName(found), "entities")
    symbols = written(graph.symbols.join(touched, "path", "left_anti").unionByName(symbols_of(found)), "symbols")
    records = dml.stale_records(graph.records, dead)
    out = finished(files, entities, symbols, edges_after(graph, files, entities, symbols, changes), records.where("status <> 'stale'"))
    return replace(out, records=out.records.unionByName(records.where("status = 'stale'"))), changes


def no_variables(graph: Graph) -> DataFrame:
    """Extraction gives no variables with roles; edges to those that analysis names go with their equations' edges."""
    return graph.symbols.select("id", "file_id").limit(0)


def deleted(graph: Graph, paths: list[str]) -> Graph:
    """The graph without the files and all they hold; edges at either end go, records become stale."""
    gone = graph.files.where(F.col("path").isin(paths))
    dead = dml.nodes_of_files(gone, graph.symbols, graph.equations, no_variables(graph))
    out = lambda df: df.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return Graph(
        graph.files.join(gone.select("id"), "id", "left_anti"),
        graph.entities.join(gone.select("path"), "path", "left_anti"),
        out(graph.symbols),
        out(graph.equations),
        dml.cascade_edges(graph.edges, dead),
        dml.stale_records(graph.records, dead),
    )


def confirm_delete(graph: Graph, target_type: str, name: str | None, path: str | None, confirmed: bool = False) -> tuple[Graph, DataFrame]:
    """The graph without the target, and what happened: success, message, and for a deletion the audit row (operation_type,
    target_type, target_name, impact_summary, status), null otherwise.

    Nothing happens without confirmation or target; several targets raise. A file takes its symbols and equations with
    it, of edges only its own; a symbol its own edges; an equation no edge."""
    spark = graph.files.sparkSession
    columns = "success boolean, message string, operation struct<operation_type: string, target_type: string, target_name: string, impact_summary: string, status: string>"
    said = lambda ok, text, row=None: spark.createDataFrame([(ok, text, row)], columns)
    if not confirmed:
        return graph, said(False, "Deletion not confirmed")
    found = find_target(target_type, name, path, graph.files, graph.symbols, graph.equations)
    if found is None:
        return graph, said(False, "Target not found")
    other = lambda df, key="id": df.where(F.col(key) != found)
    if target_type == "file":
        out = replace(
            graph, files=other(graph.files), entities=graph.entities.where(F.xxhash64("path") != found), symbols=other(graph.symbols, "file_id"),
            equations=other(graph.equations, "file_id"), edges=dml.without_node(graph.edges, "file", found),
        )
    elif target_type == "symbol":
        out = replace(graph, symbols=other(graph.symbols), edges=dml.without_node(graph.edges, "symbol", found))
    else:
        out = replace(graph, equations=other(graph.equations))
    text = f"Deleted {target_type}: {name}"
    return out, said(True, text, ("delete", target_type, name, text, "completed"))


def edited(graph: Graph, path: str, edits: list[dict]) -> DataFrame:
    """The files table with line edits applied to one file, in order; rescan() takes it from there.

    An edit: type (replace, insert, delete), start_line, end_line or None, new_content."""
    text = F.col("text")
    for e in edits:
        text = fn.edited(text, F.lit(e["type"]), F.lit(e["start_line"]), F.lit(e.get("end_line")).cast("int"), F.lit(e.get("new_content") or ""))
    changed = F.when(F.col("path") == path, text).otherwise(F.col("text"))
    return graph.files.withColumn("text", changed).withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))


def nodes_of(graph: Graph) -> DataFrame:
    parts = [
        graph.files.select(F.lit("file").alias("node_type"), F.col("id").alias("node_id"), F.col("path").alias("name")),
        graph.symbols.select(F.lit("symbol"), "id", F.coalesce("qualified_name", "name")),
        graph.equations.select(F.lit("equation"), "id", F.coalesce("name", F.concat_ws(":", F.col("file_id").cast("string"), F.col("start_line").cast("string")))),
    ]
    return reduce(DataFrame.union, parts)


def manual_entries(graph: Graph, samples: int = 5) -> DataFrame:
    """section, title, content, order: the manual's entries, with figures and examples out of the graph's tables."""
    spark = graph.files.sparkSession
    counts = {k: df.count() for k, df in (("files", graph.files), ("symbols", graph.symbols), ("equations", graph.equations))}
    names = lambda df, c: ", ".join(r[0] for r in df.where(F.col(c).isNotNull()).orderBy(c).select(c).limit(samples).collect()) or "none"
    core = names(graph.files.where("is_entrypoint"), "path")
    content = [
        ", ".join(f"{n} {k}" for k, n in counts.items()) + f"; entry points: {core}",
        f"by path, language or a part of the summary; for example {names(graph.files, 'path')}",
        f"by name or qualified name; for example {names(graph.symbols, 'qualified_name')}",
        f"by name or a part of the expression; for example {names(graph.equations, 'name')}",
        "see what an impact query gives, to the depth that matters",
        "see references and dependents first; deletions must be confirmed",
        f"impact of {core}; symbols of {core}",
    ]
    titles = [line.split(" ", 1) for line in MANUAL.strip().split("\n")]
    rows = [(section, title, text, i + 1) for i, ((section, title), text) in enumerate(zip(titles, content, strict=True))]
    return spark.createDataFrame(rows, "section string, title string, content string, order int")


def store_manual(graph: Graph, path: str) -> DataFrame:
    """Replaces the manual at `path` by the graph's entries."""
    manual_entries(graph).coalesce(1).write.mode("overwrite").parquet(path)
    return graph.files.sparkSession.read.parquet(path)


def append_operation(outcome: DataFrame, path: str) -> None:
    """Adds the audit row of confirm_delete(), if there is one, to the operations at `path`."""
    outcome.where("operation is not null").select("operation.*", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def report(graph: Graph, samples: int = 10) -> str:
    """A Markdown overview: counts, core files, symbols and equations, `samples` of each."""
    counts = graph.files.groupBy("language").count().orderBy(F.desc("count"), "language").collect()  # a row a language
    take = lambda df, *order: df.orderBy(*order).limit(samples).collect()
    lines = ["# Overview", "", *(f"- {r['language'] or 'other'}: {r['count']} files" for r in counts), "", "## Entry points", ""]
    lines += [f"- {r['path']}" for r in take(graph.files.where("is_entrypoint"), "path")]
    lines += ["", "## Symbols", "", *(f"- {r['qualified_name']} ({r['symbol_type']}, {r['path']}:{r['start_line']})" for r in take(graph.symbols.where("symbol_type <> 'variable'"), "path", "start_line"))]
    lines += ["", "## Equations", "", *(f"- {r['name']}: {r['expression'].splitlines()[0]}" for r in take(graph.equations, "name", "id"))]
    return "\n".join([*lines, ""])
