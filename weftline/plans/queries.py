"""Registered queries of the graph engine: name -> (function of Tables, oracle SQL or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as fn
from weftline.functions import values
from weftline.functions.values import EQUATION_WORDS, IMPACT_EDGES, REFERENCE_EDGES
from weftline.operators import aggregates as agg
from weftline.operators import dml, enrich, filters, graph, hierarchy, joins, postings, reach, results, search, sets
from weftline.operators.keyed import KeyedTable
from weftline.plans.tables import Tables, oracle
from weftline.sources.shared import shared_folder

REGISTERED: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, *projections: str):
    def add(f):
        REGISTERED[name] = (f, oracle(sql, *projections) if sql is not None else None)
        return f

    return add


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


IMPACT = quoted(IMPACT_EDGES)
REFS = quoted(REFERENCE_EDGES)


# ---- filters and projections ----
@query("fil01_path_lookup", "SELECT id, path, size_bytes FROM files WHERE path = 'src3/fr/doc_3.md' OR path = 'src4/fr/doc_4.yaml'", "files")
def _(t):
    return filters.by_path(t.files, "src3/fr/doc_3.md").unionByName(filters.by_path(t.files, "src4/fr/doc_4.yaml")).select("id", "path", "size_bytes")


@query("fil02_name_or_qualified", "SELECT id, name, qualified_name FROM symbols WHERE name = 'turn_4' OR qualified_name = 'conv_7.turn_0'", "symbols")
def _(t):
    return filters.by_name_or_qualified(t.symbols, "turn_4", "conv_7.turn_0").select("id", "name", "qualified_name")


@query(
    "fil03_search_files",
    """SELECT id, path FROM files WHERE coalesce(filename ILIKE '%ering%', false) OR coalesce(path ILIKE '%ering%', false) OR coalesce(purpose ILIKE '%ering%', false)
    OR coalesce(llm_summary ILIKE '%ering%', false) OR coalesce(key_concepts ILIKE '%ering%', false) OR coalesce(risk_notes ILIKE '%ering%', false)""",
    "files",
)
def _(t):
    return filters.search_files(t.files, "ering").select("id", "path")


@query("fil04_search_analyzed", "SELECT id, analysis_status FROM files WHERE analysis_status = 'completed' AND (path ILIKE '%src1%' OR purpose ILIKE '%src1%' OR coalesce(llm_summary ILIKE '%src1%', false))", "files")
def _(t):
    return filters.search_files(t.files, "src1", only_analyzed=True).select("id", "analysis_status")


@query("fil05_equation_search", "SELECT id, name FROM equations WHERE expression ILIKE '%th%' OR name = 'eq_7'", "equations")
def _(t):
    return filters.equations_with(t.equations, "th", "eq_7").select("id", "name")


@query("fil06_set_membership", "SELECT id, symbol_type FROM symbols WHERE symbol_type IN ('function', 'method')", "symbols")
def _(t):
    return filters.of_kinds(t.symbols, "symbol_type", ["function", "method"]).select("id", "symbol_type")


@query("fil07_not_archived_wildcard", r"SELECT id, path FROM files WHERE NOT (path LIKE '%/_archive/%' OR path LIKE '%\_archive\%')", "files")
def _(t):
    return t.files.where(~filters.archived_wildcard(F.col("path"))).select("id", "path")


@query("fil08_archived_substring", r"SELECT id, path FROM files WHERE contains(path, '_archive/') OR contains(path, '_archive\')", "files")
def _(t):
    return t.files.where(filters.archived_substring(F.col("path"))).select("id", "path")


@query("fil09_confident", "SELECT id, confidence FROM records WHERE confidence >= 0.5", "records")
def _(t):
    return filters.confident(t.records).select("id", "confidence")


@query("fil10_status", "SELECT id, target_id FROM records WHERE status = 'completed'", "records")
def _(t):
    return filters.with_status(t.records, "completed").select("id", "target_id")


@query("fil11_touching", "SELECT * FROM edges WHERE (source_type = 'nation' AND source_id = 3) OR (target_type = 'nation' AND target_id = 3)", "edges")
def _(t):
    return filters.touching(t.edges, "nation", 3)


@query("fil12_undone", "SELECT f.id, r.id AS record_id FROM files f LEFT JOIN records r ON r.target_type = 'file' AND r.target_id = f.id WHERE r.id IS NULL OR r.status = 'pending'", "files", "records")
def _(t):
    return filters.undone(joins.with_records(t.files, t.records, "file")).select("id", "record_id")


@query("fil13_line_interval", "SELECT id, start_line, end_line FROM symbols WHERE 3 BETWEEN start_line AND end_line", "symbols")
def _(t):
    return filters.on_line(t.symbols, 3).select("id", "start_line", "end_line")


@query("prj01_file_output", "SELECT id, path, language, size_bytes, coalesce(llm_summary, '') AS summary, is_core FROM files", "files")
def _(t):
    return filters.file_output(t.files)


@query("prj01_symbol_output", "SELECT id, name, qualified_name, symbol_type AS type, start_line, end_line FROM symbols", "symbols")
def _(t):
    return filters.symbol_output(t.symbols)


@query("prj01_equation_output", "SELECT id, name, equation_type AS type, expression, start_line FROM equations", "equations")
def _(t):
    return filters.equation_output(t.equations)


# ---- joins ----
@query("join01_file_records", "SELECT f.id, r.id AS record_id, r.status FROM files f JOIN records r ON r.target_type = 'file' AND r.target_id = f.id", "files", "records")
def _(t):
    return joins.with_records(t.files, t.records, "file", "inner").select("id", "record_id", "status")


@query(
    "join02_symbols_files_records",
    "SELECT s.id, f.path, r.id AS record_id FROM symbols s JOIN files f ON s.file_id = f.id LEFT JOIN (SELECT * FROM results WHERE target_type = 'symbol') r ON r.target_id = s.id",
    "symbols", "files", "results",
)
def _(t):
    placed = t.symbols.join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return joins.with_records(placed, t.results, "symbol").select("id", "path", "record_id")


@query(
    "join03_equations_files_records",
    "SELECT e.id, f.path, r.id AS record_id FROM equations e JOIN files f ON e.file_id = f.id LEFT JOIN (SELECT * FROM results WHERE target_type = 'equation') r ON r.target_id = e.id",
    "equations", "files", "results",
)
def _(t):
    placed = t.equations.join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return joins.with_records(placed, t.results, "equation").select("id", "path", "record_id")


@query("join04_callers", "SELECT e.source_type, e.source_id, e.target_id, n.name AS target_name FROM edges e JOIN nodes n ON n.node_type = e.target_type AND n.node_id = e.target_id WHERE e.edge_type = 'CALLS'", "edges", "nodes")
def _(t):
    return joins.to_nodes(t.edges.where("edge_type = 'CALLS'"), t.nodes, "target").select("source_type", "source_id", "target_id", "target_name")


@query("join05_equation_variables", "SELECT e.id AS equation_id, v.id AS variable_id, v.name AS variable_name FROM equations e JOIN variables v ON v.symbol_id = e.symbol_id", "equations", "variables")
def _(t):
    return joins.variables_of_equations(t.equations, t.variables).select("equation_id", "variable_id", "variable_name")


@query("join06_resolved_nodes", "SELECT e.edge_type, n.node_type, n.node_id, n.name AS source_name FROM edges e JOIN nodes n ON n.node_type = e.source_type AND n.node_id = e.source_id WHERE n.node_type <> 'lineitem'", "edges", "nodes")
def _(t):
    known = t.nodes.where("node_type <> 'lineitem'")
    return joins.to_nodes(t.edges, known, "source").select("edge_type", F.col("source_type").alias("node_type"), F.col("source_id").alias("node_id"), "source_name")


@query(
    "join07_enclosing_symbol",
    """SELECT call_id, symbol_id FROM (SELECT c.id AS call_id, s.id AS symbol_id, row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN s.symbol_type = 'function' THEN 0 ELSE 1 END, s.start_line, s.id) AS place
    FROM calls c JOIN symbols s ON c.file_id = s.file_id AND c.line BETWEEN s.start_line AND s.end_line) q WHERE place = 1""",
    "calls", "symbols",
)
def _(t):
    return joins.enclosing_symbols(t.calls, t.symbols).select("call_id", "symbol_id")


SPANS = "SELECT file_id, id, start_line - start_line % 4 AS start_line, end_line FROM symbols"


@query(
    "join08_parent_of",
    f"""SELECT id, parent_id FROM (SELECT a.id, b.id AS parent_id, row_number() OVER (PARTITION BY a.id ORDER BY b.start_line DESC, b.id DESC) AS place
    FROM ({SPANS}) a JOIN ({SPANS}) b ON a.file_id = b.file_id AND a.id <> b.id AND b.start_line <= a.start_line AND b.end_line >= a.end_line) q WHERE place = 1""",
    "symbols",
)
def _(t):
    return joins.parents(t.symbols.withColumn("start_line", F.col("start_line") - F.col("start_line") % 4)).select("id", "parent_id")


@query(
    "join09_import_by_module_or_stem",
    """SELECT n.name, min(f.id) AS file_id FROM (SELECT DISTINCT 'doc_' || CAST(file_id * 5 AS VARCHAR) AS name FROM imports UNION SELECT DISTINCT 'a.b.doc_' || CAST(file_id * 5 AS VARCHAR) FROM imports) n
    JOIN files f ON replace(replace(f.path, '/', '.'), '.py', '') = n.name OR replace(f.filename, '.py', '') = split_part(n.name, '.', -1) GROUP BY n.name""",
    "links", "imports", "files",
)
def _(t):
    base = F.concat(F.lit("doc_"), (F.col("file_id") * 5).cast("string"))
    names = t.imports.select(base.alias("name")).unionByName(t.imports.select(F.concat(F.lit("a.b."), base).alias("name")))
    return joins.imports_by_name(names, t.files)


@query(
    "join10_import_by_suffix",
    """SELECT n.name, min(f.id) AS file_id FROM (SELECT DISTINCT language || '.doc_' || CAST(id AS VARCHAR) AS name FROM files) n
    JOIN files f ON replace(replace(f.path, '/', '.'), '.py', '') = n.name OR ends_with(replace(replace(f.path, '/', '.'), '.py', ''), '.' || n.name) GROUP BY n.name""",
    "files",
)
def _(t):
    names = t.files.select(F.concat("language", F.lit(".doc_"), F.col("id").cast("string")).alias("name"))
    return joins.imports_by_suffix(names, t.files)


@query("join11_call_to_symbol", "SELECT c.name, max(s.id) AS symbol_id FROM (SELECT DISTINCT qualified_name AS name FROM symbols) c JOIN symbols s ON coalesce(s.qualified_name, s.name) = c.name GROUP BY c.name", "symbols")
def _(t):
    return joins.symbols_by_name(t.symbols.select(F.col("qualified_name").alias("name")), t.symbols)


@query("join12_defining_file", "SELECT c.name, min(s.file_id) AS file_id FROM (SELECT DISTINCT name FROM calls) c JOIN symbols s ON s.name = c.name GROUP BY c.name", "calls", "symbols")
def _(t):
    return joins.defining_files(t.calls, t.symbols)


@query(
    "join13_equation_same_file_first",
    """SELECT w.file_id, w.name, coalesce(min(CASE WHEN e.file_id = w.file_id THEN e.id END), min(e.id)) AS equation_id
    FROM (SELECT DISTINCT file_id, 'eq_' || CAST(id % 50 AS VARCHAR) AS name FROM symbols) w JOIN equations e ON e.name = w.name GROUP BY w.file_id, w.name""",
    "symbols", "equations",
)
def _(t):
    wanted = t.symbols.select("file_id", F.concat(F.lit("eq_"), (F.col("id") % 50).cast("string")).alias("name"))
    return joins.equations_by_name(wanted, t.equations)


DIFF = """SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'changed' ELSE 'same' END AS change
FROM snapshot_old o FULL OUTER JOIN snapshot_new n ON o.path = n.path"""


@query("join14_snapshot_diff", DIFF, "snapshot_old", "snapshot_new")
def _(t):
    return joins.snapshot_diff(t.snapshot_old, t.snapshot_new)


@query("join15_without_records", "SELECT id, path FROM files WHERE id NOT IN (SELECT target_id FROM records)", "files", "records")
def _(t):
    return joins.without(t.files, t.records.select(F.col("target_id").alias("id")), ["id"]).select("id", "path")


# ---- aggregates ----
@query("agg01_progress", "SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM records", "records")
def _(t):
    return agg.progress(t.records)


@query("agg02_pending_by_layer", "SELECT target_type, count(*) AS pending FROM records WHERE status = 'pending' GROUP BY target_type", "records")
def _(t):
    return agg.pending_by_layer(t.records)


@query("agg03_coverage", "SELECT language, count(*) FILTER (analysis_status = 'completed' OR coalesce(llm_summary <> '', false)) AS analyzed, count(*) AS total FROM files GROUP BY language", "files")
def _(t):
    return agg.coverage(t.files, ["language"])


@query("agg04_counters", "SELECT (SELECT count(*) FROM files) AS files_scanned, (SELECT count(*) FROM symbols) AS symbols_extracted, (SELECT count(*) FROM equations) AS equations_found", "files", "symbols", "equations")
def _(t):
    return agg.counters({"files_scanned": t.files, "symbols_extracted": t.symbols, "equations_found": t.equations})


@query("agg05_joined_names", "SELECT file_id, array_to_string(list_sort(list(DISTINCT name)), ', ') AS names FROM symbols GROUP BY file_id", "symbols")
def _(t):
    return agg.joined_names(t.symbols, ["file_id"], "name", "names")


@query("agg06_equation_kinds", "SELECT array_to_string(list_sort(list(DISTINCT equation_type)), ', ') AS kinds FROM equations", "equations")
def _(t):
    return agg.joined_names(t.equations, [], "equation_type", "kinds")


@query("agg07_distinct_test_paths", "SELECT DISTINCT path FROM files WHERE starts_with(path, 'test')", "files")
def _(t):
    return agg.paths_of_tests(t.files)


@query("agg08_in_degree", "SELECT source, count(*) AS in_degree FROM deps GROUP BY source", "deps")
def _(t):
    return agg.in_degree(t.deps)


CONSISTENCY = "SELECT target_type, target_id, round(CASE WHEN count(confidence) = 0 THEN 0.0 WHEN count(confidence) = 1 THEN avg(confidence) ELSE avg(confidence) * 0.9 END, 9) AS confidence FROM results GROUP BY target_type, target_id"


@query("agg09_consistency", CONSISTENCY, "results")
def _(t):
    return agg.consistency(t.results, ["target_type", "target_id"]).withColumn("confidence", F.round("confidence", 9))


@query("agg10_first_result", "SELECT target_type, target_id, arg_min(status, id) AS status FROM results GROUP BY target_type, target_id", "results")
def _(t):
    return agg.first_result(t.results, ["target_type", "target_id"], "id", "status")


@query("agg11_first_import", "SELECT file_id, name, min(place)::INTEGER AS place FROM imports GROUP BY file_id, name", "links", "imports")
def _(t):
    return agg.first_imports(t.imports).select("file_id", "name", F.col("place").cast("int").alias("place"))


#: Imports by name, each with the first Python module or file stem of that name.
FOUND_FILES = """SELECT n.name, min(f.id) AS fid FROM (SELECT DISTINCT name FROM named_imports) n
    JOIN files f ON replace(replace(f.path, '/', '.'), '.py', '') = n.name OR replace(f.filename, '.py', '') = n.name GROUP BY n.name"""
FILE_EDGES = f"SELECT 'file' AS source_type, n.file_id AS source_id, 'file' AS target_type, f.fid AS target_id, 'IMPORTS' AS edge_type FROM named_imports n JOIN ({FOUND_FILES}) f ON f.name = n.name"
IMPORT_TABLES = ("links", "imports", "named_imports", "files")


def file_edges(t):
    """An edge for each import, as often as it stands in the file."""
    found = t.named_imports.join(joins.imports_by_name(t.named_imports, t.files).withColumnRenamed("file_id", "fid"), "name")
    return found.select(*enrich.edge("file", F.col("file_id"), "file", F.col("fid"), "IMPORTS", F.concat(F.lit("Import: "), "name"), F.col("place").cast("double"), "x"))


@query(
    "agg12_dedup_edges",
    f"""SELECT source_type, source_id, target_type, target_id, edge_type, min(confidence) AS confidence FROM
    ({FILE_EDGES.replace(" FROM named_imports n JOIN", ", CAST(n.place AS DOUBLE) AS confidence FROM named_imports n JOIN")}) q GROUP BY source_type, source_id, target_type, target_id, edge_type""",
    *IMPORT_TABLES,
)
def _(t):
    return agg.dedup_edges(file_edges(t), [F.col("confidence")]).select(*enrich.EDGE_KEY, "confidence")


@query(
    "agg13_staleness_action",
    f"""SELECT changed, added, deleted, changed + added + deleted > 0 AS is_stale, CASE WHEN changed + added + deleted > 0 THEN 'rescan: ' || concat_ws(', ', CASE WHEN changed > 0 THEN changed || ' changed' END,
    CASE WHEN added > 0 THEN added || ' added' END, CASE WHEN deleted > 0 THEN deleted || ' deleted' END) ELSE 'up to date' END AS action
    FROM (SELECT count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'deleted') AS deleted FROM ({DIFF}) d) q""",
    "snapshot_old", "snapshot_new",
)
def _(t):
    return agg.staleness_action(joins.snapshot_diff(t.snapshot_old, t.snapshot_new))


# ---- order and limits (the limit is the feature) ----
RANK = "CASE WHEN analysis_status = 'completed' AND coalesce(llm_summary <> '', false) THEN 0 WHEN coalesce(llm_summary <> '', false) THEN 1 ELSE 2 END"


@query("srt01_ranked_search", f"SELECT id, path, CAST({RANK} AS INTEGER) AS rank FROM files WHERE coalesce(path ILIKE '%src%', false)", "files")
def _(t):
    return agg.ranked_files(t.files.where(F.col("path").ilike("%src%"))).select("id", "path", "rank")


@query("srt02_ranked_page", f"SELECT id, path FROM files ORDER BY {RANK}, path LIMIT 20", "files")
def _(t):
    return agg.ranked_files(t.files, 20).select("id", "path")


@query("srt03_next_task", "SELECT id, target_id FROM records WHERE status = 'pending' ORDER BY id LIMIT 1", "records")
def _(t):
    return agg.take(t.records.where("status = 'pending'"), 1, "id").select("id", "target_id")


@query("srt04_next_batch", "SELECT id, target_id FROM records WHERE status = 'pending' ORDER BY id LIMIT 10", "records")
def _(t):
    return agg.take(t.records.where("status = 'pending'"), 10, "id").select("id", "target_id")


@query("srt05_report_samples", "(SELECT 'core' AS section, id, path FROM files WHERE is_core ORDER BY id LIMIT 10) UNION ALL (SELECT 'completed', id, path FROM files WHERE analysis_status = 'completed' ORDER BY path LIMIT 50)", "files")
def _(t):
    core = agg.take(t.files.where("is_core"), 10, "id").select(F.lit("core").alias("section"), "id", "path")
    return core.unionByName(agg.take(t.files.where("analysis_status = 'completed'"), 50, "path").select(F.lit("completed").alias("section"), "id", "path"))


@query("srt06_sorted_diff", f"SELECT change, path FROM ({DIFF}) d ORDER BY change, path", "snapshot_old", "snapshot_new")
def _(t):
    return joins.snapshot_diff(t.snapshot_old, t.snapshot_new).select("change", "path").orderBy("change", "path")


@query("srt07_entity_order", "SELECT id, row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) AS place FROM symbols", "symbols")
def _(t):
    return agg.placed_in_file(t.symbols).select("id", "place")


@query("srt08_truncated", "SELECT id, substring(text, 1, 80) AS short FROM files", "files")
def _(t):
    return t.files.select("id", agg.shortened(F.col("text")).alias("short"))


# ---- sets ----
@query("set01_paths_in_both", "SELECT path FROM snapshot_old INTERSECT SELECT path FROM snapshot_new", "snapshot_old", "snapshot_new")
def _(t):
    return sets.in_both(t.snapshot_old, t.snapshot_new, "path")


@query("set01_paths_gone", "SELECT path FROM snapshot_old EXCEPT SELECT path FROM snapshot_new", "snapshot_old", "snapshot_new")
def _(t):
    return sets.only_left(t.snapshot_old, t.snapshot_new, "path")


@query("set02_union_names", "SELECT name FROM symbols UNION SELECT name FROM calls", "symbols", "calls")
def _(t):
    return sets.in_either(t.symbols, t.calls, "name")


@query("set03_bag_union", "SELECT id, file_id FROM symbols UNION ALL SELECT id, file_id FROM calls", "symbols", "calls")
def _(t):
    return sets.together(t.symbols, t.calls, ["id", "file_id"])


@query("set04_concat_lists", "SELECT file_id, array_to_string(list_concat(list_sort(list(name)), list_sort(list(symbol_type))), ',') AS names FROM symbols GROUP BY file_id", "symbols")
def _(t):
    return sets.joined_lists(t.symbols, "file_id", ["name", "symbol_type"], "names")


# ---- graph ----
IMPACT_SQL = f""", known AS (SELECT e.*, n.name FROM edges e JOIN nodes n ON n.node_type = e.source_type AND n.node_id = e.source_id WHERE edge_type IN ({IMPACT})),
walk(t, i, d) AS (SELECT 'region', CAST(1 AS BIGINT), 0 UNION SELECT source_type, source_id, d + 1 FROM walk JOIN known ON target_type = t AND target_id = i WHERE d < 3),
least AS (SELECT t, i, min(d) AS d FROM walk GROUP BY t, i)
SELECT source_type AS type, source_id AS id, name, edge_type, CAST(d + 1 AS INTEGER) AS depth, CASE WHEN d = 0 THEN 'direct' ELSE 'transitive' END AS reach
FROM least JOIN known ON target_type = t AND target_id = i"""


@query("gra01_impact", None)
def gra01_impact(t):
    return graph.impact(t.edges, t.nodes, "region", 1)


REGISTERED["gra01_impact"] = (gra01_impact, oracle("SELECT 1", "edges", "nodes").replace("WITH", "WITH RECURSIVE", 1).removesuffix(" SELECT 1") + IMPACT_SQL)


WANTED = """SELECT DISTINCT * FROM (SELECT 'file' AS target_type, CAST(NULL AS VARCHAR) AS name, path FROM files
  UNION ALL SELECT 'symbol', name, 'conv_' || CAST(file_id AS VARCHAR) || '.' || name FROM calls UNION ALL SELECT 'symbol', name || 'x', 'conv_' || CAST(file_id AS VARCHAR) || '.' || name FROM calls
  UNION ALL SELECT 'equation', name, expression FROM equations UNION ALL SELECT 'equation', 'x', name FROM equations) q"""


@query(
    "gra02_find_target",
    f""", wanted AS ({WANTED}), fits AS (SELECT w.*, f.id FROM wanted w JOIN files f ON w.target_type = 'file' AND f.path = w.path
    UNION SELECT w.*, s.id FROM wanted w JOIN symbols s ON w.target_type = 'symbol' AND s.name = w.name UNION SELECT w.*, s.id FROM wanted w JOIN symbols s ON w.target_type = 'symbol' AND s.qualified_name = w.path
    UNION SELECT w.*, e.id FROM wanted w JOIN equations e ON w.target_type = 'equation' AND e.name = w.name UNION SELECT w.*, e.id FROM wanted w JOIN equations e ON w.target_type = 'equation' AND e.name = w.path),
    counted AS (SELECT target_type, name, path, count(*) AS matches, min(id) AS id FROM fits GROUP BY ALL)
    SELECT w.target_type, w.name, w.path, coalesce(c.matches, 0) AS matches, CASE WHEN c.matches = 1 THEN c.id END AS id FROM wanted w
    LEFT JOIN counted c ON w.target_type = c.target_type AND w.name IS NOT DISTINCT FROM c.name AND w.path IS NOT DISTINCT FROM c.path""",
    "files", "symbols", "calls", "equations",
)
def _(t):
    w = lambda df, kind, name, path: df.select(F.lit(kind).alias("target_type"), name.cast("string").alias("name"), path.alias("path"))
    place = F.concat(F.lit("conv_"), F.col("file_id").cast("string"), F.lit("."), "name")
    wanted = w(t.files, "file", F.lit(None), F.col("path")).unionByName(w(t.calls, "symbol", F.col("name"), place)).unionByName(w(t.calls, "symbol", F.concat("name", F.lit("x")), place))
    wanted = wanted.unionByName(w(t.equations, "equation", F.col("name"), F.col("expression"))).unionByName(w(t.equations, "equation", F.lit("x"), F.col("name")))
    return graph.resolve_targets(wanted, t.files, t.symbols, t.equations)


#: Calls with the symbol around them and the symbol they name, each pair once.
CALLERS = """SELECT DISTINCT c.sid AS source_id, s.id AS target_id FROM (SELECT c.file_id, c.name, s.id AS sid, row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN s.symbol_type = 'function' THEN 0 ELSE 1 END, s.start_line, s.id) AS place
  FROM calls c JOIN symbols s ON c.file_id = s.file_id AND c.line BETWEEN s.start_line AND s.end_line) c
  JOIN (SELECT qualified_name, max(id) AS id FROM symbols GROUP BY 1) s ON s.qualified_name = 'conv_' || CAST(c.file_id AS VARCHAR) || '.' || c.name WHERE c.place = 1"""


def call_edges(t):
    """Symbol to symbol, by the symbols around calls and those that calls name."""
    placed = joins.enclosing_symbols(t.calls, t.symbols)
    called = placed.select(F.col("symbol_id").alias("caller_id"), F.concat(F.lit("conv_"), F.col("file_id").cast("string"), F.lit("."), "called").alias("name"))
    raw = enrich.static_edges(t.symbols, t.named_imports.select("file_id", "name"), called)
    return enrich.resolve_edges(raw, t.files, t.symbols)


@query(
    "gra03_related_tests",
    f"""SELECT DISTINCT f.path FROM (SELECT e.source_id AS file_id FROM ({FILE_EDGES}) e JOIN files a ON a.id = e.target_id AND a.is_core
    UNION SELECT s.file_id FROM ({CALLERS}) e JOIN symbols k ON k.id = e.target_id AND k.symbol_type = 'class' JOIN symbols s ON s.id = e.source_id) q JOIN files f ON f.id = q.file_id WHERE starts_with(f.path, 'test')""",
    *IMPORT_TABLES, "symbols", "calls",
)
def _(t):
    affected = t.files.where("is_core").select(F.lit("file").alias("type"), "id").unionByName(t.symbols.where("symbol_type = 'class'").select(F.lit("symbol").alias("type"), "id"))
    return graph.related_tests(affected, call_edges(t), t.files, t.symbols)


@query("gra04_references", f"SELECT source_type, source_id, edge_type FROM edges WHERE target_type = 'customer' AND target_id = 7 AND edge_type IN ({REFS})", "edges")
def _(t):
    return graph.references(t.edges, "customer", 7).select("source_type", "source_id", "edge_type")


@query("gra05_dependents", "SELECT target_type, target_id, edge_type FROM edges WHERE source_type = 'customer' AND source_id = 7", "edges")
def _(t):
    return graph.dependents(t.edges, "customer", 7).select("target_type", "target_id", "edge_type")


@query("gra06_orphans", f"SELECT source_type, source_id, edge_type FROM edges r WHERE target_type = 'nation' AND target_id = 3 AND edge_type IN ({REFS}) AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.source_type = 'nation' AND o.source_id = 3 AND o.target_type = r.source_type AND o.target_id = r.source_id)", "edges")
def _(t):
    return graph.orphans(t.edges, "nation", 3).select("source_type", "source_id", "edge_type")


@query(
    "gra07_delete_safety",
    f"""SELECT n.node_type, n.node_id, coalesce(r.c, 0) AS reference_count, coalesce(d.c, 0) AS dependent_count, coalesce(r.c, 0) = 0 AND coalesce(d.c, 0) = 0 AS can_delete,
    CASE WHEN coalesce(r.c, 0) = 0 AND coalesce(d.c, 0) = 0 THEN 'low' ELSE 'high' END AS risk_level, NOT (coalesce(r.c, 0) = 0 AND coalesce(d.c, 0) = 0) AS requires_confirmation
    FROM nodes n LEFT JOIN (SELECT target_type, target_id, count(*) AS c FROM edges WHERE edge_type IN ({REFS}) GROUP BY ALL) r ON r.target_type = node_type AND r.target_id = node_id
    LEFT JOIN (SELECT source_type, source_id, count(*) AS c FROM edges GROUP BY ALL) d ON d.source_type = node_type AND d.source_id = node_id""",
    "nodes", "edges",
)
def _(t):
    return graph.delete_safety(t.edges, t.nodes.select("node_type", "node_id"))


USES = """SELECT n.target_id AS source_id, coalesce(l.id, a.id) AS target_id FROM named n LEFT JOIN (SELECT file_id, name, min(id) AS id FROM equations GROUP BY 1, 2) l ON l.file_id = n.file_id AND l.name = n.name
    LEFT JOIN (SELECT name, min(id) AS id FROM equations GROUP BY 1) a ON a.name = n.name WHERE n.name <> '' AND a.id IS NOT NULL GROUP BY ALL"""
DONE = """, done AS (SELECT target_type, target_id, output_json, CASE WHEN coalesce(confidence, 0) = 0 THEN 0.8 ELSE confidence END AS confidence FROM results WHERE status = 'completed' AND json_valid(output_json)),
named AS (SELECT d.target_id, s.file_id, d.confidence, unnest(CAST(d.output_json->'related_equations' AS VARCHAR[])) AS name FROM done d JOIN symbols s ON s.id = d.target_id WHERE d.target_type = 'symbol')"""



@query(
    "gra08_symbol_neighbourhood",
    DONE + f""", e AS ({CALLERS}), u AS ({USES}) SELECT e.target_id AS symbol_id, 'caller' AS part, s.id, s.name, s.qualified_name AS detail FROM e JOIN symbols s ON s.id = e.source_id JOIN symbols o ON o.id = e.target_id
    UNION ALL SELECT e.source_id, 'callee', s.id, s.name, s.qualified_name FROM e JOIN symbols s ON s.id = e.target_id JOIN symbols o ON o.id = e.source_id
    UNION ALL SELECT u.source_id, 'equation', q.id, q.name, q.equation_type FROM u JOIN equations q ON q.id = u.target_id JOIN symbols o ON o.id = u.source_id""",
    "results", "symbols", "equations", "calls",
)
def _(t):
    edges = call_edges(t).unionByName(enrich.derived_edges(t.results, t.symbols, t.equations, t.variables))
    return graph.symbol_neighbourhood(edges, t.symbols, t.equations)


@query(
    "gra09_file_neighbourhood",
    f"""SELECT s.file_id, 'symbol' AS part, s.id, s.name, s.symbol_type AS detail FROM symbols s JOIN files f ON f.id = s.file_id UNION ALL SELECT e.file_id, 'equation', e.id, e.name, e.equation_type FROM equations e JOIN files f ON f.id = e.file_id
    UNION ALL SELECT DISTINCT i.source_id, 'dependency', f.id, f.path, 'import' FROM ({FILE_EDGES}) i JOIN files f ON f.id = i.target_id JOIN files o ON o.id = i.source_id""",
    *IMPORT_TABLES, "symbols", "equations",
)
def _(t):
    return graph.file_neighbourhood(t.files, t.symbols, t.equations, call_edges(t))


STATIC = """SELECT 'file' AS source_type, file_id AS source_id, 'symbol' AS target_type, id AS target_id, 'DEFINES' AS edge_type, 'static analysis' AS evidence, 1.0::DOUBLE AS confidence FROM symbols
UNION ALL SELECT 'file', file_id, 'file', 0, 'IMPORTS', 'Import: ' || name, 1.0::DOUBLE FROM imports UNION ALL SELECT 'symbol', id, 'symbol', 0, 'CALLS', 'Call to ' || name, 0.8::DOUBLE FROM calls"""


@query("gra10_static_edges", STATIC, "symbols", "links", "imports", "calls")
def _(t):
    return enrich.static_edges(t.symbols, t.imports, t.calls.withColumnRenamed("id", "caller_id")).drop("created_by")


@query(
    "gra11_resolved_edges",
    """, files2 AS (SELECT id, filename, path FROM files), names AS (SELECT 'doc_' || CAST(file_id * 5 AS VARCHAR) AS name, file_id FROM imports),
    found AS (SELECT n.name, min(f.id) AS fid FROM (SELECT DISTINCT name FROM names) n JOIN files2 f ON replace(replace(f.path, '/', '.'), '.py', '') = n.name OR replace(f.filename, '.py', '') = split_part(n.name, '.', -1) GROUP BY n.name)
    SELECT DISTINCT 'file' AS source_type, n.file_id AS source_id, 'file' AS target_type, f.fid AS target_id, 'IMPORTS' AS edge_type, 0.9::DOUBLE AS confidence FROM names n JOIN found f ON f.name = n.name
    UNION ALL SELECT DISTINCT 'symbol', c.id, 'symbol', s.sid, 'CALLS', 0.9::DOUBLE FROM (SELECT id, 'conv_' || CAST(file_id AS VARCHAR) || '.' || name AS name FROM calls) c
    JOIN (SELECT qualified_name AS name, max(id) AS sid FROM symbols GROUP BY 1) s ON s.name = c.name
    UNION ALL SELECT 'file', file_id, 'symbol', id, 'DEFINES', 1.0::DOUBLE FROM symbols""",
    "files", "symbols", "calls", "links", "imports",
)
def _(t):
    named = t.imports.select("file_id", F.concat(F.lit("doc_"), (F.col("file_id") * 5).cast("string")).alias("name"))
    calls = t.calls.select(F.col("id").alias("caller_id"), F.concat(F.lit("conv_"), F.col("file_id").cast("string"), F.lit("."), "name").alias("name"))
    return enrich.resolve_edges(enrich.static_edges(t.symbols, named, calls), t.files, t.symbols).drop("evidence", "created_by")


@query(
    "gra12_derived_uses",
    DONE + """ SELECT 'symbol' AS source_type, n.target_id AS source_id, 'equation' AS target_type, coalesce(l.id, a.id) AS target_id, 'USES_EQUATION' AS edge_type, max(n.confidence) AS confidence
    FROM named n LEFT JOIN (SELECT file_id, name, min(id) AS id FROM equations GROUP BY 1, 2) l ON l.file_id = n.file_id AND l.name = n.name LEFT JOIN (SELECT name, min(id) AS id FROM equations GROUP BY 1) a ON a.name = n.name
    WHERE n.name <> '' AND a.id IS NOT NULL GROUP BY ALL""",
    "results", "symbols", "equations",
)
def _(t):
    found = enrich.derived_edges(t.results, t.symbols, t.equations, t.variables)
    return found.where("edge_type = 'USES_EQUATION'").drop("evidence", "created_by")


@query(
    "gra12_derived_variables",
    """, done AS (SELECT target_id, output_json, CASE WHEN coalesce(confidence, 0) = 0 THEN 0.8 ELSE confidence END AS confidence FROM results WHERE status = 'completed' AND target_type = 'equation' AND json_valid(output_json)),
    named AS (SELECT target_id, confidence, 'EQUATION_INPUT' AS edge_type, unnest(CAST(output_json->'inputs' AS VARCHAR[])) AS name FROM done
      UNION ALL SELECT target_id, confidence, 'EQUATION_OUTPUT', unnest(CAST(output_json->'outputs' AS VARCHAR[])) FROM done UNION ALL SELECT target_id, confidence, 'EQUATION_DEPENDS_ON', unnest(CAST(output_json->'constants' AS VARCHAR[])) FROM done)
    SELECT n.target_id AS source_id, n.edge_type, count(DISTINCT n.name) AS names, max(n.confidence) AS confidence FROM named n JOIN equations e ON e.id = n.target_id WHERE n.name <> '' GROUP BY ALL""",
    "results", "equations",
)
def _(t):
    found = enrich.derived_edges(t.results, t.symbols, t.equations, t.variables).where("target_type = 'variable'")
    return found.groupBy("source_id", "edge_type").agg(F.count_distinct("target_id").alias("names"), F.max("confidence").alias("confidence"))


@query("gra13_without_derived", f"SELECT source_id, edge_type FROM ({STATIC}) e WHERE edge_type NOT IN ('USES_EQUATION', 'EQUATION_INPUT')", "symbols", "links", "imports", "calls")
def _(t):
    return enrich.without_derived(enrich.static_edges(t.symbols, t.imports, t.calls.withColumnRenamed("id", "caller_id"))).select("source_id", "edge_type")


@query(
    "gra14_file_dependencies",
    """, mods AS (SELECT id, replace(replace(path, '/', '.'), '.py', '') AS module FROM files WHERE ends_with(path, '.py')),
    found AS (SELECT n.name, min(m.id) AS target FROM (SELECT DISTINCT name FROM named_imports) n JOIN mods m ON m.module = n.name OR ends_with(m.module, '.' || n.name) GROUP BY n.name)
    SELECT source, target, kind, confidence FROM (SELECT n.file_id AS source, f.target, 'import' AS kind, 0.9::DOUBLE AS confidence FROM named_imports n JOIN found f ON f.name = n.name
      UNION ALL SELECT c.file_id, s.file_id, 'call', 0.7::DOUBLE FROM calls c JOIN (SELECT qualified_name AS name, min(file_id) AS file_id FROM symbols GROUP BY 1) s ON s.name = 'conv_' || CAST(c.file_id // 2 AS VARCHAR) || '.' || c.name) q
    WHERE source <> target AND source IN (SELECT id FROM files)""",
    *IMPORT_TABLES, "calls", "symbols",
)
def _(t):
    files = t.files.select("id", "path", fn.language(F.col("path")).isNotNull().alias("is_source"))
    calls = t.calls.select("file_id", F.concat(F.lit("conv_"), F.floor(F.col("file_id") / 2).cast("string"), F.lit("."), "name").alias("name"))
    return graph.file_dependencies(files, t.named_imports, calls, t.symbols.select("file_id", F.col("qualified_name").alias("name")))


LEVELS_SQL = """, lv(node, level) AS (SELECT target, 0 FROM deps WHERE target NOT IN (SELECT source FROM deps)
  UNION SELECT d.source, level + 1 FROM lv JOIN deps d ON d.target = lv.node WHERE d.source <> 'region:0' AND level < 10),
behind AS (SELECT 'cycle:0' AS node UNION SELECT d.source FROM behind b JOIN deps d ON d.target = b.node)
SELECT node, CAST(max(level) AS INTEGER) AS level FROM lv WHERE node NOT IN (SELECT node FROM behind) GROUP BY node"""


@query("gra15_levels", None)
def gra15_levels(t):
    return graph.levels(t.deps)


REGISTERED["gra15_levels"] = (gra15_levels, oracle("SELECT 1", "deps").replace("WITH", "WITH RECURSIVE", 1).removesuffix(" SELECT 1") + LEVELS_SQL)


CYCLES_SQL = """, reach(a, b) AS (SELECT source, target FROM deps UNION SELECT r.a, d.target FROM reach r JOIN deps d ON d.source = r.b),
ring AS (SELECT x.a AS node, least(x.a, min(x.b)) AS cycle FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
short AS (SELECT DISTINCT coalesce(p.cycle, d.source) AS source, coalesce(q.cycle, d.target) AS target FROM deps d LEFT JOIN ring p ON p.node = d.source LEFT JOIN ring q ON q.node = d.target
  WHERE coalesce(p.cycle, d.source) <> coalesce(q.cycle, d.target)),
lv(node, level) AS (SELECT target, 0 FROM short WHERE target NOT IN (SELECT source FROM short) UNION SELECT s.source, level + 1 FROM lv JOIN short s ON s.target = lv.node),
sizes AS (SELECT cycle, count(*) AS size FROM ring GROUP BY cycle),
top AS (SELECT node, max(level) AS level FROM lv GROUP BY node)
SELECT n.node, CAST(coalesce(t.level, 0) AS INTEGER) AS level, r.cycle, z.size FROM (SELECT source AS node FROM deps UNION SELECT target FROM deps) n LEFT JOIN ring r ON r.node = n.node LEFT JOIN sizes z ON z.cycle = r.cycle
LEFT JOIN top t ON t.node = coalesce(r.cycle, n.node)"""


@query("gra15_cycles", None)
def gra15_cycles(t):
    return reach.levels_with_cycles(t.deps)


REGISTERED["gra15_cycles"] = (gra15_cycles, oracle("SELECT 1", "deps").replace("WITH", "WITH RECURSIVE", 1).removesuffix(" SELECT 1") + CYCLES_SQL)


@query("gra16_level_dependencies", None)
def gra16(t):
    return graph.level_dependencies(graph.levels(t.deps), t.deps)


REGISTERED["gra16_level_dependencies"] = (
    gra16,
    REGISTERED["gra15_levels"][1].replace("SELECT node, CAST(max(level) AS INTEGER) AS level FROM lv WHERE", "SELECT q.level, count(DISTINCT d.target) AS dependencies FROM (SELECT node, CAST(max(level) AS INTEGER) AS level FROM lv WHERE")
    + ") q JOIN deps d ON d.source = q.node GROUP BY q.level",
)


@query("doc05_forward_paths", None)
def doc05(t):
    return graph.reach_with_paths(t.edges, "order", 1, 4).unionByName(graph.reach_with_paths(t.edges, "lineitem", 2, 4))


REGISTERED["doc05_forward_paths"] = (
    doc05,
    oracle("SELECT 1", "edges").replace("WITH", "WITH RECURSIVE", 1).removesuffix(" SELECT 1")
    + """, walk(t, i, d, seen, top) AS (SELECT 'order', CAST(1 AS BIGINT), 0, ['order:1'], 4 UNION ALL SELECT 'lineitem', CAST(2 AS BIGINT), 0, ['lineitem:2'], 4
  UNION ALL SELECT target_type, target_id, d + 1, list_append(seen, target_type || ':' || target_id), top FROM walk JOIN edges ON source_type = t AND source_id = i WHERE d < top AND NOT list_contains(seen, target_type || ':' || target_id))
SELECT t AS type, i AS id, CAST(d AS INTEGER) AS depth, array_to_string(seen, ' > ') AS path FROM walk WHERE d > 0""",
)


REACH_SQL = """, walk(t, i, d) AS (SELECT 'region', CAST(1 AS BIGINT), 0 UNION SELECT source_type, source_id, d + 1 FROM walk JOIN edges ON target_type = t AND target_id = i WHERE d < 10),
near AS (SELECT t, i, CAST(min(d) AS INTEGER) AS d FROM walk GROUP BY t, i),
tree AS (SELECT n.t, n.i, n.d, min({'t': p.t, 'i': p.i}) AS up FROM near n LEFT JOIN edges e ON e.source_type = n.t AND e.source_id = n.i AND n.d > 0 LEFT JOIN near p ON p.t = e.target_type AND p.i = e.target_id
  WHERE n.d = 0 OR p.d = n.d - 1 GROUP BY n.t, n.i, n.d)"""


def reached(t):
    start = t.region.where("r_regionkey = 1").select(F.lit("region").alias("type"), F.col("r_regionkey").cast("long").alias("id"))
    return reach.reach_tree(t.edges, start, 10, backward=True)


def recursive(body, *projections):
    return oracle("SELECT 1", *projections).replace("WITH", "WITH RECURSIVE", 1).removesuffix(" SELECT 1") + body


@query("doc05_reach_ten", None)
def doc05_reach(t):
    return reached(t)


REGISTERED["doc05_reach_ten"] = (doc05_reach, recursive(REACH_SQL + " SELECT t AS type, i AS id, d AS depth, CASE WHEN d > 0 THEN up.t END AS from_type, CASE WHEN d > 0 THEN up.i END AS from_id FROM tree", "edges"))


@query("doc05_paths_back", None)
def doc05_back(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.lit("lineitem").alias("type"), F.col("o_orderkey").alias("id"))
    return reach.paths_in(reached(t), urgent)


REGISTERED["doc05_paths_back"] = (
    doc05_back,
    recursive(
        REACH_SQL
        + """, up(t, i, depth, nx, path) AS (SELECT t, i, d, tree.up, t || ':' || i FROM tree JOIN orders ON t = 'lineitem' AND i = o_orderkey WHERE o_orderpriority = '1-URGENT'
      UNION ALL SELECT u.t, u.i, u.depth, CASE WHEN r.d > 0 THEN r.up END, r.t || ':' || r.i || ' > ' || u.path FROM up u JOIN tree r ON r.t = u.nx.t AND r.i = u.nx.i)
      SELECT t AS type, i AS id, depth, path FROM up WHERE nx IS NULL""",
        "edges",
    ),
)


# ---- tasks ----
@query(
    "tsk01_new_tasks",
    """SELECT w.target_type, w.target_id, 'pending' AS status FROM (SELECT 'file' AS target_type, id AS target_id FROM files UNION ALL SELECT 'symbol', id FROM symbols WHERE symbol_type IN ('function', 'method', 'class')
    UNION ALL SELECT 'equation', id FROM equations) w WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.target_type = w.target_type AND r.target_id = w.target_id)""",
    "files", "symbols", "equations", "records",
)
def _(t):
    return enrich.new_tasks(t.records, t.files, t.symbols, t.equations)


@query(
    "tsk02_rescan_tasks",
    f"""SELECT 'file' AS target_type, f.id AS target_id, 'pending' AS status FROM files f WHERE f.path IN (SELECT path FROM (SELECT path, hash FROM (SELECT path, CAST(size_bytes AS VARCHAR) AS hash FROM files WHERE analysis_status = 'completed') o) q
    WHERE length(hash) > 3) OR f.analysis_status <> 'completed'""",
    "files",
)
def _(t):
    known = t.files.where("analysis_status = 'completed'").select("path", F.col("size_bytes").cast("string").alias("hash"))
    now = t.files.select("path", F.substring(F.col("size_bytes").cast("string"), 1, 3).alias("hash"))
    return enrich.rescan_tasks(joins.snapshot_diff(known, now), t.files)


@query(
    "tsk03_next_file_tasks",
    r"SELECT r.id AS record_id, f.id AS file_id, f.path FROM files f JOIN records r ON r.target_id = f.id WHERE r.status = 'pending' AND NOT (f.path LIKE '%/_archive/%' OR f.path LIKE '%\_archive\%') ORDER BY r.id LIMIT 10",
    "files", "records",
)
def _(t):
    return enrich.next_tasks(t.files, t.records, 10)


@query(
    "tsk03_next_symbol_tasks",
    r"""SELECT s.id, s.file_id, f.path, r.id AS record_id FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN (SELECT * FROM results WHERE target_type = 'symbol') r ON r.target_id = s.id
    WHERE (r.id IS NULL OR r.status = 'pending') AND NOT (f.path LIKE '%/_archive/%' OR f.path LIKE '%\_archive\%') ORDER BY s.id, r.id LIMIT 10""",
    "symbols", "files", "results",
)
def _(t):
    return enrich.next_undone(t.symbols, t.files, t.results, "symbol", 10)


@query(
    "tsk03_next_equation_tasks",
    r"""SELECT e.id, e.file_id, f.path, r.id AS record_id FROM equations e JOIN files f ON f.id = e.file_id LEFT JOIN (SELECT * FROM results WHERE target_type = 'equation') r ON r.target_id = e.id
    WHERE (r.id IS NULL OR r.status = 'pending') AND NOT (f.path LIKE '%/_archive/%' OR f.path LIKE '%\_archive\%') ORDER BY e.id, r.id LIMIT 10""",
    "equations", "files", "results",
)
def _(t):
    return enrich.next_undone(t.equations, t.files, t.results, "equation", 10)


FILE_PROMPT = "Say what {path} ({language}, {size} bytes) is for.\n\n{text}"
SYMBOL_PROMPT = "Say what {name} ({kind}, lines {first} to {last} of {path}) does."


def asked(kind: str) -> str:
    """The SQL text of what a prompt asks for."""
    kinds = {"text": "string", "maybe": "string", "flag": "boolean", "share": "double", "texts": "array<string>", "pairs": "map<string,string>"}
    lines = [line.split() for line in values.RESULT_FIELDS[kind].strip().split("\n")]
    return "chr(10) || 'Answer with one JSON object of these fields: " + ", ".join(f"{x[0]} ({kinds.get(x[1]) or ' | '.join(values.ALLOWED[x[1]])})" for x in lines) + "'"


@query("tsk04_file_prompts", f"SELECT id, 'Say what ' || path || ' (' || language || ', ' || size_bytes || ' bytes) is for.' || chr(10) || chr(10) || coalesce(text, '') || {asked('file')} AS prompt FROM files", "files")
def _(t):
    context = {"path": F.col("path"), "language": F.col("language"), "size": F.col("size_bytes"), "text": F.col("text")}
    return t.files.select("id", results.prompt(FILE_PROMPT, context, "file").alias("prompt"))


@query("tsk04_symbol_prompts", f"SELECT s.id, 'Say what ' || s.name || ' (' || s.symbol_type || ', lines ' || s.start_line || ' to ' || s.end_line || ' of ' || f.path || ') does.' || {asked('symbol')} AS prompt FROM symbols s JOIN files f ON f.id = s.file_id", "symbols", "files")
def _(t):
    placed = t.symbols.join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    context = {"name": F.col("name"), "kind": F.col("symbol_type"), "first": F.col("start_line"), "last": F.col("end_line"), "path": F.col("path")}
    return placed.select("id", results.prompt(SYMBOL_PROMPT, context, "symbol").alias("prompt"))


def problem_sql(kind: str) -> str:
    """SQL for the first thing wrong with the JSON text j (valid) of a result."""
    cases = ["WHEN NOT json_valid(output_json) THEN 'invalid JSON'", "WHEN json_type(j) <> 'OBJECT' THEN 'no object'"]
    for line in values.RESULT_FIELDS[kind].strip().split("\n"):
        name, what, *default = line.split()
        found = f"json_type(j, '$.{name}')"
        if what in ("text", "flag", "share") and not default:
            cases.append(f"WHEN {found} IS NULL THEN '{name}: missing'")
        if what in values.ALLOWED:
            cases += [f"WHEN {found} <> 'VARCHAR' THEN '{name}: no text'", f"WHEN json_extract_string(j, '$.{name}') NOT IN ({quoted(values.ALLOWED[what])}) THEN '{name}: not allowed'"]
        elif what == "share":
            number = f"TRY_CAST(json_extract_string(j, '$.{name}') AS DOUBLE)"
            cases += [f"WHEN {found} NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'VARCHAR') OR {found} IS NOT NULL AND {number} IS NULL THEN '{name}: no number'", f"WHEN {number} NOT BETWEEN 0 AND 1 THEN '{name}: out of range'"]
        elif what == "flag":
            cases.append(f"WHEN {found} <> 'BOOLEAN' THEN '{name}: no flag'")
        elif what in ("texts", "pairs"):
            shape, inner, said = ("ARRAY", "[*]", "no list of texts") if what == "texts" else ("OBJECT", ".*", "no texts by name")
            cases.append(f"WHEN {found} <> '{shape}' OR len(list_filter(json_type(j, '$.{name}{inner}'), lambda x: x <> 'VARCHAR')) > 0 THEN '{name}: {said}'")
        else:
            cases.append(f"WHEN {found} NOT IN ('VARCHAR'{", 'NULL'" if what == 'maybe' else ''}) THEN '{name}: no text'")
    return "CASE " + " ".join(cases) + " END"


def judged_sql(kind: str, targets: str) -> str:
    """SQL of the submissions of a kind with the JSON text j, target_id and error."""
    plain = f"SELECT *, CASE WHEN json_valid(output_json) THEN output_json ELSE 'null' END AS j, CAST(split_part(task_id, '_', -1) AS BIGINT) AS target_id FROM submissions WHERE target_type = '{kind}'"
    return f"SELECT q.*, coalesce({problem_sql(kind)}, CASE WHEN target_id NOT IN (SELECT id FROM {targets}) THEN '{kind} record not found for task_id ' || task_id END) AS error FROM ({plain}) q"


def submissions(t, kind):
    return t.submissions.where(F.col("target_type") == kind)


for _kind, _table in (("file", "files"), ("symbol", "symbols"), ("equation", "equations")):

    @query(f"tsk06_validated_{_kind}", f"SELECT id, e IS NULL AS is_valid, e AS error FROM (SELECT id, {problem_sql(_kind)} AS e FROM (SELECT *, CASE WHEN json_valid(output_json) THEN output_json ELSE 'null' END AS j FROM submissions WHERE target_type = '{_kind}') q) p", "submissions")
    def _(t, kind=_kind):
        return results.validated(submissions(t, kind), kind).select("id", "is_valid", "error")

    @query(f"tsk05_accepted_{_kind}", f"SELECT id, error IS NULL AS accepted, error FROM ({judged_sql(_kind, _table)}) q", "submissions", _table)
    def _(t, kind=_kind, table=_table):
        return results.judged(submissions(t, kind), getattr(t, table), kind).select("id", "accepted", "error")


def done_sql(kind: str, targets: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY id DESC) AS place FROM ({judged_sql(kind, targets)}) a WHERE error IS NULL) b WHERE place = 1"


def done(t, kind, table):
    return results.latest(results.judged(submissions(t, kind), getattr(t, table), kind))


@query(
    "tsk05_submit_file",
    f"""SELECT f.id, CASE WHEN d.id IS NULL THEN f.purpose ELSE d.j->>'$.purpose' END AS purpose, CASE WHEN d.id IS NULL THEN f.llm_summary ELSE d.j->>'$.summary' END AS llm_summary,
    CAST(d.j->>'$.confidence' AS DOUBLE) AS llm_confidence, CASE WHEN d.id IS NULL THEN f.is_core ELSE CAST(d.j->>'$.is_core' AS BOOLEAN) END AS is_core,
    CASE WHEN d.id IS NULL THEN f.key_concepts ELSE CAST(d.j->'$.key_concepts' AS VARCHAR) END AS key_concepts, CASE WHEN d.id IS NULL THEN f.risk_notes ELSE coalesce(CAST(d.j->'$.risk_notes' AS VARCHAR), '[]') END AS risk_notes,
    CASE WHEN d.id IS NULL THEN f.analysis_status ELSE 'completed' END AS analysis_status FROM files f LEFT JOIN ({done_sql('file', 'files')}) d ON d.target_id = f.id""",
    "submissions", "files",
)
def _(t):
    return results.submitted(t.files, done(t, "file", "files"), "file").select("id", *results.CHANGES["file"])


@query(
    "tsk05_submit_symbol",
    f"""SELECT s.id, d.j->>'$.responsibility' AS llm_summary, d.j->>'$.responsibility' AS responsibility, CAST(d.j->'$.side_effects' AS VARCHAR) AS side_effects, CAST(d.j->>'$.confidence' AS DOUBLE) AS confidence
    FROM symbols s LEFT JOIN ({done_sql('symbol', 'symbols')}) d ON d.target_id = s.id""",
    "submissions", "symbols",
)
def _(t):
    return results.submitted(t.symbols, done(t, "symbol", "symbols"), "symbol").select("id", *results.CHANGES["symbol"])


@query(
    "tsk05_submit_equation",
    f"""SELECT e.id, CASE WHEN d.id IS NULL THEN e.name ELSE d.j->>'$.name' END AS name, CASE WHEN d.id IS NULL THEN e.equation_type ELSE d.j->>'$.equation_type' END AS equation_type, d.j->>'$.mathematical_meaning' AS mathematical_meaning,
    CASE WHEN d.id IS NOT NULL THEN d.j->>'$.physical_meaning' END AS physical_meaning, d.j->>'$.algorithmic_role' AS algorithmic_role, CAST(d.j->'$.inputs' AS VARCHAR) AS inputs_json,
    CASE WHEN d.id IS NOT NULL THEN '[]' END AS outputs_json, CASE WHEN d.id IS NOT NULL THEN '[]' END AS intermediate_variables_json, CASE WHEN d.id IS NOT NULL THEN '[]' END AS constants_json, CAST(d.j->'$.units' AS VARCHAR) AS units_json,
    CASE WHEN d.id IS NOT NULL THEN '[]' END AS assumptions, CAST(d.j->>'$.confidence' AS DOUBLE) AS confidence FROM equations e LEFT JOIN ({done_sql('equation', 'equations')}) d ON d.target_id = e.id""",
    "submissions", "equations",
)
def _(t):
    return results.submitted(t.equations, done(t, "equation", "equations"), "equation").select("id", *results.CHANGES["equation"])


@query(
    "tsk05_records",
    f"""SELECT 'file' AS target_type, target_id, 'completed' AS status, CAST(j->>'$.confidence' AS DOUBLE) AS confidence FROM ({done_sql('file', 'files')}) d
    UNION ALL SELECT target_type, target_id, status, confidence FROM records WHERE target_id NOT IN (SELECT target_id FROM ({done_sql('file', 'files')}) d)""",
    "submissions", "files", "records",
)
def _(t):
    records = t.records.withColumn("output_json", F.lit(None).cast("string"))
    return results.with_results(records, done(t, "file", "files"), "file").drop("output_json")


@query("tsk09_latest_progress", "SELECT status, count(*) AS n FROM (SELECT target_type, target_id, arg_max(status, id) AS status FROM results GROUP BY 1, 2) q GROUP BY status", "results")
def _(t):
    return enrich.latest_records(t.results).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("tsk12_cost", "SELECT id, round((length('Judge source code.') + length(text)) / 4.0 / 1000000 * 5.0 + 500 / 1000000.0 * 15.0, 9) AS cost FROM files", "files")
def _(t):
    return t.files.select("id", F.round(fn.estimated_cost(F.lit("Judge source code."), F.col("text")), 9).alias("cost"))


PRICES = "VALUES " + ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in values.MODEL_PRICES.items())


@query(
    "tsk12_cost_by_model",
    f"""SELECT f.id, f.model, round(length(text) / 4e0 / 1e6 * coalesce(CAST(p.a AS DOUBLE), 5e0) + 500e0 / 1e6 * coalesce(CAST(p.b AS DOUBLE), 15e0), 12) AS cost FROM
    (SELECT *, CASE id % 7 WHEN 0 THEN 'claude-3-5-sonnet-20241022' WHEN 1 THEN 'claude-3-opus-20240229' WHEN 2 THEN 'gpt-4o' WHEN 3 THEN 'gpt-4o-mini' WHEN 4 THEN 'gemini-1.5-pro' WHEN 5 THEN 'other' END AS model FROM files) f LEFT JOIN ({PRICES}) p(m, a, b) ON p.m = f.model""",
    "files",
)
def _(t):
    model = F.get(F.array(*map(F.lit, values.MODEL_PRICES), F.lit("other")), (F.col("id") % 7).cast("int"))
    return t.files.select("id", model.alias("model"), F.round(fn.estimated_cost(F.lit(""), F.col("text"), model), 12).alias("cost"))


@query("tsk13_context_hash", """SELECT id, substring(sha256('{"id":' || id || ',"language":"' || language || '","path":"' || path || '"}'), 1, 16) AS context_hash FROM files""", "files")
def _(t):
    return t.files.select("id", fn.context_hash("path", "language", "id").alias("context_hash"))


# ---- changes ----
@query(
    "snk01_upsert",
    "SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NOT NULL THEN n.hash ELSE o.hash END AS hash FROM snapshot_old o FULL OUTER JOIN snapshot_new n ON o.path = n.path",
    "snapshot_old", "snapshot_new",
)
def _(t):
    return dml.upsert(t.snapshot_old, t.snapshot_new, ["path"], ["hash"])


@query(
    "snk02_insert_symbols",
    """SELECT id, kind, row_number() OVER (PARTITION BY file_id ORDER BY k, start_line, id)::INTEGER AS place FROM (SELECT id, file_id, start_line, symbol_type AS kind, CASE symbol_type WHEN 'function' THEN 0 ELSE 1 END AS k FROM symbols
    UNION ALL SELECT id, file_id, 0, 'variable', 2 FROM variables) q""",
    "symbols", "variables",
)
def _(t):
    part = lambda kind: t.symbols.where(F.col("symbol_type") == kind).select("id", "file_id", "start_line")
    return dml.symbols_in_order(part("function"), part("class"), t.variables.select("id", "file_id", F.lit(0).cast("long").alias("start_line"))).select("id", "kind", "place")


@query("snk03_insert_ignore", "SELECT path, hash FROM snapshot_old UNION ALL SELECT path, hash FROM snapshot_new WHERE path NOT IN (SELECT path FROM snapshot_old)", "snapshot_old", "snapshot_new")
def _(t):
    return dml.insert_ignore(t.snapshot_old, t.snapshot_new, ["path"])


@query(
    "snk04_add_edges",
    f"""SELECT source_type, source_id, target_type, target_id, edge_type FROM edges UNION SELECT * FROM ({FILE_EDGES}) f
    UNION SELECT source_type, source_id, target_type, target_id, edge_type FROM edges WHERE edge_type = 'USES'""",
    "edges", *IMPORT_TABLES,
)
def _(t):
    full = lambda df: df.select(*enrich.EDGE_KEY).withColumns({"evidence": F.lit("x"), "confidence": F.lit(1.0)})
    new = full(file_edges(t)).unionByName(full(t.edges.where("edge_type = 'USES'")))
    return enrich.add_edges(full(t.edges), new).select(*enrich.EDGE_KEY)


@query(
    "snk05_new_variables",
    "SELECT DISTINCT e.file_id, e.symbol_id, 'k' || CAST(e.id % 20 AS VARCHAR) AS name, 'input' AS role FROM equations e WHERE NOT EXISTS (SELECT 1 FROM variables v WHERE v.file_id = e.file_id AND v.symbol_id IS NOT DISTINCT FROM e.symbol_id AND v.name = 'k' || CAST(e.id % 20 AS VARCHAR) AND v.role = 'input')",
    "equations", "variables",
)
def _(t):
    wanted = t.equations.select("file_id", "symbol_id", F.concat(F.lit("k"), (F.col("id") % 20).cast("string")).alias("name"), F.lit("input").alias("role"))
    return enrich.new_variables(t.variables, wanted).select("file_id", "symbol_id", "name", "role")


@query(
    "snk07_cascade_edges",
    """, gone AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
    SELECT source_id, target_id, edge_type FROM edges WHERE NOT (source_type = 'customer' AND source_id IN (SELECT id FROM gone)) AND NOT (target_type = 'customer' AND target_id IN (SELECT id FROM gone))""",
    "edges",
)
def _(t):
    gone = t.customer.join(t.orders, t.customer["c_custkey"] == t.orders["o_custkey"], "left_anti")
    dead = gone.select(F.lit("customer").alias("node_type"), F.col("c_custkey").alias("node_id"))
    return dml.cascade_edges(t.edges, dead).select("source_id", "target_id", "edge_type")


@query("snk09_without_node", "SELECT * FROM edges WHERE NOT (source_type = 'customer' AND source_id = 7) AND NOT (target_type = 'customer' AND target_id = 7)", "edges")
def _(t):
    return dml.without_node(t.edges, "customer", 7)


@query(
    "snk07_stale_records",
    "SELECT id, CASE WHEN target_type = 'symbol' AND target_id NOT IN (SELECT id FROM symbols) THEN 'stale' ELSE status END AS status FROM results",
    "results", "symbols",
)
def _(t):
    named = t.results.where("target_type = 'symbol'").select(F.col("target_id").alias("id")).distinct()
    dead = named.join(t.symbols, "id", "left_anti").select(F.lit("symbol").alias("node_type"), F.col("id").alias("node_id"))
    return dml.stale_records(t.results, dead).select("id", "status")


@query(
    "snk08_nodes_of_dead_files",
    """, gone AS (SELECT target_id AS id FROM records WHERE status = 'failed' AND target_id IN (SELECT id FROM files))
    SELECT 'file' AS node_type, id AS node_id FROM gone UNION ALL SELECT 'symbol', id FROM symbols WHERE file_id IN (SELECT id FROM gone) UNION ALL SELECT 'equation', id FROM equations WHERE file_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'variable', id FROM variables WHERE file_id IN (SELECT id FROM gone)""",
    "files", "symbols", "equations", "variables", "records",
)
def _(t):
    failed = t.records.where("status = 'failed'").select(F.col("target_id").alias("id"))
    return dml.nodes_of_files(t.files.join(failed, "id", "left_semi"), t.symbols, t.equations, t.variables)


@query(
    "snk01_in_place",
    "SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NOT NULL THEN n.hash ELSE o.hash END AS hash FROM snapshot_old o FULL OUTER JOIN snapshot_new n ON o.path = n.path",
    "snapshot_old", "snapshot_new",
)
def _(t):
    table = KeyedTable(t.spark, f"{shared_folder(t.spark)}/weftline-keyed-{uuid.uuid4().hex}", ["path"], "path string, hash string")
    table.insert_ignore(t.snapshot_old)
    table.upsert(t.snapshot_new, ["hash"])
    return table.read()


@query("fn17_qualified_names", None)
def fn17_qualified(t):
    key = F.concat_ws(":", F.col("source_type"), F.col("source_id").cast("string"))
    above = t.edges.where("edge_type <> 'DEFINES'").select(key.alias("node"), F.concat_ws(":", F.col("target_type"), F.col("target_id").cast("string")).alias("parent"))
    named = t.nodes.select(F.concat_ws(":", F.col("node_type"), F.col("node_id").cast("string")).alias("node"), "name")
    return hierarchy.ancestry(named.join(above, "node", "left"))


REGISTERED["fn17_qualified_names"] = (
    fn17_qualified,
    recursive(
        """, named AS (SELECT node_type || ':' || node_id AS node, name FROM nodes), above AS (SELECT source_type || ':' || source_id AS node, target_type || ':' || target_id AS parent FROM edges WHERE edge_type <> 'DEFINES'),
        down(node, root, depth, names) AS (SELECT n.node, n.node, 0, n.name FROM named n WHERE NOT EXISTS (SELECT 1 FROM above a JOIN named p ON p.node = a.parent WHERE a.node = n.node)
          UNION ALL SELECT n.node, d.root, d.depth + 1, d.names || '.' || n.name FROM down d JOIN above a ON a.parent = d.node JOIN named n ON n.node = a.node)
        SELECT node, root, depth, names AS qualified_name FROM down""",
        "nodes", "edges",
    ),
)


@query("snk12_snapshot_round_trip", "SELECT path, hash FROM snapshot_new", "snapshot_new")
def _(t):
    return dml.read_snapshot(dml.snapshot_json(t.snapshot_new))


@query("snk16_added_columns", "SELECT id, CAST(NULL AS VARCHAR) AS visibility, CAST(NULL AS BIGINT) AS parent_symbol_id FROM symbols", "symbols")
def _(t):
    from pyspark.sql import types as T

    return dml.with_columns_added(t.symbols.select("id"), T.StructType().add("id", "long").add("visibility", "string").add("parent_symbol_id", "long"))


# ---- column functions ----
@query("fn01_sha256", "SELECT id, sha256(text) AS hash FROM files", "files")
def _(t):
    return t.files.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("fn02_path_parts", "SELECT id, lower(regexp_extract(filename, '[^/](\\.[^./]+)$', 1)) AS extension, split_part(path, '/', -1) AS filename, regexp_replace(filename, '\\.[^./]+$', '') AS stem FROM files".replace("\\\\", "\\"), "files")
def _(t):
    return t.files.select("id", fn.suffix(F.col("filename")).alias("extension"), fn.filename(F.col("path")).alias("filename"), fn.stem(F.col("filename")).alias("stem"))


@query("fn04_language", "SELECT id, CASE id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'rust' WHEN 3 THEN 'markdown' ELSE 'yaml' END AS language, true AS is_source FROM files", "files")
def _(t):
    lang = fn.language(F.col("path"))
    return t.files.select("id", lang.alias("language"), lang.isNotNull().alias("is_source"))


@query("fn06_is_test", "SELECT id, id % 5 = 0 AND id % 7 = 0 OR id % 5 = 2 AND id % 7 = 0 OR starts_with(path, 'test/') OR contains(path, '/test/') AS is_test FROM files", "files")
def _(t):
    return t.files.select("id", fn.is_test(F.col("path")).alias("is_test"))


@query("fn07_is_config", "SELECT id, ends_with(path, '.yaml') AS is_config, filename IN ('main.py') AS is_entrypoint FROM files", "files")
def _(t):
    return t.files.select("id", fn.is_config(F.col("path")).alias("is_config"), fn.is_entrypoint(F.col("path")).alias("is_entrypoint"))


@query("src04_excluded", "SELECT id, list_contains(string_split(path, '/'), '_archive') AS excluded, true AS included FROM files", "files")
def _(t):
    return t.files.select("id", fn.excluded(F.col("path")).alias("excluded"), fn.included(F.col("path")).alias("included"))


@query("fn09_truncated", "SELECT id, CASE WHEN length(text) > 200 THEN substring(text, 1, 197) || '...' ELSE text END AS short FROM files", "files")
def _(t):
    return t.files.select("id", agg.truncated(F.col("text")).alias("short"))


@query(
    "fn10_safe_json",
    """SELECT id, json_valid(output_json) AS ok, CASE WHEN NOT json_valid(output_json) THEN '{}' WHEN output_json->>'$.responsibility' IS NULL THEN '{"confidence":' || (output_json->>'$.confidence') || '}'
    ELSE '{"responsibility":"' || (output_json->>'$.responsibility') || '","confidence":' || (output_json->>'$.confidence') || '}' END AS dumped FROM results""",
    "results",
)
def _(t):
    read = fn.safe_json(F.col("output_json"), "responsibility string, confidence double")
    return t.results.select("id", read.isNotNull().alias("ok"), F.coalesce(F.to_json(read), F.lit("{}")).alias("dumped"))


@query("fn18_class_kind", "SELECT id, symbol_type AS kind FROM symbols", "symbols")
def _(t):
    plural = F.when(F.col("symbol_type") == "class", "classes").otherwise("functions")
    return t.symbols.select("id", fn.class_kind(plural).alias("kind"))


@query("fn11_equations", f"SELECT id, substring(text, 1, 500) AS expression FROM files WHERE regexp_matches(lower(text), '{'|'.join(EQUATION_WORDS)}')", "files")
def _(t):
    return t.files.where(fn.looks_like_equation(F.col("text"))).select("id", F.substring("text", 1, 500).alias("expression"))


@query("fn11_equations_own_words", "SELECT id FROM files WHERE regexp_matches(lower(text), 'ering|the')", "files")
def _(t):
    return t.files.where(fn.looks_like_equation(F.col("text"), ["ering", "the"])).select("id")


@query("fn12_module_names", "SELECT id, replace(replace(path, '/', '.'), '.py', '') AS module, split_part(replace(replace(path, '/', '.'), '.py', ''), '.', -1) AS last FROM files", "files")
def _(t):
    module = joins.module_of(F.col("path"))
    return t.files.select("id", module.alias("module"), joins.last_part(module).alias("last"))


@query("fn14_evidence_names", f"SELECT source_id, trim(replace(replace(evidence, 'Import: ', ''), 'Call to ', '')) AS name FROM ({STATIC}) e", "symbols", "links", "imports", "calls")
def _(t):
    raw = enrich.static_edges(t.symbols, t.imports, t.calls.withColumnRenamed("id", "caller_id"))
    return raw.select("source_id", enrich.name_in(F.col("evidence")).alias("name"))


@query("fn15_unquoted", """SELECT id, regexp_replace('"' || name || '''', '^["'']+|["'']+$', '', 'g') AS name FROM symbols""", "symbols")
def _(t):
    return t.symbols.select("id", fn.unquoted(F.concat(F.lit('"'), "name", F.lit("'"))).alias("name"))


@query("fn16_comment_text", "SELECT id, trim(regexp_replace('## ' || text, '^[# /]+', '')) AS comment FROM files", "files")
def _(t):
    return t.files.select("id", fn.comment_text(F.concat(F.lit("## "), "text")).alias("comment"))


@query("fn17_qualified", "SELECT id, concat_ws('.', CASE WHEN file_id % 2 = 0 THEN qualified_name ELSE name END, name) AS qualified FROM symbols", "symbols")
def _(t):
    return t.symbols.select("id", fn.qualified(F.when(F.col("file_id") % 2 == 0, F.col("qualified_name")), F.col("name"), F.col("name")).alias("qualified"))


@query("fn19_task_key", "SELECT id, CAST(split_part(name, '_', -1) AS BIGINT) AS key FROM symbols", "symbols")
def _(t):
    return t.symbols.select("id", fn.task_key(F.col("name")).alias("key"))


@query("fn22_trusted", "SELECT id, CASE WHEN coalesce(confidence, 0) = 0 THEN 0.8 ELSE confidence END AS confidence FROM results", "results")
def _(t):
    return t.results.select("id", enrich.trusted(F.col("confidence")).alias("confidence"))


@query(
    "fn24_line_edit",
    """SELECT id, array_to_string(list_concat(list_concat(string_split(text, chr(10))[1:1], CASE WHEN id % 3 = 0 THEN [] ELSE ['new line'] END), CASE WHEN id % 3 = 2 THEN string_split(text, chr(10))[2:] ELSE string_split(text, chr(10))[4:] END), chr(10)) AS edited FROM files""",
    "files",
)
def _(t):
    kind = F.when(F.col("id") % 3 == 0, "delete").when(F.col("id") % 3 == 1, "replace").otherwise("insert")
    return t.files.select("id", fn.edited(F.col("text"), kind, F.lit(2), F.lit(3), F.lit("new line")).alias("edited"))


# ---- search ----
@query(
    "doc01_bm25",
    """, w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_-]+') AS ws FROM files), s AS (SELECT id, len(ws) AS dl, len(list_filter(ws, lambda x: x = 'the')) AS a, len(list_filter(ws, lambda x: x = 'les')) AS b FROM w),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM s)
    SELECT id, round(CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END, 6) AS score
    FROM s, st WHERE a > 0 OR b > 0""",
    "files",
)
def _(t):
    return search.bm25(t.files.select("id", "text"), ["the", "les"]).withColumn("score", F.round("score", 6))


@query(
    "doc02_tiered_search",
    "SELECT node_type, node_id, CAST(min(tier) AS INTEGER) AS tier FROM (SELECT node_type, node_id, 1 AS tier FROM nodes WHERE name = 'Customer#000000007' UNION ALL SELECT node_type, node_id, 2 FROM nodes WHERE name ILIKE '%00000001%' UNION ALL SELECT source_type, source_id, 3 FROM edges WHERE target_type = 'customer' AND target_id = 7) q GROUP BY node_type, node_id ORDER BY 3, 1, 2 LIMIT 25",
    "nodes", "edges",
)
def _(t):
    exact = t.nodes.where("name = 'Customer#000000007'")
    near = t.edges.where("target_type = 'customer' and target_id = 7").select(F.col("source_type").alias("node_type"), F.col("source_id").alias("node_id"))
    return search.tiered([exact, t.nodes.where(F.col("name").ilike("%00000001%")), near], 25)


TIERS_SQL = """, w AS (SELECT node_type AS t, node_id AS i, name, regexp_extract_all(lower(name), '[a-z0-9_-]+') AS ws FROM nodes),
s AS (SELECT t, i, name, len(ws) AS dl, len(list_filter(ws, lambda x: x = 'asia')) AS a FROM w),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da FROM s),
hits AS (SELECT t, i, 1 AS tier, CAST(NULL AS DOUBLE) AS score, 0 AS depth FROM s WHERE name = 'ASIA'
  UNION ALL SELECT t, i, 2, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)), 0 FROM s, st WHERE a > 0 AND name <> 'ASIA'),
walk(t, i, d) AS (SELECT t, i, 0 FROM hits UNION SELECT CASE WHEN source_type = t AND source_id = i THEN target_type ELSE source_type END, CASE WHEN source_type = t AND source_id = i THEN target_id ELSE source_id END, d + 1
  FROM walk JOIN edges ON (source_type = t AND source_id = i) OR (target_type = t AND target_id = i) WHERE d < 2),
far AS (SELECT t, i, 3 AS tier, CAST(NULL AS DOUBLE) AS score, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY t, i HAVING min(d) > 0)
SELECT t AS node_type, i AS node_id, tier, round(score, 6) AS score, depth FROM (SELECT * FROM hits UNION ALL SELECT * FROM far) q ORDER BY tier, q.score DESC NULLS LAST, depth, t, i LIMIT 300"""


@query("doc02_three_tiers", None)
def doc02_three(t):
    return search.tiered_text(t.nodes, t.edges, "ASIA", 300).withColumn("score", F.round("score", 6))


REGISTERED["doc02_three_tiers"] = (doc02_three, recursive(TIERS_SQL, "nodes", "edges"))


@query("doc03_identifier_words", "SELECT page_id, lower(replace(regexp_replace(url, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '.', '_')) AS words FROM pages".replace("\\\\", "\\"))
def _(t):
    return t.pages.select("page_id", search.identifier_words(F.col("url")).alias("words"))


@query(
    "doc01_bm25_columns",
    """, w AS (SELECT id, regexp_extract_all(lower(path), '[a-z0-9_-]+') AS p, regexp_extract_all(lower(coalesce(llm_summary, '')), '[a-z0-9_-]+') AS t FROM files),
    s AS (SELECT id, len(p) + len(t) AS dl, 4 * len(list_filter(p, lambda x: starts_with(x, 'doc_1'))) + len(list_filter(t, lambda x: starts_with(x, 'doc_1'))) AS a, 4 * len(list_filter(p, lambda x: x = 'les')) + len(list_filter(t, lambda x: x = 'les')) AS b FROM w),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM s)
    SELECT id, round(CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END, 6) AS score
    FROM s, st WHERE a > 0 OR b > 0""",
    "files",
)
def _(t):
    return search.bm25(t.files, ["doc_1*", "les"], weights={"path": 4.0, "llm_summary": 1.0}).withColumn("score", F.round("score", 6))


def words_of(t):
    """The stored word index of the files' texts."""
    return t.index("words", "documents", lambda index: postings.add_texts(index, t.files.select("id", "text")))


@query("doc01_stored_words", REGISTERED["doc01_bm25"][1])
def _(t):
    return postings.ranked(words_of(t), ["the", "les"]).withColumn("score", F.round("score", 6))


@query(
    "doc01_stored_best",
    """, w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_-]+') AS ws FROM files), s AS (SELECT id, len(ws) AS dl, len(list_filter(ws, lambda x: starts_with(x, 'tion'))) AS a, len(list_filter(ws, lambda x: x = 'les')) AS b,
      len(list_filter(ws, lambda x: starts_with(x, 'thing'))) AS c FROM w),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM s)
    SELECT id, round(score, 6) AS score FROM (SELECT id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl))
      + ln(1 + (n - dc + 0.5) / (dc + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM s, st WHERE a > 0 OR b > 0 OR c > 0) q ORDER BY q.score DESC, id LIMIT 20""",
    "files",
)
def _(t):
    return postings.ranked(words_of(t), ["tion*", "les", "thing*"], k=20).withColumn("score", F.round("score", 6))


def grams_of(t):
    """The stored trigram index of the pages' texts."""
    return t.index("grams", "pages", lambda index: postings.add_grams(index, t.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"))))


@query("doc04_stored_grams", "SELECT page_id, length(html) AS n FROM pages WHERE contains(html, 'href=\"/aulich\">')")
def _(t):
    return postings.holding(grams_of(t), 'href="/aulich">').select(F.col("id").alias("page_id"), F.length("text").cast("long").alias("n"))


@query("doc04_trigram_search", "SELECT page_id, url FROM pages WHERE contains(url, 'example.net/fr')")
def _(t):
    return search.trigram_search(search.trigram_index(t.pages, "page_id", "url"), t.pages, "page_id", "url", "example.net/fr").select("page_id", "url")


@query("doc05_backward_paths", None)
def doc05_backward(t):
    return graph.reach_with_paths(t.edges, "customer", 7, 2, backward=True)


REGISTERED["doc05_backward_paths"] = (
    doc05_backward,
    oracle("SELECT 1", "edges").replace("WITH", "WITH RECURSIVE", 1).removesuffix(" SELECT 1")
    + """, walk(t, i, d, seen) AS (SELECT 'customer', CAST(7 AS BIGINT), 0, ['customer:7']
  UNION ALL SELECT source_type, source_id, d + 1, list_append(seen, source_type || ':' || source_id) FROM walk JOIN edges ON target_type = t AND target_id = i WHERE d < 2 AND NOT list_contains(seen, source_type || ':' || source_id))
SELECT t AS type, i AS id, CAST(d AS INTEGER) AS depth, array_to_string(seen, ' > ') AS path FROM walk WHERE d > 0""",
)


@query(
    "doc08_agreement",
    "SELECT target_type, target_id, round(max(n) / sum(n), 9) AS agreement, max(n) / sum(n) < 0.66 AS flagged FROM (SELECT target_type, target_id, status, count(*) AS n FROM results GROUP BY ALL) q GROUP BY target_type, target_id",
    "results",
)
def _(t):
    return enrich.agreement(t.results, ["target_type", "target_id"], "status").withColumn("agreement", F.round("agreement", 9))


@query("doc08_grounded", "SELECT c.id, c.name, c.name IN (SELECT name FROM symbols) AS is_grounded FROM calls c", "calls", "symbols")
def _(t):
    return search.grounded(t.calls.select("id", "name"), t.symbols).select("id", "name", "is_grounded")


@query("doc10_search_nodes", "SELECT node_type, node_id, name FROM nodes WHERE node_type IN ('customer', 'supplier', 'nation') AND name ILIKE '%er#00000001%'", "nodes")
def _(t):
    return search.search_nodes(t.nodes, "er#00000001", ["customer", "supplier", "nation"])
