"""Graph operators: target resolution, bounded reverse reachability, neighbourhoods, delete safety, file dependencies,
dependency levels.

Loops run on the driver, one set of joins a round; frontiers are node sets, so a round handles each node once however
many edges reach it, and multi-edges never multiply paths. What a round gives is written, so no round is done again.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as fn
from weftline.functions.values import REFERENCE_EDGES
from weftline.operators.filters import impact_edges, of_kinds
from weftline.operators.joins import defining_files, imports_by_suffix
from weftline.sources.shared import release, written

#: Tables of placed nodes that levels() keeps before it writes them as one.
MERGED = 40
#: Rows of a frontier that impact() broadcasts at most.
FRONTIER = 500_000
#: Nodes whose edges reach_with_paths() asks for by their ids at most.
NEAR = 1000


def resolve_targets(wanted: DataFrame, files: DataFrame, symbols: DataFrame, equations: DataFrame) -> DataFrame:
    """wanted (target_type, name, path) with matches and id: files are known by path, symbols by name or by their
    qualified name equal to path, equations by name equal to either. id is null unless there is exactly one match."""
    wanted = wanted.distinct()
    counted = lambda df, n, **keys: df.groupBy(*(F.col(c).alias(k) for k, c in keys.items())).agg(F.count_distinct("id").alias(n), F.min("id").alias(f"{n}_id"))
    of = lambda kind: wanted.where(F.col("target_type") == kind)
    zero = lambda n: F.coalesce(n, F.lit(0))
    # matches of either key less those of both: only counts are joined, so many equal names make no pairs
    by_path = of("file").join(counted(files, "a", path="path"), "path", "left").withColumn("matches", zero("a"))
    by_name = of("symbol").join(counted(symbols, "a", name="name"), "name", "left").join(counted(symbols, "b", path="qualified_name"), "path", "left")
    by_name = by_name.join(counted(symbols, "c", name="name", path="qualified_name"), ["name", "path"], "left").withColumn("matches", zero("a") + zero("b") - zero("c"))
    either = of("equation").join(counted(equations, "a", name="name"), "name", "left").join(counted(equations, "b", path="name"), "path", "left")
    either = either.withColumn("matches", zero("a") + F.when(F.col("name") == F.col("path"), 0).otherwise(zero("b")))
    shaped = lambda df, *ids: df.select("target_type", "name", "path", "matches", F.when(F.col("matches") == 1, F.coalesce(*ids)).alias("id"))
    return shaped(by_path, "a_id").unionByName(shaped(by_name, "a_id", "b_id")).unionByName(shaped(either, "a_id", "b_id"))


def find_target(target_type: str, name: str | None, path: str | None, files: DataFrame, symbols: DataFrame, equations: DataFrame) -> int | None:
    """The id of the one node that fits, None if there is none; raises if several do."""
    wanted = files.sparkSession.createDataFrame([(target_type, name, path)], "target_type string, name string, path string")
    row = resolve_targets(wanted, files, symbols, equations).first()
    if row["matches"] > 1:
        raise ValueError(f"{row['matches']} nodes fit {target_type} {name or path}")
    return row["id"]


def named(sources: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """The nodes (source_type, source_id, name) that are sources of found edges; with few of these, without a shuffle of
    all nodes."""
    wanted = found.select("source_type", "source_id").distinct()
    return sources.join(F.broadcast(wanted) if small else wanted, ["source_type", "source_id"], "left_semi")


def impact(edges: DataFrame, nodes: DataFrame, node_type: str, node_id: int, max_depth: int = 3) -> DataFrame:
    """Edges by which others depend on the node, with depth: type, id, name, edge_type, depth, reach.

    A node at depth <= max_depth is expanded once, at its least depth, so entries reach max_depth + 1. Only edges that
    carry impact count; an edge from an unknown node is neither given nor followed. Entries are per edge: a node may
    occur under several edge types and depths. reach is direct at depth 1, else transitive.

    A round reads the written, narrow edges once and joins them with its frontier, the nodes that its predecessor reached
    and none before it; names, written once, are looked up for what was found, not for all edges. Frontiers and what they find are
    broadcast up to FRONTIER rows.
    """
    spark = edges.sparkSession
    sources = written(nodes.select(F.col("node_type").alias("source_type"), F.col("node_id").alias("source_id"), "name"), "names")
    known = written(impact_edges(edges).select("source_type", "source_id", "target_type", "target_id", "edge_type"), "known")
    frontier = visited = spark.range(1).select(F.lit(node_type).alias("target_type"), F.lit(node_id).cast("long").alias("target_id"))
    found, small = [], True
    for depth in range(max_depth + 1):
        step = written(known.join(F.broadcast(frontier) if small else frontier, ["target_type", "target_id"]).withColumn("depth", F.lit(depth + 1)), "step")
        small = step.count() <= FRONTIER
        level = written(step.join(named(sources, step, small), ["source_type", "source_id"]), "level")
        release(step)
        if depth < max_depth:
            reached = level.select(F.col("source_type").alias("target_type"), F.col("source_id").alias("target_id")).distinct()
            frontier = reached.join(visited, ["target_type", "target_id"], "left_anti")
            visited = visited.unionByName(reached)
        found.append(level)
    release(known)
    release(sources)
    return reduce(DataFrame.unionByName, found).select(
        F.col("source_type").alias("type"),
        F.col("source_id").alias("id"),
        "name",
        "edge_type",
        "depth",
        F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("reach"),
    )


def references(edges: DataFrame, node_type: str, node_id: int) -> DataFrame:
    """Edges that refer to the node."""
    return of_kinds(edges, "edge_type", REFERENCE_EDGES).where((F.col("target_type") == node_type) & (F.col("target_id") == node_id))


def dependents(edges: DataFrame, node_type: str, node_id: int) -> DataFrame:
    """Edges of any type that leave the node."""
    return edges.where((F.col("source_type") == node_type) & (F.col("source_id") == node_id))


def orphans(edges: DataFrame, node_type: str, node_id: int) -> DataFrame:
    """References whose source is not a target of the node's own edges."""
    own = dependents(edges, node_type, node_id).select(F.col("target_type").alias("source_type"), F.col("target_id").alias("source_id")).distinct()
    return references(edges, node_type, node_id).join(own, ["source_type", "source_id"], "left_anti")


def delete_safety(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (node_type, node_id): reference_count, dependent_count, can_delete, risk_level, requires_confirmation."""
    refs = of_kinds(edges, "edge_type", REFERENCE_EDGES).groupBy(F.col("target_type").alias("node_type"), F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("reference_count"))
    deps = edges.groupBy(F.col("source_type").alias("node_type"), F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("dependent_count"))
    both = targets.join(refs, ["node_type", "node_id"], "left").join(deps, ["node_type", "node_id"], "left").fillna(0, ["reference_count", "dependent_count"])
    free = (F.col("reference_count") == 0) & (F.col("dependent_count") == 0)
    return both.withColumns({"can_delete": free, "risk_level": F.when(free, "low").otherwise("high"), "requires_confirmation": ~free})


def related_tests(affected: DataFrame, edges: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Paths of test files (paths that start with "test") that import affected files, or whose symbols call affected
    symbols. affected: type, id."""
    importing = edges.where("source_type = 'file' and edge_type = 'IMPORTS' and target_type = 'file'").join(
        affected.where("type = 'file'").select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi"
    ).select(F.col("source_id").alias("file_id"))
    calling = edges.where("source_type = 'symbol' and edge_type = 'CALLS' and target_type = 'symbol'").join(
        affected.where("type = 'symbol'").select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi"
    ).join(symbols.select(F.col("id").alias("source_id"), "file_id"), "source_id").select("file_id")
    hits = importing.unionByName(calling).distinct()
    return files.where(F.col("path").startswith("test")).join(hits, files["id"] == hits["file_id"], "left_semi").select("path").distinct()


def symbol_neighbourhood(edges: DataFrame, symbols: DataFrame, equations: DataFrame) -> DataFrame:
    """symbol_id, part, id, name, detail: callers and callees (detail: qualified name) and used equations (detail: kind)
    of each symbol. Edges whose other end is unknown give nothing."""
    calls = edges.where("source_type = 'symbol' and target_type = 'symbol' and edge_type = 'CALLS'").select("source_id", "target_id")
    known = symbols.select("id", "name", F.col("qualified_name").alias("detail"))
    side = lambda own, other, part: calls.select(F.col(own).alias("symbol_id"), F.col(other).alias("id")).join(known, "id").select("symbol_id", F.lit(part).alias("part"), "id", "name", "detail")
    uses = edges.where("source_type = 'symbol' and target_type = 'equation' and edge_type = 'USES_EQUATION'").select(F.col("source_id").alias("symbol_id"), F.col("target_id").alias("id"))
    uses = uses.join(equations.select("id", "name", F.col("equation_type").alias("detail")), "id").select("symbol_id", F.lit("equation").alias("part"), "id", "name", "detail")
    every = side("target_id", "source_id", "caller").unionByName(side("source_id", "target_id", "callee")).unionByName(uses)
    return every.join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")


def file_neighbourhood(files: DataFrame, symbols: DataFrame, equations: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, part, id, name, detail: each file's symbols (detail: kind), equations (detail: kind) and imported files
    (name: path)."""
    imports = edges.where("source_type = 'file' and target_type = 'file' and edge_type = 'IMPORTS'").select(F.col("source_id").alias("file_id"), F.col("target_id").alias("id"))
    imports = imports.join(files.select("id", F.col("path").alias("name")), "id").select("file_id", F.lit("dependency").alias("part"), "id", "name", F.lit("import").alias("detail"))
    of = lambda df, part, kind: df.select("file_id", F.lit(part).alias("part"), "id", "name", F.col(kind).alias("detail"))
    every = of(symbols, "symbol", "symbol_type").unionByName(of(equations, "equation", "equation_type")).unionByName(imports)
    return every.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def file_dependencies(files: DataFrame, imports: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """source, target, kind, confidence: which file needs which, by imports (0.9) and by calls (0.7).

    files: id, path, is_source; imports: file_id, name; calls: file_id, name; symbols: file_id, name (qualified). An
    import is that of the first Python file (by id) whose module is its name or ends with it, a call that of the first
    file with a symbol of its name. Each import and call counts, files do not depend on themselves, and files that are
    no source depend on nothing."""
    own = files.where("is_source").select(F.col("id").alias("file_id"))
    sources = lambda df: df.select("file_id", "name").join(own, "file_id", "left_semi")
    modules = files.where(fn.language(F.col("path")) == "python")
    imported = sources(imports).join(imports_by_suffix(imports, modules).withColumnRenamed("file_id", "target"), "name")
    called = sources(calls).join(defining_files(calls, symbols).withColumnRenamed("file_id", "target"), "name")
    as_edges = lambda df, kind, confidence: df.select(F.col("file_id").alias("source"), "target", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    return as_edges(imported, "import", 0.9).unionByName(as_edges(called, "call", 0.7)).where("source <> target")


def levels(deps: DataFrame) -> DataFrame:
    """node, level: 0 without dependencies, else one more than the highest level it depends on; nodes on or behind a
    cycle are left out. deps: source depends on target; self-dependencies are dropped.

    Each round places the nodes without open dependencies and takes those on them off the others' counts: one join of
    the dependencies with the round's nodes, one of the open nodes with what they lose, and one written table, split
    into placed and open nodes. It ends with the first round that places none, however deep the levels are.
    """
    deps = written(deps.where("source <> target").select("source", "target").distinct(), "deps")
    nodes = deps.select(F.col("source").alias("node")).unionByName(deps.select(F.col("target").alias("node"))).distinct()
    counts = deps.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    split = lambda df: written(df.withColumn("ready", F.col("open") == 0), "level", "ready")
    state = split(nodes.join(counts, "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open")))
    placed, tables = [], []
    for level in itertools.count():
        ready = state.where("ready").select("node", F.lit(level).alias("level"))
        tables.append(state)
        if ready.isEmpty():
            break
        placed.append(ready)
        lost = deps.join(ready.select(F.col("node").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("lost"))
        state = split(state.where("not ready").join(lost, "node", "left").select("node", (F.col("open") - F.coalesce("lost", F.lit(0))).alias("open")))
        if len(placed) == MERGED:
            merged = written(reduce(DataFrame.unionByName, placed), "levels")
            for table in tables:
                release(table)
            placed, tables = [merged], [merged]
    release(deps)
    return reduce(DataFrame.unionByName, placed) if placed else state.where("ready").select("node", F.lit(0).alias("level"))


def level_dependencies(levelled: DataFrame, deps: DataFrame) -> DataFrame:
    """level, dependencies: how many different nodes the level's nodes depend on."""
    return levelled.join(deps.where("source <> target"), levelled["node"] == deps["source"]).groupBy("level").agg(F.count_distinct("target").alias("dependencies"))


def reach_with_paths(edges: DataFrame, node_type: str, node_id: int, max_depth: int = 3, backward: bool = False) -> DataFrame:
    """Along out-edges (backward: in-edges): type, id, depth, path (a string of node keys) of each simple path of at most
    max_depth edges.

    One row for each path, so their number grows with the branching to the power of max_depth: bound it. A round whose
    paths end in at most NEAR nodes reads the edges of these alone, by a filter that reaches what edges is made of; the
    first other one writes all edges, which later ones read."""
    spark = edges.sparkSession
    near, far = ("target", "source") if backward else ("source", "target")
    steps_of = lambda some: some.select(F.col(f"{near}_type").alias("from_type"), F.col(f"{near}_id").alias("from_id"), F.col(f"{far}_type").alias("type"), F.col(f"{far}_id").alias("id"))
    frontier = spark.createDataFrame([(node_type, node_id, [f"{node_type}:{node_id}"])], "from_type string, from_id long, seen array<string>")
    found, ends, size, known = [], [(node_type, node_id)], 1, None
    for depth in range(1, max_depth + 1):
        if len(ends) <= NEAR:
            ids = {kind: [i for k, i in ends if k == kind] for kind, _ in ends}
            some = (edges if known is None else known).where(reduce(lambda a, b: a | b, [(F.col(f"{near}_type") == k) & F.col(f"{near}_id").isin(v) for k, v in ids.items()]))
        else:
            known = written(edges, "known") if known is None else known
            some = known
        step = steps_of(some).join(F.broadcast(frontier) if size <= FRONTIER else frontier, ["from_type", "from_id"])
        step = step.withColumn("_key", F.concat("type", F.lit(":"), F.col("id").cast("string")))
        level = written(step.where(~F.array_contains("seen", F.col("_key"))).select("type", "id", F.concat("seen", F.array("_key")).alias("seen")), "paths")
        found.append(level.select("type", "id", F.lit(depth).alias("depth"), F.array_join("seen", " > ").alias("path")))
        frontier, size = level.select(F.col("type").alias("from_type"), F.col("id").alias("from_id"), "seen"), level.count()
        if not size:
            break
        ends = [tuple(r) for r in level.select("type", "id").distinct().limit(NEAR + 1).collect()]
    if known is not None:
        release(known)
    return reduce(DataFrame.unionByName, found)
