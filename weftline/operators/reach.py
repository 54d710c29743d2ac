"""Reachability without a row for every path, and cycles.

Both work on sets: a round joins a frontier with the edges and keeps what no round before it reached, so rows are
bounded by nodes and edges, whatever the number of paths. What a round gives is written; only counts come to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import FRONTIER, levels
from weftline.sources.shared import release, written

NODE = ["type", "id"]


def steps(edges: DataFrame, backward: bool = False) -> DataFrame:
    """from_type, from_id, type, id: different steps along the edges."""
    near, far = ("target", "source") if backward else ("source", "target")
    return edges.select(F.col(f"{near}_type").alias("from_type"), F.col(f"{near}_id").alias("from_id"), F.col(f"{far}_type").alias("type"), F.col(f"{far}_id").alias("id")).distinct()


def reach_tree(edges: DataFrame, starts: DataFrame, max_depth: int, backward: bool = False, enough: int | None = None) -> DataFrame:
    """type, id, depth, from_type, from_id: every node that is reached from a start (type, id) along at most max_depth
    edges, once, with its least depth and the least of the nodes of one depth less that lead to it (null for starts).

    enough: no round follows one after which so many nodes are known."""
    step = written(steps(edges, backward), "steps")
    seen = written(starts.select(*NODE).distinct().withColumns({"depth": F.lit(0), "from_type": F.lit(None).cast(edges.schema["source_type"].dataType), "from_id": F.lit(None).cast(edges.schema["source_id"].dataType)}), "reached")
    rounds, frontier, total = [seen], seen, seen.count()
    size = total
    for depth in range(1, max_depth + 1):
        if not size or (enough is not None and total >= enough):
            break
        near = frontier.select(F.col("type").alias("from_type"), F.col("id").alias("from_id"))
        found = step.join(F.broadcast(near) if size <= FRONTIER else near, ["from_type", "from_id"])
        first = found.groupBy(*NODE).agg(F.min(F.struct("from_type", "from_id")).alias("by")).select(*NODE, F.lit(depth).alias("depth"), "by.from_type", "by.from_id")
        known = reduce(DataFrame.unionByName, [r.select(*NODE) for r in rounds])
        frontier = written(first.join(known, NODE, "left_anti"), "reached")
        size = frontier.count()
        total += size
        rounds.append(frontier)
    out = written(reduce(DataFrame.unionByName, rounds), "tree")
    for table in (step, *rounds):
        release(table)
    return out


def paths_in(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """type, id, depth, path of the wanted nodes (type, id) that a tree holds: one path each, from its start, as keys.
    One join for each depth there is, of as many rows as are wanted."""
    key = F.concat_ws(":", F.col("type"), F.col("id").cast("string"))
    now = written(tree.join(wanted.select(*NODE).distinct(), NODE, "left_semi").withColumn("path", F.array(key)), "paths")
    depth = now.agg(F.max("depth")).first()[0] or 0
    up = tree.select(F.col("type").alias("from_type"), F.col("id").alias("from_id"), F.col("from_type").alias("next_type"), F.col("from_id").alias("next_id"), key.alias("key"))
    out = now
    for _ in range(depth):
        joined = out.join(up, ["from_type", "from_id"], "left")
        out = joined.select(*NODE, "depth", F.col("next_type").alias("from_type"), F.col("next_id").alias("from_id"), F.when(F.col("key").isNull(), F.col("path")).otherwise(F.concat(F.array("key"), "path")).alias("path"))
    return out.select(*NODE, "depth", F.array_join("path", " > ").alias("path"))


def _core(edges: DataFrame) -> DataFrame:
    """Edges that lie between nodes which both have an edge in and an edge out: again and again, until none goes."""
    edges = written(edges, "core")
    size = edges.count()
    while size:
        sources, targets = edges.select("source").distinct(), edges.select("target").distinct()
        kept = edges.join(targets.withColumnRenamed("target", "source"), "source", "left_semi").join(sources.withColumnRenamed("source", "target"), "target", "left_semi")
        less = written(kept.select("source", "target"), "core")
        release(edges)
        before, edges, size = size, less, less.count()
        if size == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the largest node from which each node can be reached, itself included."""
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    now = written(nodes.withColumn("colour", F.col("node")), "colours")
    while True:
        given = edges.join(now.select(F.col("node").alias("source"), "colour"), "source").groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("given"))
        next_ = written(now.join(given, "node", "left").select("node", F.greatest("colour", "given").alias("colour"), (F.coalesce("given", "colour") > F.col("colour")).alias("moved")), "colours")
        release(now)
        now = next_
        if now.where("moved").isEmpty():
            return now


def cycles(deps: DataFrame) -> DataFrame:
    """node, cycle, size: the nodes that lie on cycles (of two nodes or more), with the least node and the number of
    nodes of their strongly connected component. deps: source, target.

    Trim, then forward-backward colouring: colours run forward, a node that kept its own colour is the root of a
    component, and the nodes of its colour from which it can be reached are the component. These go, what is left is
    trimmed and coloured again."""
    edges, found = _core(deps.where("source <> target").select("source", "target").distinct()), []
    while not edges.isEmpty():
        colours = _coloured(edges)
        of = colours.select("node", "colour")
        same = edges.join(of.select(F.col("node").alias("source"), "colour"), "source").join(of.select(F.col("node").alias("target"), F.col("colour").alias("other")), "target").where("colour = other")
        same = written(same.select("source", "target", "colour"), "same")
        members = frontier = written(of.where("node = colour"), "members")
        rounds = [members]
        while True:
            near = same.join(frontier.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node"), "colour").distinct()
            frontier = written(near.join(members.select("node"), "node", "left_anti"), "members")
            if frontier.isEmpty():
                break
            rounds.append(frontier)
            members = reduce(DataFrame.unionByName, rounds)
        sizes = members.groupBy("colour").agg(F.min("node").alias("cycle"), F.count(F.lit(1)).alias("size")).where("size > 1")
        found.append(written(members.join(sizes, "colour").select("node", "cycle", "size"), "cycles"))
        gone = members.select("node")
        rest = edges.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        left = _core(rest.select("source", "target"))
        for table in (edges, colours, same, *rounds, frontier):
            release(table)
        edges = left
    none = deps.select(F.col("source").alias("node"), F.col("source").alias("cycle"), F.lit(0).cast("long").alias("size")).limit(0)
    return reduce(DataFrame.unionByName, found) if found else none


def levels_with_cycles(deps: DataFrame) -> DataFrame:
    """node, level, cycle, size: levels of all nodes, where the nodes of a cycle share the level of the cycle taken as
    one: 0 without dependencies outside it, else one more than the highest level it depends on. cycle and size are null
    for nodes on no cycle."""
    deps = written(deps.where("source <> target").select("source", "target").distinct(), "deps")
    on = written(cycles(deps), "cycles")
    name = lambda c: on.select(F.col("node").alias(c), F.col("cycle").alias(f"_{c}"))
    short = deps.join(name("source"), "source", "left").join(name("target"), "target", "left").select(F.coalesce("_source", "source").alias("source"), F.coalesce("_target", "target").alias("target"))
    placed = levels(short)
    nodes = deps.select(F.col("source").alias("node")).unionByName(deps.select(F.col("target").alias("node"))).distinct().join(on, "node", "left")
    # a cycle that nothing else touches has no dependency left, and is at the bottom
    known = nodes.withColumn("_key", F.coalesce("cycle", "node")).join(placed.select(F.col("node").alias("_key"), "level"), "_key", "left")
    return known.select("node", F.coalesce("level", F.lit(0)).alias("level"), "cycle", "size")
