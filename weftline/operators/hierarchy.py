"""Ancestors and qualified names in tables of parents: leaves are laid aside, the rest goes by pointer doubling.

While about a quarter or more of the nodes left are no parent of any other, these are laid aside as a layer; each layer
then takes its names from what lies above it by one join, so that the layers together cost a few joins of the whole
table, and the many nodes of low layers never share few keys. In what is left, after k rounds every node knows its
ancestor 2**k steps up and the names between them; a round is one join of the table with itself, so a chain of n nodes
takes about log2(n) rounds, not n. Nodes on or below a cycle of parents never end: after as many rounds as all nodes in
one chain would take they are left with no root.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.shared import release, written


#: Share of nodes that must be leaves for these to be laid aside.
LEAVES = 0.25


def _dotted(above: str, name: str) -> Column:
    return F.coalesce(F.concat(above, F.lit("."), name), above, name)


def ancestry(nodes: DataFrame) -> DataFrame:
    """node, root, depth, qualified_name of nodes (node, parent, name), node unique: the root above (itself without
    parent), the steps to it, and the names from it down that are not null, joined by dots. A parent that is no node is none. Null root,
    depth and name on and below cycles."""
    left, layers = written(nodes.select("node", "parent", "name"), "up"), []
    while True:
        count, parents = left.agg(F.count(F.lit(1)), F.approx_count_distinct("parent")).first()
        if parents > count * (1 - LEAVES):
            found = _doubled(left, count)
            break
        above = left.where("parent is not null").select(F.col("parent").alias("node"), F.lit(True).alias("_inner")).distinct()
        split = written(left.join(above, "node", "left").withColumn("_inner", F.col("_inner").isNotNull()), "left", "_inner")
        release(left)
        inner, leaves = (split.where(F.col("_inner") == x).drop("_inner") for x in (True, False))
        layers.append(leaves)
        left = inner
        left._weftline_path = f"{split._weftline_path}/_inner=true"  # the leaves stay
        if inner.isEmpty():
            found = _doubled(left, 0)
            break
    for layer in reversed(layers):
        above = found.select(F.col("node").alias("parent"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("qualified_name").alias("_name"), F.lit(True).alias("_there"))
        there = F.col("_there").isNotNull()
        named = layer.join(above, "parent", "left").select(
            "node", F.when(there, F.col("_root")).otherwise(F.col("node")).alias("root"), F.when(there, F.col("_depth") + 1).otherwise(0).alias("depth"),
            F.when(~there | F.col("_root").isNotNull(), _dotted("_name", "name")).alias("qualified_name"),
        )
        found = found.unionByName(named if layer is layers[0] else written(named, "layer"))
    return found


def _doubled(nodes: DataFrame, count: int) -> DataFrame:
    """ancestry() by pointer doubling alone."""
    now = nodes.select("node", F.col("parent").alias("up"), F.col("name").alias("names"), F.col("node").alias("last"), F.lit(0).alias("depth"))
    now._weftline_path = nodes._weftline_path
    rounds = math.ceil(math.log2(max(count, 2))) + 1
    for _ in range(rounds):
        open_, done = now.where("up is not null"), now.where("up is null")
        if open_.isEmpty():
            break
        above = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("names").alias("_names"), F.col("depth").alias("_depth"), F.col("last").alias("_last"))
        joined = open_.join(above, "up", "left").select(
            # no _last: the parent is no node
            "node", F.col("_up").alias("up"), _dotted("_names", "names").alias("names"),
            F.coalesce("_last", "last").alias("last"), (F.col("depth") + F.coalesce(F.col("_depth") + 1, F.lit(0))).alias("depth"),
        )
        next_ = written(joined.unionByName(done), "up")
        release(now)
        now = next_
    settled = F.col("up").isNull()
    return now.select("node", F.when(settled, F.col("last")).alias("root"), F.when(settled, F.col("depth")).alias("depth"), F.when(settled, F.col("names")).alias("qualified_name"))
