"""Merkle manifest of a dataset by checkpoint and recompute. Only DataFrame functions.

Every row is a leaf; the leaves of one source, by doc_id, form a tree whose nodes have up to ARITY children, and the
sources' roots form one more tree above them. Only every EVERY-th level is written. A subtree between two written
levels is aligned, has at most ARITY ** EVERY stored nodes and is the unit of all work: one row of an aggregation. Going
up, a subtree gives one node of the next written level. Going down, proofs pass from a written level to the one below:
each subtree recomputes the levels that are missing from its stored nodes, takes from them the siblings of each node,
and drops them again. So a proof's upper part is joined once for a subtree, not for a leaf, and only the last step has
a leaf's whole path in hand, in one row that is folded at once.

Places come from a range partitioning by (source, doc_id, leaf) with prefix sums over parts, so no source, however
large, meets in one task; what comes to the driver is one number, the largest source's rows.

Defined cases: null columns are hashed as `-`; a null source is a source, the first; null doc_ids come first in their
source and are never tampered with; rows of one source and doc_id go by their leaf, and equal rows each get a place of
their own; a lone leaf is its source's root, a lone source's root the dataset's; an empty table gives an empty table;
texts of any length are hashed whole; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import written

#: Children of a node at most; levels from one written level to the next.
ARITY, EVERY = 16, 2
#: What a leaf holds, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "struct<left: string, right: string>"


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of values, each as its length in UTF-8 bytes, a colon and itself, or - if null."""
    texts = [v.cast("string") for v in values]
    return _hash(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


@dataclass
class Tree:
    """Trees of one kind: the written levels (tree, place, n: nodes of the tree at this level, node, item) from the
    bottom, and tops (tree, top)."""

    levels: list[DataFrame]
    tops: DataFrame
    arity: int
    every: int

    @property
    def width(self) -> int:
        return self.arity**self.every


def ordered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (tree, ...) with place, 0, 1, 2, ... in each tree by `by`, and n, the tree's rows; written."""
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows need not fall into one part
    dealt = dealt.repartitionByRange("tree", *by, "_tie").sortWithinPartitions("tree", *by, "_tie").drop("_tie")
    numbered = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    parts = numbered.groupBy("tree", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_n").over(tree).alias("n"))
    placed = numbered.withColumn("_part", part).join(starts, ["tree", "_part"])
    return written(placed.withColumn("place", F.col("_at") + F.col("_start")).drop("_at", "_part", "_start"), "placed")


def _subtrees(level: DataFrame, width: int) -> DataFrame:
    """A row for each aligned subtree: tree, n, block, nodes (place, node, item) by place."""
    block = F.floor(F.col("place") / width).alias("block")
    return level.groupBy("tree", "n", block).agg(F.sort_array(F.collect_list(F.struct("place", "node", "item"))).alias("nodes"))


def _interior(subtrees: DataFrame, arity: int, every: int) -> DataFrame:
    """Adds the subtree's levels l0, l1, ..., recomputed from its stored nodes."""

    def parents(below: str) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(below) / arity).cast("int") - 1)
        return F.transform(runs, lambda r: _hash(F.array_join(F.slice(below, r * arity + 1, F.lit(arity)), "")))

    out = subtrees.withColumn("l0", F.transform("nodes", lambda x: x["node"]))
    for j in range(every):
        out = out.withColumn(f"l{j + 1}", parents(f"l{j}"))
    return out


def grown(base: DataFrame, arity: int = ARITY, every: int = EVERY) -> Tree:
    """The trees over base (tree, place, n, node, item), a written table."""
    width, levels, tops = arity**every, [base], []
    left = base.agg(F.max("n")).first()[0] or 0
    while True:
        made = _interior(_subtrees(levels[-1], width), arity, every)
        # the first level of the subtree that has one node for the whole tree
        top = F.coalesce(*(F.when(F.col("n") <= arity**j, F.element_at(f"l{j}", 1)) for j in range(every + 1)))
        tops.append(made.where(F.col("n") <= width).select("tree", top.alias("top")))
        if left <= width:
            break
        rest = made.where(F.col("n") > width)
        levels.append(written(rest.select("tree", F.ceil(F.col("n") / width).alias("n"), F.col("block").alias("place"), F.element_at(f"l{every}", 1).alias("node"), F.lit(None).cast("int").alias("item")), "level"))
        left = -(-left // width)
    return Tree(levels, written(reduce(DataFrame.unionByName, tops), "tops"), arity, every)


def paths(trees: Tree, above: DataFrame) -> DataFrame:
    """node, item, path and above's other columns for every bottom node: path holds the siblings to the left and to the
    right of each level's node, from the bottom up, then what above (tree, path, ...) has for the tree."""
    arity, every, width = trees.arity, trees.every, trees.width
    others = [c for c in above.columns if c not in ("tree", "path")]
    down = None
    for level in reversed(trees.levels):
        small = level.where((F.col("place") == 0) & (F.col("n") <= width)).select("tree")
        start = small.join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), "path", *others)
        upper = start if down is None else start.unionByName(down.select("tree", F.col("place").alias("block"), "path", *others))
        made = _interior(_subtrees(level, width), arity, every).join(upper.withColumnRenamed("path", "upper"), ["tree", "block"])

        def siblings(i: Column) -> Column:
            found = []
            for j in range(every):
                at = F.floor(i / arity**j).cast("int")
                first = F.floor(at / arity).cast("int") * arity
                left = F.array_join(F.slice(f"l{j}", first + 1, at - first), "")
                right = F.array_join(F.slice(f"l{j}", at + 2, first + arity - 1 - at), "")
                found.append(F.when(F.col("n") > arity**j, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(f"array<{STEP}>")))
            return F.concat(*found)

        nodes = F.transform("nodes", lambda x, i: F.struct(x["place"].alias("place"), x["node"].alias("node"), x["item"].alias("item"), siblings(i).alias("own")))
        each = made.select("tree", "upper", *others, F.inline(nodes))
        down = each.select("tree", "place", "node", "item", F.concat("own", "upper").alias("path"), *others)
    return down


def proof(path: Column) -> Column:
    """Digest of a path's siblings, level by level, left to right."""
    return _hash(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda below, s: _hash(s["left"], below, s["right"]))


@dataclass
class Manifest:
    """Trees of leaves (a tree a source: its name after an s, or - for null), the tree of sources above them (item: the
    source's tree), and the root's table (tree, top)."""

    leaves: Tree
    sources: Tree


def manifest(leaves: DataFrame, by: list[str], arity: int = ARITY, every: int = EVERY) -> Manifest:
    """leaves: source, node, item and the columns `by` that order a source's leaves."""
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))  # sorts as sources do, null first
    placed = ordered(leaves.withColumn("tree", tree), by).select("tree", "place", "n", "node", "item")
    low = grown(placed, arity, every)
    tops = ordered(low.tops.select(F.lit("").alias("tree"), F.col("tree").alias("item"), F.col("top").alias("node")), ["item"])
    return Manifest(low, grown(tops, arity, every))


def proofs(m: Manifest) -> DataFrame:
    """node, item, path, subroot, root of every leaf."""
    root = m.sources.tops.select("tree", F.array().cast(f"array<{STEP}>").alias("path"), F.col("top").alias("root"))
    of_source = paths(m.sources, root).select(F.col("item").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    return paths(m.leaves, written(of_source, "sources")).select("node", "item", "path", "subroot", "root")


def verified(docs: DataFrame, tampered: Column, text: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs (FIELDS): the manifest's, and
    the root that its proof gives for the leaf as it is now, with `text` in place of the text where `tampered`."""
    fields = [F.col(c) for c in FIELDS]
    now = F.when(tampered, leaf(*fields[:-1], text))  # null: as it was
    rows = docs.select("source", "doc_id", leaf(*fields).alias("node"), F.struct("doc_id", now.alias("now")).alias("item"))
    found = proofs(manifest(rows, ["doc_id", "node"]))
    again = folded(F.coalesce("item.now", "node"), F.col("path"))
    out = found.select("item.doc_id", F.col("node").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame) -> DataFrame:
    """verified() where the text of every row whose doc_id's checksum 5 divides is lower-cased (A-Z only)."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return verified(docs, tampered, lowered(F.col("text")))
