"""Approximate nearest neighbours: a forest of random-projection trees, a shared priority queue, exact reranking.

Trees are fitted on a pseudo-random sample of at most SAMPLE vectors: each node splits its sample at the median of the
projection on the difference of two of its vectors. Depth follows the number of all vectors, so that a leaf holds
about LEAF of them, until the sample has too few vectors a leaf. Every vector is then put into its leaf of every tree.
A query walks all trees with one priority queue of branches, nearest boundary first, until the leaves it has popped
hold SEARCH vectors, or SHARE of the forest's entries where that is more: true neighbours lie in a share of the leaves,
not in a fixed number of rows, so a fixed number loses them as the table grows. Queries meet the vectors of their leaves in blocks (large leaves are cut into parts, so no task
holds one whole, and a vector goes there with its leaves, so each is shuffled once a tree); a block gives each query its 10 nearest there by exact Euclidean distance; the best of all blocks
are the result.

The forest that tasks get is bounded by the sample: TREES trees of at most SAMPLE / 16 leaves.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part, as
queries or as candidates; vectors meet only those of their length: the forest holds those of the most frequent length,
all others are searched exactly, in blocks; rows with one vec_id are one candidate (its nearest row), and one query
(the nearest of what its rows find); with fewer candidates than k all are returned; ties go to the smaller vec_id; an
empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import written
from weftline.llm.vectors import blocks, by_block, distances, matrix, usable

TREES, LEAF, SAMPLE, SEARCH, PART, SEED = 10, 64, 16384, 40000, 2048, 5
#: Rows that a task puts into leaves at once.
ROWS = 1024
#: Of the forest's entries (vectors times trees) a query's leaves hold at least this share.
SHARE = 0.08


class Forest:
    """Complete binary trees: node i of a tree has children 2i + 1 and 2i + 2; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int):
        self.depth = depth
        self.normals = np.zeros((trees, (1 << depth) - 1, sample.shape[1]))
        self.cuts = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            rng = np.random.Generator(np.random.PCG64([SEED, t]))
            members = [np.arange(len(sample))]
            for node in range((1 << depth) - 1):
                own = members[node]
                normal = np.zeros(sample.shape[1])
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    normal = sample[a] - sample[b]
                if not normal.any():
                    normal = rng.standard_normal(sample.shape[1])
                normal /= np.sqrt(normal @ normal)
                at = sample[own] @ normal
                cut = float(np.median(at)) if len(own) else 0.0
                self.normals[t, node], self.cuts[t, node] = normal, cut
                members += [own[at <= cut], own[at > cut]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees) leaf numbers."""
        out = np.zeros((len(x), len(self.normals)), np.int32)
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > cuts[node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def probes(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order the queue gives them, until their sizes add up to `enough`."""
        margins = np.einsum("tnd,d->tn", self.normals, q) - self.cuts
        first_leaf, found, total = (1 << self.depth) - 1, [], 0
        queue = [(-np.inf, t, 0) for t in range(len(self.normals))]
        while queue and total < enough:
            near, t, node = heapq.heappop(queue)
            if node >= first_leaf:
                found.append((t, node - first_leaf))
                total += int(sizes[t, node - first_leaf])
                continue
            m = float(margins[t, node])
            heapq.heappush(queue, (max(near, m), t, 2 * node + 1))
            heapq.heappush(queue, (max(near, -m), t, 2 * node + 2))
        return found


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in blocks(batches):
            ids, query, leaf = (table.column(c).to_numpy() for c in ("vec_id", "is_query", "leaf"))
            vectors = table.column("e").combine_chunks()
            out_q, out_id, out_score = [], [], []
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                at = np.arange(a, b)
                asked, there = at[query[a:b]], at[~query[a:b]]
                if not len(asked) or not len(there):
                    continue
                x, q = matrix(vectors.take(pa.array(there))), matrix(vectors.take(pa.array(asked)))
                several = len(np.unique(ids[there])) < len(there)
                for one, i in zip(q, asked, strict=True):
                    use = np.flatnonzero((ids[there] != ids[i]) & (leaf[there] == leaf[i]))
                    if not len(use):
                        continue
                    d, own = distances(x[use], one), ids[there][use]
                    if several:  # rows of one id are one candidate
                        own, of = np.unique(own, return_inverse=True)
                        least = np.full(len(own), np.inf)
                        np.minimum.at(least, of, d)
                        d = least
                    best = np.lexsort((own, d))[:k] if len(d) <= 4 * k else None
                    if best is None:
                        limit = np.partition(d, k - 1)[k - 1]
                        some = np.flatnonzero(d <= limit)
                        best = some[np.lexsort((own[some], d[some]))[:k]]
                    out_q.append(np.full(len(best), ids[i]))
                    out_id.append(own[best])
                    out_score.append(d[best])
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_id, out_score)], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = 10, search: int | None = None, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of rows (vec_id: long, embedding) where is_query holds, the k
    nearest other vectors found. search: how many vectors a query's leaves hold; by default SEARCH or the SHARE of the
    forest's entries, whichever is more. sample: how many vectors the trees are fitted on at most; it bounds their depth,
    so raise it with the table where leaves of n * 16 / sample vectors are too large."""
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score double"
    good = rows.withColumn("is_query", F.coalesce(is_query, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "is_query", F.col("embedding").cast("array<double>").alias("e"))
    good = written(good.where(usable(F.col("e")) & F.col("vec_id").isNotNull()), "vectors")
    dims = good.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = dims[0]["d"], dims[0]["count"]
    search = max(SEARCH, math.ceil(SHARE * trees * n)) if search is None else search
    every, good = good, good.where(F.size("e") == dim)
    drawn = good.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / n))).select("vec_id", "e").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    fitted = np.array([r["e"] for r in drawn.collect()], float).reshape(-1, dim)  # bounded by the sample
    depth = int(np.clip(np.log2(max(min(n / leaf, len(fitted) / 16), 1)), 0, 16))
    forest = spark.sparkContext.broadcast(Forest(fitted, depth, trees))

    tree = np.arange(trees, dtype=np.int64) << 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, n = np.unique(forest.value.leaves(matrix(batch.column(0))) + tree, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(n)], ["leaf", "n"])

    counts = good.select("e").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()  # bounded by trees and leaves
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in counts:
        sizes[r["leaf"] >> 32, r["leaf"] & 0xFFFFFFFF] = r["n"]
    shared = spark.sparkContext.broadcast(sizes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                leaves = (forest.value.leaves(matrix(some.column(1))) + tree).ravel()
                at = pa.array(np.repeat(np.arange(some.num_rows), trees))
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), pa.array(leaves), some.column(1).take(at)], ["vec_id", "leaf", "e"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "leaf", "parts", "e"]
        for batch in batches:
            for row, q in enumerate(matrix(batch.column(1))):
                found = [(t, at) for t, at in forest.value.probes(q, shared.value, search) if shared.value[t, at]]
                leaves = np.array([(t << 32) + at for t, at in found], np.int64)
                parts = np.array([-(-int(shared.value[t, at]) // PART) for t, at in found], np.int32)
                for a in range(0, len(found), ROWS):
                    at = pa.array(np.full(len(leaves[a : a + ROWS]), row))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(leaves[a : a + ROWS]), pa.array(parts[a : a + ROWS]), batch.column(1).take(at)], names)

    kinds = ("vec_id long, leaf long, ", "e array<double>")
    asked = good.where("is_query").select("vec_id", "e").mapInArrow(ask, "parts int, ".join(kinds))
    asked = asked.select("vec_id", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_query"), "e")
    large = spark.createDataFrame([(r["leaf"], -(-r["n"] // PART)) for r in counts if r["n"] > PART] or [(-1, 1)], "leaf long, parts int")
    there = good.select("vec_id", "e").mapInArrow(place, "".join(kinds)).join(F.broadcast(large), "leaf", "left").select(
        "vec_id", "leaf", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(False).alias("is_query"), "e"
    )
    # other lengths: each row in one part of its length, each query in all of them
    rare = every.where(F.size("e") != dim).withColumn("leaf", -F.size("e").cast("long"))
    lengths = rare.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    rare = rare.join(lengths, "leaf")
    rare_there = rare.select("vec_id", "leaf", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.lit(False).alias("is_query"), "e")
    rare_asked = rare.where("is_query").select("vec_id", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_query"), "e")
    both = asked.unionByName(there).unionByName(rare_there).unionByName(rare_asked)
    near = by_block(both.withColumn("block", F.xxhash64("leaf", "part"))).mapInArrow(_nearest(k), schema)
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
