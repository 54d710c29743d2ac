"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine verification, connected components.

Each of TABLES tables hashes a vector to the signs of BITS random hyperplanes. Vectors of one label and length that
share a table's code are compared by exact cosine in double precision. A pair is counted in the first table that finds
it. Equal vectors are one class with a weight. A bucket of more than BLOCK classes is cut into blocks, each pair of
blocks a group of its own, so that no task holds a large bucket, and what a group gives is one row for each member:
how many vectors it found linked, and a root that stands for the group's local component. Pairs are never written.

With the defaults a pair at cosine 0.98 shares no code with probability 5e-5; nearer pairs are missed more rarely.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing; a vec_id counts once however often its row is repeated; of different
vectors of one vec_id (or one vector under several labels) that with the least hash counts, its other rows link with
nothing; a null vec_id has a null component and is kept; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bytes_np import U64, mix
from weftline.llm.common import connected_components, written
from weftline.llm.vectors import blocks, by_block, matrix, scaled, spread_blocks, usable

TABLES, BITS, BLOCK, SEED = 32, 20, 512, 7


@lru_cache(maxsize=8)
def planes(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, TABLES * BITS))


def codes(vectors: np.ndarray) -> np.ndarray:
    """(vectors, tables) sign codes."""
    signs = (vectors @ planes(vectors.shape[1]) > 0).reshape(len(vectors), TABLES, BITS)
    return (signs * (1 << np.arange(BITS, dtype=np.int64))).sum(axis=2)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, group, e) -> (cid, key, tab): a row for each table; group: a hash of label and length."""
    for batch in batches:
        lengths = batch.column(2).value_lengths().to_numpy()
        for dim in np.unique(lengths):
            part = batch.filter(pa.array(lengths == dim))
            found = codes(scaled(matrix(part.column(2)))).astype(U64)
            group = part.column(1).to_numpy().view(U64)
            keys = mix(mix(found * U64(64) + np.arange(TABLES, dtype=U64)) ^ group[:, None], 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column(0).to_numpy(), TABLES)), pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), part.num_rows))],
                ["cid", "key", "tab"],
            )


def _compared(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in blocks(batches):
            cid, weight = table.column("cid").to_numpy(), table.column("weight").to_numpy()
            side, tab = table.column("side").to_numpy(), table.column("tab").to_numpy()
            key, found_cid, found_n, found_root = table.column("key").to_numpy(), [], [], []
            vectors = table.column("e").combine_chunks()
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                for k in np.unique(key[a:b]):  # one, but for a clash of block hashes
                    at = a + np.flatnonzero(key[a:b] == k)
                    x = scaled(matrix(vectors.take(pa.array(at))))
                    norms, own = np.sqrt((x * x).sum(axis=1)), codes(x)
                    left, right = np.flatnonzero(side[at] <= 0), np.flatnonzero(side[at] >= 0)
                    cosine = (x[left] @ x[right].T) / norms[left][:, None] / norms[right][None, :]
                    p, q = np.nonzero(cosine >= threshold)
                    p, q = left[p], right[q]
                    once = (p < q) if not (side[at] != 0).any() else np.ones(len(p), bool)
                    p, q = p[once], q[once]
                    t = tab[at[0]]
                    first = ~(own[p, :t] == own[q, :t]).any(axis=1)
                    p, q = p[first], q[first]
                    if not len(p):
                        continue
                    n, w = np.zeros(len(at), np.int64), weight[at]
                    np.add.at(n, p, w[q])
                    np.add.at(n, q, w[p])
                    root, ids = cid[at].copy(), cid[at]
                    while True:
                        least = np.minimum(root[p], root[q])
                        if (root[p] == least).all() and (root[q] == least).all():
                            break
                        np.minimum.at(root, p, least)
                        np.minimum.at(root, q, least)
                    some = np.flatnonzero(n)
                    found_cid.append(ids[some])
                    found_n.append(n[some])
                    found_root.append(root[some])
            if found_cid:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found_cid, found_n, found_root)], ["cid", "n", "root"])

    return run


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each row of rows (vec_id: long, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("good", usable(F.col("e")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("hash", F.xxhash64("label", "e"))
    several = rows.where("good").groupBy("vec_id").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least <> most")
    several = written(several.select("vec_id", "least"), "several")
    rows = rows.join(several, "vec_id", "left").withColumn("good", F.col("good") & (F.col("least").isNull() | (F.col("hash") == F.col("least")))).drop("hash", "least")
    good = rows.where("good")
    classes = written(
        good.groupBy("label", "e").agg(F.min("vec_id").alias("cid"), F.count_distinct("vec_id").alias("weight")).withColumn("group", F.xxhash64("label", F.size("e"))),
        "classes",
    )
    keys = classes.select("cid", "group", "e").mapInArrow(_coded, "cid long, key long, tab int")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = written(keys.join(sizes, "key"), "members").withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int"))
    spread = spread_blocks(members, ["tab", "cid"]).join(classes.select("cid", "weight", "e"), "cid")
    found = written(by_block(spread).mapInArrow(_compared(threshold), "cid long, n long, root long"), "found")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = classes.join(counts, "cid", "left").join(parts.withColumnRenamed("id", "cid"), "cid", "left")
    linked = linked.select("label", "e", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "cid").alias("component"))
    joined = rows.join(linked, (rows["good"]) & (rows["label"] == linked["label"]) & (rows["e"] == linked["e"]), "left")
    component = F.coalesce(linked["component"], rows["vec_id"])
    return joined.select(
        rows["vec_id"],
        F.coalesce(linked["n"], F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(rows["vec_id"] == component, F.lit(True)).alias("kept"),
    )
