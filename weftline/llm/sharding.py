"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Documents with equal texts form a group, a vector of bytes, tokens and rows in shares of the total. Groups go, largest
first, each to the shard where the dot product of its vector with the shard's residual capacities is highest.

Groups larger than 1 / PER_SHARD of a shard are placed on the driver; there are at most shards * PER_SHARD of them.
All other groups fall into tiers by size, each a TIER-th of the one above, and within a tier into cells by hash,
about CELL groups each; a task places the groups of its cell, each by the same rule, against the cell's share of the
capacity that the large groups have left. So every group is placed by itself, and nothing that grows with the corpus
meets in one task. As sizes in a cell differ by a factor of TIER at most, none is more than a small part of a
shard's share of a full cell, however many cells there are; a tier that fills no cell is one cell. Ties go to another
shard first in each cell, so that what cells have too much does not add up. A group larger than a whole shard is split
into parts of equal size first, as nothing could balance it; all others stay whole.

Tokens are counted as the splits of a byte-level vocabulary's pre-tokenizer: runs of letters, single digits, runs of
other marks (tokens of word_bpe_49k.json are 1.95 times that on the documents of sf0.01, 1.64 to 2.33 times in nine of
ten of them; correlation 0.991). Only shares of the total count, so the factor does not matter.

The law that holds is `bytes`: the shards' sizes are near equal.

Defined cases: a null text has no bytes and no tokens, and all null texts are one group; rows with one doc_id are
placed each by itself (in their text's group); ties in size go by the group's hash; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import gapless_rank, release, written

#: Shards, large groups a shard at most, groups that a task places, largest by smallest size of a tier.
SHARDS, PER_SHARD, CELL, TIER = 16, 256, 50_000, 16


def place(vectors: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Shard of each item (rows: shares of bytes, tokens, rows, largest bytes first), by the highest dot product with the residual
    capacities `left` (shards, 3), which are lowered; a shard whose bytes would overflow is chosen only if all would,
    then that with most room. Ties go to the lower shard."""
    out = np.zeros(len(vectors), np.int32)
    for i, v in enumerate(vectors):
        score = left @ v
        score[left[:, 0] < v[0]] = -np.inf
        at = int(score.argmax())
        if score[at] == -np.inf:
            at = int(left[:, 0].argmax())
        out[i] = at
        left[at] -= v
    return out


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]+"))


def tier(size: Column, largest: float) -> Column:
    """0 for sizes above a TIER-th of `largest`, 1 for those above a TIER-th of that, and so on."""
    return F.greatest(F.lit(0), F.floor(F.log(F.lit(float(largest)) / size) / math.log(TIER))).cast("int")


def _in_cell(left: np.ndarray, total: np.ndarray, whole: np.ndarray):
    """Frames of one cell's groups (group, cell, b, t, r) -> (group, shard), by the cell's share of the capacities left."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["b", "group"], ascending=[False, True], kind="stable")
        vectors, turn = frame[["b", "t", "r"]].to_numpy(float), int(frame["cell"].iloc[0]) % len(left)
        placed = place(vectors / total, np.roll(left, -turn, axis=0) * (vectors.sum(axis=0) / whole))
        return pd.DataFrame({"group": frame["group"].to_numpy(), "shard": ((placed + turn) % len(left)).astype(np.int32)})

    return run


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            token_count(text).cast("long").alias("tokens"),
            F.xxhash64(text, F.col("text").isNull()).alias("group"),
        ),
        "rows",
    )
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    groups = written(rows.groupBy("group").agg(*sums), "groups")
    all_ = rows.agg(*sums, F.count(F.lit(1)).alias("n")).first()
    total = np.maximum(np.array([all_["b"] or 0, all_["t"] or 0, all_["r"]], float), 1)
    capacity = total[0] / shards
    large = groups.where(F.col("b") > capacity / PER_SHARD).orderBy(F.desc("b"), "group").collect()  # at most shards * PER_SHARD
    # a group above a shard becomes parts of nine tenths of a shard at most
    parts = [(r["group"], math.ceil(r["b"] / (0.9 * capacity)) if r["b"] > capacity else 1, r) for r in large]
    items = sorted(((g, k, r["b"] / n, r["t"] / n, r["r"] / n) for g, n, r in parts for k in range(n)), key=lambda x: (-x[2], x[0], x[1]))
    left = np.full((shards, 3), 1.0 / shards)
    placed = place(np.array([x[2:] for x in items], float).reshape(-1, 3) / total, left)
    count = {g: n for g, n, _ in parts}
    where = [(x[0], x[1], count[x[0]], int(s)) for x, s in zip(items, placed, strict=True)]
    table = spark.createDataFrame(where, "group long, part int, parts int, shard int")
    numbers = table.select("group", "parts").distinct()
    # all other groups, in cells of their tiers
    small = groups.where(F.col("b") <= capacity / PER_SHARD).withColumn("tier", tier(F.col("b"), capacity / PER_SHARD))
    cells = {r["tier"]: max(1, math.ceil(r["count"] / CELL)) for r in small.groupBy("tier").count().collect()}  # a few tiers
    number = F.coalesce(*(F.when(F.col("tier") == t, n) for t, n in sorted(cells.items())), F.lit(1))
    small = small.withColumn("cell", F.pmod(F.xxhash64("group"), number).cast("int"))
    rest = small.agg(F.sum("b"), F.sum("t"), F.sum("r")).first()
    whole = np.maximum(np.array([x or 0 for x in rest], float), 1)
    of_small = written(small.groupBy("tier", "cell").applyInPandas(_in_cell(np.maximum(left, 0), total, whole), "group long, shard int"), "placed")
    release(groups)
    # rows of large groups, however many, meet a broadcast table; the others' groups are small
    keyed = rows.join(F.broadcast(numbers), "group", "left")
    whole_ones = keyed.where("parts = 1").withColumn("part", F.lit(0))
    split = gapless_rank(keyed.where("parts > 1"), ["group"], ["doc_id", "size"], "rank", all_["n"]).join(F.broadcast(spark.createDataFrame([(g, r["r"]) for g, n, r in parts if n > 1], "group long, members long")), "group")
    split = split.withColumn("part", F.floor(F.col("rank") * F.col("parts") / F.col("members")).cast("int")).drop("rank", "members")
    hot = whole_ones.unionByName(split).join(F.broadcast(table.drop("parts")), ["group", "part"])
    cold = keyed.where("parts is null").join(of_small.hint("merge"), "group")
    columns = ["doc_id", "size", "text_crc32", "shard"]
    ranked = gapless_rank(hot.select(*columns).unionByName(cold.select(*columns)), ["shard"], ["doc_id", "text_crc32"], "slot", all_["n"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
