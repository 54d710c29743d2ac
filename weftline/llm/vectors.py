"""What the two vector operators share: valid vectors, and block-wise work on sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list<double> column of one length as float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two above their largest component: directions stay as they are to the last bit, and
    squares of very large or small components neither overflow nor vanish."""
    if not x.size:
        return x
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def distances(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from one; infinite only where no double holds them."""
    with np.errstate(over="ignore", under="ignore"):
        away = x - one
        d = np.sqrt((away**2).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(d) | (d < 1e-140))
        if len(odd):
            _, exponent = np.frexp(np.abs(away[odd]).max(axis=1))
            d[odd] = np.ldexp(np.sqrt((scaled(away[odd]) ** 2).sum(axis=1)), exponent)
            d[np.isnan(d)] = np.inf
    return d


def blocks(batches: Iterator[pa.RecordBatch], key: str = "block") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, borders) of whole groups from a partition sorted by `key`: group i is rows borders[i]:borders[i + 1].
    A group that spans Arrow batches is put together first."""
    carry: list[pa.RecordBatch] = []
    last = None

    def out(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        keys = table.column(key).to_numpy()
        return table, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left")) if (keys[1:] >= keys[:-1]).all() else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        if carry and (cut or keys[0] != last):
            if cut:
                carry.append(batch.slice(0, cut))
            yield out(carry)
            carry = []
        elif cut:
            yield out([batch.slice(0, cut)])
        carry.append(batch.slice(cut))
        last = keys[-1]
    if carry:
        yield out(carry)


def by_block(df: DataFrame) -> DataFrame:
    """Rows of a block side by side in one partition."""
    return df.repartition("block").sortWithinPartitions("block")


def spread_blocks(members: DataFrame, columns: list[str]) -> DataFrame:
    """columns, key, side, block of members (key, cid, parts, ...), so that each two members of a key meet in a block.

    A key's members fall into `parts` parts by hash. Block (i, j), i < j, has part i on side -1 and part j on side 1;
    block (i, i) has part i on side 0. A block holds at most two parts, however many members its key has.
    """
    part = F.pmod(F.xxhash64("cid", "key"), F.col("parts")).cast("int")
    other = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.struct(F.least(j, F.col("part")).alias("i"), F.greatest(j, F.col("part")).alias("j"), F.signum(F.col("part") - j).cast("int").alias("side")),
    )
    return (
        members.withColumn("part", part)
        .select("key", *columns, F.explode(other).alias("o"))
        .select("key", *columns, "o.side", F.xxhash64("key", "o.i", "o.j").alias("block"))
    )
