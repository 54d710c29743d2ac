"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are tokenized and cut into pieces of at most the sequence length. Only the histogram of piece lengths (at
most as many numbers as the sequence length) comes to the driver. There lengths are placed longest first, each into
the packing patterns with most room left, many packs at a time: a pattern is a list of lengths and the number of
packs that have it. The patterns are then joined back to the pieces by rank: pieces of a length are numbered without
gaps, and runs of these numbers belong to places in patterns. The number of patterns depends on the number of lengths,
not of documents, so the table of places that tasks get is bounded.

Ids are those of the tokenizers library with the given vocabulary file: words are found as the library finds them,
and each different word of many texts is encoded once by the library's model.

Defined cases: a null or empty text has only the end id, one piece; a longer document is cut into full pieces and a
rest; rows with one doc_id are packed each by itself; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import grouped, library_codec
from weftline.llm.common import gapless_rank, written

LENGTH, END_ID = 2048, 1


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and end_id, cut every `length` ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        c, end = library_codec(path), end_id.to_bytes(4, "little")
        for batch in grouped(batches):
            at, starts, lengths, crcs, totals = [], [], [], [], []
            for row, ids in enumerate(c.encode_all(batch.column(1))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, length):
                    part = ids[4 * start : 4 * (start + length)]
                    at.append(row)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """[(number of packs, lengths in them)] by shortest-pack-first; every length placed as often as it occurs."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        space = length
        while left:
            while space >= size and not room[space]:
                space -= 1
            if space < size:
                room[length - size].append((left, [size]))
                break
            packs, members = room[space].pop()
            taken = min(packs, left)
            if packs > taken:
                room[space].append((packs - taken, members))
            room[space - size].append((taken, [*members, size]))
            left -= taken
    return [x for space in sorted(room) for x in room[space]]


def places(found: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence id, offset), sorted: pieces of a length with ranks from `first rank`
    on lie in sequences from `first sequence id` on, at `offset`."""
    rows, next_rank, sequence = [], defaultdict(int), 0
    for packs, members in found:
        offset = 0
        for size in members:
            rows.append((size, next_rank[size], sequence, offset))
            next_rank[size] += packs
            offset += size
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """pieces() with sequence_id and offset: each piece's place, sequences filled without gaps from 0."""
    cut = written(pieces(docs, path, length, end_id), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most `length` rows
    table, names = places(patterns(histogram, length)), cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            sizes, ranks = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "_rank"))
            at = np.searchsorted(key, (sizes << 44) + ranks, "right") - 1
            own = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(table[at, 2] + ranks - table[at, 1]), pa.array(table[at, 3])], [*names, "sequence_id", "offset"]
            )

    ranked = gapless_rank(cut, ["length"], ["doc_id", "start"], "_rank", sum(histogram.values()))
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(run, columns)
