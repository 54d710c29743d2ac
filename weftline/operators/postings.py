"""Stored inverted indexes: ranked words and substrings (trigrams), appended to by segments.

An index is a folder:

    segments/           a row a finished segment: its documents and their tokens; written last, so readers see whole segments
    postings/segment=S/bucket=B/   (term, block, n, max_tf, min_dl, ids, tf, dl), sorted by term
    texts/segment=S/part=P/        (block, id, text), for substring search only

Documents of a segment lie in spans of at most SPAN, and these in blocks of at most BLOCK_BYTES of text or
of one document (texts are stored by spans). A row of postings holds one term's documents of one block: so a term that
every document holds is many bounded rows in several files, and all terms' rows of a block speak of the same documents.
A block is counted and its lists are made in one task, so that only finished lists are shuffled, once, to their buckets.
The row of the term MARK has the number of a block's documents and of their tokens, and no ids. Lists of grams have ids
alone. A word's bucket comes from its first four letters; words that begin with the same four letters share one. The
beginnings of PREFIXES letters are terms of their own, under a mark that no word holds.

A query reads only its terms' buckets (partition filters) and within them the row groups that hold its terms. The best k
are found by block maxima: a block's bound is the sum over terms of what its highest count and least length can give;
the blocks with the highest bounds give a k-th score, and of the others only those whose bound reaches it are read.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.shared import release, written

#: Documents of a block; buckets of terms; letters of stored beginnings, and their mark; blocks of a part of texts.
SPAN, BUCKETS, PREFIXES, MARK, PART = 4096, 64, (2, 3, 4), "^", 16
#: Bytes of a block's texts; bits of a block's number that count the blocks of a span.
BLOCK_BYTES, SUB_BITS = 16_000_000, 12
#: What search.tokens finds in lower-cased text.
WORD = re.compile("[a-z0-9_-]+")
#: Letters that decide a word's bucket.
HEAD = 4
#: Blocks whose documents give the score that others must reach, at first.
FIRST_BLOCKS = 32
#: Grams whose lists are cut with each other.
RAREST = 4
SEGMENT = "segment string, n long, total long, blocks long, buckets int, id_type string"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.when(term.startswith(MARK), term).otherwise(F.substring(term, 1, HEAD))), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """Opens the index at path; what a table's files are is found out once for each set of segments."""

    spark: SparkSession
    path: str
    opened: dict = field(default_factory=dict)

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, name: str = "segments") -> bool:
        fs, path = self._folder(name)
        return fs.exists(path)

    def segments(self) -> list:
        """A row for each finished segment, read again when there are new ones; compact() keeps them few."""
        fs, path = self._folder("segments")
        now = tuple(sorted(f.getPath().getName() for f in fs.listStatus(path)))
        if self.opened.get("listing") != now:
            self.opened["segments"] = self.spark.read.schema(SEGMENT).parquet(f"{self.path}/segments").orderBy("segment").collect()
            self.opened["listing"] = now
        return self.opened["segments"]

    def table(self, name: str, segments: list) -> DataFrame:
        """postings or texts of the segments."""
        names, kind = tuple(s["segment"] for s in segments), segments[0]["id_type"]
        if (name, names) not in self.opened:
            schema = {
                "postings": f"term string, block long, n long, max_tf double, min_dl int, ids array<{kind}>, tf array<double>, dl array<int>, segment string, bucket int",
                "texts": f"block long, id {kind}, text string, segment string, part int",
            }[name]
            folder = f"{self.path}/{name}"
            self.opened[name, names] = self.spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/segment={s}" for s in names))
        return self.opened[name, names]


def _placed(docs: DataFrame) -> DataFrame:
    """docs with _span, the number of the span they lie in; written."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)
    rows = written(docs.withColumn("_at", F.monotonically_increasing_id()), "placed")
    within = F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / SPAN)
    out = rows.withColumn("_span", F.shiftleft(F.shiftright("_at", 33), 21) + within).drop("_at")
    out._weftline_path = rows._weftline_path
    return out


def _grouped(codes: np.ndarray, docs: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes, docs and the sum of weights (without: 1), a row for each different pair, by code and document."""
    order = np.lexsort((docs, codes))
    codes, docs = codes[order], docs[order]
    new = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])]) if len(codes) else np.zeros(0, np.int64)
    sums = np.ones(len(new)) if weights is None else np.add.reduceat(weights[order], new) if len(new) else np.zeros(0)
    return codes[new], docs[new], sums


def _lists(terms: pa.Array, codes: np.ndarray, docs: np.ndarray, tf: np.ndarray, ids: pa.Array, dl: np.ndarray | None, block: int) -> pa.RecordBatch:
    """Rows of postings of one block from pairs by code and document; codes point into terms, docs into ids."""
    new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[new, len(codes)], pa.int32())
    lists = pa.ListArray.from_arrays(offsets, ids.take(pa.array(docs)))
    none = pa.array(np.zeros(len(new) + 1), pa.int32())
    if dl is None:
        least, tfs, dls = np.zeros(len(new), np.int32), pa.ListArray.from_arrays(none, pa.array([], pa.float64())), pa.ListArray.from_arrays(none, pa.array([], pa.int32()))
    else:
        each = dl[docs].astype(np.int32)
        least = np.minimum.reduceat(each, new) if len(new) else np.zeros(0, np.int32)
        tfs, dls = pa.ListArray.from_arrays(offsets, pa.array(tf)), pa.ListArray.from_arrays(offsets, pa.array(each))
    most = np.maximum.reduceat(tf, new) if len(new) else np.zeros(0)
    n = np.diff(np.r_[new, len(codes)])
    columns = [terms.take(pa.array(codes[new])), pa.array(np.full(len(new), block)), pa.array(n, pa.int64()), pa.array(most), pa.array(least), lists, tfs, dls]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "max_tf", "min_dl", "ids", "tf", "dl"])


def _of_block(rows: int, total: int, ids: pa.Array, block: int) -> pa.RecordBatch:
    """The row of MARK: how many documents and tokens the block has."""
    none = pa.array([0, 0], pa.int32())
    empty = [pa.ListArray.from_arrays(none, pa.array([], t)) for t in (ids.type, pa.float64(), pa.int32())]
    columns = [pa.array([MARK]), pa.array([block]), pa.array([rows]), pa.array([float(total)]), pa.array([0], pa.int32()), *empty]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "max_tf", "min_dl", "ids", "tf", "dl"])


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _word_lists(columns: list[pa.Array], weights: list[float], ids: pa.Array, block: int) -> Iterator[pa.RecordBatch]:
    """Lists of the words of columns (search.tokens), and of their beginnings."""
    dl, code, found, at, tf = np.zeros(len(ids), np.int64), defaultdict(), array("q"), [], []
    code.default_factory = code.__len__
    for column, weight in zip(columns, weights, strict=True):
        different, times = np.zeros(len(ids), np.int64), array("q")
        for doc, text in enumerate(column.to_pylist()):
            counts = Counter(WORD.findall(_text(text).lower()))
            found.extend(map(code.__getitem__, counts))
            times.extend(counts.values())
            different[doc] = len(counts)
            dl[doc] += counts.total()
        at.append(np.repeat(np.arange(len(ids)), different))
        tf.append(np.frombuffer(times, np.int64) * weight)
    words = pa.array(code, pa.string())
    codes, docs, tf = _grouped(np.frombuffer(found, np.int64), np.concatenate(at), np.concatenate(tf))
    yield _of_block(len(ids), int(dl.sum()), ids, block)
    yield _lists(words, codes, docs, tf, ids, dl, block)
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    for letters in PREFIXES:
        begun = pc.binary_join_element_wise(pa.scalar(MARK), pc.utf8_slice_codeunits(words, 0, letters), "").dictionary_encode()
        of = begun.indices.to_numpy().astype(np.int64)
        long = lengths[codes] >= letters
        yield _lists(begun.dictionary, *_grouped(of[codes[long]], docs[long], tf[long]), ids, dl, block)


def _gram_lists(columns: list[pa.Array], weights: list[float], ids: pa.Array, block: int) -> Iterator[pa.RecordBatch]:
    """Lists of the runs of three code points of a column (string)."""
    grams, docs = [], []
    for at, text in enumerate(columns[0].to_pylist()):
        points = np.frombuffer(_text(text).encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(points) >= 3:
            grams.append(np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:]))
            docs.append(np.full(len(grams[-1]), at))
    yield _of_block(len(ids), 0, ids, block)
    if grams:
        different, codes = np.unique(np.concatenate(grams), return_inverse=True)
        points = np.stack([different >> 42, (different >> 21) & 0x1FFFFF, different & 0x1FFFFF], 1).astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        terms = pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())
        yield _lists(terms, *_grouped(codes, np.concatenate(docs), None), ids, None, block)


def _postings(placed: DataFrame, names: list[str], weights: list[float], make: Callable) -> DataFrame:
    """Rows of postings by make, from the columns names of placed (also id, _span). A task sees whole spans."""
    kind = placed.schema["id"].dataType.simpleString()
    most, bits = BLOCK_BYTES, SUB_BITS

    def size(column: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)

    def block_of(parts: list[pa.RecordBatch], span: int, sub: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
        for batch in whole:  # one, as a block is below 2 GB
            batch = batch.take(pc.array_sort_indices(batch.column("id"), null_placement="at_start"))
            yield from make([batch.column(n) for n in names], weights, batch.column("id"), (span << bits) + sub)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, sub, parts, held = None, 0, [], 0
        for batch in batches:
            spans, sizes = batch.column("_span").to_numpy(), sum(size(batch.column(n)) for n in names)
            start = 0
            for at in range(len(spans)):
                other = spans[at] != span
                if other or (held + sizes[at] > most and held):
                    if at > start:
                        parts.append(batch.slice(start, at - start))
                    if parts:
                        yield from block_of(parts, span, sub)
                    sub = 0 if other else sub + 1
                    span, parts, held, start = int(spans[at]), [], 0, at
                held += int(sizes[at])
            parts.append(batch.slice(start))
        if parts:
            yield from block_of(parts, span, sub)

    dealt = placed.select("id", "_span", *(F.col(n).cast("binary").alias(n) for n in names)).repartition("_span").sortWithinPartitions("_span")
    columns = f"term string, block long, n long, max_tf double, min_dl int, ids array<{kind}>, tf array<double>, dl array<int>"
    return dealt.mapInArrow(run, columns)


def _finish(index: Index, lists: DataFrame, placed: DataFrame, buckets: int, texts: DataFrame | None) -> None:
    """Stores rows of postings as a new segment."""
    segment = uuid.uuid4().hex
    postings = f"{index.path}/postings/segment={segment}"
    rows = lists.withColumn("bucket", bucket_of(F.col("term"), buckets))
    # a bucket is at most one file for about every million documents, and a task writes few of them
    dealt = rows.repartition("bucket", F.floor(F.shiftright("block", SUB_BITS) / 256)).sortWithinPartitions("bucket", "term", "block")
    dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(postings)
    if texts is not None:
        parted = texts.withColumn("part", F.pmod(F.xxhash64(F.floor(F.col("block") / PART)), F.lit(1 << 16)).cast("int"))
        parted.repartition("part").sortWithinPartitions("part", "block").write.partitionBy("part").option("compression", "zstd").parquet(f"{index.path}/texts/segment={segment}")
    blocks = index.spark.read.schema("term string, n long, max_tf double, bucket int").parquet(postings).where((F.col("bucket") == bucket_of(F.lit(MARK), buckets)) & (F.col("term") == MARK))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    done = blocks.agg(F.lit(segment).alias("segment"), count("n").alias("n"), count("max_tf").alias("total"), F.count(F.lit(1)).alias("blocks"), F.lit(buckets).alias("buckets"), F.lit(placed.schema["id"].dataType.simpleString()).alias("id_type"))
    done.coalesce(1).write.mode("append").parquet(f"{index.path}/segments")
    release(placed)


def _buckets(index: Index, buckets: int) -> int:
    """All segments of an index have the first one's buckets."""
    return index.segments()[0]["buckets"] if index.exists() else buckets


def add_texts(index: Index, docs: DataFrame, weights: dict[str, float] | None = None, buckets: int = BUCKETS) -> Index:
    """Adds documents (id, and the columns that weights names, else text) as a segment. A null column is empty; a word
    counts its column's weight; a document of a new segment is not checked against older ones."""
    weights, buckets = weights or {"text": 1.0}, _buckets(index, buckets)
    placed = _placed(docs.select("id", *weights))
    _finish(index, _postings(placed, list(weights), [float(w) for w in weights.values()], _word_lists), placed, buckets, None)
    return index


def add_grams(index: Index, docs: DataFrame, buckets: int = BUCKETS) -> Index:
    """Adds documents (id, text) as a segment of grams; their texts are stored beside, by spans."""
    buckets = _buckets(index, buckets)
    placed = _placed(docs.select("id", "text"))
    _finish(index, _postings(placed, ["text"], [], _gram_lists), placed, buckets, placed.select(F.col("_span").alias("block"), "id", "text"))
    return index


def _rows(postings: DataFrame, term: str, buckets: int) -> DataFrame:
    """A query term's rows; a term that ends in * stands for all words that it begins."""
    begins = term[:-1]
    if not term.endswith("*"):
        exact = term
    elif len(begins) in PREFIXES:
        exact = MARK + begins
    else:
        exact = None
    if exact is not None:
        return postings.where((F.col("bucket") == bucket_of(F.lit(exact), buckets)) & (F.col("term") == exact))
    some = postings.where(F.col("term").startswith(begins) & ~F.col("term").startswith(MARK))
    if len(begins) >= HEAD:
        some = some.where(F.col("bucket") == bucket_of(F.lit(begins), buckets))
    each = some.select("segment", "block", F.inline(F.arrays_zip("ids", "tf", "dl"))).groupBy("segment", "block", "ids", "dl").agg(F.sum("tf").alias("tf"))
    lists = each.groupBy("segment", "block").agg(F.sort_array(F.collect_list(F.struct("ids", "tf", "dl"))).alias("x"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    return lists.select("segment", "block", F.size("x").cast("long").alias("n"), "max_tf", "min_dl", F.col("x.ids").alias("ids"), F.col("x.tf").alias("tf"), F.col("x.dl").alias("dl"))


def ranked(index: Index, terms: list[str], k: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score of the k documents that rank first for the terms (all that hold one, without k), ties by id. The
    collection's size, mean length and how many documents hold each term come to the driver, and a k-th score."""
    segments = index.segments()
    n, total = sum(s["n"] for s in segments), sum(s["total"] for s in segments)
    postings, buckets = index.table("postings", segments), segments[0]["buckets"]
    columns = ["segment", "block", "n", "max_tf", "min_dl", "ids", "tf", "dl"]
    rows = reduce(DataFrame.unionByName, [_rows(postings, t, buckets).select(*columns, F.lit(i).alias("q")) for i, t in enumerate(terms)])
    df = rows.agg(*(F.coalesce(F.sum(F.when(F.col("q") == i, F.col("n"))), F.lit(0)) for i in range(len(terms)))).first()
    weight = F.coalesce(*(F.when(F.col("q") == q, math.log(1 + (n - m + 0.5) / (m + 0.5))) for q, m in enumerate(df)))
    mean = max(total / n, 1e-9) if n else 1e-9
    gain = lambda tf, dl: F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(mean)))
    rows = rows.withColumn("weight", weight)

    def scored(some: DataFrame) -> DataFrame:
        each = some.select("weight", F.inline(F.arrays_zip("ids", "tf", "dl")))
        return each.groupBy(F.col("ids").alias("id")).agg(F.sum(gain(F.col("tf"), F.col("dl"))).alias("score"))

    if k is None:
        return scored(rows)
    first = max(FIRST_BLOCKS, -(-k // SPAN))
    if sum(s["blocks"] for s in segments) <= first:  # the first look is at all there is
        return scored(rows).orderBy(F.desc("score"), "id").limit(k)
    bounds = rows.groupBy("segment", "block").agg(F.sum(gain(F.col("max_tf"), F.col("min_dl"))).alias("bound"))
    best = bounds.orderBy(F.desc("bound"), "segment", "block").limit(first)
    reached = scored(rows.join(F.broadcast(best), ["segment", "block"], "left_semi")).orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count(F.lit(1))).first()
    floor = reached[0] if reached[1] == k else 0.0
    left = bounds.where(F.col("bound") >= floor * (1 - 1e-12)).select("segment", "block")
    return scored(rows.join(left, ["segment", "block"], "left_semi")).orderBy(F.desc("score"), "id").limit(k)


def holding(index: Index, query: str) -> DataFrame:
    """id, text of the documents whose text holds the query.

    The rarest gram's blocks are the only ones in which the next RAREST grams' lists are read; a block's lists are cut
    with each other from the shortest on, and only the texts of the parts that hold what is left are read. Queries of
    fewer than three characters are looked for in all texts."""
    segments = index.segments()
    texts = index.table("texts", segments)
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    if not grams:
        return texts.where(F.col("text").contains(query)).select("id", "text")
    buckets, postings = segments[0]["buckets"], index.table("postings", segments)
    among = reduce(lambda a, b: a | b, [F.col("bucket") == bucket_of(F.lit(g), buckets) for g in grams])
    rows = postings.where(among & F.col("term").isin(grams)).select("segment", "block", "n", "ids", "term")
    df = dict(zip(grams, rows.agg(*(F.sum(F.when(F.col("term") == g, F.col("n"))) for g in grams)).first(), strict=True))
    if None in df.values():
        return texts.limit(0).select("id", "text")
    grams = sorted(grams, key=lambda g: (df[g], g))[:RAREST]  # the texts decide in the end
    near = rows.where(F.col("term").isin(grams)).join(rows.where(F.col("term") == grams[0]).select("segment", "block"), ["segment", "block"], "left_semi")
    lists = near.groupBy("segment", "block").agg(F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("lists")).where(F.size("lists") == len(grams))
    both = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1)["ids"], lambda acc, x: F.array_intersect(acc, x["ids"]))
    hits = written(lists.select("segment", F.shiftright("block", SUB_BITS).alias("block"), F.explode(both).alias("id")), "hits")
    part = F.pmod(F.xxhash64(F.floor(F.col("block") / PART)), F.lit(1 << 16)).cast("int")
    parts = [r[0] for r in hits.select(part.alias("part")).distinct().collect()]  # at most the folders of the index
    near_texts = texts.where(F.col("part").isin(parts)) if parts else texts.limit(0)
    return near_texts.join(hits, ["segment", "block", "id"], "left_semi").where(F.col("text").contains(query)).select("id", "text")


def compact(index: Index, into: str) -> Index:
    """The index with all its segments as one, in another folder; the old one stays as it is for its readers."""
    out, segment, all_ = Index(index.spark, into), uuid.uuid4().hex, index.segments()
    number = {s["segment"]: i for i, s in enumerate(all_)}
    place = F.coalesce(*(F.when(F.col("segment") == s, i) for s, i in number.items()))
    moved = lambda df, bits: df.withColumn("block", F.col("block") + F.shiftleft(place.cast("long"), bits)).drop("segment")
    dealt = moved(index.table("postings", all_), 52).repartition("bucket", F.floor(F.shiftright("block", SUB_BITS) / 256)).sortWithinPartitions("bucket", "term", "block")
    dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{into}/postings/segment={segment}")
    if index.exists("texts"):
        part = F.pmod(F.xxhash64(F.floor(F.col("block") / PART)), F.lit(1 << 16)).cast("int")
        moved(index.table("texts", all_), 52 - SUB_BITS).withColumn("part", part).repartition("part").sortWithinPartitions("part", "block").write.partitionBy("part").option("compression", "zstd").parquet(f"{into}/texts/segment={segment}")
    done = [(segment, sum(s["n"] for s in all_), sum(s["total"] for s in all_), sum(s["blocks"] for s in all_), all_[0]["buckets"], all_[0]["id_type"])]
    index.spark.createDataFrame(done, SEGMENT).coalesce(1).write.mode("append").parquet(f"{into}/segments")
    return out
