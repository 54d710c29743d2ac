"""Language identification by prediction by partial matching, with frozen statistics.

Training counts, for each language, how often each byte follows each context of up to ORDER bytes. A text's code
length under a language is the sum over its bytes of -log2 of the probability that escape method C gives: a symbol met
n_s times after a context of n symbols, q of them distinct, has n_s / (n + q); else the escape q / (n + q) is paid and
the context is cut by its oldest byte; after the empty context comes one chance in 256. Statistics do not change while
a text is scored, so the cost of a byte depends only on itself and the ORDER bytes before it. The costs of all such
windows met in training, under all languages, and of all escapes are worked out once; scoring looks windows up in hash
tables, longest first, for all languages at a time. Every byte of every text is scored.

The prediction is the language with the shortest code; the score is its posterior probability under equal priors.

Bounds: training uses a pseudo-random sample of labelled documents, about SAMPLE_DOCS of each of at most MAX_LANGS
languages (all, where there are fewer) whatever the size of the corpus, whole texts; so the model that reaches the
driver and the tasks is bounded by the sample.

Defined cases: a null text or one without a letter is `und` with score 0; without any labelled training text every
document is `und`; ties go to the alphabetically first language; rows are judged each by itself; an empty table gives
an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.bytes_np import joined, text_chunks

#: Bytes of context, and about how many documents of each language are learned from.
ORDER, SAMPLE_DOCS = 3, 400
#: Languages that are learned at most, those with most labelled documents.
MAX_LANGS = 256


def _grams(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The windows of n bytes that end at each byte, as numbers; those that would start before their text are cut
    by the caller."""
    out = data.astype(np.uint32)
    for j in range(1, n):
        out[j:] |= data[:-j].astype(np.uint32) << np.uint32(8 * j)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, size, gram, n): windows of 1..ORDER+1 bytes of the batch."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            data, offsets = joined(batch.column(1).filter(pa.array(langs == lang)))
            inside = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
            for size in range(1, ORDER + 2):
                grams, n = np.unique(_grams(data, offsets, size)[inside >= size - 1], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), size, np.int32)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "size", "gram", "n"],
                )


class Table:
    """uint32 keys -> rows of float32, by open addressing with a few vectorized probes."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        size = 1 << self.bits
        self.slot_key, self.slot_row = np.zeros(size, np.uint32), np.full(size, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = self._slot(keys[left], step)
            free = self.slot_row[at] < 0
            self.slot_row[at[free]] = left[free]  # of several on one slot, one stays
            self.slot_key[at] = keys[self.slot_row[at]]
            left = left[self.slot_row[at] != left]
            step += 1
        self.probes, self.rows = step, np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)) + np.uint32(step) & np.uint32((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where there is none."""
        at = self._slot(keys, 0)
        found = self.slot_row[at]
        wrong = np.flatnonzero((self.slot_key[at] != keys) & (found >= 0))
        for step in range(1, self.probes):
            if not len(wrong):
                break
            at = self._slot(keys[wrong], step)
            row = self.slot_row[at]
            found[wrong] = row
            wrong = wrong[(self.slot_key[at] != keys[wrong]) & (row >= 0)]
        found[wrong] = -1
        return found


class Model:
    """Frozen statistics: of each size, costs of windows (symbol under its context) and of escapes from contexts."""

    def __init__(self, counts: list[tuple[str, int, int, int]]):
        self.langs = sorted({r[0] for r in counts})
        number = {x: i for i, x in enumerate(self.langs)}
        self.costs, self.escapes = [], []
        by_size = {s: [[], [], []] for s in range(1, ORDER + 2)}
        for lang, size, gram, n in counts:
            for x, v in zip(by_size[size], (number[lang], gram, n), strict=True):
                x.append(v)
        lower, kinds = None, len(self.langs)
        for size in range(1, ORDER + 2):
            lang, gram, n = (np.array(x, np.int64) for x in by_size[size])
            keys = np.unique(gram)
            table = np.zeros((len(keys), kinds))
            table[np.searchsorted(keys, gram), lang] = n
            context = keys >> 8
            contexts, of = np.unique(context, return_inverse=True)
            total, distinct = np.zeros((len(contexts), kinds)), np.zeros((len(contexts), kinds))
            np.add.at(total, of, table)
            np.add.at(distinct, of, table > 0)
            met = total + distinct
            escape = np.where(met > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(met, 1)), 0.0)
            own = -np.log2(np.maximum(table, 1) / np.maximum(met[of], 1))
            if lower is None:
                shorter = np.full((len(keys), kinds), 8.0)
            else:
                shorter = lower(self._shorten(keys, size))
            cost = np.where(table > 0, own, escape[of] + shorter)
            self.costs.append(Table(keys.astype(np.uint32), cost.astype(np.float32)))
            self.escapes.append(Table(contexts.astype(np.uint32), escape.astype(np.float32)))
            lower = lambda k, size=size: self.cost(k.astype(np.uint32), size)

    @staticmethod
    def _shorten(grams: np.ndarray, size: int) -> np.ndarray:
        return grams & ((1 << (8 * (size - 1))) - 1)

    def cost(self, grams: np.ndarray, size: int) -> np.ndarray:
        """(windows, languages): bits for the last byte of each window of `size` bytes."""
        if size == 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        found = self.costs[size - 1].find(grams)
        out = self.costs[size - 1].rows[found]
        missed = np.flatnonzero(found < 0)
        if len(missed):
            rest = grams[missed]
            paid = self.escapes[size - 1].rows[self.escapes[size - 1].find(rest >> np.uint32(8))]
            out[missed] = paid + self.cost(self._shorten(rest, size).astype(np.uint32), size - 1)
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): exact code length of each text in bits."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data):
            return out
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = np.arange(len(data)) - offsets[text]
        costs = self.cost(_grams(data, offsets, ORDER + 1), ORDER + 1)
        for size in range(1, ORDER + 1):  # the first bytes have shorter contexts
            early = np.flatnonzero(inside == size - 1)
            costs[early] = self.cost(_grams(data, offsets, size)[early], size)
        filled = np.flatnonzero(np.diff(offsets))
        out[filled] = np.add.reduceat(costs, offsets[filled], axis=0, dtype=np.float64)
        return out


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, max_langs: int | None = None) -> Model:
    """A model of the labelled rows (doc_id, text, lang); lang is not null. max_langs (MAX_LANGS): how many languages are
    learned, those with most rows; the model's size is this times the grams of sample_docs documents."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs or MAX_LANGS).collect()}
    if not counts:
        return Model([])
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    labelled = labelled.where(F.col("lang").isin(sorted(counts)))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    grams = labelled.where(drawn).select("lang", "text").mapInArrow(_counted, "lang string, size int, gram long, n long")
    total = grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in total.collect()])  # bounded by the sample


def predict(docs: DataFrame, model: Model, carried: str = "doc_id", text: str = "text") -> DataFrame:
    """The column `carried`, lang_pred, score for each row of docs (carried, text). With text "x.y" the text is field y
    of the carried column x."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    inner = text.split(".")[1] if "." in text else None
    docs = docs.select(carried, letters) if inner else docs.select(carried, letters, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            if m.langs:
                texts = pc.struct_field(batch.column(0), inner) if inner else batch.column(2)
                for a, b, data, offsets in text_chunks(texts):
                    bits = m.code_lengths(data, offsets)
                    best = bits.argmin(axis=1)
                    gap = np.minimum(bits - bits[np.arange(b - a), best][:, None], 1000)
                    pred[a:b], score[a:b] = np.array(m.langs, object)[best], 1 / (2.0**-gap).sum(axis=1)
            none = ~batch.column(1).to_numpy(zero_copy_only=False)
            pred[none], score[none] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], [carried, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([docs.schema[carried], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no rest; such documents are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the labelled documents of docs that are not held out."""
    is_held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = train(docs.where(~is_held & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), sample_docs)
    return predict(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
