"""Spelling variant grouping: words one edit apart, found by dense prefix-suffix tiling.

Two words differ by exactly one inserted, deleted or replaced code point if they differ and their common prefix and
suffix together reach the longer one's length less one. A tile is a padded matrix of code points whose rows are compared
with each other, or the rows of two such matrices: equal columns from the left give common prefixes, from the right
common suffixes, for whole blocks of words at once.

What is tiled together: one edit touches one of PARTS segments of a word and leaves the others alone. So each word goes,
once for each segment, to the words of its length that agree outside the segment, and likewise to those one shorter
(then the segment is one longer). A pair counts only in the tile of the segment that holds the first difference, so it
is found once. Groups of more than BLOCK words are cut into blocks by hash, and pairs of blocks are the tiles: no task
holds more than two blocks of a group, however many words share a segment's surroundings; a group of c words costs c*c
comparisons, which is what the method is.

Defined cases: a null text has no words; with a null doc_id nothing is deleted; equal rows count as often as they occur;
ties in n go to the smallest word in code-point order; words of any length are compared whole; an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import release, written

#: Runs of letters (fixed by the query), least code points and occurrences of a word.
RUN, LEAST_LENGTH, LEAST_COUNT = "[A-Za-z\u00C0-\u00FF]+", 7, 2
#: A form occurs so many times as often as the word; one of so many runs loses a code point.
TIMES, DROP = 10, 31
#: Segments of a word; words of a block, code points of a block of long words; cells of a comparison at a time.
PARTS, BLOCK, POINTS, CELLS = 3, 256, 1 << 16, 1 << 22


def spelled(doc_id: object, run: str) -> str:
    """The run, or without a code point where DROP divides its checksum with the document's id."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DROP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(least: int):
    long_runs = re.compile(rf"(?<!{RUN[:-1]}){RUN[:-1]}{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py()
                if text is None:
                    continue
                doc_id, runs = doc_id.as_py(), Counter(long_runs.findall(text.encode().lower().decode()))  # bytes: A-Z only
                for word, n in runs.items():
                    word = spelled(doc_id, word)
                    if len(word) >= least:
                        counts[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of docs (doc_id, text): added up a batch, then over the corpus."""
    counted = docs.select("doc_id", "text").mapInArrow(_counts(least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keys(parts: int) -> Column:
    """For each word: its groups (size: the shorter words' length, part, key: a digest of what surrounds the segment)."""
    length = F.length("word")

    def of(shorter: Column, part: int) -> Column:
        first, last = F.floor(shorter * part / parts).cast("int"), F.floor(shorter * (part + 1) / parts).cast("int")
        tail = shorter - last
        around = F.xxhash64(F.substring("word", F.lit(1), first), F.substring(F.col("word"), length - tail + 1, tail))
        return F.struct(shorter.cast("int").alias("size"), F.lit(part).alias("part"), around.alias("key"))

    return F.array(*(of(shorter, part) for shorter in (length, length - 1) for part in range(parts)))


def tiles(words: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """size, part, left, right: lists of (word, n) to be compared, those of a tile within a block having no right.

    Groups without a word of their size, and words alone in their group, have nothing to be compared with."""
    keyed = written(words.select("word", "n", F.inline(_keys(parts))), "keys")
    group = ["size", "part", "key"]
    counted = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.length("word") == F.col("size")).alias("short"))
    rows = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(POINTS) / F.greatest("size", F.lit(1)))))
    many = written(counted.where("c > 1 and short > 0").select(*group, F.ceil(F.col("c") / rows).cast("int").alias("blocks")), "groups")
    member = keyed.join(many, group).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # a block meets itself and every other block of its group
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = member.withColumn("other", other).select("size", "part", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "word", "n")
    item = F.struct("word", "n")
    tile = met.groupBy(*group, "a", "b").agg(F.collect_list(F.when(F.col("own") == F.col("a"), item)).alias("left"), F.collect_list(F.when(F.col("own") != F.col("a"), item)).alias("right"))
    return tile.where(((F.col("a") == F.col("b")) & (F.size("left") > 1)) | ((F.size("left") > 0) & (F.size("right") > 0))).select("size", "part", "left", "right")


def _matrix(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded with 0 at the right and at the left; lengths."""
    data = np.frombuffer("".join(w.ljust(width, "\0") + w.rjust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), 2, width)
    return data[:, 0], data[:, 1], np.array([len(w) for w in words])


def _run_length(same: np.ndarray) -> np.ndarray:
    """How many values are true before the first false one, along the last axis."""
    return np.where(same.all(axis=-1), same.shape[-1], np.argmin(same, axis=-1))


def are_near(words: tuple, first: np.ndarray, second: np.ndarray, size: int, begin: int, end: int) -> np.ndarray:
    """Which pairs of rows are one edit apart, their first difference in [begin, end) of the shorter word's `size` (or
    behind its end, in the last segment)."""
    from_left, from_right, length = words
    longer, shorter = np.maximum(length[first], length[second]), np.minimum(length[first], length[second])
    prefix = np.minimum(_run_length(from_left[first] == from_left[second]), shorter)
    suffix = np.minimum(_run_length((from_right[first] == from_right[second])[:, ::-1]), shorter)
    mine = (prefix >= begin) & ((prefix < end) | (end == size))
    return mine & (prefix < longer) & (prefix + suffix >= longer - 1)


def near_rows(size: int, part: int, words: list[str], blocks: list[tuple[int, int, int]], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of near words. blocks: of each tile, where its left and its right words begin and where they end."""
    width, begin, end = size + 1, size * part // parts, size * (part + 1) // parts
    matrix = _matrix(words, width)
    short = matrix[2] == size
    firsts, seconds, step, waiting, held = [], [], max(1, CELLS // width), [], 0

    def flush() -> None:
        first, second = (np.concatenate(x) for x in zip(*waiting, strict=True))
        hit = are_near(matrix, first, second, size, begin, end)
        firsts.append(first[hit])
        seconds.append(second[hit])
        waiting.clear()

    for low, middle, high in blocks:
        alone = middle == high
        across = (middle if alone else high) - (low if alone else middle)
        for at in range(0, (middle - low) * across, step):
            pair = np.arange(at, min(at + step, (middle - low) * across))
            first, second = low + pair // across, (low if alone else middle) + pair % across
            # two words of one more than size are compared where that is the size
            use = (short[first] | short[second]) & ((first < second) | (not alone))
            waiting.append((first[use], second[use]))
            held += int(use.sum())
            if held >= step:
                flush()
                held = 0
    if waiting:
        flush()
    return np.concatenate([np.zeros(0, int), *firsts]), np.concatenate([np.zeros(0, int), *seconds])


def _compare(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike: dict = {}
            for size, part, left, right in zip(*(batch.column(c).to_pylist() for c in ("size", "part", "left", "right")), strict=True):
                items, blocks = alike.setdefault((size, part), ([], []))
                blocks.append((len(items), len(items) + len(left), len(items) + len(left) + len(right)))
                items += left + right
            word, near, n = [], [], []
            for (size, part), (items, blocks) in alike.items():
                for i, j in zip(*near_rows(size, part, [x["word"] for x in items], blocks, parts), strict=True):
                    x, y = items[i], items[j]
                    word += (x["word"], y["word"])
                    near += (y["word"], x["word"])
                    n += (y["n"], x["n"])
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "n"])

    return run


def near_words(words: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """word, near, n (that of near): both directions of every pair of words (word, n) that are one edit apart."""
    return tiles(words, parts, block).mapInArrow(_compare(parts), "word string, near string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): where each word's forms end, by doubling: after k rounds each word knows what
    2**k steps lead to. Forms occur TIMES as often as their words, so that chains are short."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(now)
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now
        now._weftline_path = step._weftline_path


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    words = written(word_counts(docs), "words")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form = (-F.col("best.less")) >= F.col("n") * TIMES
    found = words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")
    )
    found = written(found, "variants")
    ends = roots(found.where("form is not null"))
    return found.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
