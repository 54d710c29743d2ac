"""Exact removal of long repeated substrings by column-wise multi-document suffix sorting.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else (with across=True: in another
text). Work is dealt out by anchors: each window of `length` bytes has one anchor, the gram of a fixed size in it with
the least hash (the leftmost of equal ones), so equal windows have equal anchors at equal places. Runs of consecutive
windows with one anchor are a segment; every window start lies in exactly one segment, and windows can only be equal
inside segments of one anchor. Anchors met once are out. The others' segments form collections whose members are
aligned at the anchor.

In each collection the suffixes are sorted column by column, from the last to the first: every round inserts one
symbol for each segment in front of its suffix. The new order is the old one, stably sorted by the new symbols (the
collection's Burrows-Wheeler column), and the common prefix of two neighbours with one new symbol is one more than the
least common prefix between their old places. A window is repeated if its suffix shares `length` symbols with a
neighbour. As members are aligned, only suffixes of one column can share that much, so one round's order and common
prefixes are all that is kept; columns are read once, in sequence. What the method keeps in external files between
rounds is here the written segments: Spark's tables are the sequential files.

Equal segments are one, with a flag that says whether it was met more than once. Anchors with more than HOT different
segments are cut again with longer anchors, up to anchors of the whole length, where all segments of an anchor are
equal; so no task gets a collection that grows with a third of the input. Joins on anchors and on segments are salted
for keys that hold more than 1 / HEAVY of all segments (see `skewed`). Short strings have dense anchors, and so segments
that together have several times the texts' bytes. Then anchors are dealt into shares by their hash, and one share after
the other is done wholly, from the texts to the spans: windows of different anchors never meet, so nothing is lost, and
disk holds the segments of one share at a time.

Sequences of words go the same way, with a hash of each word as one symbol in place of a byte: `dedup_report` counts
the passages of enough words that other documents hold too, which may be shorter than `length` bytes.

Defined cases: a null text is empty; rows are separate documents, repeated rows (and rows of one doc_id) too,
but that across=True takes rows of one doc_id (or none) and one text as one document; texts
shorter than `length` bytes lose nothing; an empty table gives an empty table; extra columns of the input, whatever
their names, are kept by `dedup_texts` and not read by `dedup_report`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bytes_np import U64, mix, prefix_hash, substring_hash, text_chunks, word_hashes
from weftline.llm.common import release, written
from weftline.llm.vectors import blocks, by_block

#: Bytes of a repeated string, where the caller names no other length.
LENGTH = 400
#: Words of a passage that op5 counts (over 50).
PASSAGE_WORDS = 51
#: Different segments of an anchor that one task sorts at most; segments sorted together.
HOT, TOGETHER = 4000, 16384
#: Keys with more than this share of all segments are salted; there are fewer than HEAVY of them.
HEAVY = 1024
#: Bits for a place in a run of text that is searched for anchors at once, and the run's windows.
PLACE_BITS, RUN = 24, 1 << 20


def levels(length: int) -> tuple[int, ...]:
    """Anchor sizes of the levels; the last is the length itself. (64, 370, 400) for 400."""
    return max(1, length * 4 // 25), max(1, length * 37 // 40), length


def shares(length: int) -> int:
    """Shares of the anchors that are done one after the other: each has about as many segments as strings of LENGTH
    bytes have in all, as a text's anchors lie about length / 2 bytes apart."""
    return -(-LENGTH // length)


def _bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit symbol for each word of the texts; offsets in words."""
    return word_hashes(data, offsets, lower=False)


def _cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of segments that were cut out of texts' words."""
    return data.view(U64), offsets // 8


def anchors(data: np.ndarray, gram: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place of its anchor for each window of `length` symbols, hash of the gram at each place)."""
    prefix = prefix_hash(data)
    starts = np.arange(len(data) - gram + 1)
    hashes = substring_hash(prefix, starts, starts + gram)
    width = length - gram + 1
    if width == 1:
        return starts, hashes
    low = U64((1 << PLACE_BITS) - 1)
    keys = (mix(hashes, 17) & ~low) | starts.astype(U64)
    padded = np.concatenate([keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, U64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64), hashes


def segments(data: np.ndarray, offsets: np.ndarray, gram: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, anchor, key) of the segments of concatenated texts; places are
    counted from the text's start."""
    out = []
    for begin in range(0, max(len(data) - length + 1, 0), RUN):
        part = data[begin : begin + RUN + length - 1]
        anchor, hashes = anchors(part, gram, length)
        at = begin + np.arange(len(anchor))
        text = np.searchsorted(offsets, at, "right") - 1
        good = at + length <= offsets[text + 1]
        first = good.copy()
        first[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        last = good.copy()
        last[:-1] &= ~good[1:] | first[1:]
        f, e = np.flatnonzero(first), np.flatnonzero(last)
        base = offsets[text[f]]
        out.append((text[f], at[f] - base, at[e] - base, begin + anchor[f] - base, hashes[anchor[f]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_windows(strings: list[np.ndarray], anchor: np.ndarray, least: np.ndarray, most: np.ndarray, many: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For different aligned strings (anchor: place of each one's anchor), a mask (strings, columns): whether the
    `length` symbols from there also start, in the same column, in a string met elsewhere. Column of a string's place
    p: p - anchor + shift. least, most: the least and largest number of the texts that hold a string; strings whose
    all holders are one text do not count for each other (give different numbers where they shall). many: strings
    that by themselves are met more than once."""
    n, sizes = len(strings), np.array([len(s) for s in strings])
    shift = int(anchor.max())
    start, end = shift - anchor, shift - anchor + sizes
    width = int(end.max())
    symbols = np.zeros((width, n), strings[0].dtype)  # a row for each column, read once
    mask = np.zeros((n, width), bool)
    for i, s in enumerate(strings):
        symbols[start[i] : end[i], i] = s
        if many[i]:
            mask[i, start[i] : end[i] - length + 1] = True
    if n == 1:
        return mask
    ending = np.argsort(-end, kind="stable")
    next_in = 0
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int16)
    for column in range(width - 1, -1, -1):
        joining = next_in
        while joining < n and end[ending[joining]] == column + 1:
            joining += 1
        if joining > next_in:  # empty suffixes come first
            order = np.concatenate([ending[next_in:joining], order])
            common = np.concatenate([np.zeros(joining - next_in, np.int16), common])
            next_in = joining
        if not len(order):
            continue
        alive = np.flatnonzero(start[order] <= column)
        if len(alive) < len(order):  # strings that have begun leave; what they were between is joined
            if not len(alive):
                order, common = order[:0], common[:0]
                continue
            common = np.minimum.reduceat(common[: alive[-1] + 1], np.concatenate([[0], alive[:-1] + 1]))
            order = order[alive]
        new = symbols[column, order]
        place = np.argsort(new, kind="stable")
        pairs = np.empty(2 * len(place), np.int64)
        pairs[0], pairs[2::2] = 0, place[:-1] + 1
        pairs[1::2] = place + 1
        same = np.concatenate([[False], new[place[1:]] == new[place[:-1]]])
        lower = np.minimum.reduceat(np.append(common, np.int16(length)), pairs)[::2]
        common = np.where(same, np.minimum(lower + 1, length), 0).astype(np.int16)
        order = order[place]
        if (common >= length).any():
            first = np.flatnonzero(common < length)  # suffixes that share `length` symbols stand side by side
            apart = np.minimum.reduceat(least[order], first) != np.maximum.reduceat(most[order], first)
            counts = np.diff(np.append(first, len(order)))
            hit = np.repeat(apart & (counts > 1), counts)
            mask[order[hit], column] = True
    return mask


def _digests(pieces: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(s, digest_size=8).digest() for s in pieces]), np.int64)


def _segments(gram: int, length: int, share: int = 0, of: int = 1, read=_bytes):
    """(d, h, text, ...) -> a row for each segment of a share of the keys, with a digest of its symbols, which with the
    key names it; further columns are carried along. read: what a text's symbols are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "text"]
            for a, _, *chunk in text_chunks(batch.column(2)):
                data, offsets = read(*chunk)
                text, first, last, anchor, key = segments(data, offsets, gram, length)
                mine = mix(key.view(U64), 51) % U64(of) == share
                text, first, last, anchor, key = (x[mine] for x in (text, first, last, anchor, key))
                at, buffer, base, size = pa.array(text + a), data.tobytes(), offsets[text], data.itemsize
                digest = _digests([buffer[i:j] for i, j in zip((size * (base + first)).tolist(), (size * (base + last + length)).tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(n)).take(at) for n in names), pa.array(key), pa.array(digest), *(pa.array(x.astype(np.int32)) for x in (first, last, anchor))],
                    [*names, "key", "s", "first", "last", "anchor"],
                )

    return run


def _cut(length: int, names: list[str], read=_bytes):
    """(text, places: array of (first, last, anchor, then names)) -> a row for each place: names, anchor, its symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            chunks = [read(*chunk) for _, _, *chunk in text_chunks(batch.column(0))]
            data = np.concatenate([data for data, _ in chunks])
            offsets = np.cumsum([0, *np.concatenate([np.diff(offsets) for _, offsets in chunks])])
            places = batch.column(1)
            first, last, anchor, *rest = places.flatten().flatten()
            first, last, anchor = (x.to_numpy() for x in (first, last, anchor))
            row = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            buffer, base, size = data.tobytes(), offsets[:-1][row], data.itemsize
            for i in range(0, len(row), 8192):
                j = slice(i, i + 8192)
                cut = [buffer[size * (b + f) : size * (b + e + length)] for b, f, e in zip(base[j], first[j], last[j], strict=True)]
                yield pa.RecordBatch.from_arrays([*(x.slice(i, 8192) for x in rest), pa.array((anchor - first)[j]), pa.array(cut, pa.binary())], [*names, "anchor", "piece"])

    return run


def _sorted(length: int, across: bool, symbol: type = np.uint8):
    """Collections (block, s, many, anchor, piece; least, most if across) -> repeated spans (key, s, lo, hi) of the pieces, in symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in blocks(batches):
            many, anchor = table.column("many").to_numpy(), table.column("anchor").to_numpy().astype(np.int64)
            key, s, pieces = table.column("block").to_numpy(), table.column("s").to_numpy(), table.column("piece").combine_chunks()
            least, most = (table.column(c).to_numpy() for c in ("least", "most")) if across else (None, None)
            a = 0
            while a < len(borders) - 1:
                b = max(a + 1, int(np.searchsorted(borders, borders[a] + TOGETHER, "right")) - 1)
                rows = np.arange(borders[a], borders[b])
                a = b
                if len(rows) == 1 and not many[rows[0]]:
                    continue
                strings = [np.frombuffer(pieces[int(i)].as_buffer(), symbol) for i in rows]
                low, high = (least[rows], most[rows]) if across else (np.arange(len(rows)), np.arange(len(rows)))
                mask = repeated_windows(strings, anchor[rows], low, high, many[rows], length)
                edge = np.zeros((len(rows), 1), np.int8)
                steps = np.diff(mask.astype(np.int8), axis=1, prepend=edge, append=edge)
                (i, lo), (_, hi) = np.nonzero(steps == 1), np.nonzero(steps == -1)
                back = anchor[rows][i] - int(anchor[rows].max())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[rows[i]]), pa.array(s[rows[i]]), pa.array((lo + back).astype(np.int32)), pa.array((hi - 1 + back + length).astype(np.int32))],
                    ["key", "s", "lo", "hi"],
                )

    return run


def skewed(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame, salt: list[str], how: str) -> DataFrame:
    """left joined with right on the columns `on`. heavy (on, parts) names left's keys with very many rows, fewer than
    HEAVY of them: their rows are dealt over `parts` tasks by the columns `salt`, right's are copied to each."""
    parts = F.coalesce("_parts", F.lit(1))
    heavy = F.broadcast(heavy.select(*on, F.col("parts").alias("_parts")))
    dealt = left.join(heavy, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt), parts).cast("int")).drop("_parts")
    copied = right.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).drop("_parts")
    return dealt.join(copied.hint("merge"), [*on, "_salt"], how).drop("_salt")


def _heavy(counts: DataFrame, total: int) -> DataFrame:
    """Of counts (..., n), the rows with more than 1 / HEAVY of the total, and the parts they are dealt over."""
    limit = max(total // HEAVY, 1)
    return counts.where(F.col("n") > limit).withColumn("parts", F.ceil(F.col("n") / limit).cast("int"))


def _repeats(texts: DataFrame, level: int, length: int, across: bool, share: int = 0, of: int = 1, words: bool = False) -> DataFrame:
    """(d, h, lo, hi): spans of the texts (d, h, text) that repeated strings of `length` bytes (words, if words) cover,
    in bytes (words), as far as their anchors are of the share. On deeper levels the texts are different segments, and
    carry many (met more than once) and, if across, least and most (the numbers of the documents that hold them)."""
    read = (_cut_words if level else _words) if words else _bytes
    carried = (["many boolean"] + ["least long", "most long"] * across) * (level > 0)
    every = written(texts.mapInArrow(_segments(levels(length)[level], length, share, of, read), ", ".join(["d long", "h long", *carried, "key long", "s long", "first int", "last int", "anchor int"])), "segments")
    own = F.xxhash64("d", "h")
    numbers = [] if not across else [F.min("least").alias("least"), F.max("most").alias("most")] if level else [F.min(own).alias("least"), F.max(own).alias("most")]
    n = F.count(F.lit(1)).alias("n")
    met = F.expr("least <> most") if across else F.expr("n > 1 or many") if level else F.expr("n > 1")
    flags = [F.max("many").alias("many")] * (level > 0)
    keys = written(every.groupBy("key").agg(n, *numbers, *flags).where(met).select("key", "n"), "keys")
    total = every.count()
    found = written(skewed(every, keys.select("key"), ["key"], _heavy(keys, total), ["d", "h", "first"], "left_semi"), "shared")
    release(every)
    release(keys)
    # of equal segments one place stands for all; only its bytes are cut
    place = F.min(F.struct("d", "h", "first", "last", "anchor")).alias("p")
    different = written(found.groupBy("key", "s").agg(place, n, *numbers, *flags).withColumn("many", met), "places")
    heavy = written(_heavy(different.select("key", "s", "n"), total), "heavy")
    names = {"key": "long", "s": "long", "many": "boolean"} | ({"least": "long", "most": "long"} if across else {})
    places = different.groupBy("p.d", "p.h").agg(F.collect_set(F.struct("p.first", "p.last", "p.anchor", *names)).alias("places"))
    once = texts.groupBy("d", "h").agg(F.first("text").alias("text")) if level == 0 else texts.select("d", "h", "text")  # equal rows, however many, are cut once
    cut = once.join(places.hint("merge"), ["d", "h"]).select("text", "places")
    pieces = written(cut.mapInArrow(_cut(length, list(names), read), ", ".join(f"{k} {v}" for k, v in names.items()) + ", anchor int, piece binary"), "different")
    cold, hot, done = pieces, None, [found, heavy, pieces]
    if level + 1 < len(levels(length)):
        sizes = written(different.groupBy("key").agg(n).where(F.col("n") > HOT), "hot")
        done.append(sizes)
        if not sizes.isEmpty():
            parts = _heavy(sizes, total)
            cold = skewed(pieces, sizes.select("key"), ["key"], parts, ["s"], "left_anti")
            hot = skewed(pieces, sizes.select("key"), ["key"], parts, ["s"], "left_semi")
    release(different)
    sorted_ = by_block(cold.withColumnRenamed("key", "block"))
    spans = sorted_.mapInArrow(_sorted(length, across, U64 if words else np.uint8), "key long, s long, lo int, hi int")
    if hot is not None:
        again = hot.select(F.col("key").alias("d"), F.col("s").alias("h"), F.col("piece").alias("text"), *(c for c in names if c not in ("key", "s")))
        spans = spans.unionByName(_repeats(again, level + 1, length, across, words=words).select(F.col("d").alias("key"), F.col("h").alias("s"), "lo", "hi"))
    spans = spans.groupBy("key", "s").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    back = skewed(found.select("d", "h", "first", "key", "s"), spans, ["key", "s"], heavy, ["d", "h", "first"], "inner")
    out = written(
        back.select("d", "h", "first", F.explode("spans").alias("x")).select("d", "h", (F.col("first") + F.col("x.lo")).alias("lo"), (F.col("first") + F.col("x.hi")).alias("hi")),
        "spans",
    )
    for table in done:
        release(table)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with d, h: rows with one id and one text share them, and lose the same bytes."""
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))), "h": F.xxhash64("text", F.col("doc_id").isNull())})


def repeated_spans(docs: DataFrame, length: int = LENGTH, across: bool = False, words: bool = False) -> DataFrame:
    """d, h, spans: for each text (see _keyed) with repeats, spans (lo, hi) in bytes that together cover them. words:
    length and spans count words ([^\\x20\\x09-\\x0D]+), whatever stands between them; those are done in one share."""
    texts, of = _keyed(docs).select("d", "h", "text"), 1 if words else shares(length)
    found = [_repeats(texts, 0, length, across, share, of, words) for share in range(of)]
    spans = written(reduce(DataFrame.unionAll, found).groupBy("d", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "repeats")
    for table in found:
        release(table)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: overlapping and touching spans become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in runs:
        parts.append(data[at:lo])
        at = hi
    return b"".join([*parts, data[at:]])


def _runs(spans) -> list[tuple[int, int]]:
    return merged([(s["lo"], s["hi"]) for s in spans]) if spans else []


def dedup_report(docs: DataFrame, length: int = LENGTH, passage_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text).

    With passage_words, n_passages too: how many maximal runs of a text's words consist of sequences of so many words
    that another document holds as well. They are only counted; what is removed does not depend on them."""
    docs = docs.select("doc_id", "text")
    spans = repeated_spans(docs, length)
    extra = ["shared"] if passage_words is not None else []
    if extra:
        spans = spans.join(repeated_spans(docs, passage_words, across=True, words=True).withColumnRenamed("spans", "shared"), ["d", "h"], "full_outer")
    both = _keyed(docs).join(spans.hint("merge"), ["d", "h"], "left").select("doc_id", "text", "spans", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, shas, passages = [], [], [], [], []
            for text, *spans in zip(*(c.cast(pa.binary()).to_pylist() if i == 0 else c.to_pylist() for i, c in enumerate(batch.columns[1:])), strict=True):
                data, runs = text or b"", _runs(spans[0])
                sizes.append(len(data))
                removed.append(sum(hi - lo for lo, hi in runs))
                counts.append(len(runs))
                shas.append(hashlib.sha256(without(data, runs)).hexdigest())
                passages.append(len(_runs(spans[-1])))
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(shas, pa.string()), *([pa.array(passages, pa.int64())] if extra else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passages"] if extra else [])])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passages long" * len(extra))


def dedup_texts(docs: DataFrame, length: int = LENGTH, across: bool = False, min_words: int = 0) -> DataFrame:
    """docs with the repeats removed from text; other columns stay. A removed run that begins or ends inside a
    character leaves the whole character, so texts stay valid UTF-8; texts without repeats are untouched.

    across: only strings that also start in another document are repeats. min_words: maximal runs with fewer words
    ([^\\x20\\x09-\\x0D]+) stay."""
    names = docs.columns
    keyed = _keyed(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))).select("d", "h", "row")
    both = keyed.join(repeated_spans(docs.select("doc_id", "text"), length, across).hint("merge"), ["d", "h"], "left").select("row", "spans")
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[text_at].cast(pa.binary()).to_pylist()
            for i, spans in enumerate(batch.column(1).to_pylist()):
                if spans:
                    data, runs = texts[i], []
                    for lo, hi in _runs(spans):
                        while lo < hi and data[lo] & 0xC0 == 0x80:
                            lo += 1
                        while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
                            hi -= 1
                        if len(data[lo:hi].split()) >= min_words:
                            runs.append((lo, hi))
                    texts[i] = without(data, runs)
            columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(run, docs.schema)
