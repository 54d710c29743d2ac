"""Secret scans with corpus-wide ownership frequency.

A task finds, in every whole text, the base spans (assignments to secret-sounding names, access key ids, hexadecimal
runs) and bare candidates: runs of credential characters outside base spans that hold a digit and a letter. Only
digests of their values leave the task. Then the corpus decides: for each digest, in how many different repositories
(here: documents) and with how many different owners (here: sources) does its value stand? A value that EXAMPLE_OWNERS
owners or more share is a copied example, as those in manuals are. A value that fewer share is owner-specific; it is
live-looking if its own form is random enough, or if somewhere in the corpus it is assigned to a secret-sounding name.
Bare candidates that are live-looking become spans of the kind `bare`; base spans stay whatever their class, and the
class of every span is given beside it.

A value that a third of all rows hold is one row a task and owner before it is shuffled, and verdicts are written
before they meet the candidates, so that a hot digest's candidates can be split over tasks.

Defined cases: a null text is empty; a null repository or owner counts as one of its own; equal rows are scanned each
by itself and are one repository; an empty table gives an empty table; texts of any length are searched whole, in runs
of about 512 KB; positions are code points; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bytes_np import text_chunks
from weftline.llm.common import written

#: Kinds of spans, in their order.
KINDS = ["assign", "access", "hex", "bare"]
#: Fixed patterns, over bytes; that of assignments over lower-cased ones (its value's class holds both cases).
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Least characters: of an assigned value, an access key id, a hexadecimal run, a bare candidate.
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, BARE_LEAST = 12, 18, 16, 20
#: Owners that make a value an example; bits a character from which a value looks random.
EXAMPLE_OWNERS, RANDOM_BITS = 3, 3.0


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(characters, np.uint8)] = True
    return out


LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
IS_HEX, IS_DIGIT, IS_LETTER = _table(b"0123456789abcdef"), _table(b"0123456789"), _table(LETTERS)
IS_VALUE = _table(LETTERS + b"0123456789+/_.=-")


def _runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least so many bytes of a class; runs end with their text."""
    inside = table[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def digest(value: bytes) -> bytes:
    return hashlib.sha256(value).digest()[:16]


def looks_random(value: bytes) -> bool:
    """Letters and digits whose frequencies have RANDOM_BITS bits a character or more."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= RANDOM_BITS and any(48 <= c < 58 for c in value) and any(c >= 65 for c in value)


def _by_text(places: np.ndarray, offsets: np.ndarray) -> dict[int, list[int]]:
    """The text of each place -> the places' numbers."""
    out: dict[int, list[int]] = {}
    for i, text in enumerate(np.searchsorted(offsets, places, "right") - 1):
        out.setdefault(int(text), []).append(i)
    return out


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[int, int, int, bytes, bool]]]:
    """For each text: (kind, start, end, digest of the value, looks random), base spans first, then candidates."""
    raw = data.tobytes()
    low = raw.lower()  # A-Z only
    hex_runs, bare_runs = _runs(data, offsets, IS_HEX, HEX_LEAST), _runs(data, offsets, IS_VALUE, BARE_LEAST)
    hex_of, bare_of = _by_text(hex_runs[0], offsets), _by_text(bare_runs[0], offsets)
    for text in range(len(offsets) - 1):
        a, b = int(offsets[text]), int(offsets[text + 1])
        found = [(0, m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(low, a, b) if m.end() - m.start(1) >= ASSIGN_LEAST]
        found += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(raw, a, b) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(2, int(hex_runs[0][i]), int(hex_runs[1][i]), int(hex_runs[0][i])) for i in hex_of.get(text, ())]
        base = sorted((s, e) for _, s, e, _ in found)
        for i in bare_of.get(text, ()):
            s, e = int(bare_runs[0][i]), int(bare_runs[1][i])
            part = data[s:e]
            if IS_DIGIT[part].any() and IS_LETTER[part].any() and not any(x < e and s < y for x, y in base):
                found.append((3, s, e, s))
        if not found:
            yield []
            continue
        points = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
        yield [(k, int(points[s - a]), int(points[e - a]), digest(raw[v:e]), looks_random(raw[v:e])) for k, s, e, v in found]


SPAN = "struct<kind: int, start: long, stop: long, digest: binary, random: boolean>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary()), ("random", pa.bool_())]))
    names = ["kind", "start", "stop", "digest", "random"]
    for batch in batches:
        spans: list = []
        for _, _, data, offsets in text_chunks(batch.column("text")):
            spans += ([dict(zip(names, s, strict=True)) for s in text] for text in chunk_spans(data, offsets))
        rest = [batch.column(c) for c in ("row", "doc_id", "repository", "owner")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(spans, kind)], ["row", "doc_id", "repository", "owner", "spans"])


def candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """row, doc_id, repository, owner, spans of each row of docs; a written table without texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    as_text = lambda c: F.xxhash64(F.col(c).cast("string"), F.col(c).isNull())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", as_text(repository).alias("repository"), as_text(owner).alias("owner"), "text")
    return written(rows.mapInArrow(_spans, f"row long, doc_id {kind}, repository long, owner long, spans array<{SPAN}>"), "spans")


def ownership(found: DataFrame) -> DataFrame:
    """digest, n_repositories, n_owners, assigned, random of every candidate value; a written table.

    Repositories and owners are counted by themselves, each after one row a digest and repository or owner is left."""
    each = found.select("repository", "owner", F.inline("spans"))
    known = ["digest", F.col("random"), (F.col("kind") <= 1).alias("assigned")]
    flags = [F.max("random").alias("random"), F.max("assigned").alias("assigned")]
    counted = lambda c, n: each.select(c, *known).groupBy("digest", c).agg(*flags).groupBy("digest").agg(F.count(F.lit(1)).alias(n), F.max("random").alias("random"), F.max("assigned").alias("assigned"))
    owners = counted("owner", "n_owners").select("digest", "n_owners")
    return written(counted("repository", "n_repositories").join(owners, "digest"), "owners")


def classified(found: DataFrame, owned: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """row, kind, start, stop, class of every base span and of the bare candidates that are live-looking; class: example
    (many owners), live (few owners, random or assigned somewhere), plain (else)."""
    each = found.select("row", F.inline("spans")).drop("random")
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when(F.col("random") | F.col("assigned"), "live").otherwise("plain")
    judged = each.join(owned.select("digest", verdict.alias("class")).hint("merge"), "digest")
    return judged.where("kind < 3 or class = 'live'").select("row", "kind", "start", "stop", "class")


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, classes, n_live, n_example of each row of docs.

    spans: kind:start:end of all spans by start, then kind; classes: theirs, in the same order."""
    found = candidates(docs, repository, owner)
    lists = classified(found, ownership(found)).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "class"))).alias("all"))
    rows = found.select("row", "doc_id").join(lists.hint("merge"), "row", "left")
    empty = F.array().cast("array<struct<start: long, kind: int, stop: long, class: string>>")
    rows = rows.select("doc_id", F.coalesce("all", empty).alias("all")).withColumn("base", F.filter("all", lambda s: s["kind"] < 3))
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    number = lambda c, test: F.size(F.filter(c, test)).cast("long")
    return rows.select(
        "doc_id",
        number("base", lambda s: s["kind"] == 0).alias("n_assign"),
        number("base", lambda s: s["kind"] == 1).alias("n_access"),
        number("base", lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
        text("all").alias("spans"),
        F.array_join(F.transform("all", lambda s: s["class"]), ",").alias("classes"),
        number("all", lambda s: s["class"] == "live").alias("n_live"),
        number("all", lambda s: s["class"] == "example").alias("n_example"),
    )
