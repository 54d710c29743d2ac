"""The pipeline against its stages done by brute force in plain Python."""

import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import components, library, shingles, vocabulary

from weftline.llm import suffix
from weftline.sources import shared


def brute_removed(texts, size=corpus_pipeline.PASSAGE_BYTES, words=corpus_pipeline.PASSAGE_WORDS):
    """Texts without the runs of enough words in strings that another text holds; a run keeps characters it would cut."""
    data = [(t or "").encode() for t in texts]
    holders = defaultdict(set)
    for k, b in enumerate(data):
        for i in range(len(b) - size + 1):
            holders[b[i : i + size]].add(k)
    out = []
    for b in data:
        runs = []
        for i in range(len(b) - size + 1):
            if len(holders[b[i : i + size]]) > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + size
                else:
                    runs.append([i, i + size])
        kept, at = b"", 0
        for lo, hi in runs:
            while lo < hi and b[lo] & 0xC0 == 0x80:
                lo += 1
            while hi > lo and hi < len(b) and b[hi] & 0xC0 == 0x80:
                hi -= 1
            if len(b[lo:hi].split()) >= words:
                kept, at = kept + b[at:lo], hi
        out.append((kept + b[at:]).decode())
    return out


@pytest.mark.parametrize(("size", "words"), [(400, 0), (101, 51), (60, 4)])
def test_passages_of_other_documents(spark, sf_dir, size, words):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    own = " ".join(f"w{i * i}" for i in range(80))
    rows += [(-1, f"{own} é {own}"), (-2, "x " + rows[0][1][:900]), (-3, rows[0][1][:900] + " y"), (-4, None), (-5, "")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, spans int, d int, `a.b` int").repartition(3)
    got = suffix.dedup_texts(docs, size, across=True, min_words=words)
    assert got.schema == docs.schema
    want = [w if t is not None else None for (_, t), w in zip(rows, brute_removed([t for _, t in rows], size, words), strict=True)]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == dict(zip([i for i, _ in rows], want, strict=True))
    assert want[-5] == rows[-5][1] and sum(w != t for (_, t), w in zip(rows, want, strict=True)) > 2


def test_short_words(spark, sf_dir):
    """A passage of 51 words of a letter each goes, one of 50 stays."""
    letters = " ".join("abcdefghijklmnopqrstuvwxyz"[i * i % 23] for i in range(51))
    rows = [(1, f"one of its own {letters}"), (2, f"two {letters} and its end"), (3, f"three {letters[:99]}!"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_strings(spark, docs, sf_dir).collect()}
    assert got == {1: "one of its own", 2: "two and its end", 3: rows[2][1], 4: None}


def test_pipeline(spark, sf_dir):
    tok = library(vocabulary())
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = components(sets, near)
    docs = [r for r in docs if group[r["doc_id"]] == r["doc_id"]]
    texts = dict(zip([r["doc_id"] for r in docs], brute_removed([r["text"] for r in docs]), strict=True))
    got = defaultdict(list)
    filled = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r["doc_id"]].append(r)
        filled[r["sequence_id"]] += r["length"]
    assert set(got) == set(texts) and max(filled.values()) <= 2048
    for i, text in texts.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        for r in got[i]:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert sum(r["length"] for r in got[i]) == len(ids)


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_with_clashing_columns(spark, sf_dir):
    """Columns named like those inside the stages stay as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars")
    inside = ["lang_pred", "_row", "row", "doc", "_spans", "spans", "component_id", "d", "h", "o", "score", "letters", "a.b"]
    odd = docs.select("*", *(F.col("doc_id").alias(c) for c in inside))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = stage(spark, docs, sf_dir).collect(), stage(spark, odd, sf_dir)
        assert more.columns == odd.columns
        rows = more.collect()
        assert all(r[c] == r["doc_id"] for r in rows for c in inside)
        assert sorted(tuple(r)[:4] for r in rows) == sorted(map(tuple, plain))
    assert corpus_pipeline.packed(spark, odd, sf_dir).count() == corpus_pipeline.packed(spark, docs, sf_dir).count()


def test_repeated_rows_keep_one_text(spark, sf_dir):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    same, null, mixed, one, two = (words(90) for _ in range(5))
    near = same + " end"
    rows = [(7, same), (7, same), (7, near), (None, null), (None, null), (None, mixed), (9, mixed), (8, mixed), (5, one), (5, two), (3, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], spark.read.parquet(f"{sf_dir}/documents.parquet").schema).repartition(3)
    left = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.repeated_strings(spark, left, sf_dir).collect())
    kept = got.pop((7, near), 0) + got.pop((7, same), 0)
    assert kept == 1
    assert got == Counter([(None, null), (8, mixed), (5, one), (5, two), (3, None), (None, None)])


def test_tables_leave_no_shuffle_files(spark):
    """The shuffle files of a written table's query are gone when it is written."""
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    blocks = lambda: {n for d in folder for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}
    before = blocks()
    table = shared.written(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "few")
    assert blocks() <= before and table.count() == 7
    assert spark.conf.get(shared.CLEANUP) == "false"


@pytest.mark.parametrize(("size", "of"), [(400, 1), (101, 4)])
def test_segments_come_in_shares(spark, sf_dir, monkeypatch, size, of):
    """Segments of short strings are written a share of the anchors at a time; together they are all."""
    counts = []

    def noted(df, what):
        out = shared.written(df, what)
        counts.extend([out.count()] if what == "segments" else [])
        return out

    monkeypatch.setattr(suffix, "written", noted)
    monkeypatch.setattr(suffix, "HOT", 1 << 30)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0")
    suffix.repeated_spans(docs, size, across=True)
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    every = suffix.segments(np.frombuffer(b"".join(texts), np.uint8), offsets, suffix.levels(size)[0], size)
    assert len(counts) == of and 0.98 * len(every[0]) < sum(counts) < 1.02 * len(every[0]) and max(counts) < 1.2 * sum(counts) / of
