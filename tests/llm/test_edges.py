"""Defined cases of the corpus operators: nulls, ties, repeated rows, very long texts, extra columns with clashing names; and the
registered queries themselves."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import library, shingles, vocabulary, without_repeats

from weftline.llm import ann, bpe, chat, embed_dedup, langid, packing, queries, setsketch, sharding, suffix, urls

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, or give to their results.
INSIDE = ["d", "h", "key", "cid", "block", "spans", "row", "group", "size", "shard", "slot", "length", "start", "component_id", "kept", "n_shingles", "lang_pred", "letters", "_rank", "_bucket", "a.b"]


def long_text(words, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdeilnorst", k=rng.randint(1, 9))) for _ in range(3000)]
    return " ".join(rng.choices(pool, k=words))


@pytest.fixture(scope="module")
def rows():
    very_long = long_text(60_000, 1)
    return [
        (1, "same text of a few words here", "en"), (1, "same text of a few words here", "en"), (2, "same text of a few words here", None), (None, "same text of a few words here", "en"),
        (None, None, None), (None, None, "fr"), (3, "", "fr"), (4, very_long, "fr"), (5, very_long + " end", "fr"), (6, "x" * 50_000, "en"), (7, "ein Satz", "fr"), (8, "12 . 34", "en"),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], KINDS)
    return df.select("*", *(F.lit(7).alias(c) for c in INSIDE)).repartition(3)


def by_row(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_encoding(docs, rows):
    tok = library(vocabulary())
    want = []
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    assert by_row(bpe.digests(docs, vocabulary()), "doc_id", "n_tokens", "ids_sha256") == sorted(want, key=repr)


def test_a_vocabulary_that_does_not_cover(tmp_path):
    spec = {
        "model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]], "end_of_word_suffix": ""}, "added_tokens": [],
    }
    encoder = bpe.WordEncoder(spec)
    assert encoder.ids("abab") == [2, 2]
    with pytest.raises(ValueError, match="no tokens"):
        encoder.ids("abc")


def test_packing(docs, rows):
    tok = library(vocabulary())
    got = packing.pack(docs, vocabulary(), length=256).collect()
    pieces, room = defaultdict(int), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]] += 1
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(int)
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            want[i, len(ids), at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert pieces == want
    for parts in room.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 256


def test_suffix(docs, rows):
    want = sorted(((i, *w) for (i, _, _), w in zip(rows, without_repeats([t for _, t, _ in rows]), strict=True)), key=repr)
    assert by_row(suffix.dedup_report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_near_duplicates(docs, rows):
    first = {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    want = [(i, len(shingles(t)), first.get(i), first.get(i) == i if i else True) for i, t, _ in rows]
    assert by_row(setsketch.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_language(docs, rows):
    got = by_row(langid.identify(docs), "doc_id", "held_out", "lang_pred", "score")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert [(g[0], g[1]) for g in got] == [(i, held(i)) for i, *_ in sorted(((r[0], held(r[0])) for r in got), key=repr)] and len(got) == len(rows)
    said = {g[0]: g[2:] for g in got}
    assert said[3] == said[8] == ("und", 0.0) and all(g[2] in ("en", "fr", "und") and 0 <= g[3] <= 1 for g in got)


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    odd = spark.createDataFrame([(i, f"{'abc'[i % 3] * 5} w", ["a", "b", "c"][i % 3]) for i in range(30)] + [(99, "aaaa", "a")], "doc_id long, text string, lang string")
    assert langid.train(odd).langs == ["a", "b"]


def test_sharding(docs, rows):
    got = sharding.shard(docs, 3).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"]) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows if i)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_chat_ties_and_repeats(spark):
    rows = [(1, 1, "message", 0, "user", "a"), (1, 1, "message", 0, "user", "a"), (1, 1, "message", 0, "user", "b"), (None, 1, "message", 0, None, None), (2, 1, "message", 0, "assistant", long_text(40_000, 3)), (2, 2, "odd", 1, "user", "z")]
    log = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, seq long, event string, turn long, role string, text string, turns int, loss_texts int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.reconstruct(log.repartition(3)))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "b")] and [tuple(t) for t in got[None]["turns"]] == [("", "")]
    assert got[2]["loss_texts"] == [rows[4][5]] and got[2]["turns"][1]["text"] == "z"


def test_url_columns_stay(spark):
    pages = spark.createDataFrame([(1, "x://a.com/b", 1, 2, 3, 4)], "page_id long, url string, _best int, page int, best int, `a.b` int")
    got = urls.judge_urls(pages, urls.rules_frame(spark, [("block", "com", "/")])).first().asDict()
    assert got == {"page_id": 1, "url": "x://a.com/b", "_best": 1, "page": 2, "best": 3, "a.b": 4, "host": "a.com", "path": "/b", "rule": "com/", "verdict": "block"}
    plan = urls.judge_urls(pages, urls.rules_frame(spark, queries.URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_nearest_ties_lengths_and_repeats(spark):
    rows = [(i, [float(i // 2), 1.0]) for i in range(20)] + [(100 + i, [1.0, float(i), 2.0]) for i in range(4)] + [(3, [1.0, 1.0]), (200, [5.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, leaf int").repartition(3)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 2 == 0, k=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i, _ in rows if i % 2 == 0 and i != 200}
    for q, found in got.items():
        own = dict(rows)[q]
        near = {}
        for i, v in rows:
            if i != q and len(v) == len(own):
                near[i] = min(near.get(i, 1e9), float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum())))
        assert found == [(i, s) for s, i in sorted((s, i) for i, s in near.items())[:3]]


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    first = df.where("vec_id = 1").orderBy(F.xxhash64("label", "embedding")).first()["embedding"]
    near = 2 if first[0] else 3
    got = by_row(embed_dedup.near_duplicate_vectors(df), "vec_id", "n_links", "component_id")
    assert got == sorted([(1, 1, 1), (1, 0, 1), (near, 1, 1), (5 - near, 0, 5 - near), (None, 0, None)], key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries(spark, sf_dir, name):
    """Each gives a row for all it has to judge, as its operator does."""
    got = queries.QUERIES[name](spark, sf_dir)
    count = got.count()
    table = {"op1_chat": "conversations", "op2_embedding_dedup": "embeddings", "op7_urls": "pages", "op8_nearest": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "op1_chat":
        assert count == rows.select("conv_id").distinct().count() + 1
    elif name == "op8_nearest":
        assert count == 10 * rows.where("vec_id % 100 = 0").count()
    elif name == "op6_packing":
        assert got.select("doc_id").distinct().count() == rows.count() <= count
    elif name == "op13_spelling":
        assert count == got.select("word").distinct().count() > 0
    else:
        assert count == rows.count()
    if name in ("op1_chat", "op7_urls"):
        plan = got._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
