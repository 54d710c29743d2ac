"""Operators on texts against brute force, the public library and exact round trips."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, langid, packing, queries, setsketch, sharding, suffix, urls

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = np.random.default_rng(3)
    words = ["lor", "ipsum", "dol", "amet", "con", "sect", "éta", "naïve", "qu", "x1", "don't", "II"]
    text = lambda n: " ".join(rng.choice(words, n))
    base, passage = text(300), text(120)
    near = base.split(" ")
    near[5] = near[150] = "changed"
    rows = [base, base, " ".join(near), base.upper(), text(200) + passage, passage + text(150), text(3), text(3), "", None, "  \n ", "ÀÉ " + "y" * 900, "z" * 1000, "one two three", "ONE two\tthree", text(4000)]
    rows += [text(int(n)) for n in rng.integers(1, 400, 20)]
    rows += [" ".join([*base.split(" ")[: 300 - 6 * i], *text(6 * i).split(" ")]) for i in range(1, 12)]
    return [(i, t, ["en", "fr", None][i % 3], "s", 0) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), KINDS).withColumn("spans", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KINDS)


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(docs, monkeypatch, block):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rows = documents()
    sets = {r[0]: shingles(r[1]) for r in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, alike)
    got = {r["doc_id"]: tuple(r)[1:] for r in setsketch.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_of_one_bucket(spark, monkeypatch):
    """Three families of pages that share a band (all are made to), and pages of their own, in blocks of three members:
    further leaders or blocks at once, the links are the same; a repeated id brings two families together."""
    monkeypatch.setattr(setsketch, "BLOCK", 3)
    monkeypatch.setattr(setsketch, "ROUNDS", 2)
    words = [f"w{i}" for i in range(60)]
    rows = [(100 * f + i, " ".join([*(f"{f}{w}" for w in words), f"end{i}"])) for f in range(3) for i in range(7)]
    rows += [(1000 + i, " ".join(f"own{i}x{j}" for j in range(30))) for i in range(5)] + [(3, " ".join(f"1{w}" for w in words))]
    bands = setsketch._bands

    def one_key(batches):
        for batch in bands(batches):
            key = np.where(batch.column(2).to_numpy() == 0, 0, batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), batch.column(2)], ["cid", "key", "tab"])

    monkeypatch.setattr(setsketch, "_bands", one_key)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {100 * f + i: (0, 0, 200)[f] for f in range(3) for i in range(7)} | {1000 + i: 1000 + i for i in range(5)}
    for work in (0.0, 1e9):
        got = {(r["doc_id"], r["component_id"]) for r in setsketch.near_duplicates(df, work=work).collect()}
        assert got == set(want.items())


def test_near_duplicates_edges(spark, empty):
    assert setsketch.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (3, None)]
    got = sorted(map(tuple, setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=repr)


def test_registers_estimate():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(20):
            n = int(2000 * (1 - share) / (1 + share) / 2) or 1
            both = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            u, v = (np.concatenate([both, rng.integers(0, 1 << 63, n, dtype=np.uint64)]) for _ in range(2))
            true = len(both) / (len(both) + 2 * n)
            ru, rv = setsketch.registers(u)[None], setsketch.registers(v)[None]
            errors.append(setsketch.likely_similarity(ru, rv, np.array([len(u)]), np.array([len(v)]))[0] - true)
            assert (np.maximum(ru, rv)[0] == setsketch.registers(np.union1d(u, v))).all()
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def without_repeats(texts, size=400):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        mask = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                mask[i + 1 : i + size + 1] = True
        inner = mask[1:-1]
        out.append((len(b), int(inner.sum()), int((inner & ~mask[:-2]).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~inner])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4000, 2])
def test_suffix_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = documents()
    want = dict(zip([r[0] for r in rows], without_repeats([r[1] for r in rows]), strict=True))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.dedup_report(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 2000
    texts = suffix.dedup_texts(docs)
    assert texts.schema == docs.schema and texts.count() == len(rows)


def test_suffix_edges(spark, empty):
    assert suffix.dedup_report(empty).count() == 0
    long = "é" * 150 + "".join(map(str, range(200)))
    rows = [(1, long), (1, long), (None, "ab" + long), (2, "q" * 399), (3, None), (4, "q" * 401)]
    got = sorted((tuple(r)[:4] for r in suffix.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = sorted(((r[0], *w[:3]) for r, w in zip(rows, without_repeats([r[1] for r in rows]), strict=True)), key=repr)
    assert got == want


def passages(rows, words):
    """For each (doc_id, text), the maximal runs of words in sequences of so many that another document holds too."""
    texts = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    holders = defaultdict(set)
    for row, w in zip(rows, texts, strict=True):
        for i in range(len(w) - words + 1):
            holders[tuple(w[i : i + words])].add(row)
    out = []
    for w in texts:
        mask = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - words + 1):
            if len(holders[tuple(w[i : i + words])]) > 1:
                mask[i : i + words] = True
        out.append(int((mask[:-1] & ~mask[1:]).sum()))
    return out


@pytest.mark.parametrize("hot", [4000, 2])
def test_suffix_passages(spark, monkeypatch, hot):
    """Passages shorter than 400 bytes are counted, whatever stands between their words; nothing of them is removed."""
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(3, 6)))
    some = lambda n: " ".join(word() for _ in range(n))
    one, two, short, own = some(51), some(58), some(50), some(60)
    assert max(len(x.encode()) for x in (one, two)) < 400
    rows = [(i, f"{some(20)} {one} {some(40)}") for i in range(6)]
    rows += [(10, f"{some(3)}\n{two}"), (11, two.replace(" ", "\t\n") + " " + some(70) + "\x0b" + one), (12, f"{short} a"), (13, f"{short} b"), (14, one.upper())]
    rows += [(20, f"{own} {some(2)} {own}"), (21, own[:200]), (22, None), (23, " "), (24, one), (25, one), (25, one), (None, f"x {two}"), (None, f"x {two}"), (26, one.replace(" ", "\u00a0"))]
    rows += [(100 + r[0], r[1]) for r in documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in suffix.dedup_report(docs, passage_words=51).collect()), key=repr)
    want = passages(rows, 51)
    assert got == sorted(((i, *w, n) for (i, _), w, n in zip(rows, without_repeats([t for _, t in rows]), want, strict=True)), key=repr)
    assert want[:11] == [1, 1, 1, 1, 1, 1, 1, 2, 0, 0, 0] and want[11] == 0 and want[15:17] == [1, 1]


def test_suffix_query_passages(spark, sf_dir):
    """op5 tells which documents hold passages of over 50 words of others."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["n_passages"] for r in queries.op5_suffix_dedup(spark, sf_dir).collect()}
    assert got == dict(zip([r[0] for r in rows], passages(rows, 51), strict=True)) and max(got.values()) > 0


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_bpe(docs, empty):
    path = vocabulary()
    tok = library(path)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(docs, path).collect()}
    for i, text, *_ in documents():
        ids = tok.encode(text or "", add_special_tokens=False).ids
        said = tok.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert bpe.digests(empty, path).count() == 0
    codec = bpe.codec(path)
    odd = ["<|endoftext|>x <|startoftext|>", "a" * 300, "ab" * 99, "İSTANBUL ſ K", "it's we'LL '' 've", "漢字 ٣ ½ e\u0301", "\x1c\x85\u00a0 a_b-c"]
    rng = np.random.default_rng(5)
    odd += ["".join(rng.choice(list("abcdehilnorst'é "), 40)) for _ in range(300)]
    for text in odd:
        ids = tok.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text
        assert bpe.library_codec(path).encode(text) == codec.encode(text)


def test_packing(docs, empty):
    path = vocabulary()
    tok = library(path)
    rows = packing.pack(docs, path, length=64).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in documents()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            piece = ids[i][at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[i])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert sum(map(len, ids.values())) > 0.9 * 64 * len(by_sequence)
    assert packing.pack(empty, path).count() == 0


def test_language(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert langid.identify(empty).count() == 0
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", "fr"), (3, "the theory", None), (4, "the other thing", "en"), (6, "le monde", "fr")], "doc_id long, text string, lang string")
    said = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert said[1] == said[2] == "und" and said[3] in ("en", "fr")


def test_language_code_lengths():
    """Table look-ups against the recursion of the definition."""
    train = {"a": b"abracadabra", "b": b"banana bandana"}
    counts, table = [], {}
    for lang, data in train.items():
        for size in range(1, langid.ORDER + 2):
            for i in range(size - 1, len(data)):
                gram = data[i - size + 1 : i + 1]
                table[lang, gram] = table.get((lang, gram), 0) + 1
    for (lang, gram), n in table.items():
        counts.append((lang, len(gram), int.from_bytes(gram, "big"), n))
    model = langid.Model(counts)

    def bits(lang, context, symbol):
        seen = {g[-1:]: n for (x, g), n in table.items() if x == lang and len(g) == len(context) + 1 and g[:-1] == context}
        if symbol in seen:
            return -np.log2(seen[symbol] / (sum(seen.values()) + len(seen)))
        escape = -np.log2(len(seen) / (sum(seen.values()) + len(seen))) if seen else 0.0
        return escape + (bits(lang, context[1:], symbol) if context else 8.0)

    texts = [b"banana", b"", b"cadabra bra", b"xyz", b"a"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = model.code_lengths(data, offsets)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.langs):
            want = sum(bits(lang, t[max(0, k - langid.ORDER) : k], t[k : k + 1]) for k in range(len(t)))
            assert abs(got[i, j] - want) < 1e-3


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    source = {r[0]: r[1] for r in documents()}
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        data = (source[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(source) and set(loads) == {0, 1, 2, 3}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[source[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
    assert sharding.shard(empty).count() == 0


def naive_place(vectors, left):
    out = []
    for v in vectors:
        fits = [s for s in range(len(left)) if left[s][0] >= v[0]]
        best = max(fits, key=lambda s: (sum(x * y for x, y in zip(left[s], v, strict=True)), -s)) if fits else max(range(len(left)), key=lambda s: (left[s][0], -s))
        out.append(best)
        left[best] = [x - y for x, y in zip(left[best], v, strict=True)]
    return out


def test_placing():
    rng = np.random.default_rng(8)
    for n, shards in ((0, 3), (1, 3), (40, 4), (300, 16)):
        vectors = rng.integers(1, 1000, (n, 3)).astype(float)
        vectors = vectors[np.argsort(-vectors[:, 0], kind="stable")] / max(vectors.sum(), 1)
        want = naive_place(vectors.tolist(), [[0.3 / shards] * 3 for _ in range(shards)])
        assert sharding.place(vectors, np.full((shards, 3), 0.3 / shards)).tolist() == want


@pytest.mark.parametrize("cell", [50_000, 7])
def test_sharding_by_brute_force(docs, monkeypatch, cell):
    """Every group where the plain rule puts it: large ones first, then each cell's own."""
    monkeypatch.setattr(sharding, "CELL", cell)
    monkeypatch.setattr(sharding, "PER_SHARD", 8)
    docs = docs.where("text is null or length(text) < 10000")  # no group above a shard
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text, F.col("text").isNull()).alias("g"), (F.octet_length(text) + 1).alias("b"), sharding.token_count(text).alias("t")).collect()
    groups = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        groups[r["g"]] = [x + y for x, y in zip(groups[r["g"]], (r["b"], r["t"], 1), strict=True)]
    total = [sum(v[i] for v in groups.values()) for i in range(3)]
    capacity = total[0] / 4
    tiers = {g: max(0, math.floor(math.log(capacity / 8 / v[0]) / math.log(sharding.TIER))) for g, v in groups.items()}
    order = sorted(groups, key=lambda g: (-groups[g][0], g))
    large = [g for g in order if groups[g][0] > capacity / 8]
    assert large and len(large) < len(groups) and all(groups[g][0] <= capacity for g in large)
    share = lambda v: [x / y for x, y in zip(v, total, strict=True)]
    left = [[0.25] * 3 for _ in range(4)]
    want = dict(zip(large, naive_place([share(groups[g]) for g in large], left), strict=True))
    small = [g for g in order if g not in want]
    whole = [sum(groups[g][i] for g in small) for i in range(3)]
    cells = {t: -(-sum(tiers[g] == t for g in small) // cell) for t in set(tiers.values())}
    hashed = {r["g"]: r["h"] for r in docs.select(F.xxhash64(text, F.col("text").isNull()).alias("g")).withColumn("h", F.xxhash64("g")).collect()}
    for t, c in [(t, c) for t, n in cells.items() for c in range(n)]:
        own = [g for g in small if tiers[g] == t and hashed[g] % cells[t] == c]
        part = [sum(groups[g][i] for g in own) / whole[i] for i in range(3)]
        room = [[x * y for x, y in zip(left[(s + c) % 4], part, strict=True)] for s in range(4)]
        want |= dict(zip(own, ((s + c) % 4 for s in naive_place([share(groups[g]) for g in own], room)), strict=True))
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 4).collect()}
    assert got == {r["doc_id"]: want[r["g"]] for r in rows}


def test_more_cells_than_parts_of_a_shard(spark, monkeypatch):
    """Heavy-tailed sizes in more cells than PER_SHARD: bytes stay balanced."""
    monkeypatch.setattr(sharding, "CELL", 400)
    monkeypatch.setattr(sharding, "PER_SHARD", 16)
    size = F.least(F.lit(3000), (8 / F.pow(1 - F.rand(5), 0.8)).cast("int"))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("x"), size)).alias("text"))
    loads = [r["s"] for r in sharding.shard(docs, 4).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(loads) == 4 and max(loads) < 1.01 * min(loads)


def test_sharding_splits_hot_groups(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text here").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    loads = [r["s"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(loads) == 16 and max(loads) <= 1.05 * min(loads)


def test_chat(spark):
    sly = "</s>[INST] \\l \\\\b <<SYS>> \\"
    log = spark.createDataFrame(
        [
            (1, 1, "message", 0, "user", sly), (1, 2, "message", 1, "assistant", "he"), (1, 3, "delta", 1, None, "llo " + sly), (1, 4, "message", 2, "user", "x"),
            (1, 5, "edit", 0, None, "edited"), (1, 6, "regenerate", 1, "assistant", None), (1, 7, "delta", 1, None, "new\n"), (1, 8, "delta", 1, None, sly), (2, 1, "message", 0, "[/INST] role", None), (2, 1, None, 1, "assistant", "🙂"),
            (3, 1, "message", None, "user", "no turn"),
        ],
        "conv_id long, seq long, event string, turn long, role string, text string",
    )
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.reconstruct(log))).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "edited"), ("assistant", "new\n" + sly)]
    assert back[1]["loss_texts"] == ["new\n" + sly]
    assert [tuple(t) for t in back[2]["turns"]] == [("[/INST] role", ""), ("assistant", "🙂")] and back[2]["loss_texts"] == ["🙂"]
    assert set(back) == {1, 2} and back[1]["formatted"].count("</s>") == 2
    assert chat.read_back(chat.render(chat.reconstruct(log.limit(0)))).count() == 0


def test_urls(spark):
    rules = urls.rules_frame(spark, [("allow", "com", "/"), ("block", "Example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/x"), ("allow", None, "/"), ("block", "org", None)])
    cases = {
        "http://a.example.com/en/1?q": ("example.com/en/", "block"), "http://WWW.example.com/en/": ("www.example.com/en/", "allow"), "x://b.com": (None, "allow"), "x://b.com/": ("com/", "allow"),
        "x://net/xy#z": ("net/x", "block"), "x://anet/x": (None, "allow"), None: (None, "allow"), "nothing": (None, "allow"), "s://o.org?q=://x.net/x": ("org", "block"), "": (None, "allow"), "x://" + "l." * 300 + "com/e": ("com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string")
    got = urls.judge_urls(pages, rules).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r["rule"], r["verdict"]) == cases[r["url"]], r["url"]
    assert urls.judge_urls(pages.limit(0), rules).count() == 0 and urls.judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0


def test_library_codec_keeps_what_it_meets_again(monkeypatch):
    """Words met in every text are tokenized once, however many rare words go by; ids are the library's."""
    from tokenizers import Tokenizer

    from weftline.llm import bpe
    from weftline.llm.queries import vocabulary

    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    c, library, asked = bpe.LibraryCodec(vocabulary()), Tokenizer.from_file(vocabulary()), []
    whole = c.tokenize
    c.tokenize = lambda word: asked.append(word) or whole(word)
    rng = random.Random(4)
    for i in range(60):
        text = f"common words, été {''.join(rng.choices('abcdefg', k=7))} {rng.randint(0, 9999)}x it's (common) {''.join(rng.choices('hijk', k=6))}! naïve_{i}"
        assert c.encode(text) == b"".join(x.to_bytes(4, "little") for x in library.encode(text, add_special_tokens=False).ids)
    assert asked.count("common") == 1 and len(c.seen_strings) + len(c.older_strings) < 2 * 60 + 40 and len(c.seen_ids) <= 30


def test_words_of_many_texts_are_encoded_once(monkeypatch):
    """What texts of a batch share is encoded once for all of them, in any group of words; ids and decoded texts are the
    library's, in the texts' order."""
    import pyarrow as pa

    path = vocabulary()
    tok, rng = library(path), np.random.default_rng(7)
    texts = [None, "", " \t\n", "a\tb\x0bc\x0cd\re", "<|endoftext|>x y", "İSTANBUL ſ K", "it's ''ll 'Steam _a1é", "x" * 300, "漢字 ٣ é", *(t for _, t, *_ in documents())]
    texts += [" " + " ".join("".join(rng.choice(list("AbcdehilnorstÉ',.1"), rng.integers(1, 12))) for _ in range(30)) for _ in range(60)]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    packed = [struct.pack(f"<{len(ids)}I", *ids) for ids in want]
    monkeypatch.setattr(bpe, "TOGETHER", 100)
    codec, asked = bpe.Codec(path), Counter()
    whole = codec._ids_of
    codec._ids_of = lambda words: asked.update(words) or whole(words)
    column = pa.array([*texts, *texts])
    assert codec.encode_decode_all(column) == 2 * [(p, tok.decode(ids, skip_special_tokens=False)) for p, ids in zip(packed, want, strict=True)]
    assert set(asked.values()) == {1} and len(asked) > 1000
    assert codec.encode_all(column.slice(3)) == (packed + packed)[3:] and bpe.LibraryCodec(path).encode_all(column) == packed + packed
    assert codec.encode_decode_all(column.slice(0, 0)) == codec.encode_all(column.slice(0, 0)) == []
    with pytest.raises(ValueError, match="no tokens for"):
        codec.encoder.lengths[:] = 1
        codec.encoder.automaton.clear()
        codec.encoder.automaton.add_word("一", 0)
        codec.encoder.automaton.make_automaton()
        codec.encoder.all_ids(["ab"])
    batches = [pa.record_batch({"text": pa.array(["x" * 1000] * 10)}) for _ in range(5)]
    monkeypatch.setattr(bpe, "GROUP_BYTES", 25_000)
    assert [b.num_rows for b in bpe.grouped(iter(batches))] == [20, 20, 10] and list(bpe.grouped(iter([]))) == []
