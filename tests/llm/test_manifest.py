"""The Merkle manifest against a tree built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle, queries

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def build(nodes, arity):
    """The root of nodes, and of each node the siblings (left, right), level by level."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, inside = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for p in range(len(run)):
                for i in members[at + p]:
                    paths[i].append(("".join(run[:p]), "".join(run[p + 1 :])))
            above.append(digest(*run))
            inside.append(sum(members[at : at + arity], []))
        nodes, members = above, inside
    return nodes[0], paths


def brute(rows, arity=16):
    of = defaultdict(list)
    for r in rows:
        of[r[3]].append(r)
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [build([leaf(r) for r in of[s]], arity) for s in names]
    root, tops = build([t[0] for t in trees], arity)
    out = []
    for s, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for r, path in zip(of[s], paths, strict=True):
            path, now = path + top, r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                now = (r[0], r[1].encode().lower().decode(), *r[2:])
            node = leaf(now)
            for left, right in path:
                node = digest(left, node, right)
            out.append((r[0], leaf(r), subroot, root, digest(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def corpus(n, sources, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Aé " * rng.randint(1, 5), "lower only", "X" * 40_000])
    rows = [(i, text(), rng.choice(["en", None]), sources[0] if rng.random() < 0.4 else rng.choice(sources), rng.choice([None, 3])) for i in range(n)]
    return [*rows, *rows[:3], *rows[:3], (None, "No Id", "en", sources[-1], 1), (None, None, None, None, None), (7, "Alone", "en", "one", 1)]


@pytest.mark.parametrize(("n", "sources", "arity", "every"), [(700, ["b", None, "é", "a"], 16, 2), (60, ["b", "a", "", None], 2, 3), (40, ["s"], 3, 1), (300, [f"s{i}" for i in range(50)], 4, 2)])
def test_manifest(spark, monkeypatch, n, sources, arity, every):
    rows = corpus(n, sources, n)
    docs = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit(1) for c in ("tree", "place", "node", "item", "path", "root", "a.b")}).repartition(3)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (arity, every))
    assert sorted((tuple(r) for r in merkle.audit(docs).select(*COLUMNS).collect()), key=repr) == brute(rows, arity)


def test_small_tables(spark):
    docs = spark.createDataFrame([(5, "Text", None, None, 4)], KINDS)
    assert [tuple(r) for r in merkle.audit(docs).select(*COLUMNS).collect()] == brute([(5, "Text", None, None, 4)])
    assert merkle.audit(docs.limit(0)).count() == 0


def test_written_levels(spark):
    """Only every second level is stored, and a proof's siblings are there though their level is not."""
    rows = spark.range(600).select(F.lit("s").alias("source"), F.col("id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("node"), F.col("id").alias("item"))
    made = merkle.manifest(rows, ["id"])
    assert [level.count() for level in made.leaves.levels] == [600, 3]
    lengths = merkle.proofs(made).select(F.size("path").alias("n")).distinct().collect()
    assert [r["n"] for r in lengths] == [3]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = queries.op11_manifest(spark, sf_dir)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == brute(rows)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
