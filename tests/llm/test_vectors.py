"""Operators on vectors against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, embed_dedup

KINDS = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 8))
    rows = [base[i % 60] + (0 if i < 60 else rng.standard_normal(8) * [0, 0.02, 0.2][i % 3]) for i in range(300)]
    out = [(i, [float(np.float32(x)) for x in v], i % 2 if i % 50 else None) for i, v in enumerate(rows)]
    return [*out, (300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [1.0, None] + [0.0] * 6, 1), (304, [float("inf")] * 8, 1), (305, [], 1), (306, [1.0, 2.0], 1)]


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, KINDS).repartition(3).withColumn("n", F.lit(1))
    got = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_duplicate_vectors(df).collect()}
    links, root = dict.fromkeys(range(len(rows)), 0), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, u, la in rows:
        for b, v, lb in rows:
            if a < b and la is not None and la == lb and good(u) and good(v) and len(u) == len(v):
                x, y = np.array(u, float), np.array(v, float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    assert got == {r[0]: (links[r[0]], find(r[0]), find(r[0]) == r[0]) for r in rows}
    assert sum(links.values()) > 100
    assert embed_dedup.near_duplicate_vectors(df.limit(0)).count() == 0
    twice = embed_dedup.near_duplicate_vectors(df.where("vec_id < 3").unionAll(df.where("vec_id < 3")))
    assert twice.count() == 6 and twice.agg(F.sum("n_links")).first()[0] == 0


def test_nearest(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    there = {i: np.array(v, float) for i, v, _ in rows if good(v) and len(v) == 8}
    assert set(got) == {i for i in there if i % 10 == 0}
    for q, found in got.items():
        want = sorted((float(np.sqrt(((there[q] - v) ** 2).sum())), i) for i, v in there.items() if i != q)[:5]
        assert [(r, i) for r, i, _ in sorted(found)] == [(n + 1, i) for n, (_, i) in enumerate(want)]
        assert np.allclose([s for *_, s in sorted(found)], [d for d, _ in want], rtol=0, atol=1e-12)
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id in (1, 2)"), F.lit(True)).count() == 2


def test_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.nearest(df, F.col("vec_id") % 100 == 0, search=6000).collect()
    hits = 0
    for q in range(0, 4000, 100):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits >= 0.9 * 400


@pytest.mark.parametrize("n", [60_000, 200_000])
def test_recall_by_default(spark, tmp_path, n):
    x = np.random.default_rng(n).standard_normal((n, 64)).astype(np.float32)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64, dtype=np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": flat}), tmp_path / "x.parquet")
    asked = range(0, n, n // 40)
    found = ann.nearest(spark.read.parquet(str(tmp_path / "x.parquet")), F.col("vec_id") % (n // 40) == 0).collect()
    hits = 0
    for q in asked:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argpartition(d, 10)[:10].tolist()) & {r["vec_id"] for r in found if r["query_id"] == q})
    print(n, hits / 10 / len(asked))
    assert hits >= 0.9 * 10 * len(asked)


def test_extreme_doubles(spark):
    """Very large and very small components: pairs link, and queries have neighbours at finite distances."""
    rows = [(10 * i + j, [s * 1.0, s * (1.0 + 0.001 * j)], 0) for i, s in enumerate((1e200, 1e-200, 1.0)) for j in range(3)] + [(90, [1e308, -1e308], 1), (91, [-1e308, 1e308], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicate_vectors(df).collect()}
    assert links == {**{10 * i + j: (8, 0) for i in range(3) for j in range(3)}, 90: (0, 90), 91: (0, 91)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 10 == 0, k=2).collect()}
    assert [got[q, r][0] for q in (0, 10, 20) for r in (1, 2)] == [1, 2, 11, 12, 21, 22]
    for q, s in ((0, 1e200), (10, 1e-200), (20, 1.0)):
        assert got[q, 1][1] == pytest.approx(s * 0.001) and got[q, 2][1] == pytest.approx(s * 0.002)
    assert len(got) == 8 and got[90, 1][0] != 91
