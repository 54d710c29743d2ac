"""Spelling variants against the words that deletions and replacements give."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import queries, spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def count(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(counts):
    near, holes, form = defaultdict(set), defaultdict(set), {}
    for w in counts:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def corpus(seed):
    """Words of few letters, so that most have near ones; counts of several sizes; some very long."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("ab", k=rng.randint(6, 9))) for _ in range(500)] + ["a" * 8, "a" * 9, "a" * 10, "z" * 30_000, "z" * 29_999 + "y", "z" * 29_999]
    rows = [(i, " ".join(w for _ in range(60) for w in [rng.choice(words[: 1 + rng.randint(0, len(words) - 1)])])) for i in range(60)]
    hot = [(100 + i, f"Abcdefgh {'abcdefgx' if i % 12 == 0 else ''} {'abcdefgxy' if i == 0 or i == 24 else ''}.ABCDEFGH") for i in range(150)]
    return [*rows, *rows[:2], *hot, (None, "abcdefghij " * 40), (None, None), (5, None), (6, ""), (7, "Ünïcödé ÜNÏCÖDÉ ünïcödé" * 3)]


@pytest.mark.parametrize(("parts", "block"), [(3, 256), (2, 3), (5, 1)])
def test_variants(spark, monkeypatch, parts, block):
    rows = corpus(parts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "key", "size", "root", "form", "a.b")}).repartition(3)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (parts, block))
    got, want = result(spelling.variants(docs)), brute(count(rows))
    assert got == want
    assert max(x[4] for x in got) > 3 and any(x[1] for x in got)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_pairs_once(spark):
    """Each pair in both directions once, though words that repeat letters agree around several segments."""
    words = ["a" * n for n in range(7, 15)] + ["aaaaaaab", "baaaaaaa", "abababab", "babababa", "ababababa"]
    got = Counter((r["word"], r["near"]) for r in spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect())
    assert set(got.values()) == {1} and all((b, a) in got for a, b in got)
    assert {w: sum(a == w for a, _ in got) for w in words} == {r[0]: r[4] for r in brute(dict.fromkeys(words, 2))}


def test_forms_lead_on(spark):
    counts = {"lettersx": 2, "letters": 20, "letterz": 200, "lettera": 2000, "letterb": 20000, "letterbc": 200000, "letterbcd": 2000000}
    got = spelling.roots(spark.createDataFrame(list(zip(counts, list(counts)[1:], strict=False)), "word string, form string"))
    assert {r["root"] for r in got.collect()} == {"letterbcd"} and got.count() == 6


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op13_spelling(spark, sf_dir)) == brute(count(rows))
