"""Stored indexes against searches of the texts themselves."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import postings, search
from weftline.operators.postings import Index
from weftline.plans.queries import grams_of, words_of
from weftline.plans.tables import Tables


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "a", "of", "index", "indexed", "in", "indigo", "doc_1", "doc_12", "dog-9", "x", "Zebra", "é", "thé"] + ["".join(rng.choices("abcde", k=rng.randint(2, 6))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(words)) for i in range(n)]
    return [*rows, (n, None, None), (n + 1, "", "the")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    """An index of three segments with small blocks, and all documents."""
    span, first = postings.SPAN, postings.FIRST_BLOCKS
    postings.SPAN, postings.FIRST_BLOCKS = 7, 2
    index, parts = Index(spark, str(tmp_path_factory.mktemp("index"))), []
    for i in range(3):
        rows = [(100_000 * i + r[0], *r[1:]) for r in corpus(90, i)]
        parts += rows
        postings.add_texts(index, spark.createDataFrame(rows, "id long, text string, title string").repartition(2), {"text": 1.0, "title": 3.0}, buckets=8)
    postings.SPAN = span
    yield index, spark.createDataFrame(parts, "id long, text string, title string")
    postings.FIRST_BLOCKS = first


TERMS = [["the"], ["the", "index*"], ["in*", "doc_1*", "zebra"], ["d*"], ["indigo", "nothing"], ["ab*", "abc*", "abcde*"], ["nothing"], ["the", "the"]]


@pytest.mark.parametrize("terms", TERMS)
def test_ranked(words, terms):
    index, docs = words
    want = {r["id"]: r["score"] for r in search.bm25(docs, terms, weights={"text": 1.0, "title": 3.0}).collect()}
    got = {r["id"]: r["score"] for r in postings.ranked(index, terms).collect()}
    assert got == pytest.approx(want)
    for k in (1, 10, 1000):
        best = [(r["id"], round(r["score"], 9)) for r in postings.ranked(index, terms, k).collect()]
        assert best == sorted(((i, round(s, 9)) for i, s in got.items()), key=lambda x: (-x[1], x[0]))[:k]


def test_what_a_query_opens(words):
    index, _ = words
    rows = postings._rows(index.table("postings", index.segments()), "index", 8)
    read = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert "bucket" in str(read.metadata().apply("PartitionFilters")) and "EqualTo(term,index)" in str(read.metadata().apply("PushedFilters"))
    assert read.selectedPartitions().partitionCount() == 3  # one bucket of each segment


def test_unfinished_segments_are_not_seen(words, spark, tmp_path):
    index, _ = words
    before = postings.ranked(index, ["the"]).count()
    spark.range(3).select(F.lit("the").alias("term"), F.col("id").alias("block")).write.parquet(f"{index.path}/postings/segment=broken/bucket=1")
    assert postings.ranked(Index(spark, index.path), ["the"]).count() == before


def test_compact(words, spark, tmp_path):
    index, _ = words
    one = postings.compact(index, str(tmp_path / "one"))
    assert len(one.segments()) == 1 and len(index.segments()) == 3
    for terms in TERMS[:4]:
        assert {tuple(r) for r in postings.ranked(one, terms).collect()} == {tuple(r) for r in postings.ranked(index, terms).collect()}


def test_holding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SPAN", 5)
    monkeypatch.setattr(postings, "PART", 2)
    rng, index, texts = random.Random(3), Index(spark, str(tmp_path / "grams")), {}
    for i in range(2):
        rows = [(1000 * i + j, "".join(rng.choices("abcé ", k=rng.randint(0, 60)))) for j in range(120)] + [(1000 * i + 500, None), (1000 * i + 501, "ab")]
        texts |= dict(rows)
        postings.add_grams(index, spark.createDataFrame(rows, "id long, text string").repartition(3), buckets=4)
    for query in ("abc", "aba", "ab c", "é é", "abcabc", "zzz", "ab", "", "caéb", "aaaa", " ab"):
        want = {(i, t) for i, t in texts.items() if t is not None and query in t}
        assert {tuple(r) for r in postings.holding(index, query).collect()} == want, query
    one = postings.compact(index, str(tmp_path / "one"))
    assert {r["id"] for r in postings.holding(one, "abc").collect()} == {r["id"] for r in postings.holding(index, "abc").collect()}


def test_registered(spark, sf_dir):
    """Built once; later queries read no texts but those of the hits, and are quick."""
    tables = Tables(spark, sf_dir)
    assert words_of(tables) is words_of(Tables(spark, sf_dir)) and grams_of(tables) is grams_of(Tables(spark, sf_dir))
    hits = postings.holding(grams_of(tables), 'href="/aulich">')
    assert "documents.parquet" not in plan(hits) and "pages.parquet" not in plan(hits)
    assert "documents.parquet" not in plan(postings.ranked(words_of(tables), ["the", "les"], 10))
    began = time.time()
    postings.ranked(words_of(tables), ["the", "les"], 10).collect()
    assert time.time() - began < 5


def test_blocks_are_bounded_and_lists_made_in_one_task(spark, tmp_path, monkeypatch):
    """Spans are cut into blocks by bytes, and nothing but whole lists is shuffled once words are counted."""
    monkeypatch.setattr(postings, "SPAN", 50)
    monkeypatch.setattr(postings, "BLOCK_BYTES", 300)
    rows = [*[r[:2] for r in corpus(150, 5)], (900, "Kelvin KELVIN İstanbul ΣΣ the"), (901, "the " * 300), (902, None)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    words = postings.add_texts(Index(spark, str(tmp_path / "words")), docs, buckets=4)
    lists = words.table("postings", words.segments())
    assert lists.groupBy("term", "block").count().where("count > 1").isEmpty() and lists.select("block").distinct().count() > 12
    assert words.segments()[0]["n"] == len(rows) and words.segments()[0]["total"] == sum(len(search_words(t)) for _, t in rows)
    for terms in (["the"], ["kelvin", "i*"], ["the", "index*"]):
        want = {r["id"]: r["score"] for r in search.bm25(docs, terms).collect()}
        assert {r["id"]: r["score"] for r in postings.ranked(words, terms).collect()} == pytest.approx(want)
    grams = postings.add_grams(Index(spark, str(tmp_path / "grams")), docs, buckets=4)
    for query in ("index", "the the", "Kel", "x", "ndigo "):
        assert {r["id"] for r in postings.holding(grams, query).collect()} == {i for i, t in rows if t and query in t}
    placed = docs.withColumn("_span", F.lit(0).cast("long"))
    made = plan(postings._postings(placed.localCheckpoint(), ["text"], [1.0], postings._word_lists))
    assert made.count("Exchange") == 1 and "Aggregate" not in made


def search_words(text):
    return postings.WORD.findall((text or "").lower())
