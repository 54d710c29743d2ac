"""Ranked full-text search, identifier tokens, trigrams and tiered search."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.reach import reach_tree
from weftline.sources.shared import written


def identifier_words(text: Column) -> Column:
    """camelCase and dots become underscores, lower case."""
    return F.lower(F.replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2"), F.lit("."), F.lit("_")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_-]+"), F.lit(0))


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, weights: dict[str, float] | None = None) -> DataFrame:
    """id, score of documents (id, text) that hold a term; a term that ends in * stands for all words it begins.

    weights names the columns that are searched instead of text, and how much a word in each counts.

    Texts are read and cut into tokens once; what is kept of each is its length and a count for each term. The
    collection's statistics (two numbers, and one for each term) come to the driver."""
    weights, names = weights or {"text": 1.0}, [f"tf{i}" for i in range(len(terms))]
    cut = {f"_{c}": tokens(F.coalesce(c, F.lit(""))) for c in weights}
    fits = lambda x, term: x.startswith(term[:-1]) if term.endswith("*") else x == term
    times = lambda term: reduce(lambda x, y: x + y, [F.lit(float(w)) * F.size(F.filter(f"_{c}", lambda x: fits(x, term))) for c, w in weights.items()])
    length = reduce(lambda x, y: x + y, [F.size(c) for c in cut])
    words = docs.select("id", *(x.alias(n) for n, x in cut.items()))
    counted = written(words.select("id", length.alias("dl"), *(times(t).alias(n) for t, n in zip(terms, names, strict=True))), "counts")
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(n) > 0).alias(n) for n in names)).first()
    if not total["n"]:
        return counted.select("id", F.lit(0.0).alias("score"))
    scores = []
    for n in names:
        idf = math.log(1 + (total["n"] - total[n] + 0.5) / (total[n] + 0.5))
        scores.append(F.lit(idf) * F.col(n) * (k1 + 1) / (F.col(n) + k1 * (1 - b + b * F.col("dl") / F.lit(max(total["avgdl"], 1e-9)))))
    found = counted.where(reduce(lambda x, y: x | y, [F.col(n) > 0 for n in names]))
    return found.select("id", reduce(lambda x, y: x + y, scores).alias("score"))


def trigrams(text: Column) -> Column:
    """All runs of three code points, in order. What a lambda captures is computed for every element: here nothing is, so
    that long texts take linear time."""
    points, n = F.split(text, ""), F.length(text)
    threes = F.arrays_zip(F.slice(points, F.lit(1), n - 2).alias("a"), F.slice(points, F.lit(2), n - 2).alias("b"), F.slice(points, F.lit(3), n - 2).alias("c"))
    return F.when(n >= 3, F.transform(threes, lambda x: F.concat(x["a"], x["b"], x["c"]))).otherwise(F.array().cast("array<string>"))


def trigram_index(df: DataFrame, key: str, column: str) -> DataFrame:
    """trigram, key: which rows hold which trigram; write it once, partitioned or sorted by trigram, for many queries."""
    return df.select(key, F.explode(F.array_distinct(trigrams(F.col(column)))).alias("trigram"))


def trigram_search(index: DataFrame, df: DataFrame, key: str, column: str, query: str) -> DataFrame:
    """Rows of df that hold the query: those that the index gives for all of its trigrams, then the text itself. Queries
    of fewer than three characters are looked for in all rows."""
    wanted = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    if not wanted:
        return df.where(F.col(column).contains(query))
    hits = index.where(F.col("trigram").isin(wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return df.join(hits.select(key), key, "left_semi").where(F.col(column).contains(query))


def tiered(tiers: list[DataFrame], limit: int) -> DataFrame:
    """node_type, node_id, tier: of frames (node_type, node_id) in order of preference, each node once, best tier first."""
    all_ = reduce(DataFrame.unionByName, [t.select("node_type", "node_id", F.lit(i + 1).alias("tier")) for i, t in enumerate(tiers)])
    return all_.groupBy("node_type", "node_id").agg(F.min("tier").alias("tier")).orderBy("tier", "node_type", "node_id").limit(limit)


def tiered_text(nodes: DataFrame, edges: DataFrame, query: str, cap: int, depth: int = 2) -> DataFrame:
    """node_type, node_id, tier, score, depth of at most `cap` nodes (node_type, node_id, name): 1, those whose name is the
    query; 2, those whose name holds words of it, by score; 3, those that are at most `depth` edges away from any of
    these, in either direction, by least distance. Each node is in its best tier. Nothing is expanded once the cap is
    full."""
    named = written(nodes.select(F.struct("node_type", "node_id").alias("id"), "name"), "named")
    words = sorted(set(re.findall("[a-z0-9_-]+", query.lower())))
    exact = named.where(F.col("name") == query).select("id", F.lit(1).alias("tier"), F.lit(None).cast("double").alias("score")).distinct()
    hits = exact
    if words:
        ranked = bm25(named.withColumnRenamed("name", "text"), words).join(exact.select("id"), "id", "left_anti")
        hits = exact.unionByName(ranked.orderBy(F.desc("score"), "id").limit(cap).select("id", F.lit(2).alias("tier"), "score"))
    found = written(hits.select("id.*", "tier", "score", F.lit(0).alias("depth")), "hits")
    if found.count() < cap:
        both = edges.select("source_type", "source_id", "target_type", "target_id")
        turned = both.select(F.col("target_type").alias("source_type"), F.col("target_id").alias("source_id"), F.col("source_type").alias("target_type"), F.col("source_id").alias("target_id"))
        tree = reach_tree(both.unionByName(turned), found.select(F.col("node_type").alias("type"), F.col("node_id").alias("id")), depth, enough=cap)
        known = tree.where("depth > 0").select(F.col("type").alias("node_type"), F.col("id").alias("node_id"), F.lit(3).alias("tier"), F.lit(None).cast("double").alias("score"), "depth")
        found = found.unionByName(known.join(nodes.select("node_type", "node_id").distinct(), ["node_type", "node_id"], "left_semi"))
    return found.orderBy("tier", F.desc("score"), "depth", "node_type", "node_id").limit(cap)


def search_nodes(nodes: DataFrame, query: str, kinds: list[str]) -> DataFrame:
    return nodes.where(F.col("node_type").isin(kinds) & F.col("name").ilike(f"%{query}%"))


def grounded(claims: DataFrame, symbols: DataFrame) -> DataFrame:
    """Claims (name) with whether a symbol of that name exists."""
    known = symbols.select("name", F.lit(True).alias("is_grounded")).distinct()
    return claims.join(known, "name", "left").withColumn("is_grounded", F.coalesce("is_grounded", F.lit(False)))
