"""URL filters: host-suffix and path-prefix expressions, equi-joined with rules on short hash prefixes.

Only DataFrame functions. Each distinct (host, path) is expanded into expressions host suffix + path prefix: suffixes
of as many labels and prefixes of as many characters as occur among the rules, so that "the path starts with the
rule's path" holds exactly for any rule and a URL of thousands of labels makes no more expressions than rules can fit.
Expressions meet rules on the first 8 hex digits of their SHA-256; the full digests confirm; of the rules that fit,
the longest (host and path together; of equal ones, the longer host) decides.

Defined cases: a null URL or one without "://" has an empty host and path and fits no rule; an empty table gives an
empty table; repeated rows are each judged; repeated rules count once, and of rules with the same host and path a
block wins; rules with a null or empty host are void, a null rule path is an empty one (it fits every path); extra
columns stay, and columns of the result's own names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest in the equi-join's key (32 bits, as public URL blocklists use).
PREFIX_DIGITS = 8

LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), LOWER_FROM, LOWER_TO), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path)."""
    rows = [F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(rule, ("verdict", "host", "path"), strict=True))) for rule in rules]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path).cast("binary"), 256)


def expressions(urls: DataFrame, label_counts: list[int], path_lengths: list[int]) -> DataFrame:
    """(host, path) -> a row (host, path, digest, short) for each host suffix and path prefix of the given sizes."""
    labels, counts, lengths = F.split("host", r"\.", -1), F.array(*map(F.lit, label_counts)), F.array(*map(F.lit, path_lengths))
    suffixes = F.transform(
        F.filter(counts, lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    return (
        urls.where("host <> ''")
        .select("host", "path", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes"))
        .select("host", "path", "_suffix", F.explode("_prefixes").alias("_prefix"))
        .select("host", "path", _digest(F.col("_suffix"), F.col("_prefix")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (rule host + rule path, or null) and verdict (the rule's, else `default`).

    Two lists of small integers come to the driver: the label counts and path lengths that occur among the rules (at
    most as many as the longest host has labels and the longest path characters, whatever the number of rules).
    """
    rules = (
        rules.where("host is not null and host <> ''")
        .select(F.translate("host", LOWER_FROM, LOWER_TO).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    sizes = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.", -1)))), F.sort_array(F.collect_set(F.length("rule_path")))
    ).first()
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    own = [F.col("page")[c].alias(c) for c in names]
    # the whole row is one value, so that no column's name can clash
    parts = pages.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("page"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not sizes[0]:
        return parts.select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    made = expressions(parts.select("host", "path").distinct(), sizes[0], sizes[1])
    fits = made.join(rules.withColumnRenamed("digest", "rule_digest"), "short").where("digest = rule_digest")
    best = fits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                F.length("rule_host").alias("host_size"),
                F.concat("rule_host", "rule_path").alias("rule"),
                F.col("verdict").alias("verdict"),
            )
        ).alias("best")
    )
    judged = parts.join(best, ["host", "path"], "left")
    return judged.select(*own, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
