"""Set operations on tables of paths, names and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_both(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Different values that both have."""
    return left.select(column).intersect(right.select(column))


def only_left(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Different values that right lacks."""
    return left.select(column).subtract(right.select(column))


def in_either(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Different values of both."""
    return left.select(column).unionByName(right.select(column)).distinct()


def together(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """All rows of both, repeated ones too."""
    return left.select(*columns).unionByName(right.select(*columns))


def joined_lists(df: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Each key's sorted values of one column, then of the next, as one text; a key's values are gathered."""
    return df.groupBy(key).agg(F.array_join(F.concat(*(F.array_sort(F.collect_list(c)) for c in columns)), ",").alias(name))
