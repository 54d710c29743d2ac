"""Scans of source trees into the files table. Nothing goes through the driver but counts."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as fn
from weftline.sources.tree import contents, listed, one_file


def file_id(path: Column) -> Column:
    """An id that depends on the path alone, so that scans agree and ids are never used again for another file."""
    return F.xxhash64(path)


def classified(files: DataFrame) -> DataFrame:
    """Adds name, extension, language and the kinds of a file to (path, ...)."""
    path = F.col("path")
    return files.withColumns(
        {
            "id": file_id(path),
            "filename": fn.filename(path),
            "extension": fn.suffix(fn.filename(path)),
            "language": fn.language(path),
            "is_test": fn.is_test(path),
            "is_config": fn.is_config(path),
            "is_entrypoint": fn.is_entrypoint(path),
        }
    ).withColumns({"is_source": F.col("language").isNotNull(), "file_type": F.when(F.col("language").isNotNull(), "source").otherwise("other"), "analysis_status": F.lit("pending")})


def wanted(path: Column, exclude: list[str] | None = None) -> Column:
    """Whether the files table holds the file: no part of its path is excluded, and its name or extension is known."""
    return fn.included(path) if exclude == [] else ~fn.excluded(path, exclude) & fn.included(path)


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """The tree's included files with contents, and error rows (see `tree`). Only included files are opened."""
    files = listed(spark, root, exclude)
    return contents(files.where(wanted(F.col("path"), exclude) | F.col("error").isNotNull()), root)


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """The tree's included files: path below root, size, time, SHA-256, text and classes; see skipped() for those that
    cannot be read."""
    return scanned(read_tree(spark, root, exclude))


def skipped(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """path, error of the tree's folders that cannot be listed and included files that cannot be read."""
    return read_tree(spark, root, exclude).where("error is not null").select("path", "error")


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """The files table's row of one file (path: its name), empty if there is none."""
    return scanned(one_file(spark, *posixpath.split(path)).where(fn.included(F.col("path"))))


def text_of(content: Column) -> Column:
    """UTF-8 bytes as text; what is not UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def scanned(raw: DataFrame) -> DataFrame:
    """Rows of a tree with contents as files table; rows with an error are left out."""
    files = raw.where("error is null").select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), "content")
    return classified(files.withColumns({"hash": F.sha2("content", 256), "text": text_of(F.col("content"))}).drop("content"))


def read_sources(files: DataFrame, texts: DataFrame) -> DataFrame:
    """files with the text that texts (path, text) has for their path; empty where there is none."""
    return files.drop("text").join(texts.select("path", "text"), "path", "left").withColumn("text", F.coalesce("text", F.lit("")))


def with_sources(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """files (path, ...) with their texts as they are in the tree now; empty for files that are gone or cannot be read.
    Only these files are opened, wherever they lie."""
    there = listed(spark, root, []).join(files.select("path").distinct(), "path", "left_semi")
    return read_sources(files, scanned(contents(there, root)))
