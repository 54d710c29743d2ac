"""A corpus pipeline of four operators: language ID, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet in the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, packing, setsketch, suffix
from weftline.llm.common import read_table, written
from weftline.llm.queries import vocabulary
from weftline.session import ship


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc: each row as one value, so that no column's name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def fields(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of docs out of a column doc, some changed."""
    return [changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that could be told; those without a letter go. lang becomes the prediction.

    Each row is judged by its own text, repeated rows and rows without doc_id too; a null text goes. Where no row has
    a lang to learn from, rows with a letter stay as they are. Extra columns stay, whatever their names."""
    ship(spark)
    model = langid.train(docs.where("lang is not null").select("doc_id", "text", "lang"))
    said = langid.predict(whole_rows(docs), model, "doc", "doc.text")
    if not model.langs:
        return said.where(F.col("doc.text").rlike(r"\p{L}")).select(*fields(docs))
    return said.where("lang_pred <> 'und'").select(*fields(docs, lang=F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicate rows, that with the smallest doc_id; without doc_id comes last.

    Each row is a text of its own here, as in the next stage: repeated rows of one doc_id and copies without doc_id are
    near-duplicates like any others, while different texts of one doc_id all stay. Rows of equal doc_id in a group go
    by the hash of their columns; then they are equal and any will do. Null and empty texts stay; extra columns too."""
    ship(spark)
    rows = written(whole_rows(docs).select(F.monotonically_increasing_id().alias("row"), "doc"), "rows")
    groups = setsketch.near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").alias("doc_id"), F.xxhash64("doc").alias("h"), "row")
    first = rows.select("row", order.alias("o")).join(groups.hint("merge"), "row").groupBy("component_id").agg(F.min("o").alias("o")).select("o.row")
    return rows.join(first.hint("merge"), "row", "left_semi").select(*fields(docs))


#: A passage that repeats in another document goes if it has at least so many words (over 50). Strings of so many bytes
#: find it: so many words have at least a byte each and one between them, so none is missed.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 2 * PASSAGE_WORDS - 1


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of PASSAGE_WORDS words or more that other documents hold too; n_chars, if there, follows; every
    document stays.

    What a document repeats by itself stays, as do null texts; repeated rows (of one doc_id, or none, and one text) are
    one document; extra columns stay, whatever their names."""
    ship(spark)
    left = suffix.dedup_texts(docs, PASSAGE_BYTES, across=True, min_words=PASSAGE_WORDS)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; a row for each piece. A null or empty text is one piece of its end
    id; repeated rows are packed each by itself, ties in length by doc_id; extra columns are not read."""
    ship(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("packing", packed),
]

#: Prediction by context trees, sketches and packing patterns have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
