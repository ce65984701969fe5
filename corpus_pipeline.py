"""A corpus pipeline of four stages: language ID, near-duplicate join, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the columns of documents, but for the
last, which returns placements. ``run`` writes each stage's result as Parquet in the shared folder and reads it back.

* ``language_id`` drops documents in no language: NULL texts and texts without a letter. Others stay, whatever their score: a short or
  noisy text is still a document. What it learns from, it learns from these documents' own ``lang``, which may be wrong or
  missing; ``lang`` becomes the predicted language.
* ``near_duplicates`` keeps one document, the one of the smallest id, of each component of documents whose sets of 5-word shingles
  agree by 80 percent or more. Documents without words cannot be compared and stay.
* ``repeated_passages`` cuts out passages of ``PASSAGE`` bytes or more (40 to 50 words) that an earlier document has too, whole
  characters only, and drops documents of which nothing but white space is left. Shorter repeats, like a common sentence, stay.
* ``packing`` puts all documents into sequences of 16,384 byte tokens, apart by source and by equal texts.

Edge cases follow the operators: an empty table passes through; NULL ids count as largest; repeated rows are duplicates of each
other; further columns of the documents travel along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, lang, suffix_dedup
from tidemark.llm import packing as pack
from tidemark.llm.copies import untouched
from tidemark.session import written

PASSAGE = 200


def _wrapped(docs: DataFrame) -> DataFrame:
    """Id, text and language, and all columns but the text in one, so that columns of any names pass through the operators."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__all")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", rest)


def _unwrapped(wrapped: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    columns = {c: F.col(f"__all.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")} | changed
    return wrapped.select([columns[c].alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _wrapped(docs)
    model = lang.trained(rows, F.lit(True))
    known = lang.predicted(rows, model).where(F.col("lang_pred") != lang.UND)
    return _unwrapped(known, docs, lang=F.col("lang_pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _wrapped(docs).withColumn("__key", F.xxhash64("doc_id", "text"))
    found = written(jaccard_join.similarity_components(rows.select("doc_id", "text"), words=5, percent=80))
    # One row of each component; ranks are cut to one row a component before the shuffle.
    order = Window.partitionBy("component").orderBy(F.col("doc_id").asc_nulls_last(), "row_key")
    first = found.where(F.col("component").isNotNull()).withColumn("r", F.row_number().over(order)).where(F.col("r") == 1)
    keep = first.select("row_key").unionByName(found.where(F.col("component").isNull()).select("row_key")).distinct()
    # Rows that go, or that occur more than once, are settled by a join; the others are not moved.
    counted = found.groupBy("row_key").count().join(keep.withColumn("stays", F.lit(True)), "row_key", "left")
    touched = counted.where(F.col("stays").isNull() | (F.col("count") > 1)).select("row_key")
    alone, others = untouched(rows, F.xxhash64("__key"), touched.select(F.xxhash64("row_key")))
    settled = others.join(keep.withColumnRenamed("row_key", "__key"), "__key", "left_semi").dropDuplicates(["__key"])
    return _unwrapped(alone.unionByName(settled.select(alone.columns)), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.deduplicated(_wrapped(docs), length=PASSAGE, whole_characters=True)
    gone = F.col("n_removed") > 0
    text = F.when(gone, F.col("kept").cast("string")).otherwise(F.col("text"))
    cut = left.where(~gone | F.col("kept").cast("string").rlike(r"\S"))
    return _unwrapped(cut, docs, text=text, n_chars=F.when(gone, F.length(text).cast("long")).otherwise(F.col("__all.n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = pack.packed(pack.measured(docs), "size", "source", "cluster")
    return placed.select("doc_id", "source", "piece", "start", "n_tokens", "bin", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: The first stage learns a model, and the others need hashes and searches that SQL has no words for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
