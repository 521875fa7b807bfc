"""A training-data pipeline over `documents`, in stages that are each written and read again.

Every stage but the last returns the columns of its input, whatever other
columns there are and however they are called. Rejects are found and removed by
row, that is by id and text together, so rows without an id and several texts
under one id are decided one by one. Null and empty texts pass every stage that
does not name them below; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabinlift.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from cabinlift.llm.scratch import few
from cabinlift.sources.shared import written

#: Words per shingle and least similarity in per cent of this stage; op5's contract of 4 and 85 binds its query only.
STAGE_WORDS, STAGE_PERCENT = 5, 80


def _by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of id and text as the id, for operators that work by id."""
    return docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """row, a hash of id and text, and doc, the whole row; no column of ``docs`` can clash with them."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose hashes are listed as ``row``."""
    rows = few(written(rows.distinct(), "rejected"))
    return _keyed(docs).join(rows, "row", "left_anti").select("doc.*")


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of those that share id and text."""
    keyed = _keyed(docs)
    again = written(keyed.groupBy("row").count().filter("count > 1").select("row"), "repeated")
    if again.isEmpty():
        return docs
    again = few(again)
    one = keyed.join(again, "row", "left_semi").groupBy("row").agg(F.first("doc").alias("doc"))
    return keyed.join(again, "row", "left_anti").unionByName(one).select("doc.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like any other; equal texts share their score."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-repeated lines go; a document that had nothing else goes with them.

    Of equal lines the one of the smallest id and line number stays, rows without
    an id coming last. Null texts and texts without repeated lines stay as they
    are; ``n_chars``, where there is one, follows the text.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    found = line_dedup.dedup_lines(docs.select("doc_id", "text", whole), every_row=True)
    left = found.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    doc = F.col("doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        doc = doc.withField("n_chars", F.when(F.col("n_dropped") > 0, count).otherwise(F.col("doc.n_chars")))
    return left.select(doc.alias("doc")).select("doc.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of the smallest id; rows without an id come last.

    Texts without words are copies of nothing; of rows that repeat both id and
    text one stays, also without words.
    """
    found = written(
        ngram_join.jaccard_components(_by_row(docs), STAGE_WORDS, STAGE_PERCENT)
        .select(F.col("doc_id").alias("row"), "component_id").distinct(), "groups")
    groups = found.groupBy("component_id").count().filter("count > 1").select("component_id")
    ids = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("id"))
    members = written(found.join(groups, "component_id", "left_semi").join(ids.distinct(), "row"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first"))
    rejected = members.join(first, "component_id").filter(F.col("row") != F.col("first.row"))
    return _once(_without(docs, rejected.select("row")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go; texts without words hold none."""
    found = decontaminate.contamination_report(_by_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated").select(F.col("doc_id").alias("row")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; texts without words have none to take."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: The stages are a trained model, edit distances and random rounding: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
