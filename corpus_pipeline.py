"""The corpus pipeline: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet into the shared folder and reads it again as the next
stage's docs.  All stages but the last return the columns they were given, with
their values, whatever the columns are called.  Null and empty texts stay up to
the mixing, which takes no rows without words; long texts are never cut before
the packing; rows that repeat a doc_id stay rows of their own; empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Stage
from tidemark.llm.line_dedup import deduplicated
from tidemark.llm.mixing import materialise
from tidemark.llm.near_dedup import without_near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't call toxic; null and empty texts are judged as texts without features."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return score(rows, model).where("predicted = 0").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines; documents of which nothing is left go, those that had no lines (null, empty, blank) stay."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; null, empty and blank texts and null doc_ids all stay."""
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, whole each time; those without words are not in the mix."""
    return materialise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, each copy packed on its own."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A fitted classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Stage(spark, "pipeline")
    for _, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
