"""Registered queries over whole tables, one per corpus operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod
from .html_extraction import extract_text
from .line_dedup import ORACLE as LINES_SQL
from .line_dedup import without_repeated_runs
from .lm_scoring import score_texts
from .media import store_texts
from .mixing import mix
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import pack
from .substring_dedup import ORACLE as SUBSTRINGS_SQL
from .substring_dedup import without_repeats
from .toxicity import score, train


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(_documents(spark, sf_dir))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_documents(spark, sf_dir), digest=True)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_runs(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_toxicity": op3_toxicity,
    "op4_html": op4_html,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_media": op7_media,
    "op8_substrings": op8_substrings,
    "op9_neighbours": op9_neighbours,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op8_substrings": SUBSTRINGS_SQL,
    "op10_line_dedup": LINES_SQL,
}
