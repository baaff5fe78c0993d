"""Queries of the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, quality
from ._common import table


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(*language.training_rows(table(spark, sf_dir, "documents")))
    pages = language.page_columns(table(spark, sf_dir, "pages"))
    found = language.identify(pages, model, F.col("text"), F.col("declared"), F.col("host"))
    return found.select("page_id", F.col("lang_id").alias("lang"), F.round("lang_confidence", 6).alias("confidence"), "declared", F.col("lang_text_id").alias("text_lang"))


QUERIES = {f.__name__: f for f in (op2_quality, op3_language_id)}
ORACLES: dict[str, str] = {}
