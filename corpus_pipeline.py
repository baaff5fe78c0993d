"""A corpus pipeline over ``documents``: language, quality, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Its result is written to the shared folder and read again.

Cases: null, empty and letterless texts go in the first stage; rows with null ids pass through all stages; of repeated rows and of
copies one stays; an empty table gives an empty result; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import jaccard, language, packing_concat, quality
from scriptorium.llm._common import free_prefix, fresh, give_back, written

#: A document's language must be at least so sure.
SURE = 0.5
#: A document's score must be at least this.
GOOD = 0.7


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters to tell a language by, that are in none of the languages, or have none surer than SURE.
    A document's own ``lang`` is no evidence, as the text model learns from that column."""
    model = language.fit(*language.training_rows(docs))
    give_back()
    out = free_prefix(docs, "_language_")
    found = language.identify(docs, model, F.col("text"), F.lit(None), F.col("source"), out=out)
    return found.where(F.col(f"{out}text_id").isNotNull() & (F.col(f"{out}id") != language.OTHER) & (F.col(f"{out}confidence") >= SURE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that score under GOOD."""
    score = fresh(docs, "_quality_score")
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name=score)
    return scored.where(F.col(score) >= GOOD).select(*[F.col(f"`{c}`") for c in docs.columns])


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return jaccard.distinct(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 1024 ids."""
    return packing_concat.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language ID", language_stage), ("quality classifier", quality_stage), ("n-gram Jaccard join", duplicates_stage), ("packing", packing_stage)]
#: Trained models and tokenizers decide, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for _, stage in before:
        docs = written(stage(spark, docs, sf_dir), "documents")
    return last(spark, docs, sf_dir)
