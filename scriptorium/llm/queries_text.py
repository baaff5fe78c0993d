"""Queries of the token operators; each runs over the whole of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, packing_bfd, packing_concat, token_counts
from ._common import table

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing_bfd.pack(table(spark, sf_dir, "documents"), JSON, PATTERN)
    return packed.select("sequence_id", "n_tokens", "n_segments", "doc_ids", "seg_starts", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(table(spark, sf_dir, "documents"), JSON, PATTERN)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing_concat.pack(table(spark, sf_dir, "documents"), JSON, PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe_tree.encode_decode(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_output, op4_token_counts, op6_packing, op7_bpe)}
ORACLES: dict[str, str] = {}
