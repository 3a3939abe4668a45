"""The registered query of each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bloomlm, bpe, crosspolytope, jaccard, kneserney, outliers, packing, suffix, tokenfile, warc
from tidemark.llm.common import documents


def op1_kneser_ney_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.score(documents(spark, sf_dir))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(documents(spark, sf_dir))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(documents(spark, sf_dir))


def op6_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_huffman_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(documents(spark, sf_dir))


def op9_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.score(documents(spark, sf_dir))


def op10_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_kneser_ney_perplexity, op2_mcd_outliers, op3_cross_polytope, op4_suffix_array_dedup, op5_ngram_jaccard_join, op6_bpe_rank_array, op7_sum_of_squares_packing, op8_huffman_token_file, op9_log_frequency_bloom, op10_warc_boundary_chain)}
