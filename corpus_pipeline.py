"""The corpus pipeline: each stage applies one operator to all that its predecessor kept.

A stage's result is lazy and rests on tables in the shared folder. It is written before the next stage is called (`run` does so), and then
these tables go, so that the folder never holds those of two stages. With them go the shuffle files of the stage before, and the memory that the
driver took for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, jaccard, kneserney, outliers, packing, suffix

#: No SQL: the stages iterate, hash and pack.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: set[str] = set()


def stage(f: Stage) -> Stage:
    """Remove what the stage before has left in the shared folder, and note what this one leaves."""

    @wraps(f)
    def noted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop(_left)
        _left.clear()
        common.forget(spark)
        before = common.held()
        out = f(spark, docs, sf_dir)
        _left.update(common.held() - before)
        return out

    return noted


@stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted texts' model is not beyond their language's threshold."""
    return kneserney.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return outliers.keep(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return jaccard.keep_one(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that documents with smaller ids hold too."""
    return suffix.clean(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens from all texts that are left."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result written as Parquet and read again; a result goes when the next one is written."""
    docs, path = common.documents(spark, sf_dir), None
    for name, apply in STAGES[:-1]:
        before, path = path, common.scratch_path(spark, name.replace(" ", "-"))
        docs = common.written(apply(spark, docs, sf_dir), path)
        common.drop({before})
    return STAGES[-1][1](spark, docs, sf_dir)
