"""Level tables, a benchmark and a risk-free rate from the star-schema tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.operators import panel
from tidemark.operators.panel import LEVEL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _levels(rows: DataFrame, series: str, date: str, price: str) -> DataFrame:
    daily = rows.groupBy(F.col(series).alias("series_id"), F.col(date).cast("date").alias("date")).agg(F.sum(F.col(price).cast("decimal(18,2)")).alias("level"))
    # a row per series and day, read again by the panel, its as-of date and whatever else a query needs
    return scratch.materialise(daily.select("series_id", "date", F.col("level").cast(LEVEL).alias("level")), "levels")


def _priced(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", column)
    return _levels(items.join(parts, F.col("l_partkey") == F.col("p_partkey")), column, "l_shipdate", "l_extendedprice")


def brand_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, "p_brand")


def type_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, "p_type")


def market_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(table(spark, sf_dir, "lineitem").select(F.lit("market").alias("m"), "l_shipdate", "l_extendedprice"), "m", "l_shipdate", "l_extendedprice")


def nation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return _levels(rows, "n_name", "o_orderdate", "o_totalprice")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ym, rb) of the whole market, on its own calendar."""
    return panel.panel(market_levels(spark, sf_dir)).select("ym", "period_end", F.col("r").alias("rb"))


def rate(months: DataFrame) -> DataFrame:
    """A deterministic monthly risk-free rate for the months that occur."""
    return months.select("ym").distinct().select("ym", (F.lit(0.004) + F.lit(0.0005) * (F.col("ym") % 3)).alias("f"))


def as_of(rows: DataFrame) -> datetime.date:
    """The inferred as-of date, a single value."""
    return panel.infer_as_of(rows).first()["as_of"]
