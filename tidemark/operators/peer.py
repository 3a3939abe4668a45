"""Cross-sectional ranks and aggregates; values are (group columns.., series_id, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def percentile_ranks(values: DataFrame, by: list[str], higher_is_better: bool = True) -> DataFrame:
    """100 times the share of present peers that are no better; absent values stay, with a null rank. `ranked` is the group's size."""
    order = F.col("value").asc() if higher_is_better else F.col("value").desc()
    there = present(F.col("value"))
    # absent values form a partition of their own, so they neither rank nor count
    w = Window.partitionBy(*by, F.col("_there"))
    out = values.withColumn("_there", there).withColumns({"_pct": 100 * F.cume_dist().over(w.orderBy(order)), "_n": F.count(F.lit(1)).over(w)})
    return out.withColumns({"pct": F.when(F.col("_there"), F.col("_pct")), "ranked": F.when(F.col("_there"), F.col("_n"))}).drop("_there", "_pct", "_n")


def display_pct(pct: Column, ranked: Column) -> Column:
    """Turned so that lower is better, within 0 and 100."""
    return F.when(pct.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 + F.lit(100.0) / ranked - pct)))


def category_aggregate(values: DataFrame, by: list[str]) -> DataFrame:
    """Count, median and quartiles of the present values of each group."""
    x = F.when(present(F.col("value")), F.col("value"))
    q = values.groupBy(*by).agg(F.count(x).alias("n"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(*by, "n", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(2)).alias("q3"))


def rank_history(points: DataFrame, by: list[str] | None = None, higher_is_better: bool = True) -> DataFrame:
    """Percentile ranks at each month-end among the series that have a point there."""
    return percentile_ranks(points, [*(by or []), "period_end"], higher_is_better)
