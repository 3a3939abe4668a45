"""Risk, distribution, drawdown and tail metrics; all of them are aggregates per (series_id, window)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import month_index

WINDOWS = {"1Y": 12, "3Y": 36, "5Y": 60, "SI": None}
ROOT = math.sqrt(12)


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def refused(n: Column, required: int) -> Column:
    """The reason text where there are too few observations."""
    return F.when(n < required, F.format_string(f"insufficient_history(required={required}, available=%d)", n))


def windows_by_calendar(rows: DataFrame, at: Column, windows: dict[str, int | None] = WINDOWS) -> DataFrame:
    """Rows repeated for each window they belong to: months of the calendar up to the as-of month. A series needs the as-of month and as
    many rows up to it as the window has months; SI takes all rows."""
    w = Window.partitionBy("series_id")
    last = month_index(at)
    seen = F.count(F.when(F.col("ym") <= last, 1)).over(w)
    there = F.max(F.when(F.col("ym") == last, 1)).over(w) == 1
    marked = rows.withColumns({"_seen": seen, "_there": F.coalesce(there, F.lit(False))})
    cases = [F.lit(name) if months is None else F.when(F.col("_there") & (F.col("_seen") >= months) & (F.col("ym") <= last) & (F.col("ym") > last - months), name) for name, months in windows.items()]
    return marked.withColumn("window", F.explode(F.array_compact(F.array(*cases)))).drop("_seen", "_there")


def windows_by_observation(rows: DataFrame, at: Column, windows: dict[str, int]) -> DataFrame:
    """Rows repeated for each window: the last N rows of a series up to the as-of month, which must be there."""
    last = month_index(at)
    here = rows.where(F.col("ym") <= last)
    w = Window.partitionBy("series_id")
    here = here.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("ym"))), "_all": F.count(F.lit(1)).over(w), "_top": F.max("ym").over(w)}).where(F.col("_top") == last)
    cases = [F.when((F.col("_all") >= n) & (F.col("_n") <= n), name) for name, n in windows.items()]
    return here.withColumn("window", F.explode(F.array_compact(F.array(*cases)))).drop("_n", "_all", "_top")


def _at_least(n: Column, least: int, value: Column) -> Column:
    return F.when(n >= least, finite(value))


def corrected_skew(x: Column, n: Column) -> Column:
    """Bias-corrected skewness; null without variance."""
    return F.when((n >= 3) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def corrected_kurtosis(x: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; null without variance."""
    return F.when((n >= 4) & (F.var_pop(x) > 0), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(x) + 6))


def downside(x: Column, periods: int = 12) -> Column:
    """Root of the mean squared shortfall below zero over all observations, annualised."""
    return F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2.0)))) * math.sqrt(periods)


def risk(rows: DataFrame, rf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All monthly metrics per key in one aggregation; rows hold r per month, rf (ym, f) one row per month. n counts months, n_rf those
    with a risk-free rate."""
    keys = keys or ["series_id", "window"]
    order = Window.partitionBy(*keys).orderBy("ym").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(rf.select("ym", "f")), "ym", "left")
    joined = joined.withColumn("_level", F.product(1 + F.col("r")).over(order))
    joined = joined.withColumn("_depth", F.col("_level") / F.greatest(F.lit(1.0), F.max("_level").over(order)) - 1)
    r, x, n, m = F.col("r"), F.col("r") - F.col("f"), F.count("r"), F.count(F.col("r") - F.col("f"))
    loss, low = downside(x), F.min("_depth")
    growth = F.pow(F.product(1 + r), F.lit(12.0) / n) - 1
    return joined.groupBy(*keys).agg(
        n.alias("n"),
        m.alias("n_rf"),
        _at_least(n, 2, F.stddev_samp(r) * ROOT).alias("volatility"),
        _at_least(m, 1, loss).alias("downside_deviation"),
        _at_least(m, 2, F.try_divide(F.avg(x), F.stddev_samp(x)) * ROOT).alias("sharpe"),
        _at_least(m, 2, F.try_divide(F.avg(x) * 12, loss)).alias("sortino"),
        finite(F.try_divide(growth, F.abs(low))).alias("calmar"),
        F.avg((r > 0).cast("double")).alias("pct_positive"),
        F.max(r).alias("best_period"),
        F.min(r).alias("worst_period"),
        corrected_skew(r, n).alias("skew"),
        corrected_kurtosis(r, n).alias("kurtosis"),
        (F.product(1 + r) - 1).alias("total_return"),
    )


def with_refusals(metrics: DataFrame) -> DataFrame:
    """The metrics with a map of refused ones and why."""
    need = {"volatility": ("n", 2), "downside_deviation": ("n_rf", 1), "sharpe": ("n_rf", 2), "sortino": ("n_rf", 2), "calmar": ("n", 1), "skew": ("n", 3), "kurtosis": ("n", 4)}
    entries = F.array_compact(F.array(*(F.when(F.col(c) < k, F.struct(F.lit(name).alias("key"), refused(F.col(c), k).alias("value"))) for name, (c, k) in need.items())))
    return metrics.withColumn("refused", F.map_from_entries(entries))


def underwater(levels: DataFrame, level: str = "level", order: str = "date") -> DataFrame:
    """Level over its running peak, less 1, from the levels as they are."""
    w = Window.partitionBy("series_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(level).cast("double")
    return levels.withColumn("depth", value / F.max(value).over(w) - 1)


def drawdown(levels: DataFrame) -> DataFrame:
    """The deepest episode of each series: the first lowest depth, the first highest level up to it, and the first later level that is
    as high again (null if none), with its spans in days. Levels are as given, so the first one seeds the peak."""
    rows = underwater(levels).withColumn("x", F.col("level").cast("double"))
    w = Window.partitionBy("series_id")
    rows = rows.withColumn("trough", F.min(F.struct("depth", "date")).over(w))
    rows = rows.withColumn("trough_date", F.col("trough.date"))
    top = F.max(F.when(F.col("date") <= F.col("trough_date"), F.struct(F.col("x").alias("x"), (-F.unix_date("date")).alias("early")))).over(w)
    rows = rows.withColumns({"peak_level": top["x"], "peak_date": F.date_from_unix_date(-top["early"])})
    out = rows.groupBy("series_id").agg(
        F.first("trough.depth").alias("max_drawdown"),
        F.first("peak_date").alias("peak_date"),
        F.first("trough_date").alias("trough_date"),
        F.min(F.when((F.col("date") > F.col("trough_date")) & (F.col("x") >= F.col("peak_level")), F.col("date"))).alias("recovery_date"),
    )
    return out.withColumns({"days_to_trough": F.datediff("trough_date", "peak_date"), "days_to_recover": F.datediff("recovery_date", "trough_date"), "days_under": F.datediff("recovery_date", "peak_date")})


def tail(returns: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """Historical value at risk (interpolated quantile) and the mean of the int((n - 1) * cutoff) + 1 smallest returns."""
    w = Window.partitionBy("series_id")
    ranked = returns.withColumns({"_k": F.row_number().over(w.orderBy("r")), "_n": F.count(F.lit(1)).over(w)})
    inside = F.col("_k") <= F.floor((F.col("_n") - 1) * F.lit(cutoff)) + 1
    return ranked.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("r", F.lit(cutoff)).alias("var95"), F.avg(F.when(inside, F.col("r"))).alias("cvar95"))
