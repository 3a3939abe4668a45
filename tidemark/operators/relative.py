"""Metrics against a benchmark and a risk-free rate, as aggregates per key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import finite
from tidemark.operators.rolling import aligned

ROOT = math.sqrt(12)
KEYS = ["series_id", "window"]


def excess_returns(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    return aligned(rows, benchmark).select("series_id", "ym", "period_end", (F.col("r") - F.col("rb")).alias("excess"))


def _capture(mask: Column) -> Column:
    """Ratio of the yearly growth of both sides over the masked months; null without any."""
    n = F.count(F.when(mask, 1))
    yearly = lambda c: F.pow(F.product(F.when(mask, 1 + F.col(c))), F.try_divide(F.lit(12.0), n)) - 1
    return finite(F.try_divide(yearly("r"), yearly("rb")))


def relative(rows: DataFrame, benchmark: DataFrame, rf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All two-series metrics per key, with the risk-free overlap kept apart from that of the benchmark for treynor."""
    keys = keys or KEYS
    joined = rows.join(F.broadcast(benchmark.select("ym", "rb")), "ym", "left").join(F.broadcast(rf.select("ym", "f")), "ym", "left")
    r, rb = F.when(F.col("rb").isNotNull(), F.col("r")), F.col("rb")
    d, n = r - rb, F.count(r - rb)
    var_b = F.var_pop(F.when(r.isNotNull(), rb))
    beta = F.when((n >= 2) & (var_b >= 1e-30), F.covar_pop(r, rb) / F.nullif(var_b, F.lit(0.0)))
    rho = F.when((n >= 2) & (var_b >= 1e-30) & (F.var_pop(r) > 0), F.try_divide(F.covar_pop(r, rb), F.sqrt(var_b * F.var_pop(r))))
    over = F.col("r") - F.col("f")
    return joined.groupBy(*keys).agg(
        n.alias("n"),
        F.count(over).alias("n_rf"),
        F.when(n >= 1, F.avg(d)).alias("mean_excess"),
        F.when(n >= 2, F.stddev_samp(d) * ROOT).alias("tracking_error"),
        F.when(n >= 2, finite(F.try_divide(F.avg(d) * 12, F.stddev_samp(d) * ROOT))).alias("information_ratio"),
        beta.alias("beta"),
        rho.alias("correlation"),
        F.pow(rho, F.lit(2.0)).alias("r_squared"),
        F.when(F.count(over) >= 2, finite(F.try_divide(F.avg(over) * 12, beta))).alias("treynor"),
        _capture(rb > 0).alias("up_capture"),
        _capture(rb < 0).alias("down_capture"),
        F.avg((r > rb).cast("double")).alias("hit_rate"),
    )


def jensens_alpha(rows: DataFrame, benchmark: DataFrame, rf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Regression of r - f on rb - f over the months that all three have: annualised intercept, its t-statistic, months and span. Two
    passes, since the residuals of a one-pass formula cancel; without residuals the t-statistic is infinite or 0."""
    keys = keys or KEYS
    both = rows.join(F.broadcast(benchmark.select("ym", "rb")), "ym").join(F.broadcast(rf.select("ym", "f")), "ym")
    both = both.withColumns({"y": F.col("r") - F.col("f"), "x": F.col("rb") - F.col("f")})
    fit = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("cxy"), F.min("period_end").alias("window_start"), F.max("period_end").alias("window_end"))
    fit = fit.where((F.col("n") >= 3) & (F.col("vx") >= 1e-30)).withColumn("slope", F.col("cxy") / F.col("vx")).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    rest = both.join(fit, keys).withColumn("e", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))
    sums = rest.groupBy(*keys, "n", "mx", "vx", "slope", "intercept", "window_start", "window_end").agg(F.sum(F.col("e") * F.col("e")).alias("sse"))
    n = F.col("n")
    se = F.sqrt(F.col("sse") / (n - 2)) * F.sqrt(1 / n + F.col("mx") * F.col("mx") / (n * F.col("vx")))
    bare = F.when(F.col("intercept") == 0, F.lit(0.0)).otherwise(F.signum("intercept") * F.lit(float("inf")))
    return sums.select(*keys, (F.pow(1 + F.col("intercept"), F.lit(12.0)) - 1).alias("alpha"), F.coalesce(F.try_divide(F.col("intercept"), se), bare).alias("t_stat"), F.col("slope").alias("beta"), n.alias("n"), "window_start", "window_end")
