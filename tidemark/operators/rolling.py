"""Rolling panels: calendar frames over the month index and frames of the last N observations."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = math.sqrt(12)


def _frames(months: int) -> tuple[Column, object]:
    """The emission guard (N-th row on) and the frame: whole years go by the calendar, other spans by rows."""
    w = Window.partitionBy("series_id").orderBy("ym")
    frame = w.rangeBetween(-(months - 1), 0) if months % 12 == 0 else w.rowsBetween(-(months - 1), 0)
    return F.row_number().over(w) >= months, frame


def rolling_return(rows: DataFrame, months: int, value: str = "r") -> DataFrame:
    """Annualised by the nominal number of months, also where a gap leaves fewer."""
    guard, frame = _frames(months)
    out = F.pow(F.product(1 + F.col(value)).over(frame), F.lit(12.0 / months)) - 1
    return rows.withColumns({"_go": guard, "value": out}).where("_go").select("series_id", "ym", "period_end", F.lit(months).alias("months"), "value")


def rolling_returns(rows: DataFrame, months: tuple[int, ...] = (12, 36, 60)) -> DataFrame:
    """Several spans over one partitioning, as rows (months, value)."""
    parts, outs = [], {}
    for n in months:
        guard, frame = _frames(n)
        outs[f"_v{n}"] = F.when(guard, F.pow(F.product(1 + F.col("r")).over(frame), F.lit(12.0 / n)) - 1)
        parts.append(F.when(F.col(f"_v{n}").isNotNull(), F.struct(F.lit(n).alias("months"), F.col(f"_v{n}").alias("value"))))
    return rows.withColumns(outs).select("series_id", "ym", "period_end", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("series_id", "ym", "period_end", "x.months", "x.value")


def aligned(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Inner join by month with one benchmark series (ym, rb), a row per month."""
    return rows.join(F.broadcast(benchmark.select("ym", "rb")), "ym")


def rolling_excess(rows: DataFrame, benchmark: DataFrame, months: int) -> DataFrame:
    return rolling_return(aligned(rows, benchmark).withColumn("x", F.col("r") - F.col("rb")), months, "x")


def rolling_pairs(rows: DataFrame, benchmark: DataFrame, months: int) -> DataFrame:
    """Slope and correlation over the last N common months; null where the benchmark (or the series) is flat."""
    w = Window.partitionBy("series_id").orderBy("ym")
    frame = w.rowsBetween(-(months - 1), 0)
    both = aligned(rows, benchmark).withColumns({"_n": F.row_number().over(w), "_vb": F.var_pop("rb").over(frame), "_vr": F.var_pop("r").over(frame), "_c": F.covar_pop("r", "rb").over(frame)})
    flat = F.col("_vb") < 1e-30
    beta = F.when(~flat, F.col("_c") / F.nullif(F.col("_vb"), F.lit(0.0)))
    rho = F.when(~flat & (F.col("_vr") > 0), F.try_divide(F.col("_c"), F.sqrt(F.col("_vb") * F.col("_vr"))))
    return both.where(F.col("_n") >= months).select("series_id", "ym", "period_end", F.lit(months).alias("months"), beta.alias("beta"), rho.alias("correlation"))


def rolling_sharpe(rows: DataFrame, rf: DataFrame, months: int) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("ym")
    frame = w.rowsBetween(-(months - 1), 0)
    both = rows.join(F.broadcast(rf.select("ym", "f")), "ym").withColumn("x", F.col("r") - F.col("f"))
    value = F.try_divide(F.avg("x").over(frame), F.stddev_samp("x").over(frame)) * ROOT
    return both.withColumns({"_n": F.row_number().over(w), "value": value}).where(F.col("_n") >= months).select("series_id", "ym", "period_end", F.lit(months).alias("months"), "value")


def pair_bundle(rows: DataFrame, benchmark: DataFrame, months: tuple[int, ...] = (12, 36)) -> DataFrame:
    """Slopes and correlations over several spans, as rows."""
    parts = [rolling_pairs(rows, benchmark, n) for n in months]
    return reduce(DataFrame.unionByName, parts)
