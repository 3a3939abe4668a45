"""Point-to-point figures of record and compounded returns over spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.panel import as_of, month_index, subtract_months

PERIODS = {"1Y": 12, "3Y": 36, "5Y": 60, "SI": None}


def figures(levels: DataFrame, at: Column, periods: dict[str, int | None] = PERIODS) -> DataFrame:
    """The figures of all series and periods at one date. The anchor lies whole years back (SI: the first date)."""
    first = levels.groupBy("series_id").agg(F.min("date").alias("first"))
    named = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(m).cast("int").alias("months")) for p, m in periods.items()))
    wanted = first.select("series_id", F.explode(named).alias("p"), at.alias("end"), "first").select("series_id", "p.period", "p.months", "end", anchor(F.col("p.months"), at, F.col("first")).alias("start"))
    return figures_for(levels, wanted)


def anchor(months: Column, at: Column, first: Column) -> Column:
    """Where a figure of so many months starts; null months start with the first level."""
    return F.when(months.isNull(), first).otherwise(subtract_months(at, F.coalesce(months, F.lit(0))))


def figures_for(levels: DataFrame, wanted: DataFrame) -> DataFrame:
    """series_id, period, both dates and levels, days, method and value of the wanted (series_id, period, months, start, end). Both ends
    take the last level on or before them. Under 365 days the plain ratio, else a yearly rate with exponent 1 / years, or
    365 / days for SI. Ratios are decimal; a missing end or no days give a null value."""
    # a figure's ends are its own anchors: the same series and period may be wanted at many dates
    anchors = wanted.select("series_id", "period", "months", F.col("end").alias("at"), F.explode(F.array(F.struct(F.col("start").alias("anchor"), F.lit("s").alias("side")), F.struct(F.col("end").alias("anchor"), F.lit("e").alias("side")))).alias("x")).select("series_id", "x.anchor", "period", "months", "at", "x.side")
    found = as_of(levels, anchors)
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = found.groupBy("series_id", "period", "months", "at").agg(side("s", "anchor").alias("start"), side("e", "anchor").alias("end"), side("s", "level").alias("start_level"), side("e", "level").alias("end_level"))
    days = F.datediff("end", "start")
    ratio = (F.col("end_level") / F.when(F.col("start_level") > 0, F.col("start_level"))).cast("double")
    years = F.when(F.col("months").isNull(), F.lit(365.0) / F.col("days")).otherwise(F.lit(12.0) / F.col("months"))
    value = F.when(F.col("days") > 0, F.when(F.col("days") < 365, ratio - 1).otherwise(F.pow(ratio, years) - 1))
    method = F.when(F.col("days") < 365, "absolute").otherwise("cagr")
    return both.withColumn("days", days).select("series_id", "period", "start", "end", "start_level", "end_level", "days", method.alias("method"), value.alias("value"))


def excess_figures(levels: DataFrame, yardstick: DataFrame, at: Column) -> DataFrame:
    """Each series' figure less that of the one yardstick series, by period."""
    other = figures(yardstick, at).select("period", F.col("value").alias("yardstick_value"))  # a row per period
    joined = figures(levels, at).join(F.broadcast(other), "period", "left")
    return joined.select("series_id", "period", "value", "yardstick_value", (F.col("value") - F.col("yardstick_value")).alias("excess"))


def compounded(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Product of 1 + r less 1 over the months from start to end; a series without rows there is absent."""
    return rows.where(F.col("period_end").between(start, end)).groupBy("series_id").agg((F.product(1 + F.col("r")) - 1).alias("value"))


def year_to_date(rows: DataFrame, at: Column) -> DataFrame:
    """Compounded from January of the as-of year; only for series that have the as-of month."""
    here = rows.where((F.year("period_end") == F.year(at)) & (F.col("period_end") <= at))
    sums = here.groupBy("series_id").agg((F.product(1 + F.col("r")) - 1).alias("value"), F.max("period_end").alias("last"))
    return sums.where(F.col("last") == at).select("series_id", "value")


def calendar_years(rows: DataFrame, years: list[int]) -> DataFrame:
    """series_id, year and value for every series and listed year; null where a year has no months. Part years count."""
    spine = rows.select("series_id").distinct().withColumn("year", F.explode(F.array(*(F.lit(y) for y in years))))
    sums = rows.withColumn("year", F.year("period_end")).where(F.col("year").isin(years)).groupBy("series_id", "year").agg((F.product(1 + F.col("r")) - 1).alias("value"))
    return spine.join(sums, ["series_id", "year"], "left")


def trailing_months(rows: DataFrame, at: Column, months: int) -> DataFrame:
    """Compounded return of the last months by the calendar, for series with the as-of month and enough earlier rows."""
    last = month_index(at)
    seen = rows.where(F.col("ym") <= last)
    sums = seen.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max("ym").alias("top"), (F.product(F.when(F.col("ym") > last - months, 1 + F.col("r"))) - 1).alias("value"))
    return sums.where((F.col("top") == last) & (F.col("n") >= months)).select("series_id", "value")
