"""Calendars, month-ends and returns.

Levels are (series_id string, date date, level decimal(18,6)). A panel is (series_id, ym, period_end, level, r): one row per kept
month, ym = 12 * year + month. Everything is keyed by series, so one shuffle per window family serves all series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVEL = T.DecimalType(18, 6)
PERIODS_PER_YEAR = {"monthly": 12, "daily": 252}


def periods_per_year(frequency: str) -> int:
    return PERIODS_PER_YEAR[frequency]


def require_frequency(found: str, expected: str) -> None:
    if found != expected:
        raise ValueError(f"expected {expected} returns, got {found}")


def month_index(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date)).cast("int")


def months_between(start: Column, end: Column) -> Column:
    return month_index(end) - month_index(start)


def month_end_of(ym: Column) -> Column:
    """Last day of a month index."""
    year, month = F.floor((ym - 1) / 12).cast("int"), F.pmod(ym - 1, F.lit(12)).cast("int") + 1
    return F.last_day(F.make_date(year, month, F.lit(1)))


def subtract_months(date: Column, n: int | Column) -> Column:
    """The same day n months before, clamped to the month's length."""
    return F.add_months(date, -n if isinstance(n, int) else -n.cast("int"))


def deduplicate(levels: DataFrame, order: str, keep: str = "last") -> DataFrame:
    """One row per (series_id, date): the last (or first) by the order column."""
    by = F.col(order).desc() if keep == "last" else F.col(order).asc()
    ranked = levels.withColumn("_n", F.row_number().over(Window.partitionBy("series_id", "date").orderBy(by)))
    return ranked.where("_n = 1").drop("_n")


def between(rows: DataFrame, start: Column, end: Column, column: str = "date") -> DataFrame:
    """Both ends count; a start after the end raises."""
    wrong = F.raise_error(F.lit("start after end")).cast("boolean")
    return rows.where(F.when(start > end, wrong).otherwise(F.col(column).between(start, end)))


def own_calendar(levels: DataFrame) -> DataFrame:
    """Every date that occurs trades."""
    return levels.select("date").distinct()


def quorum_calendar(levels: DataFrame) -> DataFrame:
    """Dates on which at least half of the active series publish. A series is active from its first to its last date; the number
    of active series comes from a sweep over the starts and ends, so no date meets every series."""
    bounds = levels.groupBy("series_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    steps = bounds.select(F.col("first").alias("date"), F.lit(1).alias("step")).union(bounds.select(F.date_add("last", 1), F.lit(-1)))
    published = levels.groupBy("date").agg(F.count(F.lit(1)).alias("published"))
    events = steps.groupBy("date").agg(F.sum("step").alias("step")).join(published, "date", "full")
    # one row per date: the running sum is over the calendar, not over the levels
    active = F.sum(F.coalesce("step", F.lit(0))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    kept = events.withColumn("active", active).where((F.col("published") >= 1) & (2 * F.col("published") >= F.col("active")))
    return kept.select("date", "active", "published")


def month_close(calendar: DataFrame) -> DataFrame:
    """The last trading day of each month."""
    return calendar.groupBy(month_index(F.col("date")).alias("ym")).agg(F.max("date").alias("close"))


def month_ends(levels: DataFrame, close: DataFrame | None = None) -> DataFrame:
    """Complete months only: the last level in a month, if the series reaches the month's last trading day (its own, without a
    calendar) and has a row in the following month; dated to the calendar month-end."""
    monthly = levels.groupBy("series_id", month_index(F.col("date")).alias("ym")).agg(F.max("date").alias("last_date"), F.max_by("level", "date").alias("level"))
    following = F.lead("ym").over(Window.partitionBy("series_id").orderBy("ym"))  # before any month is dropped
    monthly = monthly.withColumn("following", following).where(F.col("following") == F.col("ym") + 1)
    if close is not None:
        monthly = monthly.join(F.broadcast(close), "ym").where("last_date >= close")  # a row per calendar month
    return monthly.select("series_id", "ym", F.last_day("last_date").alias("period_end"), "level")


def simple_return(start: Column, end: Column, strict: bool = False) -> Column:
    """end / start - 1 in decimals, then one cast; a start that is not positive gives null, or an error if strict."""
    bad = F.raise_error(F.lit("levels must be positive")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(start > 0, (end / start - 1).cast("double")).when(start.isNotNull(), bad)


def monthly_returns(ends: DataFrame, strict: bool = False) -> DataFrame:
    """Returns between adjacent month-ends; a gap gives none."""
    w = Window.partitionBy("series_id").orderBy("ym")
    rows = ends.withColumns({"_level": F.lag("level").over(w), "_ym": F.lag("ym").over(w)}).where(F.col("ym") - F.col("_ym") == 1)
    return rows.select("series_id", "ym", "period_end", "level", simple_return(F.col("_level"), F.col("level"), strict).alias("r"))


def daily_returns(levels: DataFrame, strict: bool = False) -> DataFrame:
    """Returns between consecutive rows of a series."""
    before = F.lag("level").over(Window.partitionBy("series_id").orderBy("date"))
    return levels.withColumn("_level", before).where("_level is not null").select("series_id", "date", simple_return(F.col("_level"), F.col("level"), strict).alias("r"))


def panel(levels: DataFrame, close: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Monthly returns of all series at once."""
    return monthly_returns(month_ends(levels, close), strict)


def to_index(returns: DataFrame, base: float = 100.0, order: str = "ym") -> DataFrame:
    """base times the running product of 1 + r."""
    w = Window.partitionBy("series_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("index_level", base * F.product(1 + F.col("r")).over(w))


def as_of(levels: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each anchor (series_id, anchor date, any further columns) the last level on or before it, however old; null if there is
    none. Levels and anchors are merged in one sort per series instead of a range join."""
    extra = [c for c in anchors.columns if c not in ("series_id", "anchor")]
    left = levels.select("series_id", "date", "level", F.lit(0).alias("_kind"), *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra))
    right = anchors.select("series_id", F.col("anchor").alias("date"), F.lit(None).cast(LEVEL).alias("level"), F.lit(1).alias("_kind"), *extra)
    w = Window.partitionBy("series_id").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    dated = F.when(F.col("_kind") == 0, F.col("date"))
    found = left.union(right).withColumns({"level": F.last("level", ignorenulls=True).over(w), "level_date": F.last(dated, ignorenulls=True).over(w)})
    return found.where("_kind = 1").select("series_id", F.col("date").alias("anchor"), *extra, "level", "level_date")


def provenance(levels: DataFrame) -> DataFrame:
    """(series_id, rows, digest): a SHA-256 over each series' rows in order of date, whatever their order in the table."""
    line = F.concat_ws("|", F.col("date").cast("string"), F.col("level").cast("string"))
    return levels.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("digest"))


def infer_as_of(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """The latest month-end that at least this share of the series has (one row)."""
    series = rows.agg(F.countDistinct("series_id").alias("series"))
    counts = rows.groupBy("period_end").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(series)).where(F.col("n") >= share * F.col("series")).agg(F.max("period_end").alias("as_of"))


def anomalies(levels: DataFrame, start: Column, daily: float = 0.15, monthly: float = 0.25) -> DataFrame:
    """Steps of an index from `start` on that are too large: over `daily` between rows, or over `monthly` between month-ends."""
    rows = levels.where(F.col("date") >= start)
    steps = daily_returns(rows).where(F.abs("r") > daily).select("series_id", "date", F.lit("daily").alias("grain"), "r")
    ends = month_ends(rows).select("series_id", F.col("period_end").alias("date"), "level")
    return steps.union(daily_returns(ends).where(F.abs("r") > monthly).select("series_id", "date", F.lit("monthly"), "r"))
