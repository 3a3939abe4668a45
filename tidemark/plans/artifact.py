"""The batch artifact: metrics of all series, disclosures, ranks and aggregates, and its nested JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics, peer, record, relative, rolling
from tidemark.operators.panel import month_index

SCHEMA_VERSION = "series-artifact-1"
RELATIVE_WINDOWS = {"1Y": 12, "3Y": 36, "5Y": 60}
#: Whether more is better, for the ranked metrics.
RANKED = {"volatility": False, "downside_deviation": False, "sharpe": True, "sortino": True, "calmar": True, "tracking_error": False, "information_ratio": True, "beta": False}


def core_metrics(rows: DataFrame, rf: DataFrame, at: Column) -> DataFrame:
    """Risk metrics per series and calendar window with the map of refusals."""
    return metrics.with_refusals(metrics.risk(metrics.windows_by_calendar(rows, at), rf))


def relative_metrics(rows: DataFrame, benchmark: DataFrame, rf: DataFrame, at: Column) -> DataFrame:
    """Benchmark metrics and alpha per series and window of the last N months that both have."""
    windowed = metrics.windows_by_observation(rows, at, RELATIVE_WINDOWS)
    alpha = relative.jensens_alpha(windowed, benchmark, rf).select("series_id", "window", F.struct("alpha", "t_stat", "n", "window_start", "window_end").alias("alpha"))
    return relative.relative(windowed, benchmark, rf).join(alpha, ["series_id", "window"], "left")


def window_disclosure(rows: DataFrame, rf: DataFrame, benchmark: DataFrame, at: Column) -> DataFrame:
    """Months of each window and how many of them the risk-free rate and the benchmark share; zeros where the window is absent."""
    names = F.array(*(F.lit(w) for w in RELATIVE_WINDOWS))
    spine = rows.select("series_id").distinct().withColumn("window", F.explode(names))
    windowed = metrics.windows_by_observation(rows, at, RELATIVE_WINDOWS)
    joined = windowed.join(F.broadcast(rf.select("ym", "f")), "ym", "left").join(F.broadcast(benchmark.select("ym", "rb")), "ym", "left")
    counts = joined.groupBy("series_id", "window").agg(F.count("r").alias("n_months"), F.count("f").alias("n_overlap_rf"), F.count("rb").alias("n_overlap_benchmark"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return spine.join(counts, ["series_id", "window"], "left").select("series_id", "window", zero("n_months"), zero("n_overlap_rf"), zero("n_overlap_benchmark"))


def growth(rows: DataFrame, benchmark: DataFrame, start: float = 10_000.0) -> DataFrame:
    """Growth of an amount in a series and the benchmark over their common months; the first point already holds a return."""
    w = Window.partitionBy("series_id").orderBy("ym").rowsBetween(Window.unboundedPreceding, 0)
    both = rolling.aligned(rows, benchmark)
    return both.select("series_id", "period_end", (start * F.product(1 + F.col("r")).over(w)).alias("series_value"), (start * F.product(1 + F.col("rb")).over(w)).alias("benchmark_value"))


def underwater(rows: DataFrame) -> DataFrame:
    """Monthly depth below the running peak of the growth curve, whose first point is 0."""
    w = Window.partitionBy("series_id").orderBy("ym").rowsBetween(Window.unboundedPreceding, 0)
    level = rows.withColumn("level_", F.product(1 + F.col("r")).over(w))
    return level.select("series_id", "period_end", (F.col("level_") / F.max("level_").over(w) - 1).alias("depth"))


def extend_rate(rf: DataFrame, through: Column, most: int = 12) -> DataFrame:
    """The rate carried flat from its last month to the month of `through`; over `most` months raises. `extended` marks the new rows."""
    last = rf.agg(F.max_by("f", "ym").alias("f"), F.max("ym").alias("last")).withColumn("to", month_index(through))
    gap = F.col("to") - F.col("last")
    months = F.when(gap > most, F.raise_error(F.concat(F.lit(f"more than {most} months to carry: "), gap.cast("string"))).cast("array<int>")).when(gap > 0, F.sequence(F.col("last") + 1, F.col("to"))).otherwise(F.array().cast("array<int>"))
    more = last.select(F.explode(months).alias("ym"), "f").withColumn("extended", F.lit(True))
    return rf.select("ym", "f", F.lit(False).alias("extended")).unionByName(more)


def benchmark_block(stated: DataFrame, landed: DataFrame) -> DataFrame:
    """What a series states as its benchmark and what it is measured against: a first-tier code that is not landed is pending, and the
    alternate or the category yardstick stands in."""
    there = landed.select(F.col("series_id").alias("benchmark_code")).distinct().withColumn("landed", F.lit(True))
    joined = stated.join(there, "benchmark_code", "left")
    pending = (F.col("tier") == "tier1") & F.col("landed").isNull()
    return joined.select("series_id", F.col("benchmark_code").alias("stated"), F.when(pending, "alternate-pending-tier1").otherwise(F.col("tier")).alias("tier"), "yardstick")


def long_metrics(core: DataFrame) -> DataFrame:
    """(series_id, window, metric, value) of the ranked metrics that the table has."""
    names = [m for m in RANKED if m in core.columns]
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names))
    return core.select("series_id", "window", F.explode(pairs).alias("x")).select("series_id", "window", "x.metric", "x.value")


def ranks(values: DataFrame, by: list[str]) -> DataFrame:
    """Display percentiles (lower is better) of the long metrics, each in its own direction."""
    out = None
    for better in (True, False):
        part = peer.percentile_ranks(values.where(F.col("metric").isin([m for m, b in RANKED.items() if b is better])), by, better)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("display_pct", peer.display_pct(F.col("pct"), F.col("ranked")))


def to_json(core: DataFrame, at: Column) -> DataFrame:
    """One JSON text per series: metrics by name and window with non-finite values as null, and the refusals."""
    names = [c for c, t in core.dtypes if t == "double"]
    key = lambda c: F.concat(F.lit(f"{c}_"), F.col("window"))
    entries = F.array(*(F.struct(key(c).alias("key"), metrics.finite(F.col(c)).alias("value")) for c in names))
    gathered = core.groupBy("series_id").agg(F.array_sort(F.flatten(F.collect_list(entries))).alias("m"), F.array_sort(F.flatten(F.collect_list(F.transform(F.map_entries("refused"), lambda e: F.struct(F.concat(e["key"], F.lit("_"), F.col("window")).alias("key"), e["value"].alias("value")))))).alias("refused"))
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), at.alias("as_of"), F.col("series_id"), F.map_from_entries("m").alias("metrics"), F.map_from_entries("refused").alias("refused"))
    return gathered.select("series_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("artifact"))


def from_json(artifacts: DataFrame) -> DataFrame:
    """The long form of stored artifacts."""
    schema = "schema_version string, as_of date, series_id string, metrics map<string, double>, refused map<string, string>"
    return artifacts.select(F.from_json("artifact", schema).alias("x")).select("x.series_id", "x.as_of", F.explode_outer("x.metrics").alias("metric", "value"))


def carry_commentary(current: DataFrame, previous: DataFrame, version: str) -> DataFrame:
    """Commentary blocks of the previous artifact for the same series, if they were made with the same prompt version."""
    old = previous.where(F.col("prompt_version") == version).select("series_id", "commentary")
    return current.join(old, "series_id", "left")


def record_and_excess(levels: DataFrame, benchmark_levels: DataFrame, at: Column) -> DataFrame:
    return record.excess_figures(levels, benchmark_levels, at)
