"""The whole artifact: facts and point panels of all series at once, ranks and aggregates over the cohort, and their JSON form.

Facts are long: (series_id, key, value, refused) with one row per series and key of FACT_KEYS, null where a figure is undefined. Point
panels are (series_id, panel, period_end, value). Nothing loops over series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.operators import metrics, panel, peer, record, relative, rolling
from tidemark.plans import artifact

SCHEMA_VERSION = "series-artifact-2"
# The names of the figures, which of them are ranked and in which direction (True: more is better).
TRAILING = (1, 3, 6)
RISK = ("volatility", "downside_deviation", "sharpe", "sortino", "calmar")
SHAPE = ("pct_positive", "best_period", "worst_period", "skew", "kurtosis")
DAILY = ("max_drawdown", "var95", "cvar95")
RELATIVE = ("excess_return", "benchmark_return", "rf", "tracking_error", "information_ratio", "beta")
FACT_KEYS = (
    *(f"return_{n}M" for n in TRAILING),
    "return_YTD",
    *(f"{m}_{w}" for m in RISK for w in metrics.WINDOWS),
    *(f"{m}_SI" for m in (*SHAPE, *DAILY)),
    *(f"return_{p}" for p in record.PERIODS),
    *(f"{m}_{w}" for m in RELATIVE for w in artifact.RELATIVE_WINDOWS),
)
RANKED = {f"{m}_{w}": better for m, better in (("return", True), ("volatility", False), ("sharpe", True), ("sortino", True), ("calmar", True), ("excess_return", True), ("tracking_error", False), ("information_ratio", True), ("alpha", True)) for w in artifact.RELATIVE_WINDOWS} | {"max_drawdown_SI": True}
HISTORY = {"return_1Y": "rolling_return_1Y", "return_3Y": "rolling_return_3Y", "return_5Y": "rolling_return_5Y", "excess_return_1Y": "rolling_excess_return_1Y", "excess_return_3Y": "rolling_excess_return_3Y", "sharpe_1Y": "rolling_sharpe_1Y", "sharpe_3Y": "rolling_sharpe_3Y"}
ROLLING = {"1Y": 12, "3Y": 36}


def _melt(rows: DataFrame, names: dict[str, Column], refused: Column | None = None) -> DataFrame:
    """(series_id, key, value, refused) of the named columns."""
    none = F.lit(None).cast("string")
    cells = F.array(*(F.struct(F.lit(k).alias("key"), metrics.finite(c.cast("double")).alias("value"), (none if refused is None else refused[k.rpartition("_")[0]]).alias("refused")) for k, c in names.items()))
    return rows.select("series_id", F.explode(cells).alias("x")).select("series_id", "x.key", "x.value", "x.refused")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def core_facts(levels: DataFrame, rows: DataFrame, rf: DataFrame, at: Column) -> DataFrame:
    """The figures that need no benchmark, for the series that have them."""
    single = [_melt(record.trailing_months(rows, at, n), {f"return_{n}M": F.col("value")}) for n in TRAILING]
    single.append(_melt(record.year_to_date(rows, at), {"return_YTD": F.col("value")}))
    core = scratch.materialise(artifact.core_metrics(rows, rf, at), "core")
    for w in metrics.WINDOWS:
        names = (*RISK, *SHAPE) if w == "SI" else RISK
        single.append(_melt(core.where(F.col("window") == w), {f"{m}_{w}": F.col(m) for m in names}, F.col("refused")))
    single.append(_melt(metrics.drawdown(levels).select("series_id", "max_drawdown"), {"max_drawdown_SI": F.col("max_drawdown")}))
    single.append(_melt(metrics.tail(panel.daily_returns(levels)), {f"{m}_SI": F.col(m) for m in ("var95", "cvar95")}))
    figures = record.figures(levels, at).select("series_id", F.concat(F.lit("return_"), "period").alias("key"), metrics.finite(F.col("value")).alias("value"), F.lit(None).cast("string").alias("refused"))
    return _union([*single, figures])


def rate_over(rf: DataFrame, months: int, at: Column) -> DataFrame:
    """The rate's own annualised return over the months up to the as-of month: one row, null where its history does not reach that far."""
    last = panel.month_index(at)
    here = rf.where((F.col("ym") <= last) & (F.col("ym") > last - months))
    whole = (F.count("f") == months) & (F.max("ym") == F.max(last))
    return here.agg(F.when(whole, F.pow(F.product(1 + F.col("f")), F.lit(12.0 / months)) - 1).alias("value"))


def relative_facts(levels: DataFrame, rows: DataFrame, yardstick_levels: DataFrame, yardstick: DataFrame, rf: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The figures against the yardstick, and alphas: (series_id, window, alpha, t_stat, n, window_start, window_end) where both the alpha and its
    t-statistic are finite."""
    figures = record.excess_figures(levels, yardstick_levels, at).where(F.col("period").isin(list(artifact.RELATIVE_WINDOWS)))
    named = lambda m, c: figures.select("series_id", F.concat(F.lit(f"{m}_"), "period").alias("key"), metrics.finite(F.col(c)).alias("value"), F.lit(None).cast("string").alias("refused"))
    parts = [named("excess_return", "excess"), named("benchmark_return", "yardstick_value")]
    series = rows.select("series_id").distinct()
    for w, months in artifact.RELATIVE_WINDOWS.items():
        # one value for all series: a row that is joined to each
        parts.append(_melt(series.join(F.broadcast(rate_over(rf, months, at))), {f"rf_{w}": F.col("value")}))
    windowed = scratch.materialise(metrics.windows_by_observation(rows, at, artifact.RELATIVE_WINDOWS), "windowed")
    found = scratch.materialise(relative.relative(windowed, yardstick, rf), "relative")
    for w in artifact.RELATIVE_WINDOWS:
        parts.append(_melt(found.where(F.col("window") == w), {f"{m}_{w}": F.col(m) for m in ("tracking_error", "information_ratio", "beta")}))
    alpha = relative.jensens_alpha(windowed, yardstick, rf).select("series_id", "window", "alpha", "t_stat", "n", "window_start", "window_end")
    return _union(parts), alpha.where(metrics.finite(F.col("alpha")).isNotNull() & metrics.finite(F.col("t_stat")).isNotNull())


def facts(levels: DataFrame, rows: DataFrame, yardstick_levels: DataFrame, yardstick: DataFrame, rf: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """All facts of all series, one row per series and key, and the alphas."""
    other, alpha = relative_facts(levels, rows, yardstick_levels, yardstick, rf, at)
    spine = levels.select("series_id").distinct().select("series_id", F.explode(F.array(*(F.lit(k) for k in FACT_KEYS))).alias("key"))
    found = core_facts(levels, rows, rf, at).unionByName(other)
    return scratch.materialise(spine.join(found, ["series_id", "key"], "left"), "facts"), scratch.materialise(alpha, "alpha")


def points(rows: DataFrame, yardstick: DataFrame, rf: DataFrame) -> DataFrame:
    """The rolling panels: returns over 1, 3 and 5 years, excess returns and Sharpe ratios over 1 and 3."""
    named = lambda df, kind: df.select("series_id", F.concat(F.lit(f"rolling_{kind}_"), (F.col("months") / 12).cast("int").cast("string"), F.lit("Y")).alias("panel"), "period_end", metrics.finite(F.col("value")).alias("value"))
    parts = [named(rolling.rolling_returns(rows), "return")]
    for months in ROLLING.values():
        parts += [named(rolling.rolling_excess(rows, yardstick, months), "excess_return"), named(rolling.rolling_sharpe(rows, rf, months), "sharpe")]
    return _union(parts)


def calendar_years(rows: DataFrame, at: Column, years: int = 3) -> DataFrame:
    """Compounded returns of the last whole years before the as-of date's, per series; null where a year has no months."""
    spine = rows.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.year(at) - years, F.year(at) - 1)).alias("year"))
    sums = rows.groupBy("series_id", F.year("period_end").alias("year")).agg((F.product(1 + F.col("r")) - 1).alias("value"))
    return spine.join(sums, ["series_id", "year"], "left")


def ranked_values(found: DataFrame, alpha: DataFrame) -> DataFrame:
    """(key, series_id, value) of the ranked keys; an alpha counts by its value, and a series without one stands with null."""
    own = found.where(F.col("key").isin(list(RANKED))).select("key", "series_id", "value")
    keys = F.array(*(F.lit(k) for k in RANKED if k.startswith("alpha_")))
    spine = found.select("series_id").distinct().select("series_id", F.explode(keys).alias("key"))
    return own.unionByName(spine.join(alpha.select("series_id", F.concat(F.lit("alpha_"), "window").alias("key"), F.col("alpha").alias("value")), ["series_id", "key"], "left").select("key", "series_id", "value"))


def ranks(values: DataFrame) -> DataFrame:
    """The values with their display percentiles: lower is better, each key in its own direction."""
    parts = [peer.percentile_ranks(values.where(F.col("key").isin([k for k, b in RANKED.items() if b is better])), ["key"], better) for better in (True, False)]
    return _union(parts).withColumn("display_pct", peer.display_pct(F.col("pct"), F.col("ranked")))


def rank_histories(panels: DataFrame) -> DataFrame:
    """(key, series_id, period_end, display_pct) at each month-end among the series that have a point there."""
    keys = F.create_map(*(F.lit(x) for k, p in HISTORY.items() for x in (p, k)))
    values = panels.withColumn("key", keys[F.col("panel")]).where("key is not null and value is not null").select("key", "series_id", "period_end", "value")
    found = peer.rank_history(values, ["key"])  # all of them: more is better
    return found.select("key", "series_id", "period_end", peer.display_pct(F.col("pct"), F.col("ranked")).alias("display_pct"))


def window_refusals(found: DataFrame) -> DataFrame:
    """(series_id, window, refused): what was refused in each window, by metric name without the window's suffix."""
    parts = found.where("refused is not null").select("series_id", F.regexp_extract("key", r"_([^_]+)$", 1).alias("window"), F.struct(F.regexp_extract("key", r"^(.*)_[^_]+$", 1).alias("key"), F.col("refused").alias("value")).alias("x"))
    return parts.groupBy("series_id", "window").agg(F.map_from_entries(F.array_sort(F.collect_list("x"))).alias("refused"))


def extension_basis(last: Column, clause: str = "") -> Column:
    """What the carried months of the rate rest on."""
    text = F.concat(F.lit("carried at the value last published, of "), F.date_format(last, "yyyy-MM-dd"))
    return F.concat(text, F.lit(f"; {clause}")) if clause else text


def rate_disclosure(rf: DataFrame, name: str, at: Column, clause: str = "") -> DataFrame:
    """One row: the rate's name, frequency and last month, its level over each window, and what was carried forward (null if nothing);
    `rf` is the extended table of `extend_rate`."""
    marked = rf if "extended" in rf.columns else rf.withColumn("extended", F.lit(False))
    end = lambda c: panel.month_end_of(c)
    sums = marked.agg(F.max("ym").alias("top"), F.max(F.when(~F.col("extended"), F.col("ym"))).alias("last"), F.count(F.when(F.col("extended"), 1)).alias("carried"))
    for w, months in artifact.RELATIVE_WINDOWS.items():
        sums = sums.join(F.broadcast(rate_over(rf, months, at).withColumnRenamed("value", f"level_{w}")))  # one row each
    levels = F.struct(*(F.col(f"level_{w}").alias(w) for w in artifact.RELATIVE_WINDOWS))
    carried = F.struct(end(F.col("last")).alias("last_published"), end(F.col("top")).alias("extended_through"), F.col("carried").alias("n_extended"), extension_basis(end(F.col("last")), clause).alias("basis"))
    return sums.select(F.lit(name).alias("series_name"), F.lit("monthly").alias("frequency"), end(F.col("top")).alias("last_date"), levels.alias("levels"), F.when(F.col("carried") > 0, carried).alias("extended"))


def _points_by(rows: DataFrame, name: str, date: str = "period_end", value: str = "value") -> DataFrame:
    """(series_id, points): a map from name to the points in order of date."""
    listed = rows.groupBy("series_id", name).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("date"), F.col(value).alias(value)))).alias("p"))
    return listed.groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "p")))).alias("points"))


def panel_artifacts(found: DataFrame, alpha: DataFrame, panels: DataFrame, windows: DataFrame, growth: DataFrame, underwater: DataFrame, years: DataFrame, ranked: DataFrame, histories: DataFrame, names: DataFrame, at: Column) -> DataFrame:
    """(series_id, artifact): the nested JSON of each series. `names` has series_id and any describing columns (nulls stay nulls)."""
    flat = found.groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metrics"))
    alphas = alpha.groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("alpha_"), "window").alias("key"), F.struct(F.col("alpha").alias("value"), "t_stat", "n", "window_start", "window_end").alias("value"))))).alias("alpha"))
    told = windows.join(window_refusals(found), ["series_id", "window"], "left").groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("window", F.struct("n_months", "n_overlap_rf", "n_overlap_benchmark", F.to_json("refused").alias("refused")).alias("value"))))).alias("windows"))
    by_year = years.groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("year").cast("string").alias("year"), "value")))).alias("calendar_years"))
    curve = lambda df, *cs: df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.col("period_end").alias("date"), *cs))).alias("c"))
    standing = ranked.join(histories.groupBy("series_id", "key").agg(F.array_sort(F.collect_list(F.struct(F.col("period_end").alias("date"), F.col("display_pct").alias("pct")))).alias("history")), ["series_id", "key"], "left")
    standing = standing.groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct(F.col("display_pct").alias("pct"), "history").alias("value"))))).alias("ranks"))
    parts = [flat, alphas, told, by_year, _points_by(panels, "panel").withColumnRenamed("points", "rolling"), curve(growth, "series_value", "benchmark_value").withColumnRenamed("c", "growth_10k"), curve(underwater, "depth").withColumnRenamed("c", "underwater"), standing]
    joined = reduce(lambda a, b: a.join(b, "series_id", "left"), parts, names)
    rest = [F.col(f"`{c}`") for c in names.columns if c != "series_id"]
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), at.alias("as_of"), F.col("series_id"), *rest, "metrics", "calendar_years", "alpha", "rolling", F.struct("growth_10k", "underwater").alias("series"), "ranks", "windows")
    return joined.select("series_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("artifact"))


def universe_artifact(values: DataFrame, disclosure: DataFrame, category: str, yardstick: str, at: Column) -> DataFrame:
    """One row: the JSON head of an artifact, with the cohort's size and aggregates and the rate's disclosure."""
    sums = peer.category_aggregate(values, ["key"])
    held = sums.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct("median", "q1", "q3").alias("value"))))).alias("aggregates"))
    count = values.agg(F.countDistinct("series_id").alias("count"))
    joined = held.join(F.broadcast(count)).join(F.broadcast(disclosure.select(F.struct("*").alias("rf"))))  # one row each
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), at.alias("as_of"), F.struct(F.lit(category).alias("category"), "count", F.lit(yardstick).alias("yardstick"), "aggregates", "rf").alias("universe"))
    return joined.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("artifact"))


def parsed(artifacts: DataFrame) -> DataFrame:
    """The facts of stored artifacts, in long form."""
    return artifacts.select(F.from_json("artifact", "series_id string, metrics map<string, double>").alias("x")).select("x.series_id", F.explode("x.metrics").alias("key", "value"))


def point_json(date: Column, value: Column) -> Column:
    return F.to_json(F.struct(F.date_format(date, "yyyy-MM-dd").alias("date"), value.alias("value")), {"ignoreNullFields": "false"})


def point_of(text: Column) -> Column:
    return F.from_json(text, "date date, value double")


def benchmark_of(rows: DataFrame, override: str | None = None, stored: str = "benchmark_id") -> DataFrame:
    """The rows with the benchmark they are measured against: the override, else the stored one; a series with neither raises."""
    chosen = F.coalesce(F.lit(override).cast("string"), F.col(stored))
    return rows.withColumn("against", F.coalesce(chosen, F.raise_error(F.concat(F.lit("no benchmark for "), "series_id")).cast("string")))


def universe(master: DataFrame, category: str, plan: str = "direct", option: str = "growth") -> DataFrame:
    """The members of a cohort."""
    return master.where((F.col("category") == category) & (F.col("plan") == plan) & (F.col("option") == option))
