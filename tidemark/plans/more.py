"""Further registered queries: the assembled artifact, commentary, pages, sources and sinks, weights and cash flows, each beside its SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions import text
from tidemark.operators import cashflows, holdings, metrics, panel, rolling
from tidemark.plans import adapters, artifact, assembly, build, checks, commentary, site
from tidemark.plans.queries import _ALPHA, _CAL_WINDOWS, _FIGURES, _LV, _OBS, _REL, _RISK, _ROWS24, _panels, _roll, _with, q8, query, r8
from tidemark.sources import ingest


def shown(name: str, value: Column | None = None) -> Column:
    """Seven significant digits, for figures of any size."""
    return F.format_string("%.6e", (F.col(name) if value is None else value) + F.lit(0.0)).alias(name)


def s7(expression: str, name: str) -> str:
    return f"CASE WHEN {expression} IS NULL THEN 'null' ELSE printf('%.6e', {expression} + 0.0) END AS {name}"


def _shown(name: str, value: Column | None = None) -> Column:
    x = F.col(name) if value is None else value
    return F.when(x.isNull(), F.lit("null")).otherwise(shown(name, x)).alias(name)


# --- the assembled artifact --------------------------------------------------------------------------------------------------------------

_YARDSTICK = f", ylv AS ({_LV['market']})" + re.sub(r"\bfe\b", "ye", re.sub(r"\bfs\b", "ys", re.sub(r"\bfa\b", "ya", _FIGURES.format(lv="ylv", name="fy").replace("fp AS (", "fp2 AS ("))))
_OBSERVED = re.sub(r"\bwn\b", "wo", _OBS + _REL.rstrip() + _ALPHA)
_FACT_PARTS = [
    *(f"SELECT series_id, 'return_{n}M' AS key, product(1 + r) FILTER (ym > am - {n}) - 1 AS value FROM pn, ao WHERE ym <= am GROUP BY series_id, am HAVING max(ym) = am AND count(*) >= {n}" for n in assembly.TRAILING),
    "SELECT series_id, 'return_YTD', product(1 + r) - 1 FROM pn, ao WHERE year(period_end) = year(a) AND period_end <= a GROUP BY series_id, a HAVING max(period_end) = a",
    *(f"SELECT series_id, '{m}_' || \"window\", {m} FROM rs" for m in assembly.RISK),
    *(f"SELECT series_id, '{m}_SI', {m} FROM rs WHERE \"window\" = 'SI'" for m in assembly.SHAPE),
    "SELECT series_id, 'max_drawdown_SI', min(d) FROM (SELECT series_id, CAST(level AS DOUBLE) / max(CAST(level AS DOUBLE)) OVER (PARTITION BY series_id ORDER BY date) - 1 d FROM lv) GROUP BY 1",
    "SELECT series_id, 'var95_SI', quantile_cont(r, 0.05) FROM dk GROUP BY 1",
    "SELECT series_id, 'cvar95_SI', avg(r) FILTER (k <= floor((n - 1) * 0.05::DOUBLE) + 1) FROM dk GROUP BY 1",
    "SELECT series_id, 'return_' || period, value FROM fg",
    "SELECT fg.series_id, 'excess_return_' || fg.period, fg.value - fy.value FROM fg LEFT JOIN fy USING (period) WHERE fg.period <> 'SI'",
    "SELECT fg.series_id, 'benchmark_return_' || fg.period, fy.value FROM fg LEFT JOIN fy USING (period) WHERE fg.period <> 'SI'",
    *(f"SELECT series_id, 'rf_{w}', (SELECT CASE WHEN count(f) = {n} AND max(ym) = max(am) THEN pow(product(1 + f), 12.0 / {n}) - 1 END FROM rf, ao WHERE ym <= am AND ym > am - {n}) FROM (SELECT DISTINCT series_id FROM pn)" for w, n in artifact.RELATIVE_WINDOWS.items()),
    *(f"SELECT series_id, '{m}_' || \"window\", {m} FROM rl" for m in ("tracking_error", "information_ratio", "beta")),
]
_FACTS = (
    _with("type", market=True).rstrip() + _CAL_WINDOWS + _RISK.rstrip() + _OBSERVED.rstrip() + _FIGURES.format(lv="lv", name="fg").rstrip() + _YARDSTICK.rstrip()
    + ", dk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY r) k, count(*) OVER (PARTITION BY series_id) n FROM (SELECT series_id, CAST(level AS DOUBLE) / lag(CAST(level AS DOUBLE)) OVER (PARTITION BY series_id ORDER BY date) - 1 r FROM lv) WHERE r IS NOT NULL)"
    + ",\nfx AS (" + " UNION ALL ".join(_FACT_PARTS) + f"),\nft AS (SELECT s.series_id, k.key, fx.value FROM (SELECT DISTINCT series_id FROM lv) s CROSS JOIN (SELECT unnest({list(assembly.FACT_KEYS)}) AS key) k LEFT JOIN fx ON fx.series_id = s.series_id AND fx.key = k.key),\n"
    + "al2 AS (SELECT series_id, \"window\", pow(1 + a, 12) - 1 alpha, a / (sqrt(sse / (n - 2)) * sqrt(1.0 / n + mx * mx / (n * vx))) t, n, s, e FROM al),\n"
    + f"rv AS (SELECT key, series_id, value FROM ft WHERE key IN ({', '.join(repr(k) for k in assembly.RANKED)}) UNION ALL SELECT 'alpha_' || w, s.series_id, alpha FROM (SELECT DISTINCT series_id FROM lv) s CROSS JOIN (SELECT unnest(['1Y', '3Y', '5Y']) AS w) w LEFT JOIN al2 ON al2.series_id = s.series_id AND al2.\"window\" = w.w)\n"
)


def _assembled(spark: SparkSession, sf_dir: str) -> dict:
    """Everything that the artifact is made of, for the type series against the whole market."""
    levels, rows = _panels(spark, sf_dir)
    rows = scratch.materialise(rows, "panel")
    against = adapters.market_levels(spark, sf_dir)
    other = scratch.materialise(panel.panel(against).select("ym", "period_end", F.col("r").alias("rb")), "returns")
    rf, at = adapters.rate(rows), F.lit(adapters.as_of(rows))
    facts, alpha = assembly.facts(levels, rows, against, other, rf, at)
    return {"levels": levels, "rows": rows, "other": other, "rf": rf, "at": at, "facts": facts, "alpha": alpha}


#: The scratch tables of the last artifacts made of a folder, and what reads them.
_kept: dict[tuple[str, str], tuple[set[str], tuple[dict, DataFrame, DataFrame]]] = {}


def _artifacts(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame, DataFrame]:
    """What the artifact is made of, the artifacts and their head; made once per folder while its scratch tables are there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept or not _kept[key][0] <= scratch.held():
        before = scratch.held()
        out = _make(spark, sf_dir)
        _kept[key] = (scratch.held() - before, out)
    return _kept[key][1]


def _make(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame, DataFrame]:
    m = _assembled(spark, sf_dir)
    panels = scratch.materialise(assembly.points(m["rows"], m["other"], m["rf"]), "points")
    values = scratch.materialise(assembly.ranked_values(m["facts"], m["alpha"]), "values")
    windows = artifact.window_disclosure(m["rows"], m["rf"], m["other"], m["at"])
    names = m["levels"].select("series_id").distinct().select("series_id", F.concat("series_id", F.lit(" Fund - Direct Plan - Growth")).alias("name"), F.lit("House").alias("house"), F.lit("market").alias("yardstick"))
    made = assembly.panel_artifacts(m["facts"], m["alpha"], panels, windows, artifact.growth(m["rows"], m["other"]), artifact.underwater(m["rows"]), assembly.calendar_years(m["rows"], m["at"]), assembly.ranks(values), assembly.rank_histories(panels), names, m["at"])
    head = assembly.universe_artifact(values, assembly.rate_disclosure(m["rf"], ingest.RATE_ID, m["at"]), "types", "market", m["at"])
    return m, scratch.materialise(made, "artifacts"), scratch.materialise(head, "universe")


@query(_FACTS + f"SELECT series_id, key, {s7('value', 'value')} FROM ft")
def panel_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of every series, as its nested JSON artifact gives them back."""
    return assembly.parsed(_artifacts(spark, sf_dir)[1]).select("series_id", "key", _shown("value"))


@query(_FACTS + f"SELECT 'median' AS part, key, {s7('quantile_cont(value, 0.5)', 'value')} FROM rv GROUP BY key UNION ALL SELECT 'q1', key, {s7('quantile_cont(value, 0.25)', 'value')} FROM rv GROUP BY key UNION ALL SELECT 'q3', key, {s7('quantile_cont(value, 0.75)', 'value')} FROM rv GROUP BY key UNION ALL SELECT 'count', 'series', printf('%.6e', count(DISTINCT series_id)::DOUBLE) FROM lv UNION ALL SELECT 'rate', replace(key, 'rf_', ''), {s7('any_value(value)', 'value')} FROM ft WHERE key LIKE 'rf_%' GROUP BY key")
def universe_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort's size, aggregates and rate levels, as the JSON head gives them back."""
    head = _artifacts(spark, sf_dir)[2].select(F.from_json("artifact", "universe struct<count: long, aggregates: map<string, struct<median: double, q1: double, q3: double>>, rf: struct<levels: map<string, double>>>")["universe"].alias("u"))
    held = head.select(F.explode("u.aggregates").alias("key", "a")).select(F.explode(F.array(*(F.struct(F.lit(q).alias("part"), F.col("key"), F.col(f"a.{q}").alias("value")) for q in ("median", "q1", "q3")))).alias("x")).select("x.*")
    rest = head.select(F.lit("count").alias("part"), F.lit("series").alias("key"), F.col("u.count").cast("double").alias("value")).unionByName(head.select(F.lit("rate").alias("part"), F.explode("u.rf.levels").alias("key", "value")))
    return held.unionByName(rest).select("part", "key", _shown("value"))


@query(_FACTS + f"SELECT series_id, \"window\", {s7('alpha', 'alpha')}, {s7('t', 't_stat')}, n, CASE WHEN n < 24 THEN 'suppressed' WHEN abs(t) < 2 THEN 'greyed' ELSE 'shown' END AS shown FROM al2")
def alpha_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alphas as the artifact holds them, and whether a page shows, greys or withholds them."""
    entries = commentary.entries(_artifacts(spark, sf_dir)[1]).select("series_id", F.explode("alpha").alias("key", "a"))
    rows = entries.select("series_id", F.replace("key", F.lit("alpha_"), F.lit("")).alias("window"), "a.*")
    return rows.select("series_id", "window", _shown("alpha", F.col("value")), _shown("t_stat"), "n", text.alpha_cell(F.col("value"), F.col("t_stat"), F.col("n")).alias("shown"))


_DIRECTION = f"CASE WHEN key IN ({', '.join(repr(k) for k, b in assembly.RANKED.items() if not b)}) THEN -value ELSE value END"


@query(_FACTS + f"SELECT key, series_id, {q8('CASE WHEN value IS NOT NULL THEN least(100, greatest(0, 100 + 100.0 / n - p)) END', 'display_pct')} FROM (SELECT *, 100 * cume_dist() OVER (PARTITION BY key, value IS NULL ORDER BY {_DIRECTION}) p, count(*) OVER (PARTITION BY key, value IS NULL) n FROM rv)")
def universe_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display percentiles of all ranked keys, each in its own direction, as the artifact holds them."""
    entries = commentary.entries(_artifacts(spark, sf_dir)[1]).select("series_id", F.explode("ranks").alias("key", "r"))
    return entries.select("key", "series_id", r8("display_pct", F.col("r.pct")))


def _sharpe_roll(n: int) -> str:
    rows = _ROWS24.replace("23 PRECEDING", f"{n - 1} PRECEDING")
    return f"SELECT series_id, 'rolling_sharpe_{n // 12}Y' AS panel, period_end, v AS value FROM (SELECT *, avg(x) {rows} / nullif(stddev_samp(x) {rows}, 0) * sqrt(12) v, row_number() OVER (PARTITION BY series_id ORDER BY ym) k FROM sj) WHERE k >= {n}"


def _plain_roll(n: int, value: str, source: str, name: str) -> str:
    return f"SELECT series_id, '{name}_{n // 12}Y' AS panel, period_end, value FROM (" + _roll(n, value, source).replace("round(", "(").replace(", 8) + 0.0", ")") + ")"


_POINTS = _with("type", market=True).rstrip() + ", ex AS (SELECT pn.series_id, pn.ym, pn.period_end, r - rb x FROM pn JOIN bm USING (ym)), sj AS (SELECT series_id, ym, period_end, r - f x FROM pn JOIN rf USING (ym)), pt AS (SELECT series_id, panel, period_end, CASE WHEN isfinite(value) THEN value END AS value FROM (" + " UNION ALL ".join([*(_plain_roll(n, "r", "pn", "rolling_return") for n in (12, 36, 60)), *(_plain_roll(n, "x", "ex", "rolling_excess_return") for n in (12, 36)), *(_sharpe_roll(n) for n in (12, 36))]) + "))\n"


@query(_POINTS + f"SELECT series_id, panel, period_end, {s7('value', 'value')} FROM pt")
def panel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rolling panels, as the artifact holds them."""
    entries = commentary.entries(_artifacts(spark, sf_dir)[1]).select("series_id", F.explode("rolling").alias("panel", "points"))
    return entries.select("series_id", "panel", F.explode("points").alias("p")).select("series_id", "panel", F.col("p.date").alias("period_end"), _shown("value", F.col("p.value")))


_HISTORY_KEYS = " ".join(f"WHEN '{p}' THEN '{k}'" for k, p in assembly.HISTORY.items())


@query(_POINTS + f"SELECT key, series_id, period_end, {q8('least(100, greatest(0, 100 + 100.0 / n - p))', 'display_pct')} FROM (SELECT *, 100 * cume_dist() OVER (PARTITION BY key, period_end ORDER BY value) p, count(*) OVER (PARTITION BY key, period_end) n FROM (SELECT *, CASE panel {_HISTORY_KEYS} END AS key FROM pt) WHERE key IS NOT NULL AND value IS NOT NULL)")
def rank_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, rows = _panels(spark, sf_dir)
    rows = scratch.materialise(rows, "panel")
    points = scratch.materialise(assembly.points(rows, adapters.benchmark(spark, sf_dir), adapters.rate(rows)), "points")
    return assembly.rank_histories(points).select("key", "series_id", "period_end", r8("display_pct"))


_REFUSED = {"volatility": ("n", 2), "downside_deviation": ("n_rf", 1), "sharpe": ("n_rf", 2), "sortino": ("n_rf", 2), "calmar": ("n", 1), "skew": ("n", 3), "kurtosis": ("n", 4)}


@query(_with("brand", True).rstrip() + ", c AS (SELECT series_id, count(r) n, count(r - f) n_rf FROM pn LEFT JOIN rf USING (ym) GROUP BY 1) " + " UNION ALL ".join(f"SELECT series_id, '{m}' AS metric, 'insufficient_history(required={k}, available=' || {c} || ')' AS reason FROM c WHERE {c} < {k}" for m, (c, k) in _REFUSED.items()))
def refused_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused for want of months since inception, and why."""
    rows = _panels(spark, sf_dir, "brand", True)[1]
    found = metrics.with_refusals(metrics.risk(rows.withColumn("window", F.lit("SI")), adapters.rate(rows)))
    return found.select("series_id", F.explode("refused").alias("metric", "reason"))


@query(_FACTS + ", pv AS (" + " UNION ALL ".join(f"SELECT series_id, {k} AS place, '{label}' AS label, '{w}' AS \"window\", " + (f"max(value) FILTER (key = 'return_{w}') - max(value) FILTER (key = 'excess_return_{w}')" if name == "benchmark_return" else f"max(value) FILTER (key = '{name}_{w}')") + f" AS value, {is_pct} AS is_pct FROM ft GROUP BY 1" for k, (name, label, is_pct, _) in enumerate(site.ROWS) for w in artifact.RELATIVE_WINDOWS) + f") SELECT series_id, CAST(place AS INTEGER) AS place, label, \"window\", is_pct, {s7('value', 'value')} FROM pv")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each series' table of figures."""
    return site.metric_rows(_artifacts(spark, sf_dir)[0]["facts"]).select("series_id", "place", "label", "window", "is_pct", _shown("value"))


@query(_FACTS + ", rk3 AS (SELECT series_id, CASE WHEN value IS NOT NULL THEN least(100, greatest(0, 100 + 100.0 / n - p)) END AS rank FROM (SELECT *, 100 * cume_dist() OVER (PARTITION BY value IS NULL ORDER BY value) p, count(*) OVER (PARTITION BY value IS NULL) n FROM rv WHERE key = 'return_3Y')) SELECT row_number() OVER (ORDER BY rank NULLS LAST, series_id) AS place, series_id, " + q8("rank") + ", " + ", ".join(s7(f"(SELECT value FROM ft WHERE ft.series_id = rk3.series_id AND key = '{k}')", n) for k, n in (("return_1Y", "return_1Y"), ("excess_return_3Y", "excess_return_3Y"), ("volatility_3Y", "volatility"), ("sharpe_3Y", "sharpe"))) + " FROM rk3")
def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index page's rows in their order."""
    m = _artifacts(spark, sf_dir)[0]
    rows = site.index_table(m["facts"], assembly.ranks(assembly.ranked_values(m["facts"], m["alpha"])))
    place = F.row_number().over(panel.Window.orderBy(F.col("rank").asc_nulls_last(), "series_id"))  # a row per series of one cohort
    return rows.withColumn("place", place.cast("long")).select("place", "series_id", r8("rank"), _shown("return_1Y"), _shown("excess_return_3Y"), _shown("volatility"), _shown("sharpe"))


@query(_FACTS + f", ag AS (SELECT key, quantile_cont(value, 0.5) m, quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b FROM rv GROUP BY 1) SELECT CAST(s.place AS INTEGER) AS place, replace(s.key, '_', ' ') AS label, NOT regexp_matches(s.key, '^({'|'.join(site.RATIOS)})(_|$)') AS is_pct, {s7('m', 'median')}, {s7('a', 'q1')}, {s7('b', 'q3')} FROM (SELECT unnest({list(site.AGGREGATES)}) AS key, unnest(range({len(site.AGGREGATES)})) AS place) s LEFT JOIN ag USING (key)")
def aggregate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort's aggregates that the index page shows."""
    m = _artifacts(spark, sf_dir)[0]
    rows = site.aggregate_rows(assembly.peer.category_aggregate(assembly.ranked_values(m["facts"], m["alpha"]), ["key"]))
    return rows.select("place", "label", "is_pct", _shown("median"), _shown("q1"), _shown("q3"))


# --- commentary --------------------------------------------------------------------------------------------------------------------------


@query(_FACTS + ", x AS (SELECT b.series_id, b.key, b.value * r.value AS c FROM ft b JOIN ft r ON b.series_id = r.series_id AND b.key LIKE 'beta_%' AND r.key = replace(b.key, 'beta_', 'benchmark_return_')) SELECT series_id, replace(key, 'beta_', 'beta_contribution_') AS key, round(c, 5) + 0.0 AS value FROM x WHERE c IS NOT NULL")
def beta_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What beta times the benchmark's return explains, as a writer is given it."""
    _, made, head = _artifacts(spark, sf_dir)
    given = commentary.payloads(commentary.entries(made), head).select("series_id", F.explode(F.from_json("payload", "metrics map<string, double>")["metrics"]).alias("key", "value"))
    return given.where("key like 'beta_contribution_%'").select("series_id", "key", (F.round("value", 5) + 0.0).alias("value"))


@query(_POINTS + f"SELECT series_id, panel, min(period_end) AS first, max(period_end) AS last, {s7('min(value)', 'low')}, arg_min(period_end, value) AS low_at, {s7('max(value)', 'high')}, arg_max(period_end, value) AS high_at FROM pt WHERE value IS NOT NULL GROUP BY 1, 2")
def payload_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four points that stand for each rolling panel in a payload."""
    _, made, head = _artifacts(spark, sf_dir)
    point = "struct<date: date, value: double>"
    told = commentary.payloads(commentary.entries(made), head).select("series_id", F.explode(F.from_json("payload", f"rolling_summary map<string, struct<first: {point}, last: {point}, min: {point}, max: {point}>>")["rolling_summary"]).alias("panel", "s"))
    return told.select("series_id", "panel", F.col("s.first.date").alias("first"), F.col("s.last.date").alias("last"), _shown("low", F.col("s.min.value")), F.col("s.min.date").alias("low_at"), _shown("high", F.col("s.max.value")), F.col("s.max.date").alias("high_at"))


@query(_FACTS + """, yr AS (SELECT series_id, count(*) FILTER (v IS NOT NULL) n FROM (SELECT s.series_id, y.y, (SELECT product(1 + r) - 1 FROM pn WHERE pn.series_id = s.series_id AND year(period_end) = y.y) v FROM (SELECT DISTINCT series_id FROM pn) s, (SELECT unnest(range(year(a) - 3, year(a))) y FROM ao) y) GROUP BY 1),
w AS (SELECT series_id, max(value) FILTER (key = 'beta_3Y') b, max(value) FILTER (key = 'benchmark_return_3Y') rb, max(value) FILTER (key = 'volatility_3Y') v3, max(value) FILTER (key = 'volatility_1Y') v1 FROM ft GROUP BY 1),
md AS (SELECT quantile_cont(value, 0.5) FILTER (key = 'volatility_3Y') m3, quantile_cont(value, 0.5) FILTER (key = 'volatility_1Y') m1 FROM rv),
d AS (SELECT w.*, a3.alpha, a3.t, yr.n yn, a3.alpha IS NOT NULL AND b IS NOT NULL AND rb IS NOT NULL AND coalesce((SELECT count(*) FROM wo WHERE wo.series_id = w.series_id AND "window" = '3Y'), 0) >= 24 AS whole, CASE WHEN v3 IS NOT NULL THEN v3 ELSE v1 END vol, CASE WHEN v3 IS NOT NULL THEN m3 ELSE m1 END med FROM w CROSS JOIN md LEFT JOIN (SELECT * FROM al2 WHERE "window" = '3Y') a3 USING (series_id) LEFT JOIN yr USING (series_id))
SELECT series_id, CASE WHEN NOT whole THEN 'young_fund' WHEN rb >= 0 THEN 'bench_up' ELSE 'bench_down' END AS decomposition, CASE WHEN NOT whole OR t IS NULL THEN 'suppressed' WHEN abs(t) < 2 THEN 'insignificant' ELSE 'significant' END AS significance, CASE WHEN vol IS NULL OR med IS NULL THEN 'risk_absolute' WHEN vol > med THEN 'vol_above_median' ELSE 'vol_below_median' END AS risk, CASE WHEN yn >= 2 THEN 'calendar_years' ELSE 'short_history' END AS context FROM d""")
def sentence_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which branch each section of a rule-made paragraph takes."""
    _, made, head = _artifacts(spark, sf_dir)
    universe = head.select(F.from_json("artifact", commentary.UNIVERSE)["universe"]["aggregates"].alias("aggregates"))
    found = commentary.entries(made).join(F.broadcast(universe))  # one row
    return commentary.branches(found, F.col("aggregates")).select("series_id", "decomposition", "significance", "risk", "context")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [CAST(p_size + 91000000 AS VARCHAR)] ELSE [] END AS made_up, p_partkey % 2 = 0 AS quoted FROM part")
def number_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text that its source does not hold, and whether a figure is quoted."""
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 100).alias("share"))
    said = F.concat(F.lit("It rose "), F.format_string("%.2f%%", F.bround(F.col("share") * 100, 2)), F.lit(" and "), (F.col("p_size") + 91_000_000).cast("string"), F.lit(" of "), (F.col("p_partkey") + 5_000_000).cast("string"))
    source = F.to_json(F.struct(F.col("share").alias("a"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") + 91_000_000).alias("b"), F.struct((F.col("p_partkey") + 5_000_000).cast("string").alias("c")).alias("d")))
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("share")).otherwise(F.lit(98_765.4321))
    return rows.select("p_partkey", text.fabricated_numbers(said, source).alias("made_up"), text.is_quoted(other, said).alias("quoted"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text, ' '), '\\n\\s*\\n'), lambda p: trim(p, ' ') <> '')) AS paragraphs, contains(lower(text), 'est') AS hedged FROM documents WHERE text IS NOT NULL")
def paragraph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and hedges of texts."""
    docs = adapters.table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.paragraph_count(F.col("text")).cast("long").alias("paragraphs"), text.has_hedge(F.col("text"), ["EST"]).alias("hedged"))


@query("WITH t AS (SELECT p_partkey, printf('%.2f', p_retailprice) AS a, CAST(p_size AS VARCHAR) AS b FROM part) SELECT p_partkey, 2 AS places, 0 AS none, concat(b, ' of ', a, '.') AS filled FROM t")
def template_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits after the point, and a template with its fields."""
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", F.format_string("%.2f", F.bround("p_retailprice", 2)).alias("a"), F.col("p_size").cast("string").alias("b"))
    return rows.select("p_partkey", text.decimal_places(F.col("a")).alias("places"), text.decimal_places(F.col("b")).alias("none"), text.fill("{size} of {price}.", size=F.col("b"), price=F.col("a")).alias("filled"))


# --- sources and sinks -------------------------------------------------------------------------------------------------------------------


@query(f"WITH lv AS ({_LV['brand']}) SELECT series_id, date, CAST(level AS DECIMAL(18,6)) AS level FROM lv")
def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses, newest first and with a second entry for some dates, written as gzipped JSON, read back and normalised."""
    levels = adapters.brand_levels(spark, sf_dir)
    entry = F.struct(F.date_format("date", "dd-MM-yyyy").alias("date"), F.col("level").cast("string").alias("nav"))
    late = F.struct(F.date_format("date", "dd-MM-yyyy").alias("date"), F.lit("1").alias("nav"))
    both = F.when(F.dayofmonth("date") == 15, F.array(entry, late)).otherwise(F.array(entry))
    held = levels.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", both.alias("e"))), asc=False), lambda x: x["e"]).alias("e"))
    raw = held.select(F.lit("House").alias("fund_house"), F.col("series_id").alias("scheme_code"), F.lit("X - Direct Plan - Growth").alias("scheme_name"), F.lit("Equity - Flexi Cap Fund").alias("scheme_category"), F.lit("01-02-1994").alias("scheme_start_date"), F.flatten("e").alias("data"))
    path = scratch.scratch_path(spark, "raw")
    ingest.write_shards(raw, path)
    return ingest.normalise(spark.read.schema(ingest.RAW).json(path))


@query("SELECT p_partkey AS series_id_, 'flexi_cap' AS category, 'direct' AS plan, 'growth' AS option, CASE p_size % 3 WHEN 0 THEN DATE '2013-02-01' WHEN 1 THEN DATE '2014-03-05' END AS inception_date FROM part")
def master_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension rows from raw responses, whose start date comes as text, as an object or not at all."""
    start = F.when(F.col("p_size") % 3 == 0, F.lit("01-02-2013")).when(F.col("p_size") % 3 == 1, F.lit('{"date": "05-03-2014", "nav": "10"}')).otherwise(F.lit("n/a"))
    raw = adapters.table(spark, sf_dir, "part").select(F.lit("H").alias("fund_house"), F.col("p_partkey").cast("string").alias("scheme_code"), F.concat("p_name", F.lit(" - Direct Plan - Growth")).alias("scheme_name"), F.lit("Equity Scheme - Flexi Cap Fund").alias("scheme_category"), start.alias("scheme_start_date"))
    return ingest.master_records(raw).select(F.col("series_id").cast("long").alias("series_id_"), "category", "plan", "option", "inception_date")


@query(f"WITH lv AS ({_LV['type']}) SELECT series_id, date, CAST(level AS DECIMAL(18,6)) AS level FROM lv WHERE series_id IN ('ECONOMY', 'PROMO')")
def landed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels landed as a sorted table and read through the guarded catalogue, for the series asked for."""
    root = scratch.scratch_path(spark, "root")
    ingest.land(adapters.type_levels(spark, sf_dir), f"{root}/levels.parquet")
    catalog = ingest.Catalog(spark, root)
    return catalog.panel(["ECONOMY", "PROMO"])


@query("WITH m AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS period_end FROM orders) SELECT 'risk-free' AS series_id, CAST(year(period_end) * 12 + month(period_end) AS INTEGER) AS ym, period_end, round((month(period_end) % 5 + 0.25) / 100, 10) AS f FROM m WHERE month(period_end) <> 7")
def rate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly rate written as a file, in percent and with missing months, and parsed."""
    months = adapters.table(spark, sf_dir, "orders").select(F.last_day(F.col("o_orderdate").cast("date")).alias("d")).distinct()
    value = F.when(F.month("d") == 7, F.lit("NA")).otherwise((F.month("d") % 5 + F.lit(0.25)).cast("decimal(6,2)").cast("string"))
    path = scratch.scratch_path(spark, "rate")
    months.select(F.date_format("d", "yyyy-MM").alias("Date"), F.lit("0").alias("SMB"), value.alias("RF")).coalesce(1).write.option("header", True).csv(path)
    return ingest.risk_free(spark, path).withColumn("f", F.round("f", 10))


@query(f"WITH lv AS ({_LV['market']}) SELECT 'IX' AS series_id, date, CAST(level AS DECIMAL(18,6)) AS level FROM lv")
def index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written as a file with thousands separators and parsed."""
    levels = adapters.market_levels(spark, sf_dir)
    path = scratch.scratch_path(spark, "index")
    levels.select(F.date_format("date", "dd-MMM-yyyy").alias("Index Date"), F.format_number("level", 2).alias("Total Returns Index")).write.option("header", True).csv(path)
    return ingest.total_return_index(spark, path, "IX")


@query("""WITH b AS (SELECT n_name AS series_id, n_nationkey % 4 AS k FROM nation), t AS (SELECT series_id, CASE WHEN k IN (0, 1) THEN 'T1' END AS t1, CASE WHEN k IN (1, 2) THEN 'ALT' END AS alt FROM b)
SELECT series_id, coalesce(t1, alt) AS benchmark_code, CASE WHEN t1 IS NOT NULL THEN 'tier1' WHEN alt IS NOT NULL THEN 'alternate' END AS benchmark_tier, alt AS benchmark_alternate, 'Y' AS category_yardstick, CASE WHEN t1 IS NOT NULL THEN 'alternate-pending-tier1' WHEN alt IS NOT NULL THEN 'alternate' END AS disclosed FROM t""")
def benchmark_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension with its benchmarks of two tiers from a file, and what is disclosed where the first tier has not landed."""
    nation = adapters.table(spark, sf_dir, "nation").select(F.col("n_name").alias("series_id"), (F.col("n_nationkey") % 4).alias("k"))
    tiers = nation.where("k in (0, 1)").select("series_id", F.lit("T1").alias("benchmark_code"), F.lit("tier1").alias("tier")).union(nation.where("k in (1, 2)").select("series_id", F.lit("ALT"), F.lit("alternate")))
    path = scratch.scratch_path(spark, "map")
    tiers.coalesce(1).write.option("header", True).csv(path)
    master = ingest.with_benchmarks(nation.select("series_id", F.lit("c").alias("category")), ingest.benchmark_map(spark, path), {"c": "Y"})
    landed = master.where("benchmark_code = 'ALT'").select(F.lit("ALT").alias("series_id"))
    told = artifact.benchmark_block(master.select("series_id", "benchmark_code", F.col("benchmark_tier").alias("tier"), F.col("category_yardstick").alias("yardstick")), landed).select("series_id", F.col("tier").alias("disclosed"))
    return master.join(told, "series_id").select("series_id", "benchmark_code", "benchmark_tier", "benchmark_alternate", "category_yardstick", "disclosed")


@query("SELECT CAST(c_custkey AS VARCHAR) AS series_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_nationkey <> 3")
def codes_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to fetch: neither landed nor in the file of failures."""
    customers = adapters.table(spark, sf_dir, "customer")
    named = lambda df, c: df.select(F.col(c).cast("string").alias("series_id"))
    path = scratch.scratch_path(spark, "failed")
    for half in (0, 1):
        ingest.append_failed(customers.where(f"c_nationkey = 3 and c_custkey % 2 = {half}").select(F.col("c_custkey").cast("string").alias("series_id"), F.lit("no data").alias("reason")), path)
    return ingest.remaining(named(customers, "c_custkey"), named(adapters.table(spark, sf_dir, "orders"), "o_custkey"), ingest.read_failed(spark, path))


@query(_with("type").rstrip() + ", top AS (SELECT max(ym) m FROM rf) SELECT CAST(ym AS INTEGER) AS ym, round(f, 10) AS f, FALSE AS extended FROM rf UNION ALL SELECT CAST(m + k AS INTEGER), round((SELECT f FROM rf, top WHERE ym = m), 10), TRUE FROM top, (SELECT unnest(range(1, 4)) k)")
def carried_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk-free rate carried three months beyond its last one."""
    rows = scratch.materialise(_panels(spark, sf_dir)[1], "panel")
    last = rows.agg(F.max("period_end")).first()[0]
    return artifact.extend_rate(adapters.rate(rows), F.add_months(F.lit(last), 3)).select("ym", F.round("f", 10).alias("f"), "extended")


@query(f"WITH lv AS ({_LV['type']}) SELECT series_id, count(*) AS rows, sha256(string_agg(CAST(date AS VARCHAR) || '|' || CAST(CAST(level AS DECIMAL(18,6)) AS VARCHAR), chr(10) ORDER BY date)) AS digest FROM lv GROUP BY 1")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each series' levels."""
    return panel.provenance(adapters.type_levels(spark, sf_dir))


# --- weights, cash flows, checks ---------------------------------------------------------------------------------------------------------


@query(f"WITH lv AS ({_LV['brand']}), e AS (SELECT series_id, min(date) s, max(date) t, CAST(arg_min(level, date) AS DOUBLE) a, CAST(arg_max(level, date) AS DOUBLE) b FROM lv GROUP BY 1) SELECT series_id, round(CASE WHEN t > s THEN pow(b / a, 365.0 / date_diff('day', s, t)) - 1 END, 6) + 0.0 AS rate FROM e WHERE t > s")
def money_weighted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The internal rate of holding each brand from its first to its last level, whose closed form is known."""
    levels = adapters.brand_levels(spark, sf_dir)
    ends = levels.groupBy("series_id").agg(F.min("date").alias("s"), F.max("date").alias("t"), F.min_by("level", "date").alias("a"), F.max_by("level", "date").alias("b")).where("t > s")
    flows = ends.select("series_id", F.col("s").alias("date"), (-F.col("a").cast("double")).alias("amount")).union(ends.select("series_id", "t", F.col("b").cast("double")))
    return cashflows.money_weighted(flows).select("series_id", (F.round("rate", 6) + 0.0).alias("rate"))


_EDGES = "SELECT o_orderpriority AS parent, o_orderstatus AS child, last_day(CAST(o_orderdate AS DATE)) AS as_of, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / 1e9 AS weight FROM orders WHERE month(o_orderdate) IN (3, 9) GROUP BY 1, 2, 3"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "orders").where(F.month("o_orderdate").isin(3, 9))
    return rows.groupBy(F.col("o_orderpriority").alias("parent"), F.col("o_orderstatus").alias("child"), F.last_day(F.col("o_orderdate").cast("date")).alias("as_of")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1e9).alias("weight"))


@query(f"WITH e AS ({_EDGES}), g AS (SELECT CAST(unnest(['1995-01-01', '1996-06-30', '1999-12-31', '2003-01-01']) AS DATE) AS date), d AS (SELECT DISTINCT parent, as_of FROM e), p AS (SELECT DISTINCT parent FROM e), a AS (SELECT p.parent, g.date, d.as_of FROM (SELECT * FROM p, g) p JOIN g USING (date) ASOF JOIN d ON p.parent = d.parent AND p.date >= d.as_of) SELECT a.parent, e.child, a.date, {q8('e.weight', 'weight')} FROM a JOIN e ON a.parent = e.parent AND a.as_of = e.as_of")
def disclosed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the last disclosure on or before the dates of a grid."""
    grid = spark.range(1).select(F.explode(F.array(*(F.lit(d).cast("date") for d in ("1995-01-01", "1996-06-30", "1999-12-31", "2003-01-01")))).alias("date"))
    return cashflows.disclosed_weights(_edges(spark, sf_dir), grid).select("parent", "child", "date", r8("weight"))


@query(f"WITH e AS ({_EDGES}), r AS (SELECT parent, as_of, 1 - sum(weight) w FROM e GROUP BY 1, 2), x AS (SELECT parent, as_of, child, weight FROM e UNION ALL SELECT parent, as_of, 'cash', w FROM r WHERE abs(w) > 1e-12) SELECT parent, as_of, child, {q8('weight')}, CASE WHEN child = 'cash' THEN 'cash' ELSE 'stock' END AS kind FROM x")
def residual_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosures with what they leave of 1 as cash, and the kind of each child."""
    edges = cashflows.with_cash(_edges(spark, sf_dir))
    kinds = cashflows.node_kinds(edges).withColumnRenamed("node", "child")
    return edges.join(kinds, "child").select("parent", "as_of", "child", r8("weight"), "kind")


@query(f"WITH lv AS ({_LV['type']}), g AS (SELECT CAST(unnest(['1994-01-01', '1996-06-30', '1999-12-31']) AS DATE) AS date), s AS (SELECT DISTINCT series_id, length(series_id) AS units, g.date FROM lv, g), v AS (SELECT s.series_id, s.date, coalesce(CAST(lv.level AS DOUBLE) * units, 0) AS v FROM s ASOF LEFT JOIN lv ON s.series_id = lv.series_id AND s.date >= lv.date) SELECT series_id, date, {q8('v / nullif(sum(v) OVER (PARTITION BY date), 0)', 'weight')} FROM v")
def weight_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of held units in the whole at the dates of a grid."""
    levels = adapters.type_levels(spark, sf_dir)
    grid = spark.range(1).select(F.explode(F.array(*(F.lit(d).cast("date") for d in ("1994-01-01", "1996-06-30", "1999-12-31")))).alias("date"))
    units = levels.select("series_id").distinct().withColumn("units", F.length("series_id").cast("double"))
    return cashflows.weight_curves(levels, units, grid).select("series_id", "date", r8("weight"))


@query(_with("type", market=True) + f"SELECT series_id, count(*) AS n, {s7('regr_intercept(r - f, rb - f)', 'intercept')}, {s7('regr_slope(r - f, rb - f)', 'market')} FROM pn JOIN bm USING (ym) JOIN rf USING (ym) GROUP BY 1 HAVING count(*) > 2")
def factor_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings by the normal equations, on one factor, whose closed form SQL has."""
    rows = scratch.materialise(_panels(spark, sf_dir)[1], "panel")
    rf = adapters.rate(rows)
    factor = adapters.benchmark(spark, sf_dir).join(rf, "ym").select("ym", (F.col("rb") - F.col("f")).alias("market"))
    out = cashflows.factor_regression(rows, factor, ["market"], rf).where("n > 2")
    return out.select("series_id", "n", _shown("intercept"), _shown("market"))


@query(_with("type") + f"SELECT a.series_id AS left_id, b.series_id AS right_id, a.period_end, {q8('a.r - b.r', 'gap')} FROM pn a JOIN pn b USING (ym) WHERE a.series_id < b.series_id")
def share_class_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly differences between the two series of each pair."""
    rows = scratch.materialise(_panels(spark, sf_dir)[1], "panel")
    names = rows.select("series_id").distinct()
    listed = names.agg(F.array_sort(F.collect_list("series_id")).alias("all"))
    pairs = names.join(F.broadcast(listed)).select(F.col("series_id").alias("left_id"), F.explode(F.filter("all", lambda x: x > F.col("series_id"))).alias("right_id"))  # six types
    return holdings.plan_gap(rows, pairs).select("left_id", "right_id", "period_end", r8("gap"))


@query(_with("type", market=True).rstrip() + ", j AS (SELECT pn.series_id, ym, pn.period_end, r, rb FROM pn JOIN bm USING (ym)) " + " UNION ALL ".join(f"SELECT series_id, period_end, {n} AS months, {q8('b', 'beta')}, {q8('c', 'correlation')} FROM (SELECT *, covar_pop(r, rb) {w} / nullif(var_pop(rb) {w}, 0) b, corr(r, rb) {w} c, row_number() OVER (PARTITION BY series_id ORDER BY ym) k FROM j) WHERE k >= {n}" for n, w in ((n, _ROWS24.replace("23 PRECEDING", f"{n - 1} PRECEDING")) for n in (12, 36))))
def rolling_pair_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling betas and correlations over one and three years."""
    rows = scratch.materialise(_panels(spark, sf_dir)[1], "panel")
    return rolling.pair_bundle(rows, adapters.benchmark(spark, sf_dir)).select("series_id", "period_end", "months", r8("beta"), r8("correlation"))


@query("SELECT status, count(o_orderkey) AS n FROM (SELECT unnest(['MATCH', 'MISMATCH', 'EXEMPT', 'UNCOMPUTABLE']) AS status) LEFT JOIN orders ON status = CASE WHEN o_orderkey % 7 = 0 THEN 'EXEMPT' WHEN o_orderkey % 2 = 0 THEN 'MATCH' ELSE 'MISMATCH' END GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status with its count, zeros included."""
    key = F.col("o_orderkey")
    status = F.when(key % 7 == 0, "EXEMPT").when(key % 2 == 0, "MATCH").otherwise("MISMATCH")
    return checks.status_counts(adapters.table(spark, sf_dir, "orders").select(status.alias("status")))


@query("SELECT n_name AS series_id, CASE n_nationkey % 3 WHEN 0 THEN 'no levels' ELSE 'levels must be positive' END AS reason FROM nation WHERE n_nationkey % 3 <> 2")
def build_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a cohort that cannot be built, and why."""
    nation = adapters.table(spark, sf_dir, "nation").select(F.col("n_name").alias("series_id"), "n_nationkey")
    levels = adapters.nation_levels(spark, sf_dir).join(F.broadcast(nation), "series_id").where("n_nationkey % 3 <> 0")  # 25 rows
    spine = nation.where("n_nationkey % 3 <> 0").select("series_id", F.lit("1990-01-01").cast("date").alias("date"), F.when(F.col("n_nationkey") % 3 == 1, -1).otherwise(1).cast(panel.LEVEL).alias("level"))
    return build.failures(levels.select("series_id", "date", "level").unionByName(spine), nation)


@query(f"WITH lv AS ({_LV['type']}) SELECT series_id, date, {q8('r', 'step')} FROM (SELECT series_id, date, CAST(level AS DOUBLE) / lag(CAST(level AS DOUBLE)) OVER (PARTITION BY series_id ORDER BY date) - 1 r FROM lv) WHERE abs(r) > 0.5")
def largest_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single steps of more than a half."""
    return checks.largest_steps(adapters.type_levels(spark, sf_dir)).select("series_id", "date", r8("step"))


@query("SELECT n_name AS series_id, n_nationkey % 2 = 0 AS carried FROM nation")
def carried_commentary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commentary of an earlier artifact goes along only if it was made with the same prompt version."""
    nation = adapters.table(spark, sf_dir, "nation").select(F.col("n_name").alias("series_id"), "n_nationkey")
    old = nation.select("series_id", F.lit("text").alias("commentary"), F.when(F.col("n_nationkey") % 2 == 0, "v2").otherwise("v1").alias("prompt_version"))
    return artifact.carry_commentary(nation.select("series_id"), old, "v2").select("series_id", F.col("commentary").isNotNull().alias("carried"))
