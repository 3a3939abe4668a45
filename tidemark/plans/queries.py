"""The registered queries over the star-schema tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import holdings, metrics, panel, peer, record, relative, rolling
from tidemark.plans import adapters, artifact, checks
from tidemark.sources import ingest
from tidemark.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r8(name: str, value: Column | None = None) -> Column:
    """Rounded for comparison between engines, without negative zeros."""
    return (F.round(F.col(name) if value is None else value, 8) + F.lit(0.0)).alias(name)


def q8(expression: str, name: str = "") -> str:
    return f"round({expression}, 8) + 0.0 AS {name or expression}"


_LV = {
    "brand": "SELECT p_brand AS series_id, CAST(l_shipdate AS DATE) AS date, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS level FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "type": "SELECT p_type AS series_id, CAST(l_shipdate AS DATE) AS date, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS level FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "market": "SELECT 'market' AS series_id, CAST(l_shipdate AS DATE) AS date, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS level FROM lineitem GROUP BY 1, 2",
    "nation": "SELECT n_name AS series_id, CAST(o_orderdate AS DATE) AS date, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS level FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
}
_CAL = """
bounds AS (SELECT series_id, min(date) lo, max(date) hi FROM lv GROUP BY 1),
pub AS (SELECT date, count(*) published FROM lv GROUP BY 1),
cal AS (SELECT date, (SELECT count(*) FROM bounds b WHERE pub.date BETWEEN b.lo AND b.hi) active, published FROM pub),
td AS (SELECT * FROM cal WHERE published >= greatest(1, ceil(active / 2.0))),
mc AS (SELECT year(date) * 12 + month(date) ym, max(date) AS close FROM td GROUP BY 1)"""


def _panel(lv: str, name: str, quorum: bool = False) -> str:
    close = "JOIN mc USING (ym) WHERE nx = ym + 1 AND ld >= mc.close" if quorum else "WHERE nx = ym + 1"
    return f"""
{name}_me AS (SELECT series_id, ym, last_day(ld) AS period_end, level FROM (SELECT *, lead(ym) OVER (PARTITION BY series_id ORDER BY ym) nx FROM (SELECT series_id, year(date) * 12 + month(date) AS ym, max(date) ld, arg_max(level, date) AS level FROM {lv} GROUP BY 1, 2)) {close}),
{name} AS (SELECT series_id, ym, period_end, level, CAST(level AS DOUBLE) / CAST(pl AS DOUBLE) - 1 AS r FROM (SELECT *, lag(level) OVER w pl, lag(ym) OVER w py FROM {name}_me WINDOW w AS (PARTITION BY series_id ORDER BY ym)) WHERE ym - py = 1)"""


def _with(kind: str, quorum: bool = False, market: bool = False) -> str:
    """CTEs: lv, pn (its panel), ao (as-of date a), rf, and with the market also bm (ym, rb)."""
    parts = [f"WITH lv AS ({_LV[kind]})"] + ([_CAL] if quorum else []) + [_panel("lv", "pn", quorum)]
    parts.append("ao AS (SELECT max(period_end) a, year(max(period_end)) * 12 + month(max(period_end)) am FROM (SELECT period_end, count(*) n FROM pn GROUP BY 1) WHERE n >= 0.5 * (SELECT count(DISTINCT series_id) FROM pn))")
    parts.append("rf AS (SELECT DISTINCT ym, 0.004::DOUBLE + 0.0005::DOUBLE * (ym % 3) AS f FROM pn)")
    if market:
        parts += [f"mlv AS ({_LV['market']})", _panel("mlv", "mp"), "bm AS (SELECT ym, period_end, r AS rb FROM mp)"]
    return ",\n".join(parts) + "\n"


def _panels(spark: SparkSession, sf_dir: str, kind: str = "type", quorum: bool = False) -> tuple[DataFrame, DataFrame]:
    levels = getattr(adapters, f"{kind}_levels")(spark, sf_dir)
    close = panel.month_close(panel.quorum_calendar(levels)) if quorum else None
    return levels, panel.panel(levels, close)


# --- scans, calendars, month-ends, returns -----------------------------------------------------------------------------------


@query(f"WITH lv AS ({_LV['brand']}) SELECT series_id, date, CAST(level AS DECIMAL(18,6)) AS level FROM lv WHERE series_id IN ('Brand#11', 'Brand#23') AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def scan_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.brand_levels(spark, sf_dir).where(F.col("series_id").isin("Brand#11", "Brand#23"))
    return panel.between(rows, F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date"))


@query(f"WITH lv AS ({_LV['brand']}),{_CAL} SELECT date, active, published FROM td")
def quorum_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.quorum_calendar(adapters.brand_levels(spark, sf_dir))


@query(f"WITH lv AS ({_LV['brand']}),{_CAL} SELECT ym, close FROM mc")
def month_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.month_close(panel.quorum_calendar(adapters.brand_levels(spark, sf_dir)))


@query(f"WITH lv AS ({_LV['brand']}) SELECT DISTINCT date FROM lv")
def own_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.own_calendar(adapters.brand_levels(spark, sf_dir))


@query(_with("brand", True) + "SELECT series_id, ym, period_end, CAST(level AS DECIMAL(18,6)) AS level FROM pn_me")
def month_ends_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = adapters.brand_levels(spark, sf_dir)
    return panel.month_ends(levels, panel.month_close(panel.quorum_calendar(levels)))


@query(_with("brand", True) + f"SELECT series_id, ym, period_end, {q8('r')} FROM pn")
def monthly_returns_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panels(spark, sf_dir, "brand", True)[1].select("series_id", "ym", "period_end", r8("r"))


@query(_with("nation") + f"SELECT series_id, ym, period_end, {q8('r')} FROM pn")
def monthly_returns_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panels(spark, sf_dir, "nation")[1].select("series_id", "ym", "period_end", r8("r"))


@query(f"WITH lv AS ({_LV['type']}) SELECT series_id, date, {q8('CAST(level AS DOUBLE) / CAST(pl AS DOUBLE) - 1', 'r')} FROM (SELECT *, lag(level) OVER (PARTITION BY series_id ORDER BY date) pl FROM lv) WHERE pl IS NOT NULL")
def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.daily_returns(adapters.type_levels(spark, sf_dir)).select("series_id", "date", r8("r"))


@query(_with("type") + f"SELECT series_id, ym, {q8('100 * product(1 + r) OVER (PARTITION BY series_id ORDER BY ym)', 'index_level')} FROM pn")
def value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.to_index(_panels(spark, sf_dir)[1]).select("series_id", "ym", r8("index_level"))


@query(f"WITH lv AS ({_LV['brand']}), an AS (SELECT series_id, anchor FROM (SELECT DISTINCT series_id FROM lv), (SELECT CAST(unnest(['1994-06-30', '1996-02-29', '1999-12-31', '2005-01-01']) AS DATE) AS anchor)) SELECT an.series_id, an.anchor, CAST(lv.level AS DECIMAL(18,6)) AS level, lv.date AS level_date FROM an ASOF LEFT JOIN lv ON an.series_id = lv.series_id AND an.anchor >= lv.date")
def as_of_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = adapters.brand_levels(spark, sf_dir)
    days = F.array(*(F.lit(d).cast("date") for d in ("1994-06-30", "1996-02-29", "1999-12-31", "2005-01-01")))
    return panel.as_of(levels, levels.select("series_id").distinct().select("series_id", F.explode(days).alias("anchor")))


@query(_with("nation") + "SELECT a AS as_of FROM ao")
def inferred_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.infer_as_of(_panels(spark, sf_dir, "nation")[1])


@query(f"""WITH lv AS ({_LV['type']}), lf AS (SELECT * FROM lv WHERE date >= DATE '1996-01-01'), {_panel("lf", "pf")[1:]},
d AS (SELECT series_id, date, 'daily' AS grain, CAST(level AS DOUBLE) / lag(CAST(level AS DOUBLE)) OVER (PARTITION BY series_id ORDER BY date) - 1 AS r FROM lf),
m AS (SELECT series_id, period_end AS date, 'monthly' AS grain, CAST(level AS DOUBLE) / lag(CAST(level AS DOUBLE)) OVER (PARTITION BY series_id ORDER BY period_end) - 1 AS r FROM pf_me)
SELECT series_id, date, grain, {q8('r')} FROM d WHERE abs(r) > 0.15 UNION ALL SELECT series_id, date, grain, {q8('r')} FROM m WHERE abs(r) > 0.25""")
def index_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.anomalies(adapters.type_levels(spark, sf_dir), F.lit("1996-01-01").cast("date")).select("series_id", "date", "grain", r8("r"))


# --- figures of record ---------------------------------------------------------------------------------------------------------

_FIGURES = """,
fp AS (SELECT * FROM (VALUES ('1Y', 12), ('3Y', 36), ('5Y', 60), ('SI', NULL)) t(period, months)),
fa AS (SELECT series_id, period, months, CASE WHEN months IS NULL THEN lo ELSE CAST(a - to_months(CAST(months AS INTEGER)) AS DATE) END AS s, a AS e FROM (SELECT series_id, min(date) lo FROM {lv} GROUP BY 1), fp, ao),
fs AS (SELECT fa.*, l.level sl FROM fa ASOF LEFT JOIN {lv} l ON fa.series_id = l.series_id AND fa.s >= l.date),
fe AS (SELECT fs.*, l.level el FROM fs ASOF LEFT JOIN {lv} l ON fs.series_id = l.series_id AND fs.e >= l.date),
{name} AS (SELECT series_id, period, s, e, date_diff('day', s, e) AS days, sl, el, CASE WHEN date_diff('day', s, e) <= 0 THEN NULL WHEN date_diff('day', s, e) < 365 THEN CAST(el AS DOUBLE) / CAST(sl AS DOUBLE) - 1 ELSE pow(CAST(el AS DOUBLE) / CAST(sl AS DOUBLE), CASE WHEN months IS NULL THEN 365.0 / date_diff('day', s, e) ELSE 12.0 / months END) - 1 END AS value FROM fe)
"""


@query(_with("brand").rstrip() + _FIGURES.format(lv="lv", name="fg") + f"SELECT series_id, period, s AS \"start\", e AS \"end\", CAST(sl AS DECIMAL(18,6)) AS start_level, CAST(el AS DECIMAL(18,6)) AS end_level, CAST(days AS INTEGER) AS days, CASE WHEN days < 365 THEN 'absolute' ELSE 'cagr' END AS method, {q8('value')} FROM fg")
def figures_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, rows = _panels(spark, sf_dir, "brand")
    out = record.figures(levels, F.lit(adapters.as_of(rows)))
    return out.withColumn("value", r8("value"))


@query(_with("type").rstrip() + _FIGURES.format(lv="lv", name="fg") + f", ylv AS ({_LV['market']})" + _FIGURES.format(lv="ylv", name="fy").replace("fp AS (", "fp2 AS (").replace("fa AS (", "ya AS (").replace("fa.", "ya.").replace("FROM fa ", "FROM ya ").replace("fs AS (", "ys AS (").replace("fs.", "ys.").replace("FROM fs ", "FROM ys ").replace("fe AS (", "ye AS (").replace("FROM fe)", "FROM ye)") + f"SELECT fg.series_id, fg.period, {q8('fg.value', 'value')}, {q8('fy.value', 'yardstick_value')}, {q8('fg.value - fy.value', 'excess')} FROM fg LEFT JOIN fy USING (period)")
def excess_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, rows = _panels(spark, sf_dir)
    out = record.excess_figures(levels, adapters.market_levels(spark, sf_dir), F.lit(adapters.as_of(rows)))
    return out.select("series_id", "period", r8("value"), r8("yardstick_value"), r8("excess"))


@query(_with("brand") + f"SELECT series_id, {q8('product(1 + r) - 1', 'value')} FROM pn WHERE period_end BETWEEN DATE '1996-01-31' AND DATE '1997-12-31' GROUP BY 1")
def compounded_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.compounded(_panels(spark, sf_dir, "brand")[1], F.lit("1996-01-31").cast("date"), F.lit("1997-12-31").cast("date")).select("series_id", r8("value"))


@query(_with("brand") + f"SELECT series_id, {q8('product(1 + r) - 1', 'value')} FROM pn, ao WHERE year(period_end) = year(a) AND period_end <= a GROUP BY 1, a HAVING max(period_end) = a")
def year_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir, "brand")[1]
    return record.year_to_date(rows, F.lit(adapters.as_of(rows))).select("series_id", r8("value"))


@query(_with("brand") + f"SELECT s.series_id, y.year, {q8('v', 'value')} FROM (SELECT DISTINCT series_id FROM pn) s CROSS JOIN (SELECT unnest([1995, 1996, 1997, 2005]) AS year) y LEFT JOIN (SELECT series_id, year(period_end) yy, product(1 + r) - 1 v FROM pn GROUP BY 1, 2) p ON p.series_id = s.series_id AND p.yy = y.year")
def calendar_year_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.calendar_years(_panels(spark, sf_dir, "brand")[1], [1995, 1996, 1997, 2005]).select("series_id", "year", r8("value"))


@query(_with("type") + " UNION ALL ".join(f"SELECT series_id, '{n}M' AS period, {q8(f'product(1 + r) FILTER (ym > am - {n}) - 1', 'value')} FROM pn, ao WHERE ym <= am GROUP BY series_id, am HAVING max(ym) = am AND count(*) >= {n}" for n in (1, 3, 6)))
def trailing_month_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir)[1]
    at = F.lit(adapters.as_of(rows))
    out = [record.trailing_months(rows, at, n).select("series_id", F.lit(f"{n}M").alias("period"), r8("value")) for n in (1, 3, 6)]
    return out[0].union(out[1]).union(out[2])


# --- risk, tails, drawdowns ------------------------------------------------------------------------------------------------------

_RISK_COLUMNS = ["volatility", "downside_deviation", "sharpe", "sortino", "calmar", "pct_positive", "best_period", "worst_period", "skew", "kurtosis", "total_return"]
_RISK = """, rk AS (SELECT w.*, f, min(dd) OVER (PARTITION BY series_id, "window") low FROM (SELECT *, lv_ / greatest(1, max(lv_) OVER (PARTITION BY series_id, "window" ORDER BY ym)) - 1 dd FROM (SELECT *, product(1 + r) OVER (PARTITION BY series_id, "window" ORDER BY ym) lv_ FROM wn)) w LEFT JOIN rf USING (ym)),
rs AS (SELECT series_id, "window", count(r) n, count(r - f) n_rf, stddev_samp(r) * sqrt(12) volatility, sqrt(avg(pow(least(r - f, 0), 2))) * sqrt(12) downside_deviation, CASE WHEN count(r - f) >= 2 THEN avg(r - f) / nullif(stddev_samp(r - f), 0) * sqrt(12) END sharpe, CASE WHEN count(r - f) >= 2 THEN avg(r - f) * 12 / nullif(sqrt(avg(pow(least(r - f, 0), 2))) * sqrt(12), 0) END sortino, (pow(product(1 + r), 12.0 / count(r)) - 1) / nullif(abs(min(low)), 0) calmar, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) pct_positive, max(r) best_period, min(r) worst_period, CASE WHEN count(r) >= 3 THEN skewness(r) END skew, CASE WHEN count(r) >= 4 THEN kurtosis(r) END kurtosis, product(1 + r) - 1 total_return FROM rk GROUP BY 1, 2)
"""
_RISK_OUT = ", ".join(q8(c) for c in _RISK_COLUMNS)
_CAL_WINDOWS = """, wn AS (SELECT pn.*, "window" FROM (SELECT *, count(*) FILTER (ym <= am) OVER (PARTITION BY series_id) seen, bool_or(ym = am) OVER (PARTITION BY series_id) there FROM pn, ao) pn, (VALUES ('1Y', 12), ('3Y', 36), ('5Y', 60), ('SI', NULL)) v("window", months) WHERE months IS NULL OR (there AND seen >= months AND ym <= am AND ym > am - months))"""


@query(_with("brand", True).rstrip() + ', wn AS (SELECT *, \'SI\' AS "window" FROM pn)' + _RISK + f'SELECT series_id, "window", n, n_rf, {_RISK_OUT} FROM rs')
def risk_metrics_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir, "brand", True)[1]
    out = metrics.risk(rows.withColumn("window", F.lit("SI")), adapters.rate(rows))
    return out.select("series_id", "window", "n", "n_rf", *(r8(c) for c in _RISK_COLUMNS))


@query(_with("type").rstrip() + _CAL_WINDOWS + _RISK + f'SELECT series_id, "window", n, n_rf, {_RISK_OUT} FROM rs')
def core_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir)[1]
    out = artifact.core_metrics(rows, adapters.rate(rows), F.lit(adapters.as_of(rows)))
    return out.select("series_id", "window", "n", "n_rf", *(r8(c) for c in _RISK_COLUMNS))


@query(f"WITH lv AS ({_LV['type']}) SELECT series_id, date, {q8('CAST(level AS DOUBLE) / max(CAST(level AS DOUBLE)) OVER (PARTITION BY series_id ORDER BY date) - 1', 'depth')} FROM lv")
def underwater_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.underwater(adapters.type_levels(spark, sf_dir)).select("series_id", "date", r8("depth"))


@query(f"""WITH lv AS ({_LV['type']}), u AS (SELECT series_id, date, CAST(level AS DOUBLE) x, CAST(level AS DOUBLE) / max(CAST(level AS DOUBLE)) OVER (PARTITION BY series_id ORDER BY date) - 1 dd FROM lv),
t AS (SELECT series_id, dd, date td FROM u QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY dd, date) = 1),
p AS (SELECT u.series_id, t.dd, t.td, u.x px, u.date pd FROM u JOIN t USING (series_id) WHERE u.date <= t.td QUALIFY row_number() OVER (PARTITION BY u.series_id ORDER BY u.x DESC, u.date) = 1),
rc AS (SELECT p.series_id, min(u.date) rd FROM p LEFT JOIN u ON u.series_id = p.series_id AND u.date > p.td AND u.x >= p.px GROUP BY 1)
SELECT series_id, {q8('dd', 'max_drawdown')}, pd AS peak_date, td AS trough_date, rd AS recovery_date, CAST(td - pd AS INTEGER) AS days_to_trough, CAST(rd - td AS INTEGER) AS days_to_recover, CAST(rd - pd AS INTEGER) AS days_under FROM p JOIN rc USING (series_id)""")
def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.drawdown(adapters.type_levels(spark, sf_dir)).withColumn("max_drawdown", r8("max_drawdown"))


@query(f"""WITH lv AS ({_LV['brand']}), d AS (SELECT series_id, CAST(level AS DOUBLE) / lag(CAST(level AS DOUBLE)) OVER (PARTITION BY series_id ORDER BY date) - 1 AS r FROM lv), k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY r) k, count(*) OVER (PARTITION BY series_id) n FROM d WHERE r IS NOT NULL)
SELECT series_id, count(*) AS n, {q8('quantile_cont(r, 0.05)', 'var95')}, {q8('avg(r) FILTER (k <= floor((n - 1) * 0.05::DOUBLE) + 1)', 'cvar95')} FROM k GROUP BY 1""")
def tail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.tail(panel.daily_returns(adapters.brand_levels(spark, sf_dir)))
    return out.select("series_id", "n", r8("var95"), r8("cvar95"))


# --- rolling -------------------------------------------------------------------------------------------------------------------------


def _roll(n: int, value: str, source: str) -> str:
    frame = f"RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if n % 12 == 0 else f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"SELECT series_id, ym, period_end, {n} AS months, {q8(f'pow(p, 12.0 / {n}) - 1', 'value')} FROM (SELECT *, product(1 + {value}) OVER (PARTITION BY series_id ORDER BY ym {frame}) p, row_number() OVER (PARTITION BY series_id ORDER BY ym) k FROM {source}) WHERE k >= {n}"


@query(_with("brand", True) + " UNION ALL ".join(_roll(n, "r", "pn") for n in (12, 18, 36)))
def rolling_returns_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_returns(_panels(spark, sf_dir, "brand", True)[1], (12, 18, 36)).withColumn("value", r8("value"))


@query(_with("type") + " UNION ALL ".join(_roll(n, "r", "pn") for n in (12, 36, 60)))
def rolling_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_returns(_panels(spark, sf_dir)[1]).withColumn("value", r8("value"))


@query(_with("type", market=True).rstrip() + ", ex AS (SELECT pn.series_id, pn.ym, pn.period_end, r - rb x FROM pn JOIN bm USING (ym)) " + _roll(12, "x", "ex"))
def rolling_excess_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_excess(_panels(spark, sf_dir)[1], adapters.benchmark(spark, sf_dir), 12).withColumn("value", r8("value"))


_ROWS24 = "OVER (PARTITION BY series_id ORDER BY ym ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query(_with("type", market=True).rstrip() + f", j AS (SELECT pn.series_id, ym, pn.period_end, r, rb FROM pn JOIN bm USING (ym)) SELECT series_id, ym, period_end, 24 AS months, {q8('b', 'beta')}, {q8('c', 'correlation')} FROM (SELECT *, covar_pop(r, rb) {_ROWS24} / nullif(var_pop(rb) {_ROWS24}, 0) b, corr(r, rb) {_ROWS24} c, row_number() OVER (PARTITION BY series_id ORDER BY ym) k FROM j) WHERE k >= 24")
def rolling_beta_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling.rolling_pairs(_panels(spark, sf_dir)[1], adapters.benchmark(spark, sf_dir), 24)
    return out.select("series_id", "ym", "period_end", "months", r8("beta"), r8("correlation"))


@query(_with("type").rstrip() + f", j AS (SELECT series_id, ym, period_end, r - f x FROM pn JOIN rf USING (ym)) SELECT series_id, ym, period_end, 24 AS months, {q8('v', 'value')} FROM (SELECT *, avg(x) {_ROWS24} / nullif(stddev_samp(x) {_ROWS24}, 0) * sqrt(12) v, row_number() OVER (PARTITION BY series_id ORDER BY ym) k FROM j) WHERE k >= 24")
def rolling_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir)[1]
    return rolling.rolling_sharpe(rows, adapters.rate(rows), 24).withColumn("value", r8("value"))


# --- benchmark-relative ----------------------------------------------------------------------------------------------------------------

_OBS = """, ob AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ym DESC) k, count(*) OVER (PARTITION BY series_id) c, max(ym) OVER (PARTITION BY series_id) top FROM pn, ao WHERE ym <= am),
wn AS (SELECT ob.series_id, ym, period_end, r, "window" FROM ob, (VALUES ('1Y', 12), ('3Y', 36), ('5Y', 60)) v("window", months) WHERE top = am AND c >= months AND k <= months)"""
_REL_COLUMNS = ["mean_excess", "tracking_error", "information_ratio", "beta", "correlation", "r_squared", "treynor", "up_capture", "down_capture", "hit_rate"]


def _cap(sign: str) -> str:
    n = f"nullif(count(*) FILTER (rb {sign} 0), 0)"
    return f"(pow(product(1 + r) FILTER (rb {sign} 0), 12.0 / {n}) - 1) / nullif(pow(product(1 + rb) FILTER (rb {sign} 0), 12.0 / {n}) - 1, 0)"


_REL = f""", rj AS (SELECT wn.series_id, "window", ym, wn.period_end, wn.r r0, CASE WHEN rb IS NOT NULL THEN wn.r END r, rb, f FROM wn LEFT JOIN bm USING (ym) LEFT JOIN rf USING (ym)),
rl AS (SELECT series_id, "window", count(r - rb) n, count(r0 - f) n_rf, avg(r - rb) mean_excess, stddev_samp(r - rb) * sqrt(12) tracking_error, avg(r - rb) * 12 / nullif(stddev_samp(r - rb) * sqrt(12), 0) information_ratio, covar_pop(r, rb) / nullif(var_pop(rb), 0) beta, corr(r, rb) correlation, pow(corr(r, rb), 2) r_squared, avg(r0 - f) * 12 / nullif(covar_pop(r, rb) / nullif(var_pop(rb), 0), 0) treynor, {_cap('>')} up_capture, {_cap('<')} down_capture, avg(CASE WHEN r > rb THEN 1.0 WHEN r IS NULL THEN NULL ELSE 0.0 END) hit_rate FROM rj GROUP BY 1, 2)
"""
_REL_OUT = ", ".join(q8(c) for c in _REL_COLUMNS)
_ALPHA = """, aj AS (SELECT series_id, "window", period_end, r0 - f y, rb - f x FROM rj WHERE rb IS NOT NULL AND f IS NOT NULL),
af AS (SELECT series_id, "window", count(*) n, regr_slope(y, x) b, avg(y) - regr_slope(y, x) * avg(x) a, avg(x) mx, var_pop(x) vx, min(period_end) s, max(period_end) e FROM aj GROUP BY 1, 2),
al AS (SELECT series_id, "window", n, any_value(b) b, any_value(a) a, any_value(mx) mx, any_value(vx) vx, s, e, sum(pow(y - a - b * x, 2)) sse FROM aj JOIN af USING (series_id, "window") GROUP BY series_id, "window", n, s, e)
"""


@query(_with("type", market=True).rstrip() + ', wn AS (SELECT *, \'SI\' AS "window" FROM pn)' + _REL + f'SELECT series_id, "window", n, n_rf, {_REL_OUT} FROM rl')
def relative_metrics_si(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir)[1]
    out = relative.relative(rows.withColumn("window", F.lit("SI")), adapters.benchmark(spark, sf_dir), adapters.rate(rows))
    return out.select("series_id", "window", "n", "n_rf", *(r8(c) for c in _REL_COLUMNS))


@query(_with("type", market=True).rstrip() + _OBS + _REL + f'SELECT series_id, "window", n, n_rf, {_REL_OUT} FROM rl')
def relative_metrics_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir)[1]
    out = artifact.relative_metrics(rows, adapters.benchmark(spark, sf_dir), adapters.rate(rows), F.lit(adapters.as_of(rows)))
    return out.select("series_id", "window", "n", "n_rf", *(r8(c) for c in _REL_COLUMNS))


@query(_with("type", market=True).rstrip() + _OBS + _REL.rstrip() + _ALPHA + f'SELECT series_id, "window", {q8("pow(1 + a, 12) - 1", "alpha")}, round(a / (sqrt(sse / (n - 2)) * sqrt(1.0 / n + mx * mx / (n * vx))), 6) + 0.0 AS t_stat, {q8("b", "beta")}, n, s AS window_start, e AS window_end FROM al')
def jensens_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir)[1]
    windowed = metrics.windows_by_observation(rows, F.lit(adapters.as_of(rows)), artifact.RELATIVE_WINDOWS)
    out = relative.jensens_alpha(windowed, adapters.benchmark(spark, sf_dir), adapters.rate(rows))
    return out.select("series_id", "window", r8("alpha"), (F.round("t_stat", 6) + 0.0).alias("t_stat"), r8("beta"), "n", "window_start", "window_end")


@query(_with("type", market=True) + f"SELECT pn.series_id, pn.ym, pn.period_end, {q8('r - rb', 'excess')} FROM pn JOIN bm USING (ym)")
def excess_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.excess_returns(_panels(spark, sf_dir)[1], adapters.benchmark(spark, sf_dir)).withColumn("excess", r8("excess"))


@query(_with("type", market=True).rstrip() + _OBS + """, g AS (SELECT series_id, "window", count(r) a, count(f) b, count(rb) c FROM wn LEFT JOIN rf USING (ym) LEFT JOIN bm USING (ym) GROUP BY 1, 2)
SELECT s.series_id, w."window", coalesce(a, 0) AS n_months, coalesce(b, 0) AS n_overlap_rf, coalesce(c, 0) AS n_overlap_benchmark FROM (SELECT DISTINCT series_id FROM pn) s CROSS JOIN (SELECT unnest(['1Y', '3Y', '5Y']) AS "window") w LEFT JOIN g ON g.series_id = s.series_id AND g."window" = w."window" """)
def window_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir)[1]
    return artifact.window_disclosure(rows, adapters.rate(rows), adapters.benchmark(spark, sf_dir), F.lit(adapters.as_of(rows)))


@query(_with("type", market=True) + f"SELECT series_id, period_end, {q8('10000 * product(1 + r) OVER w', 'series_value')}, {q8('10000 * product(1 + rb) OVER w', 'benchmark_value')} FROM (SELECT pn.series_id, pn.ym, pn.period_end, r, rb FROM pn JOIN bm USING (ym)) WINDOW w AS (PARTITION BY series_id ORDER BY ym)".replace(", 8)", ", 6)"))
def growth_of_10k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = artifact.growth(_panels(spark, sf_dir)[1], adapters.benchmark(spark, sf_dir))
    return out.select("series_id", "period_end", *((F.round(c, 6) + 0.0).alias(c) for c in ("series_value", "benchmark_value")))


@query(_with("type") + f"SELECT series_id, period_end, {q8('l / max(l) OVER (PARTITION BY series_id ORDER BY ym) - 1', 'depth')} FROM (SELECT *, product(1 + r) OVER (PARTITION BY series_id ORDER BY ym) l FROM pn)")
def underwater_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifact.underwater(_panels(spark, sf_dir)[1]).withColumn("depth", r8("depth"))


# --- peers -------------------------------------------------------------------------------------------------------------------------------

_NATION_VOL = _with("nation").rstrip() + ", vol AS (SELECT series_id, stddev_samp(r) * sqrt(12) v FROM pn GROUP BY 1), vr AS (SELECT r_name AS category, n_name AS series_id, v AS value FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN vol ON series_id = n_name)\n"


def _nation_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir, "nation")[1]
    value = rows.groupBy("series_id").agg((F.stddev_samp("r") * metrics.ROOT).alias("value"))
    names = adapters.table(spark, sf_dir, "nation").join(adapters.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return names.select(F.col("r_name").alias("category"), F.col("n_name").alias("series_id")).join(value, "series_id", "left").select("category", "series_id", "value")


@query(_NATION_VOL + f"SELECT category, series_id, {q8('value')}, {q8('CASE WHEN value IS NOT NULL THEN p END', 'pct')}, {q8('CASE WHEN value IS NOT NULL THEN least(100, greatest(0, 100 + 100.0 / n - p)) END', 'display_pct')} FROM (SELECT *, 100 * cume_dist() OVER (PARTITION BY category, value IS NULL ORDER BY value DESC) p, count(*) OVER (PARTITION BY category, value IS NULL) n FROM vr)")
def peer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = peer.percentile_ranks(_nation_volatility(spark, sf_dir), ["category"], False)
    return out.select("category", "series_id", r8("value"), r8("pct"), r8("display_pct", peer.display_pct(F.col("pct"), F.col("ranked"))))


@query(_NATION_VOL + f"SELECT category, count(value) AS n, {q8('quantile_cont(value, 0.5)', 'median')}, {q8('quantile_cont(value, 0.25)', 'q1')}, {q8('quantile_cont(value, 0.75)', 'q3')} FROM vr GROUP BY 1")
def peer_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peer.category_aggregate(_nation_volatility(spark, sf_dir), ["category"]).select("category", "n", r8("median"), r8("q1"), r8("q3"))


@query(_with("brand", True).rstrip() + ", rr AS (" + _roll(12, "r", "pn") + f") SELECT series_id, period_end, {q8('value')}, {q8('100 * cume_dist() OVER (PARTITION BY period_end ORDER BY value)', 'pct')} FROM rr")
def rank_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = rolling.rolling_return(_panels(spark, sf_dir, "brand", True)[1], 12).withColumn("value", r8("value"))
    return peer.rank_history(points).select("series_id", "period_end", "value", r8("pct"))


# --- checks and ingest -------------------------------------------------------------------------------------------------------------------


@query(f"WITH lv AS ({_LV['nation']}), t AS (SELECT DISTINCT series_id, year(date) * 12 + month(date) ym FROM lv WHERE month(date) NOT IN (3, 7)), b AS (SELECT series_id, min(ym) lo, max(ym) hi FROM t GROUP BY 1), s AS (SELECT series_id, unnest(range(lo + 1, hi)) ym FROM b) SELECT s.series_id, CAST(s.ym AS INTEGER) AS ym, last_day(make_date(CAST((s.ym - 1) // 12 AS INTEGER), CAST((s.ym - 1) % 12 + 1 AS INTEGER), 1)) AS month_end, count(lv.date) AS raw_rows, CASE WHEN count(lv.date) > 0 THEN 'fetch_side' ELSE 'upstream' END AS side FROM s LEFT JOIN t USING (series_id, ym) LEFT JOIN lv ON lv.series_id = s.series_id AND year(lv.date) * 12 + month(lv.date) = s.ym WHERE t.ym IS NULL GROUP BY s.series_id, s.ym")
def hole_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = adapters.nation_levels(spark, sf_dir)
    found = checks.holes(raw.where(~F.month("date").isin(3, 7)))
    return checks.classify_holes(found, raw).select("series_id", F.col("ym").cast("int").alias("ym"), "month_end", "raw_rows", "side")


@query(_with("type", market=True).rstrip() + _OBS + _REL.rstrip() + _ALPHA.rstrip() + f""", rg AS (SELECT wn.series_id, wn."window", stddev_samp(r) * sqrt(12) vol, pow(product(1 + r), 12.0 / count(*)) - 1 ar, pow(product(1 + rb), 12.0 / count(*)) - 1 br, pow(product(1 + f), 12.0 / count(*)) - 1 fr, avg(r - f) / stddev_samp(r - f) * sqrt(12) sh FROM wn JOIN bm USING (ym) JOIN rf USING (ym) GROUP BY 1, 2),
ix AS (SELECT rg.*, tracking_error te, information_ratio ir, beta, pow(1 + a, 12) - 1 alpha FROM rg JOIN rl USING (series_id, "window") JOIN al USING (series_id, "window")),
iy AS (SELECT series_id, "window", 'sharpe' AS rule, sh AS found, (ar - fr) / vol AS expected, greatest(0.03 / vol, 0.15) AS tolerance FROM ix UNION ALL SELECT series_id, "window", 'information_ratio', ir, (ar - br) / te, greatest(0.03 / te, 0.15) FROM ix UNION ALL SELECT series_id, "window", 'alpha', alpha, (ar - br) + (1 - beta) * (br - fr), 0.03 FROM ix)
SELECT series_id, "window", rule, {q8('found')}, {q8('expected')}, {q8('tolerance')}, abs(found - expected) > tolerance AS violated FROM iy""")
def identity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, other = _panels(spark, sf_dir)[1], adapters.benchmark(spark, sf_dir)
    rf = adapters.rate(rows)
    windowed = metrics.windows_by_observation(rows, F.lit(adapters.as_of(rows)), artifact.RELATIVE_WINDOWS)
    both = windowed.join(other.select("ym", "rb"), "ym").join(rf, "ym")
    yearly = lambda c: F.pow(F.product(1 + F.col(c)), F.lit(12.0) / F.count(F.lit(1))) - 1
    x = F.col("r") - F.col("f")
    base = both.groupBy("series_id", "window").agg((F.stddev_samp("r") * metrics.ROOT).alias("volatility"), yearly("r").alias("annual_return"), yearly("rb").alias("benchmark_return"), yearly("f").alias("rf_return"), (F.avg(x) / F.stddev_samp(x) * metrics.ROOT).alias("sharpe"))
    rel = relative.relative(windowed, other, rf).select("series_id", "window", "tracking_error", "information_ratio", "beta")
    alpha = relative.jensens_alpha(windowed, other, rf).select("series_id", "window", "alpha")
    out = checks.identities(base.join(rel, ["series_id", "window"]).join(alpha, ["series_id", "window"]))
    return out.select("series_id", "window", "rule", r8("found"), r8("expected"), r8("tolerance"), "violated")


@query(f"""WITH lv AS ({_LV['type']}), fd AS (SELECT series_id, min(date) lo FROM lv GROUP BY 1),
pb AS (SELECT series_id, period, DATE '1999-06-30' AS as_of, months FROM (SELECT DISTINCT series_id FROM lv UNION ALL SELECT 'UNKNOWN'), (VALUES ('1Y', 12), ('3Y', 36), ('5Y', 60)) t(period, months)),
s AS (SELECT pb.*, CAST(as_of - to_months(CAST(months AS INTEGER)) AS DATE) ws FROM pb), a AS (SELECT s.*, l.level sl FROM s ASOF LEFT JOIN lv l ON s.series_id = l.series_id AND s.ws >= l.date), b AS (SELECT a.*, l.level el FROM a ASOF LEFT JOIN lv l ON a.series_id = l.series_id AND a.as_of >= l.date)
SELECT b.series_id, period, as_of, {q8('100 * (pow(CAST(el AS DOUBLE) / CAST(sl AS DOUBLE), 12.0 / months) - 1)', 'engine_pct')}, CASE WHEN lo IS NULL OR ws < lo OR sl IS NULL THEN 'UNCOMPUTABLE' WHEN period = '3Y' THEN 'EXEMPT' WHEN abs(100 * (pow(CAST(el AS DOUBLE) / CAST(sl AS DOUBLE), 12.0 / months) - 1) - 5) * 100 <= 10 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM b LEFT JOIN fd USING (series_id)""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = adapters.type_levels(spark, sf_dir)
    names = levels.select("series_id").distinct().union(spark.createDataFrame([("UNKNOWN",)], "series_id string"))
    day = F.lit("1999-06-30").cast("date")
    published = names.select("series_id", F.explode(F.array(F.lit("1Y"), F.lit("3Y"), F.lit("5Y"))).alias("period"), F.lit(5).cast("decimal(12,4)").alias("published_pct"), day.alias("as_of"))
    out = checks.reconcile(published, levels, published.where("period = '3Y'"), F.lit("2026-05-31").cast("date"))
    return out.select("series_id", "period", "as_of", r8("engine_pct"), "status")


@query(f"WITH b AS ({_LV['brand']}), a AS (SELECT series_id, date, level, 1 AS landed_at FROM b UNION ALL SELECT series_id, date, CASE WHEN day(date) = 15 THEN level + 1 ELSE level END, 2 FROM b WHERE day(date) >= 15) SELECT series_id, date, CAST(arg_max(level, landed_at) AS DECIMAL(18,6)) AS level FROM a GROUP BY 1, 2")
def landed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = adapters.brand_levels(spark, sf_dir)
    changed = F.when(F.dayofmonth("date") == 15, (F.col("level") + 1).cast(panel.LEVEL)).otherwise(F.col("level"))
    later = levels.where(F.dayofmonth("date") >= 15).select("series_id", "date", changed.alias("level"), F.lit(2).alias("landed_at"))
    return ingest.latest_landed(levels.withColumn("landed_at", F.lit(1)).union(later))[0].select("series_id", "date", "level")


_NAMES = "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' - Direct Plan - Growth' WHEN 1 THEN ' - Regular Plan - IDCW' WHEN 2 THEN ' Direct - Regular - dividend' WHEN 3 THEN ' - Redirect growth dividend' ELSE '' END)"


@query(f"""WITH n AS (SELECT p_partkey, {_NAMES} AS name, concat('Equity Scheme - ', p_type, ' Fund') AS raw FROM part),
h AS (SELECT *, regexp_matches(name, '(?i)\\bdirect\\b') d, regexp_matches(name, '(?i)\\bregular\\b') g, regexp_matches(name, '(?i)\\bgrowth\\b') w, regexp_matches(name, '(?i)\\b(idcw|dividend|income distribution cum capital withdrawal)\\b') i FROM n)
SELECT p_partkey, CASE WHEN d AND NOT g THEN 'direct' WHEN g AND NOT d THEN 'regular' END AS plan, CASE WHEN w AND NOT i THEN 'growth' WHEN i AND NOT w THEN 'idcw' END AS option, nullif(regexp_replace(regexp_replace(regexp_replace(lower(string_split(raw, ' - ')[-1]), '\\b(fund|scheme)s?\\b', ' ', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS category, string_split(name, ' - ')[1] AS short_name FROM h""")
def name_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAMES).alias("name"), F.concat(F.lit("Equity Scheme - "), "p_type", F.lit(" Fund")).alias("raw"))
    name = F.col("name")
    return rows.select("p_partkey", ingest.parse_plan(name).alias("plan"), ingest.parse_option(name).alias("option"), ingest.normalise_category(F.col("raw")).alias("category"), text.short_name(name).alias("short_name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed, CASE WHEN o_orderkey % 3 <> 2 THEN last_day(CAST(o_orderdate AS DATE)) END AS month_end, CAST(o_totalprice AS DECIMAL(18,6)) AS level FROM orders")
def feed_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "orders")
    shape = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise(F.lit("n/a"))
    rows = rows.select("o_orderkey", shape.alias("d"), F.format_number("o_totalprice", 2).alias("p"))
    parsed = ingest.try_dates(F.col("d"), ingest.DATE_FORMATS)
    return rows.select("o_orderkey", parsed.alias("parsed"), F.last_day(parsed).alias("month_end"), ingest.parse_level(F.col("p")).alias("level"))


# --- text, holdings, streaming, relational extras -------------------------------------------------------------------------------------------

_TERMS = ["the", "and", "guarantee", "est", "der"]


@query("SELECT doc_id, [t FOR t IN ['the', 'and', 'guarantee', 'est', 'der'] IF regexp_matches(text, concat('(?i)(^|[^\\p{L}\\p{N}_])', t, '($|[^\\p{L}\\p{N}_])'))] AS hits, len(regexp_extract_all(text, '\\d*\\.\\d+|\\d{2,}')) AS numerals FROM documents")
def text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.vocabulary_hits(F.col("text"), _TERMS).alias("hits"), F.size(text.numeral_tokens(F.col("text"))).cast("long").alias("numerals"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '—' ELSE printf('%.2f%%', p_size / 64.0 * 100) END AS pct, CASE WHEN p_partkey % 11 = 0 THEN '—' ELSE printf('%.2f', p_size / 64.0) END AS ratio, CASE WHEN p_partkey % 11 = 0 THEN 'neutral' WHEN p_size > 25 THEN 'positive' WHEN p_size < 25 THEN 'negative' ELSE 'neutral' END AS sign FROM part")
def presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "part")
    share = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") / F.lit(64.0))
    away = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") - F.lit(25))
    return rows.select("p_partkey", text.show_pct(share).alias("pct"), text.show_ratio(share).alias("ratio"), text.sign_class(away).alias("sign"))


@query(_with("brand", True).rstrip() + f", p AS (SELECT * FROM pn) SELECT series_id, min(period_end) AS first_date, max(period_end) AS last_date, {q8('arg_min(r, period_end)', 'first_value')}, {q8('arg_max(r, period_end)', 'last_value')}, {q8('min(r)', 'low')}, {q8('max(r)', 'high')} FROM p GROUP BY 1")
def summary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.summary_points(_panels(spark, sf_dir, "brand", True)[1], "r")
    return out.select("series_id", F.col("first.date").alias("first_date"), F.col("last.date").alias("last_date"), r8("first_value", F.col("first.value")), r8("last_value", F.col("last.value")), r8("low", F.col("lowest.value")), r8("high", F.col("highest.value")))


@query("""WITH RECURSIVE e AS (SELECT 'ALL' AS parent, r_name AS child, 1.0 / (SELECT count(*) FROM region) AS weight FROM region UNION ALL SELECT r_name, n_name, 1.0 / count(*) OVER (PARTITION BY r_name) FROM nation JOIN region ON n_regionkey = r_regionkey),
w(root, node, x) AS (SELECT parent, child, CAST(weight AS DOUBLE) FROM e UNION ALL SELECT root, child, x * CAST(weight AS DOUBLE) FROM w JOIN e ON parent = node)
SELECT root, node AS leaf, round(sum(x), 8) + 0.0 AS exposure FROM w WHERE node NOT IN (SELECT parent FROM e) GROUP BY 1, 2""")
def look_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = adapters.table(spark, sf_dir, "region"), adapters.table(spark, sf_dir, "nation")
    count = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    top = region.select(F.lit("ALL").alias("parent"), F.col("r_name").alias("child"), (F.lit(1.0) / count).alias("weight"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    low = named.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("r_name"))).alias("weight"))
    return holdings.look_through(top.union(low)).select("root", "leaf", r8("exposure"))


@query(_with("type").rstrip() + f", u AS (SELECT DISTINCT series_id, 1.0 / 6 AS w FROM pn) SELECT ym, period_end, {q8('sum(w * r)', 'r')} FROM pn JOIN u USING (series_id) GROUP BY 1, 2")
def fixed_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir)[1]
    weights = rows.select("series_id").distinct().withColumn("weight", F.lit(1.0 / 6))
    return holdings.blend(rows, weights).select("ym", "period_end", r8("r"))


@query(_with("type").rstrip() + f", g AS (SELECT *, product(1 + r) OVER (PARTITION BY series_id ORDER BY ym) / 6 g FROM pn) SELECT series_id, ym, period_end, {q8('g / sum(g) OVER (PARTITION BY ym)', 'drifted')} FROM g")
def drifting_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panels(spark, sf_dir)[1]
    weights = rows.select("series_id").distinct().withColumn("weight", F.lit(1.0 / 6))
    return holdings.drifted_weights(rows, weights).withColumn("drifted", r8("drifted"))


@query("SELECT date_trunc('day', ts) AS \"start\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.event_counts(adapters.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility and Sharpe ratio of every brand since inception, with their ranks."""
    rows = _panels(spark, sf_dir, "brand")[1]
    found = metrics.risk(rows.withColumn("window", F.lit("SI")), adapters.rate(rows)).select("series_id", "window", "n", "volatility", "sharpe")
    values = artifact.long_metrics(found)
    return artifact.ranks(values, ["metric", "window"])
