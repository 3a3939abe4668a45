"""Static pages from stored artifacts: an index with ranks and aggregates, one page per series, and charts as SVG."""

from __future__ import annotations

import html
import json
import os
import shutil
from string import Template

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.text import DASH
from tidemark.plans.artifact import RELATIVE_WINDOWS
from tidemark.plans.commentary import DISPLAY_NAMES

#: Months beyond which a carried risk-free rate is pointed out more strongly.
LONG_EXTENSION = 6
TABLE_WINDOW = "3Y"
WINDOWS = tuple(RELATIVE_WINDOWS)
# Which figures are plain numbers, the rows of a series' table (name, label, whether a share, whether an excess), and the
# aggregates that the index shows.
RATIOS = ("sharpe", "sortino", "calmar", "information_ratio", "beta")
ROWS = (("return", "Return", True, False), ("benchmark_return", "Benchmark Return", True, False), ("excess_return", "Excess Return", True, True), ("volatility", "Volatility", True, False), ("sharpe", "Sharpe", False, False), ("sortino", "Sortino", False, False), ("calmar", "Calmar", False, False), ("tracking_error", "Tracking Error", True, False), ("information_ratio", "Information Ratio", False, False), ("beta", "Beta", False, False))
AGGREGATES = ("return_1Y", "excess_return_1Y", "return_3Y", "excess_return_3Y", "return_5Y", "excess_return_5Y", "volatility_3Y", "sharpe_3Y")


def pct(value: float | None, digits: int = 2) -> str:
    return DASH if value is None or value != value else f"{100 * value:.{digits}f}%"


def pct100(value: float | None, digits: int = 1) -> str:
    """A figure that is already between 0 and 100."""
    return DASH if value is None or value != value else f"{value:.{digits}f}"


def ratio(value: float | None, digits: int = 2) -> str:
    return DASH if value is None or value != value else f"{value:.{digits}f}"


def sort_value(value: float | str | None) -> str:
    """What a table is sorted by; nothing for an absent figure."""
    return "" if value is None else str(value)


def is_ratio(key: Column) -> Column:
    """Whether a figure, with or without its window, is a plain number."""
    return key.rlike(f"^({'|'.join(RATIOS)})(_|$)")


def benchmark_label(code: str) -> str:
    return f"category benchmark ({DISPLAY_NAMES.get(code, code)})"


def metric_rows(facts: DataFrame) -> DataFrame:
    """(series_id, place, label, is_pct, is_excess, window, value): the rows of each series' table. The benchmark's return is the return less
    the excess, so that the three always add up."""
    wide = facts.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    cells = []
    for place, (name, label, is_pct, is_excess) in enumerate(ROWS):
        for w in WINDOWS:
            value = F.col("m")[f"return_{w}"] - F.col("m")[f"excess_return_{w}"] if name == "benchmark_return" else F.col("m")[f"{name}_{w}"]
            cells.append(F.struct(F.lit(place).alias("place"), F.lit(label).alias("label"), F.lit(is_pct).alias("is_pct"), F.lit(is_excess).alias("is_excess"), F.lit(w).alias("window"), value.alias("value")))
    return wide.select("series_id", F.explode(F.array(*cells)).alias("x")).select("series_id", "x.*")


def alpha_cells(alpha: DataFrame, windows: DataFrame) -> DataFrame:
    """(series_id, window, value, t_stat, shown): greyed below the bound of significance, and without figures where the months are too few."""
    joined = alpha.join(windows.select("series_id", "window", "n_months"), ["series_id", "window"], "left")
    state = tx.alpha_cell(F.col("alpha"), F.col("t_stat"), F.col("n_months"))
    kept = lambda c: F.when(state != "suppressed", F.col(c))
    return joined.select("series_id", "window", kept("alpha").alias("value"), kept("t_stat").alias("t_stat"), state.alias("shown"))


def index_table(facts: DataFrame, ranks: DataFrame) -> DataFrame:
    """A row per series with returns, benchmark's and excess returns by window, volatility, Sharpe ratio and rank; the best rank first,
    those without one last, ties by series."""
    wide = facts.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    m, columns = F.col("m"), []
    for w in WINDOWS:
        columns += [m[f"return_{w}"].alias(f"return_{w}"), (m[f"return_{w}"] - m[f"excess_return_{w}"]).alias(f"benchmark_return_{w}"), m[f"excess_return_{w}"].alias(f"excess_return_{w}")]
    rank = ranks.where(F.col("key") == f"return_{TABLE_WINDOW}").select("series_id", F.col("display_pct").alias("rank"))
    return index_rows(wide.select("series_id", *columns, m[f"volatility_{TABLE_WINDOW}"].alias("volatility"), m[f"sharpe_{TABLE_WINDOW}"].alias("sharpe")).join(rank, "series_id", "left"))


def index_rows(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """Ordered by rank, those without one last, ties by series."""
    return rows.orderBy(F.col(rank).asc_nulls_last(), "series_id")


def aggregate_rows(aggregates: DataFrame) -> DataFrame:
    """(place, key, label, is_pct, median, q1, q3) of the figures that the index shows, of (key, median, q1, q3); absent ones are null."""
    spine = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(key).alias("key")) for k, key in enumerate(AGGREGATES)))
    shown = aggregates.sparkSession.range(1).select(F.explode(spine).alias("x")).select("x.place", "x.key")
    return shown.join(aggregates.select("key", "median", "q1", "q3"), "key", "left").select("place", "key", F.replace("key", F.lit("_"), F.lit(" ")).alias("label"), (~is_ratio(F.col("key"))).alias("is_pct"), "median", "q1", "q3")


def nav_entries(names: DataFrame) -> DataFrame:
    """The pairs that a page's list of series shows."""
    return names.select("series_id", F.coalesce("name", "series_id").alias("name")).orderBy("name", "series_id")


def extension_line(months: int | None) -> str | None:
    """What a page says of a carried risk-free rate."""
    if not months:
        return None
    text = f"The risk-free rate is carried forward by {months} month{'s' if months > 1 else ''}."
    return f"Note: {text} Ratios of the latest windows rest on it." if months > LONG_EXTENSION else text


# --- charts ------------------------------------------------------------------------------------------------------------------------------


def dates_values(points: list[dict], value: str = "value") -> tuple[list[str], list[float]]:
    """Dates and values of the points that have one."""
    held = [p for p in points or [] if p.get(value) is not None]
    return [p["date"] for p in held], [p[value] for p in held]


def svg(lines: list[list[float]], dates: list[str], width: int = 640, height: int = 160, band: tuple[float, float] | None = None) -> str | None:
    """Lines over common dates on one scale, with a shaded band if one is given; none without two points."""
    if len(dates) < 2:
        return None
    values = [v for line in lines for v in line] + list(band or ())
    low, span = min(values), (max(values) - min(values)) or 1.0
    y = lambda v: f"{height - height * (v - low) / span:.1f}"
    shade = f'<rect x="0" width="{width}" y="{y(band[1])}" height="{height * (band[1] - band[0]) / span:.1f}" fill="currentColor" opacity="0.1"/>' if band else ""
    drawn = "".join(f'<polyline fill="none" stroke="currentColor"{" stroke-dasharray=\'4 3\'" if k else ""} points="{" ".join(f"{width * x / (len(line) - 1):.1f},{y(v)}" for x, v in enumerate(line))}"/>' for k, line in enumerate(lines))
    return f'<svg viewBox="0 0 {width} {height}" role="img"><title>{dates[0]} to {dates[-1]}</title>{shade}{drawn}</svg>'


def svg_line(points: list[tuple[str, float]], width: int = 640, height: int = 160) -> str | None:
    """A line chart of (date, value) pairs."""
    return svg([[v for _, v in points]], [d for d, _ in points], width, height)


def growth_chart(entry: dict) -> str | None:
    points = entry["series"]["growth_10k"]
    dates, own = dates_values(points, "series_value")
    return svg([own, dates_values(points, "benchmark_value")[1]], dates)


def drawdown_chart(entry: dict) -> str | None:
    dates, values = dates_values(entry["series"]["underwater"], "depth")
    return svg([values], dates)


def excess_chart(entry: dict) -> str | None:
    dates, values = dates_values((entry["rolling"] or {}).get("rolling_excess_return_1Y"))
    return svg([values, [0.0] * len(values)], dates)


def rank_chart(entry: dict) -> str | None:
    """Where the rolling Sharpe ratio has ranked, over the band of the middle half; the best rank is on top."""
    dates, values = dates_values(((entry["ranks"] or {}).get("sharpe_3Y") or {}).get("history"), "pct")
    return svg([[-v for v in values]], dates, band=(-75.0, -25.0))


CHARTS = {"Growth of 10,000": growth_chart, "Drawdown": drawdown_chart, "Rolling excess return": excess_chart, "Rank of the rolling Sharpe ratio": rank_chart}


def charts(entry: dict) -> dict[str, str | None]:
    return {name: f(entry) for name, f in CHARTS.items()}


# --- pages -------------------------------------------------------------------------------------------------------------------------------

PAGE = Template('<!doctype html><html lang="en"><meta charset="utf-8"><title>$title</title><body><h1>$title</h1>$body<footer>$footer</footer></body></html>')


def page(title: str, body: str, footer: str = "") -> str:
    return PAGE.substitute(title=html.escape(title), body=body, footer=html.escape(footer))


def table(head: list[str], rows: list[list[tuple[str, object]]]) -> str:
    """Rows of (text, what the column is sorted by)."""
    top = "".join(f"<th>{html.escape(h)}</th>" for h in head)
    return f"<table><tr>{top}</tr>" + "".join("<tr>" + "".join(f'<td data-value="{html.escape(sort_value(v))}">{html.escape(t)}</td>' for t, v in r) + "</tr>" for r in rows) + "</table>"


def _entry_page(entry: dict, footer: str, carried: str | None, commentary: str | None) -> str:
    metrics = entry["metrics"]
    rows = []
    for name, label, is_pct, _ in ROWS:
        cells = []
        for w in WINDOWS:
            value = metrics.get(f"{name}_{w}")
            if name == "benchmark_return":
                own, excess = metrics.get(f"return_{w}"), metrics.get(f"excess_return_{w}")
                value = None if own is None or excess is None else own - excess
            cells.append((pct(value) if is_pct else ratio(value), value))
        rows.append([(label, label), *cells])
    cells = []
    for w in WINDOWS:
        alpha, n = (entry["alpha"] or {}).get(f"alpha_{w}"), ((entry["windows"] or {}).get(w) or {}).get("n_months")
        held = alpha is not None and n is not None and n >= tx.MIN_MONTHS
        cells.append((f"{pct(alpha['value'])}{' (not significant)' if abs(alpha['t_stat']) < tx.SIGNIFICANT_T else ''}" if held else DASH, alpha["value"] if held else None))
    rows.append([("Alpha", "Alpha"), *cells])
    ranks = [[(k, k), (pct100((v or {}).get("pct")), (v or {}).get("pct"))] for k, v in sorted((entry["ranks"] or {}).items())]
    parts = [table(["", *WINDOWS], rows), f"<p>{html.escape(commentary)}</p>" if commentary else "", table(["rank", "percentile"], ranks)]
    parts += [f"<h2>{html.escape(n)}</h2>{c}" for n, c in charts(entry).items() if c]
    return page(entry.get("name") or entry["series_id"], "".join(parts), " ".join(x for x in (footer, carried) if x))


def render_site(artifacts: DataFrame, head: DataFrame, folder: str, texts: DataFrame | None = None) -> int:
    """Write index.html, a page per series and the artifact itself below a local folder; the number of series. Artifacts come one at a time,
    so the driver holds one page and the index, which has a row per series."""
    os.makedirs(folder, exist_ok=True)
    top = json.loads(head.first()["artifact"])
    universe = top["universe"]
    rate = universe["rf"] or {}
    carried = extension_line((rate.get("extended") or {}).get("n_extended"))
    footer = f"As of {top['as_of']}, against the {benchmark_label(universe['yardstick'])}; risk-free rate: {rate.get('series_name')}."
    rows = artifacts.select("series_id", "artifact", F.lit(None).cast("string").alias("text")) if texts is None else artifacts.join(texts.select("series_id", "text"), "series_id", "left")
    listed = []
    with open(os.path.join(folder, "artifacts.jsonl"), "w", encoding="utf-8") as out:
        for k, r in enumerate(rows.select("series_id", "artifact", "text").orderBy("series_id").toLocalIterator()):
            entry = json.loads(r["artifact"])
            out.write(r["artifact"] + "\n")
            with open(os.path.join(folder, f"series-{k}.html"), "w", encoding="utf-8") as f:
                f.write(_entry_page(entry, footer, carried, r["text"]))
            listed.append((((entry["ranks"] or {}).get(f"return_{TABLE_WINDOW}") or {}).get("pct"), entry.get("name") or entry["series_id"], k, entry["metrics"]))
    listed.sort(key=lambda x: (x[0] is None, x[0] or 0.0, x[1]))
    body = table(["Rank", "Series", *(f"{n} {w}" for w in WINDOWS for n in ("Return", "Excess")), "Volatility", "Sharpe"], [[(pct100(rank), rank), (name, name), *((pct(m.get(f"{n}_{w}")), m.get(f"{n}_{w}")) for w in WINDOWS for n in ("return", "excess_return")), (pct(m.get(f"volatility_{TABLE_WINDOW}")), m.get(f"volatility_{TABLE_WINDOW}")), (ratio(m.get(f"sharpe_{TABLE_WINDOW}")), m.get(f"sharpe_{TABLE_WINDOW}"))] for rank, name, _, m in listed])
    links = "".join(f'<li><a href="series-{k}.html">{html.escape(name)}</a></li>' for _, name, k, _ in listed)
    shown = []
    for key in AGGREGATES:
        held, show = universe["aggregates"].get(key) or {}, ratio if key.rsplit("_", 1)[0] in RATIOS else pct
        shown.append([(key.replace("_", " "), key), *((show(held.get(q)), held.get(q)) for q in ("median", "q1", "q3"))])
    with open(os.path.join(folder, "index.html"), "w", encoding="utf-8") as f:
        f.write(page(f"{universe['category']}: {universe['count']} series", f"<ul>{links}</ul>{body}{table(['', 'median', 'q1', 'q3'], shown)}", " ".join(x for x in (footer, carried) if x)))
    return len(listed)


def clear(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)
