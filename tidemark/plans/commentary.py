"""Commentary from stored artifacts: the reduced payload, the gates of a text, sentences by rule, and texts from an injected writer.

All functions take and give columns or tables of artifacts parsed by `entries`; nothing is computed anew, only reduced and compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans.artifact import RELATIVE_WINDOWS

ENTRY = (
    "series_id string, name string, house string, yardstick string, metrics map<string, double>, calendar_years map<string, double>, "
    "alpha map<string, struct<value: double, t_stat: double, n: long, window_start: date, window_end: date>>, "
    "rolling map<string, array<struct<date: date, value: double>>>, "
    "ranks map<string, struct<pct: double, history: array<struct<date: date, pct: double>>>>, "
    "windows map<string, struct<n_months: long, n_overlap_rf: long, n_overlap_benchmark: long, refused: string>>"
)
UNIVERSE = "universe struct<count: long, aggregates: map<string, struct<median: double, q1: double, q3: double>>>"
WINDOWS = tuple(RELATIVE_WINDOWS)
DISPLAY_NAMES = {"market": "Whole Market"}


def entries(artifacts: DataFrame) -> DataFrame:
    """The columns of the stored artifacts."""
    return artifacts.select(F.from_json("artifact", ENTRY).alias("x")).select("x.*")


def n_months(window: str, absent: int | None = None) -> Column:
    """The window's own count of months, never inferred from its name."""
    return F.coalesce(F.col("windows")[window]["n_months"], F.lit(absent).cast("long"))


def display_name(code: Column) -> Column:
    """What a yardstick is called; an unknown one keeps its code."""
    known = F.create_map(*(F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv))
    return F.coalesce(known[code], code)


def summary_of(points: Column, value: str) -> Column:
    """First, last, lowest and highest of the points that have a value, in order of date, the earliest of equals; null without any."""
    points = F.filter(points, lambda p: p[value].isNotNull())
    low = F.array_min(F.transform(points, lambda p: F.struct(p[value].alias("v"), F.unix_date(p["date"]).alias("d"))))
    high = F.array_max(F.transform(points, lambda p: F.struct(p[value].alias("v"), (-F.unix_date(p["date"])).alias("d"))))
    made = lambda date, v: F.struct(date.alias("date"), v.alias(value))
    ends = [made(F.element_at(points, k)["date"], F.element_at(points, k)[value]) for k in (1, -1)]
    out = F.struct(ends[0].alias("first"), ends[1].alias("last"), made(F.date_from_unix_date(low["d"]), low["v"]).alias("min"), made(F.date_from_unix_date(-high["d"]), high["v"]).alias("max"))
    return F.when(F.size(points) > 0, out)


def _present(entries_: Column) -> Column:
    """A map from an array of (key, value) structs without those whose value is null."""
    return F.map_from_entries(F.filter(entries_, lambda e: e["value"].isNotNull()))


def with_contributions(metrics: Column) -> Column:
    """The metrics, and the part of each window's return that beta times the benchmark's return explains."""
    more = F.array(*(F.struct(F.lit(f"beta_contribution_{w}").alias("key"), tx.market_model(metrics[f"beta_{w}"], metrics[f"benchmark_return_{w}"]).alias("value")) for w in WINDOWS))
    return F.map_concat(metrics, _present(more))


def alpha_summary() -> Column:
    """Each window's alpha, with its t-statistic only where the window has enough months."""
    cells = []
    for w in WINDOWS:
        entry = F.col("alpha")[f"alpha_{w}"]
        told = F.struct(entry["value"].alias("value"), F.when(n_months(w) >= tx.MIN_MONTHS, entry["t_stat"]).alias("t_stat"))
        cells.append(F.struct(F.lit(f"alpha_{w}").alias("key"), F.when(entry["value"].isNotNull(), told).alias("value")))
    return _present(F.array(*cells))


def _summaries(named: Column, points: Callable[[Column], Column], value: str) -> Column:
    return _present(F.transform(F.map_entries(named), lambda e: F.struct(e["key"].alias("key"), summary_of(points(e["value"]), value).alias("value"))))


def payloads(found: DataFrame, head: DataFrame) -> DataFrame:
    """(series_id, payload): what a writer is given, as JSON. `head` is the one row of the universe's artifact."""
    universe = head.select(F.from_json("artifact", UNIVERSE)["universe"].alias("universe"))
    rows = found.join(F.broadcast(universe))  # one row
    body = F.struct(
        F.struct("name", F.col("house").alias("fund_house")).alias("fund"),
        display_name(F.col("yardstick")).alias("category_benchmark"),
        with_contributions(F.col("metrics")).alias("metrics"),
        alpha_summary().alias("alpha"),
        "calendar_years",
        F.transform_values("ranks", lambda _, r: r["pct"]).alias("ranks"),
        _summaries(F.col("ranks"), lambda r: r["history"], "pct").alias("rank_history_summary"),
        _summaries(F.col("rolling"), lambda p: p, "value").alias("rolling_summary"),
        "universe",
    )
    return rows.select("series_id", F.to_json(body).alias("payload"))


def _quoted_bare(value: Column, text: Column) -> Column:
    """Whether some paragraph shows the value without a hedge."""
    return F.exists(tx.paragraphs(text), lambda p: tx.is_quoted(value, p) & ~tx.has_hedge(p, list(tx.HEDGES)))


def market_model_violations(text: Column, payload: Column) -> Column:
    """What a text says of betas and alphas against its payload: a quoted contribution must be beta times the benchmark's return; an alpha
    with |t| below the limit may stand only beside a hedge; one whose t-statistic is held back may not stand at all."""
    told = F.from_json(payload, "metrics map<string, double>, alpha map<string, struct<value: double, t_stat: double>>")
    out = []
    for w in WINDOWS:
        share, beta, rb = (told["metrics"][f"{k}_{w}"] for k in ("beta_contribution", "beta", "benchmark_return"))
        expected = tx.market_model(beta, rb)
        out.append(F.when(tx.is_quoted(share, text) & (F.abs(expected - share) > tx.CLOSE), F.lit(f"contribution:{w}")))
        alpha, t = told["alpha"][f"alpha_{w}"]["value"], told["alpha"][f"alpha_{w}"]["t_stat"]
        bare = _quoted_bare(alpha, text)
        out.append(F.when(alpha.isNotNull() & t.isNull() & tx.is_quoted(alpha, text), F.lit(f"suppressed alpha:{w}")).when((F.abs(t) < tx.SIGNIFICANT_T) & bare, F.lit(f"alpha without hedge:{w}")))
    return F.array_compact(F.array(*out))


def violations(text: Column, payload: Column, banned: list[str]) -> Column:
    """Everything that a text breaks; empty for a clean one."""
    return F.concat(tx.commentary_violations(text, payload, banned), market_model_violations(text, payload))


# --- sentences by rule -------------------------------------------------------------------------------------------------------------------

VARIANTS: dict[str, dict[str, tuple[str, ...]]] = {
    "decomposition": {
        "bench_up": ("Its benchmark gained {bench_ret} a year over {window}; at a beta of {beta} that accounts for {mech} of {fund_short}'s {fund_ret}, and {alpha} is left.", "Over {window}, {fund_short} made {fund_ret} a year. A benchmark up {bench_ret} and a beta of {beta} explain {mech}; the rest is {alpha}."),
        "bench_down": ("Its benchmark lost {bench_ret} a year over {window}; at a beta of {beta} that accounts for {mech} of {fund_short}'s {fund_ret}, and {alpha} is left.", "Over {window}, {fund_short} made {fund_ret} a year while its benchmark fell by {bench_ret}; a beta of {beta} explains {mech}, the rest is {alpha}."),
        "young_fund": ("{fund_short} made {fund_ret} in the last year, its benchmark {bench_ret}; the history is too short to take the return apart.",),
    },
    "significance": {
        "significant": ("The remainder's t-statistic is {tstat}, beyond the usual bound.",),
        "insignificant": ("With a t-statistic of {tstat}, the remainder is not statistically distinguishable from zero.",),
        "suppressed": ("",),
    },
    "risk": {
        "vol_above_median": ("Volatility of {vol} lies above the peers' median of {cat_vol}; the deepest fall was {mdd}.",),
        "vol_below_median": ("Volatility of {vol} lies at or below the peers' median of {cat_vol}; the deepest fall was {mdd}.",),
        "risk_absolute": ("Volatility was {vol} and the deepest fall {mdd}.",),
    },
    "context": {
        "calendar_years": ("By calendar year: {cy1} in {cy1_label}, {cy2} in {cy2_label}, {cy3} in {cy3_label}.",),
        "short_history": ("",),
    },
}


def decomposition_window() -> Column:
    """3Y where its alpha, beta and benchmark return are there and it has enough months, else null."""
    m = F.col("metrics")
    whole = F.col("alpha")["alpha_3Y"]["value"].isNotNull() & m["beta_3Y"].isNotNull() & m["benchmark_return_3Y"].isNotNull() & (n_months("3Y", 0) >= tx.MIN_MONTHS)
    return F.when(whole, F.lit("3Y"))


def branches(found: DataFrame, aggregates: Column) -> DataFrame:
    """The entries with one branch per section and the windows they speak of."""
    m, t = F.col("metrics"), F.col("alpha")["alpha_3Y"]["t_stat"]
    rows = found.withColumns({"dec_window": decomposition_window(), "risk_window": F.when(m["volatility_3Y"].isNotNull(), "3Y").otherwise("1Y"), "aggregates_": aggregates})
    vol, median = m[F.concat(F.lit("volatility_"), "risk_window")], F.col("aggregates_")[F.concat(F.lit("volatility_"), "risk_window")]["median"]
    known = F.size(F.filter(F.map_values("calendar_years"), lambda x: x.isNotNull()))
    return rows.withColumns(
        {
            "decomposition": F.when(F.col("dec_window").isNull(), "young_fund").when(m["benchmark_return_3Y"] >= 0, "bench_up").otherwise("bench_down"),
            "significance": F.when(F.col("dec_window").isNull() | t.isNull(), "suppressed").when(F.abs(t) < tx.SIGNIFICANT_T, "insignificant").otherwise("significant"),
            "risk": F.when(vol.isNull() | median.isNull(), "risk_absolute").when(vol > median, "vol_above_median").otherwise("vol_below_median"),
            "context": F.when(known >= 2, "calendar_years").otherwise("short_history"),
        }
    )


def fields() -> dict[str, Column]:
    """Every placeholder's text, from the columns of `branches`; an absent figure is a dash."""
    m, w, risk = F.col("metrics"), F.coalesce("dec_window", F.lit("1Y")), F.col("risk_window")
    of = lambda name, window: m[F.concat(F.lit(f"{name}_"), window)]
    bench = of("benchmark_return", w)
    out = {
        "window": w,
        "fund_short": F.trim(tx.short_name(F.coalesce("name", "series_id"))),
        "fund_ret": tx.show_pct(of("return", w)),
        "bench_ret": tx.show_pct(F.when(F.col("dec_window").isNull(), bench).otherwise(F.abs(bench))),
        "beta": tx.show_ratio(of("beta", w)),
        "mech": tx.show_pct(of("beta", w) * bench),
        "alpha": tx.show_pct(F.col("alpha")["alpha_3Y"]["value"]),
        "tstat": tx.show_ratio(F.col("alpha")["alpha_3Y"]["t_stat"]),
        "vol": tx.show_pct(of("volatility", risk)),
        "cat_vol": tx.show_pct(F.col("aggregates_")[F.concat(F.lit("volatility_"), risk)]["median"]),
        "mdd": tx.show_pct(m["max_drawdown_SI"]),
    }
    latest = F.slice(F.sort_array(F.map_keys("calendar_years")), F.greatest(F.size("calendar_years") - 2, F.lit(1)), 3)
    for k in range(3):
        year = F.get(latest, F.lit(k))
        out |= {f"cy{k + 1}_label": F.coalesce(year, F.lit(tx.DASH)), f"cy{k + 1}": tx.show_pct(F.try_element_at("calendar_years", year))}
    return out


def sentences(found: DataFrame, aggregates: Column, variants: dict = VARIANTS) -> DataFrame:
    """(series_id, text): a paragraph by rule; each section takes the variant that the series' code and the section's name choose, and empty
    parts drop out."""
    rows, known, parts = branches(found, aggregates), fields(), []
    for section, by_branch in variants.items():
        text = F.lit(None).cast("string")
        for branch, choices in by_branch.items():
            made = F.array(*(tx.fill(c, **known) for c in choices))
            text = F.when(F.col(section) == branch, F.get(made, tx.variant_index(F.col("series_id"), section, len(choices)))).otherwise(text)
        parts.append(F.nullif(text, F.lit("")))
    return rows.select("series_id", F.concat_ws(" ", *parts).alias("text"))


# --- texts from a writer -----------------------------------------------------------------------------------------------------------------

Writer = Callable[[str, str | None], str]


def _written(rows: DataFrame, writer: Writer, correction: Column) -> DataFrame:
    """The rows with the writer's text (null where it fails)."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for payload, told in batches:
            out = []
            for p, c in zip(payload, told, strict=True):
                try:
                    out.append(writer(p, c))
                except Exception:  # noqa: BLE001  one series' failure is its own
                    out.append(None)
            yield pd.Series(out, dtype="object")

    return rows.withColumn("text", ask("payload", correction))


def generate(given: DataFrame, writer: Writer, banned: list[str], version: str, model: str, made_at: Column, previous: DataFrame | None = None) -> DataFrame:
    """(series_id, commentary) with one text per payload, null where a second attempt breaks a rule too. With `previous` (series_id,
    commentary), series that have one keep it and only the others are written."""
    from tidemark import scratch

    kept = None
    if previous is not None:
        kept = previous.where("commentary is not null").select("series_id", "commentary")
        given = given.join(kept, "series_id", "left_anti")
    judged = lambda rows: rows.withColumn("broken", F.when(F.col("text").isNull(), F.array(F.lit("no text"))).otherwise(violations(F.col("text"), F.col("payload"), banned)))
    first = scratch.materialise(judged(_written(given, writer, F.lit(None).cast("string"))), "texts")  # a writer is asked once
    again = first.where("size(broken) > 0").withColumn("told", F.array_join("broken", "; "))
    second = scratch.materialise(judged(_written(again, writer, F.col("told")).drop("told")), "texts")
    both = first.where("size(broken) = 0").unionByName(second)
    block = F.struct("text", F.lit(model).alias("model"), F.lit(version).alias("prompt_version"), made_at.alias("generated_at"))
    out = both.select("series_id", F.when(F.size("broken") == 0, block).alias("commentary"))
    return out if kept is None else out.unionByName(kept)


def run_counts(made: DataFrame) -> DataFrame:
    """One row: how many series have a text and how many have none."""
    return made.agg(F.count("commentary").alias("written"), F.count(F.when(F.col("commentary").isNull(), 1)).alias("failed"))
