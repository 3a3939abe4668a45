"""The gated run: from stored levels to stored artifacts. Each gate is a count over a table of what it must not find."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.operators import panel
from tidemark.plans import artifact, assembly, checks

GUARD_START = datetime.date(2010, 1, 1)


@dataclass(frozen=True)
class Built:
    """What a run has made: tables below `out`, the as-of date, and how many series are in and out."""

    out: str
    as_of: datetime.date
    series: int
    failed: int
    carried_commentary: int


def checked_index(levels: DataFrame, code: str, start: datetime.date = GUARD_START) -> DataFrame:
    """The levels of one index; none, or a step that is too large from `start` on, raises."""
    rows = levels.where(F.col("series_id") == code)
    if rows.isEmpty():
        raise ValueError(f"no rows for {code}")
    checks.require_none(panel.anomalies(rows, F.lit(start)), f"steps of {code}")
    return rows


def failures(levels: DataFrame, names: DataFrame) -> DataFrame:
    """(series_id, reason) of the members that cannot be built: no levels, or a level that is not positive."""
    seen = levels.groupBy("series_id").agg(F.min("level").alias("low"))
    reason = F.when(F.col("low").isNull(), "no levels").when(F.col("low") <= 0, "levels must be positive")
    return names.select("series_id").distinct().join(seen, "series_id", "left").withColumn("reason", reason).where("reason is not null").select("series_id", "reason")


def identity_rows(facts: DataFrame, alpha: DataFrame) -> DataFrame:
    """The stored figures side by side, as the identity check takes them."""
    names = {"annual_return": "return", "rf_return": "rf", "benchmark_return": "benchmark_return", "volatility": "volatility", "sharpe": "sharpe", "tracking_error": "tracking_error", "information_ratio": "information_ratio", "beta": "beta"}
    m = F.col("m")
    wide = facts.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m")).select("series_id", "m", F.explode(F.array(*(F.lit(w) for w in artifact.RELATIVE_WINDOWS))).alias("window"))
    rows = wide.select("series_id", "window", *(m[F.concat(F.lit(f"{source}_"), "window")].alias(name) for name, source in names.items()))
    return rows.join(alpha.select("series_id", "window", "alpha"), ["series_id", "window"], "left")


def run(levels: DataFrame, index_levels: DataFrame, names: DataFrame, rf: DataFrame, out: str, yardstick: str, category: str = "all", at: datetime.date | None = None, guard_start: datetime.date = GUARD_START, failed_share: float = 0.1, previous: DataFrame | None = None, prompt_version: str = "", strict: bool = True) -> Built:
    """Write artifacts, universe and facts of the members in `names` (series_id and any describing columns) below `out`.

    The yardstick keeps its own calendar; the members share a quorum calendar; the as-of date is the latest month-end that half of them have
    unless one is given; the rate is carried to it. Over `failed_share` failures, a bad index or a broken identity (if strict) raise."""
    failed = scratch.materialise(failures(levels, names), "failures")
    total, lost = names.select("series_id").distinct().count(), failed.count()
    checks.too_many_failures(failed, total, failed_share)
    members = names.join(failed, "series_id", "left_anti")
    levels = scratch.materialise(levels.join(members.select("series_id"), "series_id", "left_semi"), "levels")
    against = scratch.materialise(checked_index(index_levels, yardstick, guard_start), "yardstick")
    rows = scratch.materialise(panel.panel(levels, panel.month_close(panel.quorum_calendar(levels))), "panel")
    day = at or panel.infer_as_of(rows).first()["as_of"]
    here: Column = F.lit(day)
    rate = scratch.materialise(artifact.extend_rate(rf, here), "rate")
    other = scratch.materialise(panel.panel(against).select("ym", "period_end", F.col("r").alias("rb")), "returns")
    facts, alpha = assembly.facts(levels, rows, against, other, rate, here)
    if strict:
        checks.require_none(checks.identities(identity_rows(facts, alpha)).where("violated"), "identities")
    panels = scratch.materialise(assembly.points(rows, other, rate), "points")
    values = scratch.materialise(assembly.ranked_values(facts, alpha), "values")
    windows = artifact.window_disclosure(rows, rate, other, here)
    made = assembly.panel_artifacts(facts, alpha, panels, windows, artifact.growth(rows, other), artifact.underwater(rows), assembly.calendar_years(rows, here), assembly.ranks(values), assembly.rank_histories(panels), members.withColumn("yardstick", F.lit(yardstick)), here)
    carried = 0
    if previous is not None:
        made = artifact.carry_commentary(made, previous, prompt_version)
    made.write.mode("overwrite").parquet(f"{out}/artifacts")
    head = assembly.universe_artifact(values, assembly.rate_disclosure(rate, "risk-free", here), category, yardstick, here)
    head.write.mode("overwrite").parquet(f"{out}/universe")
    facts.write.mode("overwrite").parquet(f"{out}/facts")
    if previous is not None:
        carried = made.sparkSession.read.parquet(f"{out}/artifacts").where("commentary is not null").count()
    return Built(out, day, total - lost, lost, carried)
