"""Consistency checks: identities between metrics, holes in level tables, reconciliation with published figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import month_end_of, month_index
from tidemark.operators.record import PERIODS, anchor, figures_for

IDENTITY_TOLERANCE = 0.03
RATIO_TOLERANCE = 0.15
RECON_BPS = 10
STATUSES = ("MATCH", "MISMATCH", "EXEMPT", "UNCOMPUTABLE")


class CheckError(ValueError):
    """A gate found rows that it must not find."""


def require_none(rows: DataFrame, message: str, shown: int = 5) -> None:
    """Raise if there is any row, naming the first few."""
    found = rows.take(shown)
    if found:
        raise CheckError(f"{message}: {[r.asDict() for r in found]}")


def ratio_tolerance(denominator: Column) -> Column:
    """A fixed error of the numerator turns into one of the ratio; it is at least RATIO_TOLERANCE."""
    return F.greatest(F.coalesce(F.try_divide(F.lit(IDENTITY_TOLERANCE), F.abs(denominator)), F.lit(RATIO_TOLERANCE)), F.lit(RATIO_TOLERANCE))


def identities(rows: DataFrame) -> DataFrame:
    """Per series and window the rules sharpe = (R - rf) / volatility, information_ratio = (R - Rb) / tracking_error and
    alpha = (R - Rb) + (1 - beta) (Rb - rf), with both sides, the tolerance and whether they agree; a rule with a null input is left out."""
    ret, rf, rb = F.col("annual_return"), F.col("rf_return"), F.col("benchmark_return")
    rule = lambda name, found, expected, tol: F.struct(F.lit(name).alias("rule"), found.alias("found"), expected.alias("expected"), tol.alias("tolerance"))
    rules = F.array(
        rule("sharpe", F.col("sharpe"), F.try_divide(ret - rf, F.col("volatility")), ratio_tolerance(F.col("volatility"))),
        rule("information_ratio", F.col("information_ratio"), F.try_divide(ret - rb, F.col("tracking_error")), ratio_tolerance(F.col("tracking_error"))),
        rule("alpha", F.col("alpha"), (ret - rb) + (1 - F.col("beta")) * (rb - rf), F.lit(IDENTITY_TOLERANCE)),
    )
    out = rows.select("series_id", "window", F.explode(rules).alias("x")).select("series_id", "window", "x.*").where("found is not null and expected is not null")
    gap = F.abs(F.col("found") - F.col("expected"))
    return out.withColumns({"gap": gap, "violated": gap > F.col("tolerance")})


def holes(levels: DataFrame) -> DataFrame:
    """Months without rows strictly between the first and the last month of a series."""
    bounds = levels.groupBy("series_id").agg(F.min(month_index(F.col("date"))).alias("lo"), F.max(month_index(F.col("date"))).alias("hi"))
    spine = bounds.where("hi - lo >= 2").select("series_id", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("ym"))
    there = levels.select("series_id", month_index(F.col("date")).alias("ym")).distinct()
    return spine.join(there, ["series_id", "ym"], "left_anti").withColumn("month_end", month_end_of(F.col("ym")))


def classify_holes(found: DataFrame, raw: DataFrame) -> DataFrame:
    """Whether a hole has rows in the raw feed (fetch_side) or not (upstream), and how many."""
    counts = raw.groupBy("series_id", month_index(F.col("date")).alias("ym")).agg(F.count(F.lit(1)).alias("raw_rows"))
    joined = found.join(counts, ["series_id", "ym"], "left").withColumn("raw_rows", F.coalesce("raw_rows", F.lit(0)).cast("long"))
    return joined.withColumn("side", F.when(F.col("raw_rows") > 0, "fetch_side").otherwise("upstream"))


def reconcile(published: DataFrame, levels: DataFrame, exemptions: DataFrame, latest: Column, tolerance_bps: int = RECON_BPS) -> DataFrame:
    """One row per published figure (series_id, period, published_pct decimal, as_of) with the engine's value, the difference in basis points
    and a status: UNCOMPUTABLE for an unknown series, a date beyond `latest` or a window before the first level; then EXEMPT; then
    MATCH within the tolerance, else MISMATCH."""
    first = levels.groupBy("series_id").agg(F.min("date").alias("first_date"))
    months = F.create_map(*(F.lit(x) for p, m in PERIODS.items() for x in (p, m)))[F.col("period")]
    asked = published.select("series_id", "period", "as_of").distinct().join(first, "series_id")
    wanted = asked.select("series_id", "period", months.alias("months"), anchor(months, F.col("as_of"), F.col("first_date")).alias("start"), F.col("as_of").alias("end"))
    out = figures_for(levels, wanted.where(months.isNotNull() | (F.col("period") == "SI"))).select("series_id", "period", F.col("end").alias("as_of"), F.col("start").alias("window_start"), (F.col("value") * 100).alias("engine_pct"))
    exempt = exemptions.select("series_id", "period", "as_of").distinct().withColumn("exempt", F.lit(True))
    rows = published.join(first, "series_id", "left").join(out, ["series_id", "period", "as_of"], "left").join(exempt, ["series_id", "period", "as_of"], "left")
    difference = F.abs(F.col("engine_pct") - F.col("published_pct").cast("double")) * 100
    detail = F.when(F.col("first_date").isNull(), "no levels").when(F.col("as_of") > latest, "after the frozen date").when((F.col("window_start") < F.col("first_date")) | F.col("engine_pct").isNull(), "window predates the first level")
    status = F.when(detail.isNotNull(), "UNCOMPUTABLE").when(F.col("exempt"), "EXEMPT").when(difference <= tolerance_bps, "MATCH").otherwise("MISMATCH")
    return rows.select("series_id", "period", "as_of", "published_pct", "engine_pct", difference.alias("difference_bps"), status.alias("status"), detail.alias("detail"))


def status_counts(rows: DataFrame) -> DataFrame:
    """Every status with its count, zeros included."""
    spine = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return spine.join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def format_table(rows: DataFrame) -> str:
    """A fixed-width report of reconciled rows, for the driver's terminal."""
    found = rows.orderBy("series_id", "period").collect()
    head = ("series", "period", "as of", "published", "engine", "bps", "status")
    body = [(r["series_id"], r["period"], str(r["as_of"]), f"{r['published_pct']}", "-" if r["engine_pct"] is None else f"{r['engine_pct']:.4f}", "-" if r["difference_bps"] is None else f"{r['difference_bps']:.2f}", r["status"]) for r in found]
    wide = [max(len(row[k]) for row in [head, *body]) for k in range(len(head))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, wide, strict=True)).rstrip() for row in [head, *body])


def too_many_failures(failed: DataFrame, total: int, share: float = 0.1) -> None:
    """Abort a batch in which more than this share failed."""
    n = failed.count()
    if total and n > share * total:
        raise CheckError(f"{n} of {total} series failed")


def largest_steps(levels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Single steps beyond the limit, for data-quality reports."""
    before = F.lag("level").over(Window.partitionBy("series_id").orderBy("date"))
    step = (F.col("level") / F.nullif(before, F.lit(0)) - 1).cast("double")
    return levels.withColumn("step", step).where(F.abs("step") > limit)
