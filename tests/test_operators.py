"""Closed forms, gaps, ties and missing values on tables written by hand."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import holdings, metrics, panel, peer, record, relative, rolling
from tidemark.plans import artifact, checks
from tidemark.sources import ingest
from tidemark.streaming import ingest as streaming

D = datetime.date


def month_end(k: int) -> datetime.date:
    """The k-th month-end from January 2020 on."""
    y, m = divmod(k + 1, 12)
    return D(2020 + y, m + 1, 1) - datetime.timedelta(days=1)


def levels(spark, series: dict[str, list[tuple[datetime.date, str]]]):
    return spark.createDataFrame([(s, d, Decimal(v)) for s, rows in series.items() for d, v in rows], ingest.LEVELS)


def returns(spark, values: list[float], skip: tuple[int, ...] = (), series: str = "a"):
    rows = [(series, 2020 * 12 + 1 + k, month_end(k), float(v)) for k, v in enumerate(values) if k not in skip]
    return spark.createDataFrame(rows, "series_id string, ym int, period_end date, r double")


def rate(spark, n: int, f: float = 0.002):
    return spark.createDataFrame([(2020 * 12 + 1 + k, f) for k in range(n)], "ym int, f double")


VALUES = [0.01 * ((k * 7) % 5 - 1) for k in range(36)]


def test_risk_closed_forms(spark):
    row = metrics.risk(returns(spark, VALUES).withColumn("window", F.lit("SI")), rate(spark, 36)).first()
    x = np.array(VALUES)
    assert row["volatility"] == pytest.approx(x.std(ddof=1) * math.sqrt(12), rel=1e-9)
    assert row["sharpe"] == pytest.approx((x - 0.002).mean() / (x - 0.002).std(ddof=1) * math.sqrt(12), rel=1e-9)
    down = math.sqrt((np.minimum(x - 0.002, 0) ** 2).mean()) * math.sqrt(12)
    assert row["sortino"] == pytest.approx((x - 0.002).mean() * 12 / down, rel=1e-9)
    level = np.cumprod(1 + x)
    low = (level / np.maximum.accumulate(np.maximum(level, 1)) - 1).min()
    assert row["calmar"] == pytest.approx((level[-1] ** (12 / 36) - 1) / abs(low), rel=1e-9)
    n, g = 36, ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert row["skew"] == pytest.approx(g * math.sqrt(n * (n - 1)) / (n - 2), rel=1e-6)


def test_too_few_and_flat(spark):
    rows = returns(spark, [0.01]).union(returns(spark, [0.01] * 5, series="flat")).withColumn("window", F.lit("SI"))
    out = {r["series_id"]: r for r in metrics.with_refusals(metrics.risk(rows, rate(spark, 5, 0.01))).collect()}
    assert out["a"]["volatility"] is None and out["a"]["refused"]["volatility"] == "insufficient_history(required=2, available=1)"
    assert out["flat"]["sharpe"] is None and out["flat"]["calmar"] is None and out["flat"]["skew"] is None


def test_month_completeness_and_gaps(spark):
    days = [(D(2024, 1, 10), "100"), (D(2024, 1, 31), "110"), (D(2024, 2, 29), "121"), (D(2024, 3, 28), "133.1"), (D(2024, 5, 31), "140"), (D(2024, 6, 3), "141")]
    ends = panel.month_ends(levels(spark, {"a": days}))
    assert [r["period_end"] for r in ends.orderBy("ym").collect()] == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 5, 31)]
    rows = panel.monthly_returns(ends).collect()
    assert [(r["period_end"], round(r["r"], 12)) for r in rows] == [(D(2024, 2, 29), 0.1)]
    close = spark.createDataFrame([(2024 * 12 + 1, D(2024, 1, 31)), (2024 * 12 + 2, D(2024, 3, 1)), (2024 * 12 + 5, D(2024, 5, 31))], "ym int, close date")
    assert [r["ym"] for r in panel.month_ends(levels(spark, {"a": days}), close).orderBy("ym").collect()] == [2024 * 12 + 1, 2024 * 12 + 5]


def test_quorum_needs_half_of_the_active(spark):
    one = [(D(2024, 1, k), "1") for k in (1, 2, 3, 4)]
    rows = levels(spark, {"a": one, "b": [one[0], one[3]], "c": [one[0], one[3]], "d": [(D(2024, 1, 9), "1")]})
    assert sorted(r["date"].day for r in panel.quorum_calendar(rows).collect()) == [1, 4, 9]


def test_duplicates_first_and_last(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 1), 1, 5), ("a", D(2024, 1, 1), 2, 6)], "series_id string, date date, pos int, level int")
    assert panel.deduplicate(rows, "pos").first()["level"] == 6
    assert panel.deduplicate(rows, "pos", "first").first()["level"] == 5


def test_as_of_has_no_staleness_limit(spark):
    rows = levels(spark, {"a": [(D(2020, 1, 1), "10"), (D(2020, 2, 1), "20")]})
    anchors = spark.createDataFrame([("a", D(2019, 1, 1)), ("a", D(2020, 1, 31)), ("a", D(2030, 1, 1)), ("b", D(2030, 1, 1))], "series_id string, anchor date")
    assert [(r["series_id"], r["anchor"].year, r["level"]) for r in panel.as_of(rows, anchors).orderBy("series_id", "anchor").collect()] == [("a", 2019, None), ("a", 2020, Decimal("10")), ("a", 2030, Decimal("20")), ("b", 2030, None)]


def test_figures_absolute_and_cagr(spark):
    rows = levels(spark, {"a": [(D(2020, 2, 29), "100"), (D(2021, 2, 28), "121")], "young": [(D(2020, 10, 1), "100"), (D(2021, 2, 28), "110")]})
    out = {(r["series_id"], r["period"]): r for r in record.figures(rows, F.lit("2021-02-28").cast("date")).collect()}
    assert out["a", "1Y"]["start"] == D(2020, 2, 28) and out["a", "1Y"]["value"] is None
    assert out["a", "SI"]["value"] == pytest.approx(0.21) and out["a", "SI"]["days"] == 365
    assert out["young", "SI"]["method"] == "absolute" and out["young", "SI"]["value"] == pytest.approx(0.1)


def test_windows_differ_on_gaps(spark):
    rows = returns(spark, VALUES, skip=(30,))
    at = F.lit(month_end(35))
    cal = metrics.windows_by_calendar(rows, at, {"1Y": 12}).count()
    obs = metrics.windows_by_observation(rows, at, {"1Y": 12}).count()
    assert (cal, obs) == (11, 12)
    assert metrics.windows_by_calendar(rows, F.lit(month_end(30)), {"1Y": 12}).count() == 0


def test_rolling_annualises_by_nominal_months(spark):
    rows = returns(spark, [0.01] * 14, skip=(5,))
    out = rolling.rolling_return(rows, 12).orderBy("ym").collect()
    assert len(out) == 2 and out[0]["value"] == pytest.approx(1.01**11 - 1)


def test_drawdown_episode(spark):
    days = [(D(2024, 1, k + 1), v) for k, v in enumerate(["100", "120", "90", "110", "120", "80"])]
    row = metrics.drawdown(levels(spark, {"a": days})).first()
    assert (row["peak_date"].day, row["trough_date"].day, row["recovery_date"]) == (2, 6, None)
    row = metrics.drawdown(levels(spark, {"a": days[:5]})).first()
    assert (row["peak_date"].day, row["trough_date"].day, row["recovery_date"].day, row["days_under"]) == (2, 3, 5, 3)


def test_alpha_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    b = rng.normal(0.01, 0.03, 36)
    y = 0.001 + 1.2 * b + rng.normal(0, 0.01, 36)
    bench = spark.createDataFrame([(2020 * 12 + 1 + k, float(v)) for k, v in enumerate(b)], "ym int, rb double")
    row = relative.jensens_alpha(returns(spark, list(y)).withColumn("window", F.lit("x")), bench, rate(spark, 36)).first()
    x = np.stack([np.ones(36), b - 0.002], 1)
    coef, sse, *_ = np.linalg.lstsq(x, y - 0.002, rcond=None)
    se = math.sqrt(sse[0] / 34 * np.linalg.inv(x.T @ x)[0, 0])
    assert row["alpha"] == pytest.approx((1 + coef[0]) ** 12 - 1, rel=1e-6)
    assert row["t_stat"] == pytest.approx(coef[0] / se, rel=1e-6)
    flat = relative.relative(returns(spark, list(y)).withColumn("window", F.lit("x")), bench.withColumn("rb", F.lit(0.01)), rate(spark, 36)).first()
    assert flat["beta"] is None and flat["down_capture"] is None


def test_ranks_share_ties_and_skip_absent(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None), ("e", float("nan"))], "series_id string, value double").withColumn("g", F.lit(1))
    out = {r["series_id"]: r["pct"] for r in peer.percentile_ranks(rows, ["g"]).collect()}
    assert out == {"a": pytest.approx(100 / 3), "b": 100.0, "c": 100.0, "d": None, "e": None}
    assert peer.category_aggregate(rows.where("value is null"), ["g"]).first()["median"] is None


def test_rate_is_carried_at_most_a_year(spark):
    rf = rate(spark, 3)
    out = artifact.extend_rate(rf, F.lit(month_end(5)))
    assert out.count() == 6 and out.where("extended").count() == 3
    with pytest.raises(Exception, match="more than 12 months"):
        artifact.extend_rate(rf, F.lit(month_end(20))).collect()


def test_holes_and_gate(spark):
    rows = levels(spark, {"a": [(D(2024, 1, 5), "1"), (D(2024, 4, 5), "1")], "b": [(D(2024, 1, 5), "1")]})
    assert [(r["series_id"], r["month_end"]) for r in checks.holes(rows).orderBy("ym").collect()] == [("a", D(2024, 2, 29)), ("a", D(2024, 3, 31))]
    with pytest.raises(checks.CheckError):
        checks.require_none(checks.holes(rows), "holes")


def test_parsers(spark, tmp_path):
    raw = spark.createDataFrame([("H", "1", "X - Direct Plan - Growth", "Equity Scheme - Flexi Cap Fund", "01-02-2013", [("02-01-2024", "11"), ("01-01-2024", "10"), ("02-01-2024", "99")])], ingest.RAW.replace("data array", "data array"))
    ingest.write_shards(raw, str(tmp_path / "raw"))
    back = ingest.read_shards(spark, str(tmp_path / "raw"))
    assert [(r["date"], r["level"]) for r in ingest.normalise(back).orderBy("date").collect()] == [(D(2024, 1, 1), Decimal("10.000000")), (D(2024, 1, 2), Decimal("11.000000"))]
    row = ingest.master_records(back).first()
    assert (row["category"], row["plan"], row["option"], row["inception_date"]) == ("flexi_cap", "direct", "growth", D(2013, 2, 1))
    (tmp_path / "rf.csv").write_text("Date,SMB,RF\n2024-01,1,0.5\n2024-02,1,NA\n2024-03,2,0.6\n")
    assert [(r["period_end"], r["f"]) for r in ingest.risk_free(spark, str(tmp_path / "rf.csv")).orderBy("ym").collect()] == [(D(2024, 1, 31), 0.005), (D(2024, 3, 31), 0.006)]
    (tmp_path / "ix.csv").write_text("Index Date ,Total Returns Index\n01-Jan-2024,\"1,234.5\"\n,\n")
    assert ingest.total_return_index(spark, str(tmp_path / "ix.csv"), "I").first()["level"] == Decimal("1234.500000")
    (tmp_path / "bm.csv").write_text("# note\nseries_id,benchmark_code,tier\n1,A,tier1\n1,B,tier1\n")
    with pytest.raises(ValueError, match="twice"):
        ingest.benchmark_map(spark, str(tmp_path / "bm.csv"))


def test_land_and_guard(spark, tmp_path):
    rows = levels(spark, {"a": [(D(2024, 1, 1), "1")], "b": [(D(2024, 1, 1), "2")]})
    ingest.land(rows, str(tmp_path / "levels.parquet"))
    catalog = ingest.Catalog(spark, str(tmp_path))
    assert catalog.series("b").first()["level"] == Decimal("2.000000")
    assert catalog.panel([]).count() == 0 and catalog.panel(["a"]).count() == 1
    with pytest.raises(ValueError):
        catalog.series("zzz")
    rows.withColumn("level", F.col("level").cast("double")).write.parquet(str(tmp_path / "bad.parquet"))
    with pytest.raises(ingest.SchemaError):
        catalog.table("bad")
    with pytest.raises(ValueError):
        ingest.land(rows.where("false"), str(tmp_path / "none.parquet"))


def test_text_checks(spark):
    rows = spark.createDataFrame([("It rose 12.35% and 99 more, 99 in all", '{"a": 0.12345}'), ("1000000000000.5 and 12", '{"a": 1e30, "b": {"c12": true}}'), ("2.5 or 7", None), ("17 and 250", '{"a": [1, true, {"b": 2.5}], "c": "17"}'), ("12.34", '{"a": -0.12344}')], "t string, s string")
    out = rows.select(text.fabricated_numbers(F.col("t"), F.col("s")).alias("f"), text.stored_numbers(F.col("s")).alias("n"), text.is_quoted(F.lit(0.123451), F.col("t")).alias("q")).collect()
    assert [r["f"] for r in out] == [["99"], ["1000000000000.5"], None, [], []]
    assert out[3]["n"] == [1.0, 2.5] and [r["q"] for r in out] == [True, True, False, False, False]
    assert text.placeholders("{a} and {b}") == {"a", "b"}


def test_commentary_violations(spark):
    rows = spark.createDataFrame([("Guaranteed 42.\n\nmore", '{"x": 1}')], "t string, s string")
    out = rows.select(text.commentary_violations(F.col("t"), F.col("s"), ["guaranteed"]).alias("v")).first()["v"]
    assert out == ["words:3", "banned:guaranteed", "number:42"]


def test_look_through_sums_paths_and_stops_cycles(spark):
    edges = spark.createDataFrame([("p", "q", 0.5), ("p", "x", 0.5), ("q", "x", 0.4), ("q", "y", 0.6)], "parent string, child string, weight double")
    out = {(r["root"], r["leaf"]): r["exposure"] for r in holdings.look_through(edges).collect()}
    assert out["p", "x"] == pytest.approx(0.7) and out["p", "y"] == pytest.approx(0.3)
    with pytest.raises(ValueError):
        holdings.look_through(edges.union(spark.createDataFrame([("x", "p", 1.0)], edges.schema)))


def test_stream_lands_each_level_once(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = levels(spark, {"a": [(D(2024, 1, 1), "1"), (D(2024, 1, 2), "2")]})
    for _ in range(2):
        rows.write.mode("append").parquet(source)
    streaming.land_stream(streaming.level_stream(spark, source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_empty_tables(spark):
    none = levels(spark, {})
    assert panel.panel(none).count() == 0 and panel.quorum_calendar(none).count() == 0 and checks.holes(none).count() == 0
    assert record.figures(none, F.lit("2024-01-31").cast("date")).count() == 0
