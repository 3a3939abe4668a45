"""The assembled artifact, the gates of a run, commentary, cash flows and the live feed, on tables written by hand."""

from __future__ import annotations

import datetime
import gzip
import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cashflows, panel, rolling
from tidemark.plans import artifact, assembly, build, checks, commentary
from tidemark.sources import ingest, live

D = datetime.date


def daily(spark, series: dict[str, list[float]], first: datetime.date = D(2019, 1, 1)):
    return spark.createDataFrame([(s, first + datetime.timedelta(days=k), Decimal(f"{v:.6f}")) for s, values in series.items() for k, v in enumerate(values)], ingest.LEVELS)


def walk(seed: int, n: int) -> list[float]:
    return list(100 * np.cumprod(1 + np.random.default_rng(seed).normal(0.0005, 0.01, n)))


def rate(spark, months: int, start: int = 2019 * 12 + 1):
    return spark.createDataFrame([(start + k, 0.003) for k in range(months)], "ym int, f double")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("built"))
    levels = daily(spark, {"old": walk(1, 2300), "twin": walk(2, 2300), "young": walk(3, 300)}).where("series_id <> 'young'").unionByName(daily(spark, {"young": walk(3, 300)}, D(2024, 6, 20)))
    names = spark.createDataFrame([("old", "Old Fund - Direct Plan - Growth", "H"), ("twin", "Twin Fund", "H"), ("young", "Young Fund", None)], "series_id string, name string, house string")
    made = build.run(levels, daily(spark, {"market": walk(9, 2300)}), names, rate(spark, 72), out, "market", "funds", strict=False)
    return made, spark.read.parquet(f"{out}/artifacts"), spark.read.parquet(f"{out}/universe")


def test_artifacts_are_whole(built):
    made, artifacts, head = built
    found = {r["series_id"]: json.loads(r["artifact"]) for r in artifacts.collect()}
    assert made.series == 3 and made.failed == 0 and set(found) == {"old", "twin", "young"}
    old, young = found["old"], found["young"]
    assert set(old["metrics"]) == set(assembly.FACT_KEYS) and set(old["ranks"]) == set(assembly.RANKED)
    assert old["alpha"]["alpha_3Y"]["n"] == 36 and len(old["calendar_years"]) == 3 and old["series"]["underwater"][0]["depth"] == 0
    assert len(old["rolling"]["rolling_return_1Y"]) == old["windows"]["5Y"]["n_months"] + len(old["rolling"]["rolling_return_5Y"]) - 12
    assert young["metrics"]["volatility_3Y"] is None and young["windows"]["3Y"]["n_months"] == 0 and young["ranks"]["return_3Y"]["pct"] is not None or young["metrics"]["return_3Y"] is None
    top = json.loads(head.first()["artifact"])["universe"]
    assert top["count"] == 3 and top["category"] == "funds" and top["rf"]["levels"]["3Y"] == pytest.approx(1.003**12 - 1)
    assert "NaN" not in "".join(r["artifact"] for r in artifacts.collect())


def test_payload_sentences_and_gates(spark, built):
    _, artifacts, head = built
    entries = commentary.entries(artifacts)
    payloads = {r["series_id"]: r["payload"] for r in commentary.payloads(entries, head).collect()}
    old = json.loads(payloads["old"])
    m = old["metrics"]
    assert m["beta_contribution_3Y"] == pytest.approx(m["beta_3Y"] * m["benchmark_return_3Y"], abs=1e-6) and old["category_benchmark"] == "Whole Market"
    assert "t_stat" not in old["alpha"]["alpha_1Y"] and "t_stat" in old["alpha"]["alpha_3Y"]
    assert set(old["rolling_summary"]["rolling_return_1Y"]) == {"first", "last", "min", "max"} and "growth_10k" not in payloads["old"]
    universe = head.select(F.from_json("artifact", commentary.UNIVERSE)["universe"]["aggregates"].alias("aggregates"))
    texts = {r["series_id"]: r["text"] for r in commentary.sentences(entries.join(F.broadcast(universe)), F.col("aggregates")).collect()}
    assert texts["old"].startswith(("Its benchmark", "Over 3Y")) and "Old Fund" in texts["old"] and "too short" in texts["young"] and "  " not in texts["old"]
    value, share = old["alpha"]["alpha_1Y"]["value"], m["beta_contribution_3Y"]
    wrong = json.dumps(old | {"metrics": m | {"beta_contribution_3Y": share + 0.5}})
    weak = json.dumps(old | {"alpha": {"alpha_3Y": {"value": 0.4321, "t_stat": 1.1}}})
    rows = [(f"It was {100 * value:.2f} in all.", payloads["old"]), (f"That explains {100 * (share + 0.5):.2f}.", wrong), ("Left over are 43.21.", weak), ("Left over are 43.21, not statistically different.", weak), ("Nothing.", weak), ("x", "{}")]
    out = spark.createDataFrame(rows, "t string, p string").select(commentary.market_model_violations(F.col("t"), F.col("p")).alias("v")).collect()
    assert [r["v"] for r in out] == [["suppressed alpha:1Y"], ["contribution:3Y"], ["alpha without hedge:3Y"], [], [], []]


def test_texts_from_a_writer(spark):
    words = "\n\n".join(" ".join(["plain"] * 60) for _ in range(2))
    given = spark.createDataFrame([("good", "{}"), ("late", '{"late": 1}'), ("bad", '{"bad": 1}'), ("kept", "{}")], "series_id string, payload string")

    def writer(payload: str, told: str | None) -> str:
        if "bad" in payload:
            raise RuntimeError("down")
        return words if "late" not in payload or told else "short"

    previous = spark.createDataFrame([("kept", ("old", "m", "v0", "then")), ("bad", None)], "series_id string, commentary struct<text: string, model: string, prompt_version: string, generated_at: string>")
    made = commentary.generate(given, writer, ["guaranteed"], "v1", "m", F.lit("now"), previous)
    out = {r["series_id"]: r["commentary"] for r in made.collect()}
    assert out["good"]["prompt_version"] == "v1" and out["late"]["text"] == words and out["bad"] is None and out["kept"]["text"] == "old"
    assert tuple(commentary.run_counts(made).first()) == (3, 1)


def test_gates(spark, tmp_path):
    levels = daily(spark, {"a": walk(1, 500), "b": [-1.0, 1.0]})
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "series_id string")
    assert {r["series_id"]: r["reason"] for r in build.failures(levels, names).collect()} == {"b": "levels must be positive", "c": "no levels"}
    with pytest.raises(checks.CheckError, match="2 of 3"):
        build.run(levels, levels, names, rate(spark, 30), str(tmp_path), "a")
    with pytest.raises(checks.CheckError, match="steps of j"):
        build.checked_index(daily(spark, {"j": [100.0, 130.0]}), "j")
    with pytest.raises(ValueError, match="no rows"):
        build.checked_index(levels, "zz")
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "series_id string, benchmark_id string")
    assert [r["against"] for r in assembly.benchmark_of(rows, "y").collect()] == ["y", "y"]
    with pytest.raises(Exception, match="no benchmark for b"):
        assembly.benchmark_of(rows).collect()
    master = spark.createDataFrame([("1", "c", "direct", "growth"), ("2", "c", "regular", "growth"), ("3", None, None, None)], "series_id string, category string, plan string, option string")
    assert [r["series_id"] for r in assembly.universe(master, "c").collect()] == ["1"]
    with pytest.raises(Exception, match="start after end"):
        panel.between(levels, F.lit(D(2020, 1, 2)), F.lit(D(2020, 1, 1))).collect()


def test_points_and_disclosures(spark):
    row = spark.range(1).select(assembly.point_json(F.lit(D(2024, 1, 31)), F.lit(0.5)).alias("j")).select("j", assembly.point_of(F.col("j")).alias("p")).first()
    assert row["j"] == '{"date":"2024-01-31","value":0.5}' and row["p"]["value"] == 0.5
    rf = artifact.extend_rate(rate(spark, 14), F.lit(D(2020, 4, 30)))
    told = assembly.rate_disclosure(rf, "r", F.lit(D(2020, 4, 30)), "rates unchanged").first()
    assert told["levels"]["1Y"] == pytest.approx(1.003**12 - 1) and told["levels"]["3Y"] is None and told["extended"]["n_extended"] == 2
    assert told["extended"]["basis"] == "carried at the value last published, of 2020-02-29; rates unchanged"
    facts = spark.createDataFrame([("a", "sharpe_1Y", None, "insufficient_history(required=2, available=1)"), ("a", "sharpe_SI", 1.0, None)], "series_id string, key string, value double, refused string")
    assert [tuple(r) for r in assembly.window_refusals(facts).collect()] == [("a", "1Y", {"sharpe": "insufficient_history(required=2, available=1)"})]
    none = daily(spark, {})
    assert assembly.points(panel.panel(none), rate(spark, 1).select("ym", F.col("f").alias("rb")), rate(spark, 1)).count() == 0


def test_money_weighted_and_weights(spark):
    flows = [("a", D(2020, 1, 1), -100.0), ("a", D(2021, 1, 1), -100.0), ("a", D(2022, 1, 1), 231.0), ("b", D(2020, 1, 1), 5.0), ("c", D(2020, 1, 1), -1.0), ("c", D(2020, 7, 1), 2.0)]
    out = {r["series_id"]: r["rate"] for r in cashflows.money_weighted(spark.createDataFrame(flows, "series_id string, date date, amount double")).collect()}
    worth = sum(a / (1 + out["a"]) ** ((d - D(2020, 1, 1)).days / 365) for s, d, a in flows if s == "a")
    assert abs(worth) < 1e-6 and out["b"] is None and out["c"] == pytest.approx(2 ** (365 / 182) - 1)
    edges = spark.createDataFrame([("p", "x", D(2020, 1, 1), 0.6), ("p", "y", D(2020, 1, 1), 0.3), ("p", "y", D(2021, 1, 1), 1.0)], "parent string, child string, as_of date, weight double")
    grid = spark.createDataFrame([(D(2019, 1, 1),), (D(2020, 6, 1),), (D(2021, 1, 1),)], "date date")
    assert sorted((r["child"], str(r["date"]), r["weight"]) for r in cashflows.disclosed_weights(edges, grid).collect()) == [("x", "2020-06-01", 0.6), ("y", "2020-06-01", 0.3), ("y", "2021-01-01", 1.0)]
    assert cashflows.weight_at(edges, "x", F.lit(D(2022, 1, 1))).first()["weight"] == 0 and cashflows.weight_at(edges, "x", F.lit(D(2020, 3, 1))).first()["weight"] == 0.6
    whole = cashflows.with_cash(edges)
    assert [round(r["weight"], 9) for r in whole.where("child = 'cash'").collect()] == [0.1]
    assert {r["node"]: r["kind"] for r in cashflows.node_kinds(whole).collect()} == {"p": "portfolio", "x": "stock", "y": "stock", "cash": "cash"}


def test_factors_match_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.03, (40, 3))
    y = 0.002 + x @ [1.1, -0.4, 0.3] + rng.normal(0, 0.01, 40)
    rows = spark.createDataFrame([("a", 100 + k, float(v + 0.003)) for k, v in enumerate(y)] + [("b", 100, 0.1)], "series_id string, ym int, r double")
    factors = spark.createDataFrame([(100 + k, *map(float, v)) for k, v in enumerate(x)], "ym int, m double, s double, h double").withColumn("twice", 2 * F.col("m"))
    rf = spark.createDataFrame([(100 + k, 0.003) for k in range(40)], "ym int, f double")
    out = {r["series_id"]: r for r in cashflows.factor_regression(rows, factors, ["m", "s", "h"], rf).collect()}
    coef = np.linalg.lstsq(np.c_[np.ones(40), x], y, rcond=None)[0]
    assert [out["a"][c] for c in ("intercept", "m", "s", "h")] == pytest.approx(list(coef), rel=1e-6) and out["b"]["m"] is None
    assert cashflows.factor_regression(rows, factors, ["m", "twice"], rf).where("series_id = 'a'").first()["twice"] is None


class Feed:
    def __init__(self, answers: dict) -> None:
        self.answers, self.asked = answers, []

    def codes(self):
        return ["2", "10", "1", "1", "x"]

    def history(self, code: str):
        self.asked.append(code)
        answer = self.answers[code]
        found = answer.pop(0) if len(answer) > 1 else answer[0]
        if isinstance(found, Exception):
            raise found
        return found


def test_live_feed(spark, tmp_path):
    good = {"scheme_code": "1", "data": [{"date": "02-01-2024", "nav": "11"}, {"date": "01-01-2024", "nav": "10"}]}
    feed, pauses = Feed({"1": [OSError("down"), good], "2": [None], "10": [OSError("gone")]}), []
    assert live.list_codes(feed) == ["1", "10", "2"]
    counts = live.land_feed(feed, str(tmp_path), delay=0, sleep=pauses.append)
    assert counts == {"landed": 1, "skipped": 0, "failed": 2} and pauses[0] == 2.0 and feed.asked.count("2") == 2 and feed.asked.count("10") == 4
    with gzip.open(live.shard_path(str(tmp_path), "1"), "rt") as f:
        assert json.load(f)["data"][0]["nav"] == "11"
    assert sorted(x.split("\t")[0] for x in (tmp_path / "failed.tsv").read_text().splitlines()) == ["10", "2"]
    assert live.land_feed(feed, str(tmp_path), delay=0, sleep=pauses.append) == {"landed": 0, "skipped": 3, "failed": 0}
    feed.answers["2"] = [good]
    assert live.land_feed(feed, str(tmp_path), delay=0, shard=(2, 3), retry_failed=True, sleep=pauses.append) == {"landed": 1, "skipped": 0, "failed": 0}
    assert live.history(spark, feed, "1").count() == 2
    with pytest.raises(ValueError, match="no data"):
        live.history(spark, Feed({"1": [None]}), "1")
    with pytest.raises(ValueError, match="fewer than"):
        live.client(lambda timeout: feed)
    assert live.client(lambda timeout: feed, least_codes=2) is feed


def test_landing_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "levels.parquet")
    for values in ([1.0, 2.0], [3.0]):
        ingest.land(daily(spark, {"a": values}), path, keep_old_as="old")
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(f"{path}.old").count() == 2
    digest = lambda rows: panel.provenance(rows).first()["digest"]
    rows = daily(spark, {"a": [1.0, 2.0]})
    assert digest(rows) == digest(rows.orderBy(F.desc("date"))) != digest(daily(spark, {"a": [1.0, 2.5]}))


def test_pair_bundle(spark):
    rows = spark.createDataFrame([("a", 100 + k, D(2024, 1, 31), 0.01 * (k % 5)) for k in range(40)], "series_id string, ym int, period_end date, r double")
    bench = spark.createDataFrame([(100 + k, 0.01 * (k % 7)) for k in range(40)], "ym int, rb double")
    assert {r["months"] for r in rolling.pair_bundle(rows, bench).collect()} == {12, 36}
