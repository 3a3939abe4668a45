from __future__ import annotations

import datetime
import json
from decimal import Decimal

import pytest

from tidemark import __main__ as cli
from tidemark.plans import site
from tidemark.sources import ingest


def test_command_line_builds_writes_and_renders(spark, tmp_path):
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(1200)]
    price = lambda s, k: Decimal(1000 + (7 * k + 13 * len(s)) % 41 + k // 20)
    ingest.land(spark.createDataFrame([(s, d, price(s, k)) for s in ("a", "bb") for k, d in enumerate(days)], ingest.LEVELS), str(tmp_path / "levels.parquet"))
    ingest.land(spark.createDataFrame([("market", d, price("xyz", k)) for k, d in enumerate(days)], ingest.LEVELS), str(tmp_path / "indices.parquet"))
    (tmp_path / "rf.csv").write_text("Date,RF\n" + "".join(f"{2020 + k // 12}-{k % 12 + 1:02d},0.3\n" for k in range(36)))
    base = ["--data-dir", str(tmp_path), "--rf-path", str(tmp_path / "rf.csv")]
    made, pages = str(tmp_path / "made"), tmp_path / "site"
    cli.main(["build", *base, "--out", made, "--lenient"])
    entries = [json.loads(r["artifact"]) for r in spark.read.parquet(f"{made}/artifacts").orderBy("series_id").collect()]
    assert [e["series_id"] for e in entries] == ["a", "bb"] and entries[0]["as_of"] == "2023-03-31"
    assert entries[0]["metrics"]["volatility_3Y"] > 0 and entries[0]["metrics"]["volatility_5Y"] is None and entries[0]["windows"]["3Y"]["n_months"] == 36
    head = json.loads(spark.read.parquet(f"{made}/universe").first()["artifact"])["universe"]
    assert head["count"] == 2 and head["rf"]["extended"]["n_extended"] == 3 and head["rf"]["extended"]["last_published"] == "2022-12-31"
    cli.main(["sentences", "--metrics", made, "--out", str(tmp_path / "texts")])
    assert all("beta" in r["text"] for r in spark.read.parquet(str(tmp_path / "texts")).collect())
    cli.main(["render", "--metrics", made, "--out", str(pages)])
    page, index = (pages / "series-0.html").read_text(), (pages / "index.html").read_text()
    assert page.count("<svg") >= 3 and "carried forward by 3 months" in page and "Information Ratio" in page
    assert "bb" in index and "volatility 3Y" in index and len((pages / "artifacts.jsonl").read_text().splitlines()) == 2
    cli.main(["build", *base, "--out", made, "--lenient", "--as-of", "2022-12-31"])
    assert json.loads(spark.read.parquet(f"{made}/universe").first()["artifact"])["universe"]["rf"]["extended"] is None
    with pytest.raises(SystemExit):
        cli.main(["render"])


def test_formats():
    assert site.pct(None) == site.ratio(float("nan")) == site.pct100(None) == "—" and site.pct(0.1234) == "12.34%" and site.pct100(33.333) == "33.3"
    assert site.svg_line([("x", 1.0)]) is None and "polyline" in site.svg_line([("x", 1.0), ("y", 2.0)])
    assert site.extension_line(None) is None and site.extension_line(7).startswith("Note")
    assert site.dates_values([{"date": "d", "value": 1.0}, {"date": "e", "value": None}]) == (["d"], [1.0])
    assert site.sort_value(None) == "" and site.benchmark_label("X1") == "category benchmark (X1)"
    assert site.page("<t>", "b").count("&lt;t&gt;") == 2
