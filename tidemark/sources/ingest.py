"""Parsers for raw feeds and reference files, guarded table scans, and sinks."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import panel
from tidemark.operators.panel import LEVEL

DATA_DIR = "TIDEMARK_DATA_DIR"
#: What the risk-free rate is called wherever it stands beside other series.
RATE_ID = "risk-free"
LEVELS = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("date", T.DateType()), T.StructField("level", LEVEL)])
RAW = "fund_house string, scheme_code string, scheme_name string, scheme_category string, scheme_start_date string, data array<struct<date: string, nav: string>>"
MONTH_FORMATS = ("yyyy-MM-dd", "yyyy-MM", "yyyyMM", "MMM-yyyy", "MM/yyyy")
DATE_FORMATS = ("dd-MMM-yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd MMM yyyy", "dd/MM/yyyy")
#: Row groups of this many rows let a sorted table skip to one series.
ROW_GROUP_BYTES = 8 << 20


def default_data_dir() -> str | None:
    return os.environ.get(DATA_DIR) or None


class SchemaError(TypeError):
    """A column is absent or has another type than declared."""


class Catalog:
    """Lazy tables below one root; types are checked from footers, once per table, before any scan."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._checked = spark, root.rstrip("/"), {}

    def table(self, name: str, column: str = "level", kind: T.DataType = LEVEL) -> DataFrame:
        if name not in self._checked:
            found = self.spark.read.parquet(f"{self.root}/{name}.parquet")
            if column not in found.columns or found.schema[column].dataType != kind:
                raise SchemaError(f"{name}.{column} must be {kind.simpleString()}")
            self._checked[name] = found
        return self._checked[name]

    def series(self, code: str, name: str = "levels") -> DataFrame:
        """One series in order of date; an unknown code raises."""
        rows = self.table(name).where(F.col("series_id") == code)
        if rows.isEmpty():
            raise ValueError(f"no rows for {code}")
        return rows.orderBy("date")

    def panel(self, codes: Sequence[str] | None = None, name: str = "levels") -> DataFrame:
        """All series, or those listed (none for an empty list), as stored decimals."""
        rows = self.table(name)
        if codes is not None:
            rows = rows.where(F.col("series_id").isin(list(codes))) if codes else rows.where("false")
        return rows

    def calendar(self, codes: Sequence[str] | None = None) -> DataFrame:
        return panel.quorum_calendar(self.panel(codes))

    def master(self, benchmarks: DataFrame, yardsticks: dict[str, str]) -> DataFrame:
        return with_benchmarks(self.spark.read.parquet(f"{self.root}/master.parquet"), benchmarks, yardsticks)


def with_benchmarks(master: DataFrame, benchmarks: DataFrame, yardsticks: dict[str, str]) -> DataFrame:
    """The dimension with its benchmark (first tier, else the alternate), the tier it comes from, the alternate, and the yardstick of its
    category; rows without an entry stay."""
    tiers = benchmarks.groupBy("series_id").pivot("tier", ["tier1", "alternate"]).agg(F.first("benchmark_code"))
    code = F.coalesce("tier1", "alternate")
    tier = F.when(F.col("tier1").isNotNull(), "tier1").when(F.col("alternate").isNotNull(), "alternate")
    yardstick = F.create_map(*(F.lit(x) for kv in yardsticks.items() for x in kv)) if yardsticks else F.create_map().cast("map<string,string>")
    joined = master.join(tiers, "series_id", "left")
    return joined.withColumns({"benchmark_code": code, "benchmark_tier": tier, "benchmark_alternate": F.col("alternate"), "category_yardstick": F.try_element_at(yardstick, F.col("category"))}).drop("tier1", "alternate")


def try_dates(text: Column, formats: Sequence[str]) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats))


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """As try_dates, but a non-null text that fits none raises."""
    found = try_dates(F.trim(text), formats)
    return F.when(text.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("unreadable date: "), text)).cast("date")).otherwise(found)


def month_end_date(text: Column) -> Column:
    return F.last_day(parse_date(text, MONTH_FORMATS))


def parse_level(text: Column) -> Column:
    """A positive decimal, with thousands separators allowed; anything else raises."""
    value = F.regexp_replace(F.trim(text), ",", "").try_cast("decimal(18,6)")
    return F.when(value > 0, value).otherwise(F.raise_error(F.concat(F.lit("bad level: "), F.coalesce(text, F.lit("null")))).cast("decimal(18,6)"))


def require_columns(rows: DataFrame, needed: Sequence[str], source: str) -> None:
    missing = [c for c in needed if c not in rows.columns]
    if missing:
        raise ValueError(f"{source}: no column {', '.join(missing)}")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.toDF(*(c.strip() for c in rows.columns))


def two_columns(spark: SparkSession, path: str, code: str, dates: Sequence[str], level: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Levels of one index from a file with a date column (the first of `dates` that is there) and a level column; blank rows are skipped."""
    rows = _csv(spark, path)
    require_columns(rows, [level], path)
    date = next((d for d in dates if d in rows.columns), None)
    if date is None:
        raise ValueError(f"{path}: no column {' or '.join(dates)}")
    rows = rows.where(F.coalesce(F.trim(date), F.lit("")) != "")
    return rows.select(F.lit(code).alias("series_id"), parse_date(F.col(date), formats).alias("date"), parse_level(F.col(level)).alias("level"))


def total_return_index(spark: SparkSession, path: str, code: str) -> DataFrame:
    return two_columns(spark, path, code, ("Date", "Index Date"), "Total Returns Index")


def closing_index(spark: SparkSession, path: str, code: str) -> DataFrame:
    return two_columns(spark, path, code, ("Date",), "Close")


def risk_free(spark: SparkSession, path: str, date: str = "Date", rate: str = "RF", percent: bool = True) -> DataFrame:
    """(series_id, ym, period_end, f) of a monthly rate file: NA rows are skipped, percent becomes a share in decimals before the cast, and a
    month that occurs twice raises."""
    rows = _csv(spark, path)
    require_columns(rows, [date, rate], path)
    rows = rows.where(F.coalesce(F.upper(F.trim(rate)), F.lit("NA")).isin("NA", "") == F.lit(False))
    value = F.trim(rate).cast("decimal(18,9)")
    out = rows.select(month_end_date(F.col(date)).alias("period_end"), (value / F.lit(100 if percent else 1)).cast("double").alias("f"))
    twice = out.groupBy("period_end").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"{path}: {twice[0]['period_end']} occurs twice")
    return out.select(F.lit(RATE_ID).alias("series_id"), panel.month_index(F.col("period_end")).alias("ym"), "period_end", "f")


def benchmark_map(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, benchmark_code, tier); blanks, unknown tiers and repeated (series, tier) raise."""
    rows = _csv(spark, path)
    require_columns(rows, ["series_id", "benchmark_code", "tier"], path)
    bad = rows.where("coalesce(series_id, '') = '' or coalesce(benchmark_code, '') = '' or coalesce(tier, '') not in ('tier1', 'alternate')").take(1)
    if bad:
        raise ValueError(f"{path}: bad row {bad[0].asDict()}")
    twice = rows.groupBy("series_id", "tier").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"{path}: {twice[0].asDict()} occurs twice")
    return rows.select("series_id", "benchmark_code", "tier")


def published_returns(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path)
    return rows.select("series_id", "period", F.col("published_pct").cast("decimal(12,4)").alias("published_pct"), F.col("as_of").cast("date").alias("as_of"), "source_url")


def exemptions(spark: SparkSession, path: str | None) -> DataFrame:
    """The exemption file, or an empty table where there is none."""
    if path is None:
        return spark.createDataFrame([], "series_id string, period string, as_of date, reason string")
    return _csv(spark, path).select("series_id", "period", F.col("as_of").cast("date").alias("as_of"), "reason")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Raw provider responses, one JSON document per (gzipped) file."""
    return spark.read.schema(RAW).json(path, multiLine=True)


def write_shards(raw: DataFrame, path: str) -> None:
    raw.write.mode("overwrite").json(path, compression="gzip")


def normalise(raw: DataFrame) -> DataFrame:
    """Levels from raw responses; the feed is newest first, so the first entry of a date wins."""
    rows = raw.select(F.col("scheme_code").alias("series_id"), F.posexplode("data").alias("pos", "x"))
    rows = rows.select("series_id", "pos", parse_date(F.col("x.date"), ("dd-MM-yyyy",)).alias("date"), F.col("x.nav").cast(LEVEL).alias("level"))
    return panel.deduplicate(rows, "pos", "first").select("series_id", "date", "level")


def normalise_category(raw: Column) -> Column:
    """The leaf after the last " - " as a slug without the words fund and scheme; blank gives null."""
    leaf = F.lower(F.element_at(F.split(raw, " - ", -1), -1))
    words = F.regexp_replace(leaf, r"\b(fund|scheme)s?\b", " ")
    return F.nullif(F.regexp_replace(F.regexp_replace(words, "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))


def _one_of(name: Column, options: dict[str, str]) -> Column:
    """The only option whose pattern occurs, else null."""
    hits = F.array_compact(F.array(*(F.when(name.rlike(f"(?i){pattern}"), value) for value, pattern in options.items())))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def parse_plan(name: Column) -> Column:
    return _one_of(name, {"direct": r"\bdirect\b", "regular": r"\bregular\b"})


def parse_option(name: Column) -> Column:
    return _one_of(name, {"growth": r"\bgrowth\b", "idcw": r"\b(idcw|dividend|income distribution cum capital withdrawal)\b"})


def parse_inception(text: Column) -> Column:
    """DD-MM-YYYY, as it is or as the date of a JSON object; anything else is null, and the first level never stands in."""
    return try_dates(F.coalesce(F.get_json_object(text, "$.date"), text), ("dd-MM-yyyy",))


def master_records(raw: DataFrame) -> DataFrame:
    """One dimension row per raw response."""
    return raw.select(F.col("scheme_code").alias("series_id"), "scheme_name", "fund_house", "scheme_category", normalise_category(F.col("scheme_category")).alias("category"), parse_plan(F.col("scheme_name")).alias("plan"), parse_option(F.col("scheme_name")).alias("option"), parse_inception(F.col("scheme_start_date")).alias("inception_date"))


def consolidate(raw: DataFrame, root: str) -> None:
    """Levels and dimension from all responses."""
    land(normalise(raw), f"{root}/levels.parquet")
    master_records(raw).sort("series_id").write.mode("overwrite").parquet(f"{root}/master.parquet")


def back_up(spark: SparkSession, path: str, suffix: str) -> bool:
    """Move what is at a path aside, beside its name; whether there was anything."""
    source = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(source) and system.rename(source, spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{suffix}")))


def land(levels: DataFrame, path: str, keep_old_as: str | None = None) -> None:
    """Overwrite a level table, range-partitioned and sorted by series and date so that footers prune; no rows raises. With
    `keep_old_as`, the table that was there stays under that suffix."""
    rows = levels.select("series_id", "date", F.col("level").cast(LEVEL).alias("level"))
    if rows.isEmpty():
        raise ValueError("nothing to land")
    if keep_old_as:
        back_up(levels.sparkSession, path, keep_old_as)
    rows.repartitionByRange("series_id", "date").sortWithinPartitions("series_id", "date").write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def remaining(codes: DataFrame, landed: DataFrame, failed: DataFrame, retry_failed: bool = False) -> DataFrame:
    """What a resumed run still has to fetch."""
    left = codes.join(landed, "series_id", "left_anti")
    return left if retry_failed else left.join(failed, "series_id", "left_anti")


def append_failed(failed: DataFrame, path: str) -> None:
    failed.select("series_id", "reason").write.mode("append").csv(path, sep="\t")


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="series_id string, reason string").select("series_id").distinct()


def latest_landed(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of landed batches (with landed_at) by latest-landed-wins, and the rows that were overridden by another value."""
    kept = panel.deduplicate(batches, "landed_at", "last")
    new = kept.select("series_id", "date", F.col("level").alias("new_level"))
    overridden = batches.join(new, ["series_id", "date"]).where("level <> new_level")
    return kept.drop("landed_at"), overridden
