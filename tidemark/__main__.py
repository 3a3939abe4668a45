"""Command line: consolidate raw shards, build the artifacts, write sentences, or render pages."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import functions as F

from tidemark.plans import build, commentary, site
from tidemark.session import session
from tidemark.sources import ingest


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("command", choices=["consolidate", "build", "sentences", "render"])
    parser.add_argument("--data-dir", default=ingest.default_data_dir(), help="root of levels.parquet, indices.parquet, master.parquet and raw/")
    parser.add_argument("--rf-path", help="monthly risk-free file (build)")
    parser.add_argument("--benchmark-map", help="benchmarks of the series (build, with a master table)")
    parser.add_argument("--yardstick", default="market", help="code in indices.parquet that all are measured against (build)")
    parser.add_argument("--category", help="members of this category, direct and growth only (build, with a master table)")
    parser.add_argument("--as-of", type=datetime.date.fromisoformat, help="YYYY-MM-DD; by default the latest month-end that half of the series have")
    parser.add_argument("--carry-commentary", help="earlier commentary table (series_id, commentary, prompt_version)")
    parser.add_argument("--prompt-version", default="")
    parser.add_argument("--lenient", action="store_true", help="report broken identities instead of stopping (build)")
    parser.add_argument("--metrics", help="folder that build has written (sentences, render)")
    parser.add_argument("--out", help="folder for artifacts (build), texts (sentences) or pages (render)")
    args = parser.parse_args(argv)
    spark = session()
    if args.command in ("sentences", "render"):
        if not args.metrics or not args.out:
            parser.error("--metrics and --out are needed")
        artifacts, head = (spark.read.parquet(f"{args.metrics}/{t}") for t in ("artifacts", "universe"))
        universe = head.select(F.from_json("artifact", commentary.UNIVERSE)["universe"]["aggregates"].alias("aggregates"))
        found = commentary.entries(artifacts).join(F.broadcast(universe))  # one row
        texts = commentary.sentences(found, F.col("aggregates"))
        if args.command == "sentences":
            texts.write.mode("overwrite").parquet(args.out)
        else:
            site.render_site(artifacts, head, args.out, texts)
        return
    if not args.data_dir:
        parser.error("no --data-dir")
    if args.command == "consolidate":
        ingest.consolidate(ingest.read_shards(spark, f"{args.data_dir}/raw"), args.data_dir)
        return
    if not args.rf_path or not args.out:
        parser.error("--rf-path and --out are needed")
    catalog = ingest.Catalog(spark, args.data_dir)
    levels = catalog.panel()
    if args.category:
        from tidemark.plans.assembly import universe as members

        benchmarks = ingest.benchmark_map(spark, args.benchmark_map) if args.benchmark_map else spark.createDataFrame([], "series_id string, benchmark_code string, tier string")
        master = catalog.master(benchmarks, {args.category: args.yardstick})
        names = members(master, args.category).select("series_id", F.col("scheme_name").alias("name"), F.col("fund_house").alias("house"), F.col("inception_date").cast("string").alias("inception_date"), F.col("benchmark_code").alias("stated"), F.col("benchmark_tier").alias("tier"))
    else:
        names = levels.select("series_id").distinct().select("series_id", F.col("series_id").alias("name"), F.lit(None).cast("string").alias("house"))
    previous = spark.read.parquet(args.carry_commentary) if args.carry_commentary else None
    made = build.run(levels, catalog.table("indices"), names, ingest.risk_free(spark, args.rf_path), args.out, args.yardstick, args.category or "all", args.as_of, previous=previous, prompt_version=args.prompt_version, strict=not args.lenient)
    print(made)


if __name__ == "__main__":
    main()
