"""Command line, for ``spark-submit`` or ``python -m pitchspark``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pitchspark.operators.windows import WindowConfig
from pitchspark.plans import jobs
from pitchspark.sources.registry import PROVIDERS
from pitchspark.streaming.ingest import ingest_new


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pitchspark")
    commands = parser.add_subparsers(dest="command", required=True)

    ingest = commands.add_parser("ingest", help="provider files to canonical tables")
    ingest.add_argument("--dataset", choices=sorted(PROVIDERS), default="metrica")
    ingest.add_argument("--raw-dir", required=True)
    ingest.add_argument("--out-dir", required=True)
    ingest.add_argument("--match-id", help="read everything as one match of this name")

    new = commands.add_parser("ingest-new", help="read raw files that no run has read yet")
    new.add_argument("--dataset", choices=sorted(PROVIDERS), default="metrica")
    new.add_argument("--raw-dir", required=True)
    new.add_argument("--out-dir", required=True)

    features = commands.add_parser("features", help="tracking to the feature table")
    features.add_argument("--tracking", required=True)
    features.add_argument("--out", required=True)

    quality = commands.add_parser("quality", help="print the quality summary, or write the report")
    quality.add_argument("--tracking", required=True)
    quality.add_argument("--out", help="directory for the parts of the report")

    windows = commands.add_parser("export-windows", help="history/future windows for models")
    windows.add_argument("--tracking", required=True)
    windows.add_argument("--features")
    windows.add_argument("--out", required=True)
    windows.add_argument("--match-id", help="export this match, leaving the others' windows alone")
    defaults = WindowConfig()
    for name in ("history_s", "future_s", "fps"):
        windows.add_argument(f"--{name.replace('_', '-')}", type=float,
                             default=getattr(defaults, name))
    for name in ("max_agents", "stride_steps"):
        windows.add_argument(f"--{name.replace('_', '-')}", type=int,
                             default=getattr(defaults, name))
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"pitchspark {args.command}").getOrCreate()
    if args.command == "ingest":
        try:
            done = jobs.ingest(spark, args.dataset, args.raw_dir, args.out_dir, args.match_id)
        except (FileNotFoundError, ValueError) as missing:
            print(missing)
            return 1
        print(json.dumps(done))
    elif args.command == "ingest-new":
        done = ingest_new(spark, args.dataset, args.raw_dir, args.out_dir).agg(
            F.count_if("is_new").alias("files"), F.count_distinct("match_id").alias("matches")
        )
        print(json.dumps(done.first().asDict()))
    elif args.command == "features":
        print(json.dumps({"features": jobs.features(spark, args.tracking, args.out)}))
    elif args.command == "quality":
        summary = jobs.quality(spark, args.tracking, args.out)
        print(json.dumps(summary.first().asDict()))
    else:
        cfg = WindowConfig(args.history_s, args.future_s, args.fps, args.max_agents,
                           args.stride_steps)
        print(json.dumps(
            jobs.export_windows(spark, args.tracking, args.out, args.features, cfg, args.match_id)
        ))
    return 0
