"""Command line jobs on written modelling tables.

    python -m demandloom.cli audit --dataset store_daily.parquet --model-type xgb_total
    python -m demandloom.cli prune --dataset store_daily.parquet --top-k 20
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import SparkSession

from demandloom.forecast import trees
from demandloom.operators import datasets, guards
from demandloom.session import ship_package
from demandloom.sources.files import read_table, write_report


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="demandloom")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("audit", "prune"):
        job = jobs.add_parser(name)
        job.add_argument("--dataset", required=True, help="Parquet table (store, share or direct).")
        job.add_argument("--model-type", default="xgb_total", choices=sorted(datasets.LABELS))
        job.add_argument("--horizon-days", type=int, default=7)
    jobs.choices["audit"].add_argument("--known-future", default="", help="Comma-separated additional names.")
    jobs.choices["audit"].add_argument("--output", default="", help="Folder of the CSV report.")
    jobs.choices["prune"].add_argument("--top-k", type=int, default=20)
    jobs.choices["prune"].add_argument("--threshold", type=float, default=None)
    return parser.parse_args(argv)


def audit(spark: SparkSession, args: argparse.Namespace):
    table = read_table(spark, args.dataset)
    features, label = datasets.select_features(table, args.model_type)
    extra = {c.strip() for c in args.known_future.split(",") if c.strip()}
    report = guards.audit_table(table, features, label, args.horizon_days, guards.KNOWN_FUTURE | extra)
    if args.output:
        write_report(report, args.output)
    return report


def prune(spark: SparkSession, args: argparse.Namespace):
    split = partial(datasets.split_last_n, n=args.horizon_days)
    train, test = split(read_table(spark, args.dataset))
    return trees.prune_compare(train, test, args.model_type, args.top_k, args.threshold)


def main(argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    spark = SparkSession.builder.appName(f"demandloom-{args.job}").getOrCreate()
    ship_package(spark)
    if args.job == "audit":
        report = audit(spark, args)
        guards.audit_status_counts(report).show()
        guards.flagged_features(report).show(15, truncate=False)
    else:
        prune(spark, args).show(truncate=False)


if __name__ == "__main__":
    main()
