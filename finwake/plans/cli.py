"""Command line: ``python -m finwake demo`` and ``python -m finwake run``."""

from __future__ import annotations

import argparse
import json

from finwake.plans.pipeline import run
from finwake.session import connect
from finwake.sources.demo import make_demo

DEMO_CUT = "2024-02-01"


def _demo(spark, args) -> dict:
    made = make_demo(spark, f"{args.output}/transactions.parquet", args.rows)
    return run(spark, made, DEMO_CUT, args.output, trees=args.trees)


def _run(spark, args) -> dict:
    return run(spark, args.input, args.cut, args.output, trees=args.trees, recursive=args.recursive)


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--trees", type=int, default=200, help="boosting rounds")
    shared.add_argument("--memory-limit", help="memory of driver and executors, as Spark writes it")
    shared.add_argument("--temp-directory", help="folder for spilled data")
    top = argparse.ArgumentParser(prog="finwake", description=__doc__)
    kinds = top.add_subparsers(required=True)
    demo = kinds.add_parser("demo", parents=[shared], help="generate transfers and run the whole plan on them")
    demo.set_defaults(act=_demo)
    demo.add_argument("--rows", type=int, default=12_000)
    demo.add_argument("--output", default="data/demo")
    own = kinds.add_parser("run", parents=[shared], help="run on transfers in Parquet")
    own.set_defaults(act=_run)
    own.add_argument("--input", required=True, help="a file or folder")
    own.add_argument("--recursive", action=argparse.BooleanOptionalAction, help="read nested folders (default: unless they are hive partitions)")
    own.add_argument("--cut", required=True, help="first day of the test part")
    own.add_argument("--output", required=True)
    return top


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    metrics = args.act(connect(args.memory_limit, args.temp_directory), args)
    print(json.dumps(metrics, indent=2, default=str))
    return metrics
