"""python -m arborweave benchmark|check FILE... : codec sizes or cross-checks of edge files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from arborweave.operators.analytics import accuracy, speedup
from arborweave.plans import batch
from arborweave.sources.reports import console_table, write_report


def main() -> None:
    parser = argparse.ArgumentParser(prog="arborweave", description=__doc__)
    parser.add_argument("what", choices=("benchmark", "check"))
    parser.add_argument("files", nargs="+")
    parser.add_argument("--format", choices=("edges", "mtx"), default="edges")
    parser.add_argument("--out", help="folder for a CSV file")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("arborweave").getOrCreate()
    run = batch.benchmark if args.what == "benchmark" else batch.cross_checks
    found = run(spark, args.files, args.format)
    rows = found.rows if args.what == "benchmark" else speedup(found.rows)
    console_table(rows).show(1000, truncate=False)
    if args.what == "check":
        accuracy(found.rows).show()
    for path, why in found.failures.items():
        print(f"skipped {path}: {why}")
    if args.out:
        write_report(rows, args.out, digits=4)


if __name__ == "__main__":
    main()
