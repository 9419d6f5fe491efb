"""python -m fieldrollup INPUT.csv [DEVICE_COLUMN] [--output result.csv | --show]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from fieldrollup.plans.report import rollup_file, run_report
from fieldrollup.schema import DEVICE_COLUMN


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fieldrollup", description="Monthly rollup of device readings.")
    parser.add_argument("input")
    parser.add_argument("device_column", nargs="?", default=DEVICE_COLUMN)
    parser.add_argument("--output", default="result.csv")
    parser.add_argument("--show", action="store_true", help="print the result and its row count instead")
    parser.add_argument("--lenient", action="store_true", help="bad dates and numbers become nulls")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("fieldrollup").getOrCreate()
    if args.show:
        result = rollup_file(spark, args.input, args.device_column, strict=not args.lenient)
        result.show(truncate=False)
        print(result.count())
    else:
        for step, seconds in run_report(spark, args.input, args.output, args.device_column, strict=not args.lenient).items():
            print(f"{step}: {seconds:.3f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
