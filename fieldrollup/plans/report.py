"""File in, rollup out, with stage timings."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from fieldrollup.operators.rollup import monthly_rollup
from fieldrollup.schema import DEVICE_COLUMN
from fieldrollup.sources.delimited import read_readings, summary
from fieldrollup.sources.sinks import publish_part, write_part


def rollup_file(spark: SparkSession, path: str, device_column: str = DEVICE_COLUMN, **options) -> DataFrame:
    return monthly_rollup(read_readings(spark, path), device_column, **options)


def run_report(spark: SparkSession, path: str, out: str, device_column: str = DEVICE_COLUMN, **options) -> dict[str, float]:
    """Writes the rollup of ``path`` as one CSV file; returns seconds by step.

    open: the file and its header; devices: rows by device, as the summary shows them;
    plan: analysis and optimisation; process: scan, aggregation and order; write: the one file.
    """
    marks = [("start", time.perf_counter())]

    def done(name: str) -> None:
        marks.append((name, time.perf_counter()))

    raw = read_readings(spark, path)
    done("open")
    if device_column in raw.columns:
        summary(spark, raw, device_column).collect()
    done("devices")
    result = monthly_rollup(raw, device_column, **options)
    result._jdf.queryExecution().optimizedPlan()
    done("plan")
    write_part(result, out)
    done("process")
    publish_part(spark, out)
    done("write")
    steps = {name: t - before for (_, before), (name, t) in zip(marks, marks[1:], strict=False)}
    return steps | {"total": marks[-1][1] - marks[0][1]}
