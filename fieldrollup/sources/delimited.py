"""Delimited text and Parquet sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrollup.schema import DEVICE_COLUMN, SEPARATOR


def has_csv_suffix(path: str) -> bool:
    """True if what follows the last dot is exactly ``csv`` (case-sensitive)."""
    return path.endswith(".csv")


def read_readings(spark: SparkSession, path: str, sep: str = SEPARATOR, check_suffix: bool = True) -> DataFrame:
    """A header-first file as all-string columns, one record a line.

    Blank lines are skipped, short rows are padded with nulls and long ones cut. A file
    that is empty, or whose header has no line end, raises ``ValueError``; a wrong suffix does too.
    """
    if check_suffix and not has_csv_suffix(path):
        raise ValueError(f"not a .csv file: {path}")
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding="UTF-8")
    if not df.columns:
        raise ValueError(f"empty file, no header: {path}")
    # a file without rows is little more than its header: read whole
    if df.isEmpty() and not spark.read.text(path, wholetext=True).where(~F.contains("value", F.lit("\n"))).isEmpty():
        raise ValueError(f"the header has no line end: {path}")
    return df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line of a text file, in the column ``value``; only ``\\n`` ends a line."""
    return spark.read.text(path, lineSep="\n")


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def header_index(header: str, name: str = DEVICE_COLUMN, sep: str = SEPARATOR) -> int:
    """0-based place of a column in a header line, names trimmed of spaces; -1 if absent."""
    names = [x.strip(" ") for x in header.rstrip("\r\n").split(sep)]
    return names.index(name) if name in names else -1


def summary(spark: SparkSession, readings: DataFrame, device_column: str = DEVICE_COLUMN, sep: str = SEPARATOR) -> DataFrame:
    """One row: data rows, distinct devices, the header, the bytes of header and rows as delimited text, the default parallelism."""
    header = sep.join(readings.columns)
    cells = [F.octet_length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in readings.columns]
    row_size = reduce(lambda a, b: a + b, cells) + (len(cells) - 1) * len(sep.encode()) + 1
    return readings.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(device_column).alias("n_devices"), F.coalesce(F.sum(row_size), F.lit(0)).cast("bigint").alias("data_size"),
    ).select(
        "n_rows", "n_devices", F.lit(header).alias("header"), F.lit(len(header.encode())).cast("bigint").alias("header_size"), "data_size",
        F.lit(spark.sparkContext.defaultParallelism).alias("parallelism"),
    )
