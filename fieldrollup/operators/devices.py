"""Counts, enumeration, lookup and ranking of devices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldrollup.schema import DEVICE_COLUMN


def line_counts(df: DataFrame, device_column: str = DEVICE_COLUMN) -> DataFrame:
    return df.groupBy(F.col(device_column).alias("device")).agg(F.count(F.lit(1)).alias("line_count"))


def ranked_devices(df: DataFrame, device_column: str = DEVICE_COLUMN) -> DataFrame:
    """Devices by falling row count; ties by device."""
    return line_counts(df, device_column).orderBy(F.desc("line_count"), "device")


def distinct_devices(df: DataFrame, device_column: str = DEVICE_COLUMN) -> DataFrame:
    return df.select(F.col(device_column).alias("device")).where(F.col("device").isNotNull()).distinct()


def count_devices(df: DataFrame, device_column: str = DEVICE_COLUMN) -> DataFrame:
    """Exact number of devices."""
    return df.agg(F.countDistinct(device_column).alias("n_devices"))


def device_lines(df: DataFrame, key, device_column: str = DEVICE_COLUMN) -> DataFrame:
    """The rows of one device: a point predicate that reaches the scan."""
    return df.where(F.col(device_column) == F.lit(key))
