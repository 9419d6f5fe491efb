"""From raw string rows to typed readings: drop, null filter, dates, cutoff, casts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldrollup.schema import CUTOFF, DATE_COLUMN, DEVICE_COLUMN, DROPPED, MONTH_COLUMN, SENSORS


def drop_columns(df: DataFrame, names: Sequence[str] = DROPPED) -> DataFrame:
    """Without the named columns; names it lacks are ignored. Exact, case-sensitive names."""
    return df.drop(*[n for n in names if n in df.columns])


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Rows in which no remaining column is null."""
    return df.dropna(how="any")


def parse_day(col: Column, strict: bool = True) -> Column:
    """The text before the first space as a timestamp at midnight.

    strict: text that isn't ``yyyy-MM-dd`` raises; otherwise it becomes null.
    """
    day = F.substring_index(col, " ", 1)
    return F.to_timestamp(day, "yyyy-MM-dd") if strict else F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))


def to_double(col: Column, strict: bool = True) -> Column:
    return col.cast("double") if strict else col.try_cast("double")


def year_month(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def since(df: DataFrame, column: str = DATE_COLUMN, cutoff: dt.datetime = CUTOFF) -> DataFrame:
    """Rows on or after the cutoff."""
    return df.where(F.col(column) >= F.lit(cutoff).cast(df.schema[column].dataType))


def present_sensors(df: DataFrame, sensors: Sequence[str] = SENSORS) -> list[str]:
    return [s for s in sensors if s in df.columns]


def clean_readings(
    df: DataFrame,
    device_column: str = DEVICE_COLUMN,
    date_column: str = DATE_COLUMN,
    cutoff: dt.datetime = CUTOFF,
    sensors: Sequence[str] = SENSORS,
    dropped: Sequence[str] = DROPPED,
    strict: bool = True,
) -> DataFrame:
    """Readings as (device, ano-mes, sensors as doubles).

    Nulls in any column but the dropped ones remove the row before anything is parsed;
    numbers are cast after the cutoff, so that old rows can't fail. Raises ``ValueError``
    if the date column or all sensors are missing. NaN readings are kept. Columns that are
    typed already (Parquet) are used as they are, so that the cutoff reaches the scan.
    """
    if date_column not in df.columns:
        raise ValueError(f"no column {date_column!r}")
    names = present_sensors(df, sensors)
    if not names:
        raise ValueError(f"none of the sensors {list(sensors)} is present")
    kinds = dict(df.dtypes)
    rows = drop_null_rows(drop_columns(df, dropped)).where(F.col(device_column).isNotNull())
    if kinds[date_column] == "string":
        rows = rows.withColumn(date_column, parse_day(F.col(date_column), strict))
    rows = since(rows, date_column, cutoff)
    return rows.select(
        F.col(device_column).alias("device"),
        year_month(F.col(date_column)).alias(MONTH_COLUMN),
        *[F.col(s) if kinds[s] == "double" else to_double(F.col(s), strict).alias(s) for s in names],
    )
