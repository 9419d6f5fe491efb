"""The monthly rollup: one wide aggregate, unfolded into one row for each sensor."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldrollup.operators.clean import clean_readings
from fieldrollup.schema import DEVICE_COLUMN, MONTH_COLUMN, ROLLUP_SCHEMA


def decimal_mean(col: str) -> Column:
    """Mean over exact sums, for readings of four decimals at most; the order of rows can't show."""
    return F.sum(F.col(col).cast("decimal(18,4)")).cast("double") / F.count(col)


def rollup_wide(df: DataFrame, keys: Sequence[str], measures: Sequence[str], mean: Callable[[str], Column] = F.avg) -> DataFrame:
    """max, mean and min of every measure in a single pass: one partial and one final aggregate."""
    return df.groupBy(*keys).agg(
        *[f(m).alias(f"{m}:{tag}") for m in measures for tag, f in (("max", F.max), ("avg", mean), ("min", F.min))]
    )


def unfold(wide: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Wide aggregates as rows (keys, sensor, valor_maximo, valor_medio, valor_minimo).

    It follows the aggregate, so that only groups, not readings, are multiplied.
    """
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cells = ", ".join(f"{quoted(m)}, `{m}:max`, `{m}:avg`, `{m}:min`" for m in measures)
    stacked = f"stack({len(measures)}, {cells}) as (sensor, valor_maximo, valor_medio, valor_minimo)"
    return wide.selectExpr(*[f"`{k}`" for k in keys], stacked)


def concat_sensors(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The readings themselves in long form (UNION ALL of one projection per sensor)."""
    parts = [df.select(*keys, F.lit(m).alias("sensor"), F.col(m).alias("value")) for m in measures]
    return reduce(DataFrame.unionByName, parts)


def rollup_readings(cleaned: DataFrame, order: bool = True, mean: Callable[[str], Column] = F.avg) -> DataFrame:
    keys = ["device", MONTH_COLUMN]
    measures = [c for c in cleaned.columns if c not in keys]
    out = unfold(rollup_wide(cleaned, keys, measures, mean), keys, measures)
    return out.orderBy(*keys, "sensor") if order else out


def monthly_rollup(
    df: DataFrame, device_column: str = DEVICE_COLUMN, order: bool = True, mean: Callable[[str], Column] = F.avg, **options
) -> DataFrame:
    """The whole query on raw string rows; options as in ``clean_readings``.

    Without the device column the result is empty, with the same columns.
    """
    if device_column not in df.columns:
        return df.sparkSession.createDataFrame([], ROLLUP_SCHEMA)
    return rollup_readings(clean_readings(df, device_column, **options), order, mean)
