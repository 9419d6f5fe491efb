"""The rollup over a folder that CSV files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fieldrollup.operators.clean import clean_readings
from fieldrollup.operators.rollup import rollup_readings
from fieldrollup.schema import SEPARATOR


def stream_readings(spark: SparkSession, folder: str, columns: list[str], sep: str = SEPARATOR) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.readStream.schema(schema).csv(folder, sep=sep, header=True)


def stream_rollup(readings: DataFrame, **options) -> DataFrame:
    """For output mode ``complete`` or ``update``; unsorted. State: one row per device and month."""
    return rollup_readings(clean_readings(readings, **options), order=False)
