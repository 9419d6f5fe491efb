"""Column names, defaults and the output schema of the monthly rollup."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

# Names, separator and first day of the readings, the sensors in output order, and the columns
# whose nulls never drop a row; below, names and types of the result.
SEPARATOR = "|"
DEVICE_COLUMN = "device"
DATE_COLUMN = "data"
MONTH_COLUMN = "ano-mes"
CUTOFF = dt.datetime(2024, 3, 1)
SENSORS = ("temperatura", "umidade", "luminosidade", "ruido", "eco2", "etvoc")
DROPPED = ("id", "latitude", "longitude")

ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField("device", T.StringType()),
        T.StructField(MONTH_COLUMN, T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("valor_maximo", T.DoubleType()),
        T.StructField("valor_medio", T.DoubleType()),
        T.StructField("valor_minimo", T.DoubleType()),
    ]
)
