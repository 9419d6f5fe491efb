"""Dealing devices to partitions: by hash, or balanced by row count, and even block sizes."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldrollup.operators.devices import line_counts
from fieldrollup.schema import DEVICE_COLUMN

#: Devices that the greedy placement takes to the driver at most: one (key, count) row each.
MAX_PLACED = 1_000_000


def greedy_bins(counts: list[tuple[object, int]], bins: int) -> list[tuple[object, int, int]]:
    """(key, count, bin): heaviest key first, each to the least loaded bin, ties to the lowest."""
    loads = [(0, b) for b in range(bins)]
    out = []
    for key, n in sorted(counts, key=lambda x: (-x[1], str(x[0]))):
        load, b = heapq.heappop(loads)
        out.append((key, n, b))
        heapq.heappush(loads, (load + n, b))
    return out


def balanced_placement(df: DataFrame, bins: int, device_column: str = DEVICE_COLUMN) -> DataFrame:
    """(device, line_count, bin): every device in exactly one bin.

    The assignment is sequential by nature, so that one row for each device goes to the
    driver, MAX_PLACED of them at most; beyond that use ``hash_placement``.
    """
    counts = line_counts(df, device_column).where(F.col("device").isNotNull())
    rows = [(r[0], r[1]) for r in counts.limit(MAX_PLACED + 1).collect()]
    if len(rows) > MAX_PLACED:
        raise ValueError(f"more than {MAX_PLACED} devices: use hash_placement")
    kind = counts.schema["device"].dataType
    schema = T.StructType([T.StructField("device", kind), T.StructField("line_count", T.LongType()), T.StructField("bin", T.IntegerType())])
    return df.sparkSession.createDataFrame(greedy_bins(rows, bins), schema)


def place_rows(df: DataFrame, placement: DataFrame, bins: int, device_column: str = DEVICE_COLUMN) -> DataFrame:
    """The rows, each in the Spark partition of its device's bin. A placement of more than MAX_PLACED rows isn't broadcast."""
    small = placement.select(F.col("device").alias("_placed"), "bin")
    small = F.broadcast(small) if small.limit(MAX_PLACED + 1).count() <= MAX_PLACED else small.hint("merge")
    return df.join(small, df[device_column] == small["_placed"]).drop("_placed").repartitionById(bins, "bin")


def hash_placement(df: DataFrame, bins: int, device_column: str = DEVICE_COLUMN) -> DataFrame:
    return df.repartition(bins, device_column)


def block_sizes(spark: SparkSession, total: int, blocks: int) -> DataFrame:
    """(block, size): equal blocks, the remainder in the last one."""
    return spark.range(blocks).select(
        F.col("id").alias("block"),
        (F.lit(total // blocks) + F.when(F.col("id") == blocks - 1, F.lit(total % blocks)).otherwise(F.lit(0))).cast("bigint").alias("size"),
    )
