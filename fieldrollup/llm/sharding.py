"""Sharding by a minimax contiguous partition of atomic groups. DataFrame functions only.

Rows of equal texts are one atomic group; groups stand in the order of a 60-bit key of
their text. The smallest capacity for which greedy cutting needs no more than the wished
number of shards is found by binary search, and the cuts of that capacity are the shards.

The driver never sees all groups. It starts from the sums of 2**BITS ranges of the key and
narrows: for capacities that are still possible, each cut can only fall into a short run of
ranges, and only those are opened, range by range, until few enough groups are left to be
looked at one by one. The result is exact: the same as a search over all groups.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldrollup.llm.common import Staging, text_or_empty

KEY_BITS = 60
#: Ranges of the first histogram, bits by which an open range is split, and groups that may be looked at one by one.
BITS, MORE_BITS, MAX_GROUPS = 14, 6, 100_000
#: Rows of one window partition when slots are numbered.
CELL_ROWS = 200_000
OVERHEAD = 8


def greedy_cuts(sizes: list[int], capacity: int) -> list[int]:
    """Ends (indices, exclusive) of the shards that greedy cutting fills up to the capacity."""
    totals = [0, *accumulate(sizes)]
    ends, at = [], 0
    while at < len(sizes):
        end = bisect_right(totals, totals[at] + capacity) - 1
        if end <= at:
            raise ValueError("a group is larger than the capacity")
        while end < len(sizes) and totals[end + 1] == totals[end]:
            end += 1
        ends.append(end)
        at = end
    return ends


def smallest_capacity(sizes: list[int], shards: int, low: int = 0) -> int:
    """The least capacity, from ``low`` on, for which greedy cutting makes at most ``shards`` shards."""
    low = max(low, max(sizes, default=0), -(-sum(sizes) // shards))
    high = max(low, sum(sizes))
    while low < high:
        mid = (low + high) // 2
        if len(greedy_cuts(sizes, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def _open_runs(cells: list[tuple[int, int, int, int]], shards: int, low: int, high: int) -> list[tuple[int, int]]:
    """Runs of cell indices that a cut may fall into, for any capacity from low to high."""
    totals = [0, *accumulate(c[2] for c in cells)]
    runs: list[list[int]] = []
    least, most = 0, 0
    for _ in range(shards - 1):
        reach = bisect_right(totals, totals[least] + low) - 1  # cuts on cell borders reach no less
        least = min(max(reach, least), len(cells))
        most = min(most + high, totals[-1])  # cuts anywhere reach no more
        if least >= len(cells):
            break
        last = min(bisect_right(totals, most) - 1, len(cells) - 1)
        if runs and least <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([least, last])
    return [(a, b) for a, b in runs]


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Keys at which the second and later shards start. groups: (key, size), one row a group."""
    top = F.shiftright("key", KEY_BITS - BITS)
    found = groups.groupBy(top.alias("c")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.max("size").alias("m")).orderBy("c").collect()
    if not found:
        return []
    largest = max(r["m"] for r in found)
    # a cell: first key, bits below it, sum, groups
    cells = [(r["c"] << (KEY_BITS - BITS), KEY_BITS - BITS, r["s"], r["n"]) for r in found]
    low = max(largest, -(-sum(c[2] for c in cells) // shards))
    while True:
        high = smallest_capacity([c[2] for c in cells], shards, low)
        runs = _open_runs(cells, shards, low, high)
        inside = [i for a, b in runs for i in range(a, b + 1) if cells[i][3] > 1 and cells[i][1] > 0]
        if not inside:
            break
        few = sum(cells[i][3] for i in inside) <= MAX_GROUPS
        bits = min(cells[i][1] for i in inside)
        keep = 0 if few else max(0, bits - MORE_BITS)
        spans = [(cells[a][0], cells[b][0] + (1 << cells[b][1]) - 1) for a, b in runs]
        where = " or ".join(f"key between {a} and {b}" for a, b in spans)
        finer = groups.where(where).groupBy(F.shiftright("key", keep).alias("c")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("c").collect()
        opened = {i for a, b in runs for i in range(a, b + 1)}
        cells = sorted([c for i, c in enumerate(cells) if i not in opened] + [(r["c"] << keep, keep, r["s"], r["n"]) for r in finer])
    ends = greedy_cuts([c[2] for c in cells], high)
    return [cells[e][0] for e in ends[:-1]]


def shard_of(key: Column, cuts: list[int]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c <= key))


def shards(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each input row; law ``bytes``.

    size: UTF-8 bytes of the text and OVERHEAD; a null text counts as empty and forms one
    group with empty ones. Rows of equal texts share a shard; the largest shard is as small
    as any contiguous partition of the ordered groups allows. Slots number a shard's rows
    from 0 without gaps. Repeated rows and null ids get slots of their own; an empty table
    gives an empty result; a shard may stay empty where groups are few.

    Texts are read once and never shuffled. A group of any size is one pre-aggregated row
    for the cuts; for the slots its rows are salted by id into cells of bounded size.
    """
    spark = df.sparkSession
    stage = Staging(spark, "shards")
    text = text_or_empty(text_col)
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint").alias("key"),
    )
    n_rows = df.count()
    rows = stage.write(rows, "rows", n_rows)
    groups = stage.write(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups", n_rows)
    cuts = minimax_cuts(groups, n_shards)
    salts = max(16, math.ceil(n_rows / (n_shards * CELL_ROWS)))
    placed = rows.select("doc_id", "size", "text_crc32", shard_of(F.col("key"), cuts).alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(salts)).alias("salt"))
    counts = placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("shard").alias("_shard"), F.col("salt").alias("_salt"), F.coalesce(before, F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size"))
    numbered = placed.withColumn("number", number)
    # one row for each CELL_ROWS rows, on the keys that the numbers are dealt by
    out = numbered.join(starts, (F.col("shard") == F.col("_shard")) & (F.col("salt") == F.col("_salt")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("number") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
