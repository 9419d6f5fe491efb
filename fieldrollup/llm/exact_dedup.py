"""Exact duplicates by distributed MSD radix partitioning.

A text is the byte string of its length followed by its bytes. Each round splits the open
groups by their next bytes (digits of growing width); a group with a single document, or
whose documents have ended, is closed. Groups hold equal texts then, and no digest decides.
Every byte of an open document crosses the network once, as the digit of one round;
documents that differ early (nearly all of them) never ship more than the first digit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldrollup.llm.common import Staging, files, text_or_empty, without_spaces

#: Bytes of the digits by round; the last width repeats until all groups are closed.
WIDTHS = (64, 4096, 65536, 1 << 20)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", widths: Sequence[int] = WIDTHS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each input row.

    Equal: the same after deleting ``[\\x20\\x09-\\x0D]``; null counts as empty, and empty
    texts are equal. Of a group, the row with the most code points stays, then the smallest
    doc_id (nulls last), then the first of rows that are repeated under one doc_id.
    An empty table gives an empty result; further columns aren't looked at.

    A group of any size is safe: digits are counted by partial aggregates, and the join that
    hands group ids back is one that AQE splits where a key is hot. The SHA-256 is an output
    column only.
    """
    spark = df.sparkSession
    stage, n_files = Staging(spark, "radix"), files(df.count())
    text = text_or_empty(text_col)
    body = without_spaces(text)
    first = widths[0]
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.char_length(text).cast("bigint").alias("n_chars"), body.alias("body")
    ).select(
        "doc_id", "n_chars", F.octet_length("body").cast("bigint").alias("n_left"), F.sha2("body", 256).alias("text_sha256"),
        F.substring(F.col("body").cast("binary"), 1, first).alias("digit"), F.col("body").cast("binary").alias("body"),
    )
    opened = rows.groupBy("n_left", "digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").repartition(n_files)
    opened = stage.write(opened.select(F.col("n_left").alias("_len"), F.col("digit").alias("_digit"), F.monotonically_increasing_id().alias("gid")), "open0")
    # a merge join at every size: the open digits grow with the input and are never broadcast
    joined = rows.join(opened.hint("merge"), (F.col("n_left") == F.col("_len")) & (F.col("digit") == F.col("_digit")), "left")
    state = joined.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "text_sha256", "gid",
        (F.col("n_left") - first).alias("n_left"),
        F.when(F.col("gid").isNotNull() & (F.col("n_left") > first), F.substring("body", first + 1, 1 << 30)).alias("rest"),
    )
    state = stage.write(state, "state0")
    stage.drop("open0")
    columns = ["row", "doc_id", "n_chars", "text_sha256"]
    alone = [state.where("gid is null").select(*columns)]
    closed = [state.where("gid is not null and n_left <= 0").select(*columns, F.lit(0).alias("round"), "gid")]
    state = state.where("gid is not null and n_left > 0")
    k = 0
    while not state.isEmpty():
        k += 1
        width = widths[min(k, len(widths) - 1)]
        digits = state.withColumn("digit", F.substring("rest", 1, width))
        found = digits.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").repartition(n_files)
        found = stage.write(found.select(F.col("gid").alias("_gid"), F.col("digit").alias("_digit"), F.monotonically_increasing_id().alias("new")), f"open{k}")
        split = digits.join(found.hint("merge"), (F.col("gid") == F.col("_gid")) & (F.col("digit") == F.col("_digit")), "left").select(
            *columns, F.col("new").alias("gid"), (F.col("n_left") - width).alias("n_left"),
            F.when(F.col("new").isNotNull() & (F.col("n_left") > width), F.substring("rest", width + 1, 1 << 30)).alias("rest"),
        )
        split = stage.write(split, f"state{k}")
        stage.drop(f"open{k}")
        alone.append(split.where("gid is null").select(*columns))
        closed.append(split.where("gid is not null and n_left <= 0").select(*columns, F.lit(k).alias("round"), "gid"))
        state = split.where("gid is not null and n_left > 0")
    return _result(reduce(DataFrame.unionAll, alone), reduce(DataFrame.unionAll, closed))


def _result(alone: DataFrame, closed: DataFrame) -> DataFrame:
    single = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("smallest"), (-F.col("row")).alias("first")))
    groups = closed.groupBy(F.col("round").alias("_round"), F.col("gid").alias("_gid")).agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    # a merge join, which AQE splits where a group is hot
    grouped = closed.join(groups.hint("merge"), (F.col("round") == F.col("_round")) & (F.col("gid") == F.col("_gid"))).select(
        "doc_id", (-F.col("best.smallest")).alias("keep_id"), "group_size",
        (F.col("row") == -F.col("best.first")).alias("kept"), "text_sha256",
    )
    return single.unionAll(grouped)
