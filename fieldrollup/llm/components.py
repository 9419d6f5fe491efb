"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldrollup.llm.common import Staging

MAX_ROUNDS = 60


def components(edges: DataFrame, stage: Staging, name: str = "components", rows: int | None = None) -> DataFrame:
    """(node, root): every node that an edge (a, b) names, with the smallest node it is connected to.

    Each round links all larger neighbours of a node to its smallest one (large star), then
    all smaller ones (small star), until nothing changes; rounds grow with the logarithm of
    the nodes. Rounds are written to the shared folder. No list of neighbours is ever
    gathered: a node's minimum is an aggregate, and handing it back is a join that AQE splits.
    rows: about how many edges there are, for the number of files.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, k = stage.write(clean, f"{name}0", rows), 0

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = mark(current)
    while last[0]:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        current = stage.write(small, f"{name}{k}", last[0])
        stage.drop(f"{name}{k - 1}")
        now = mark(current)
        if now == last:
            break
        if k >= MAX_ROUNDS:
            raise RuntimeError("components don't settle")
        last = now
    roots = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
