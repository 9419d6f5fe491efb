"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget goes down the tree by the weights of
its nodes. A leaf can give its tokens MAX_EPOCHS times; what it can't fill goes to its
siblings, by their weights, and only what all of them can't take goes up, to the siblings of
the parent. Each leaf then takes whole passes over its documents and the token-prefix of one
more pass, every pass in its own seeded order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldrollup.llm.common import Staging, text_or_empty, words

#: Leaves whose plan is broadcast at most, one short row each; a larger plan is joined by a shuffle.
MAX_LEAVES = 200_000
#: Rows of a run within which prefix sums are taken.
RUN_ROWS = 100_000


def budgets(leaves: DataFrame, names: Sequence[str], weights: Mapping[tuple, float], budget: float, max_epochs: int) -> DataFrame:
    """The leaves (names, t tokens, n rows) with ``given``, the tokens that each one gives.

    From the root down, a node's tokens go to its children by their weights (by path prefix, 1
    where none is given), and no child gets more than its room, its tokens max_epochs times.
    What a child can't take its siblings share, by their weights again, and only what all of them
    can't take goes up. Children fill in the order of room over weight: those before the
    first that isn't filled are full, and the others share the rest at one level.
    """
    spark = leaves.sparkSession
    roof = leaves.agg(F.sum("t") * max_epochs).first()[0] or 0
    given, keys = None, []
    for depth, name in enumerate(names, 1):
        above, keys = keys, [*keys, name]
        nodes = leaves.groupBy(*keys).agg((F.sum("t") * max_epochs).cast("double").alias("room"))
        own = [(*(None if x is None else str(x) for x in path), float(w)) for path, w in weights.items() if len(path) == depth]
        listed = spark.createDataFrame(own, ", ".join(f"_{k} string" for k in keys) + ", weight double")
        nodes = nodes.join(F.broadcast(listed), _same(keys), "left").drop(*[f"_{k}" for k in keys])  # the caller's table
        nodes = nodes.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        if given is None:
            nodes = nodes.withColumn("given", F.lit(float(min(budget, roof))))
        else:
            nodes = nodes.join(given.select(*[F.col(k).alias(f"_{k}") for k in above], "given"), _same(above)).drop(*[f"_{k}" for k in above])
        live = (F.col("room") > 0) & (F.col("weight") > 0)
        nodes = nodes.withColumn("ratio", F.when(live, F.col("room") / F.col("weight")))
        order = Window.partitionBy(*above).orderBy(F.asc_nulls_last("ratio"), *keys)
        before = F.coalesce(F.sum(F.when(live, F.col("room"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum(F.when(live, F.col("weight"))).over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("level", F.when(live, (F.col("given") - before) / rest))
        full = F.col("ratio") <= F.col("level")
        level = F.max(F.when(~full, F.greatest("level", F.lit(0.0)))).over(Window.partitionBy(*above))
        share = F.when(~live, 0.0).when(full, F.col("room")).otherwise(level * F.col("weight"))
        given = nodes.select(*keys, share.alias("share")).withColumnRenamed("share", "given")
    own = given.select(*[F.col(k).alias(f"_{k}") for k in keys], "given")
    return leaves.join(own, _same(keys)).drop(*[f"_{k}" for k in keys])


def _same(names: Sequence[str]) -> Column:
    """Equal paths; a null is a value of its own."""
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])


def mix(
    df: DataFrame,
    levels: Sequence[tuple[str, Column]],
    weights: Mapping[tuple, float],
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 17,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """(row, the levels, n_tokens, epoch): a row for each time that an input row is taken.

    levels: names and expressions from the root down; weights: by the path of their values,
    where a path without weight has 1. budget: tokens to take; by default what the input
    has. n_tokens: words of the text. A leaf takes the prefix of documents that begin within
    its budget, so that it may pass it by a part of one document. Documents without words have
    no tokens; they are in wherever a pass comes by. Null levels are a value of their own.
    Repeated rows (equal id and text) stand at one place and are in or out together. An
    empty table gives an empty result; columns may bear any names, as a row travels whole.

    Passes are dealt into runs by the leading bits of their order, so that a leaf of any
    size is summed in parallel: runs first, then rows within a run.
    """
    spark = df.sparkSession
    stage = Staging(spark, "mix")
    names = [n for n, _ in levels]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    text = text_or_empty(text_col)
    keyed = df.select(
        whole, *[e.cast("string").alias(n) for n, e in levels], F.size(words(text)).cast("bigint").alias("n_tokens"),
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("own"),
    )
    n_rows = df.count()
    small = stage.write(keyed.select(*names, "n_tokens", "own"), "keys", n_rows)
    leaves = stage.write(small.groupBy(*names).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")), "leaves", n_rows)
    n_leaves, wish, largest = leaves.agg(F.count(F.lit(1)), F.sum("t"), F.max("n")).first()
    plan = budgets(leaves, names, weights, (wish or 0) if budget is None else budget, max_epochs)
    full = F.least(F.floor(F.col("given") / F.col("t") + 1e-9), F.lit(max_epochs))
    plan = plan.withColumn("full", F.when(F.col("t") > 0, full).otherwise((F.col("given") > 0).cast("int")).cast("int"))
    plan = plan.withColumn("rest", F.col("given") - F.col("full") * F.col("t"))
    plan = stage.write(plan.select(*[F.col(n).alias(f"_{n}") for n in names], "full", "rest"), "plan", n_leaves)
    attach = F.broadcast if n_leaves <= MAX_LEAVES else lambda df: df
    match = _same(names)
    runs = max(1, math.ceil((largest or 0) / RUN_ROWS))
    order = F.xxhash64("own", "full", F.lit(seed))
    last = small.join(attach(plan), match).where("rest >= 0.5").select(*names, "n_tokens", "own", "rest", order.alias("place"))
    last = last.withColumn("run", F.floor(F.shiftrightunsigned("place", 1).cast("double") / F.lit(float(1 << 63)) * runs).cast("int"))
    # the place decides order; its unsigned value is compared through the sign bit
    sums = last.groupBy(*names, "run").agg(F.sum("n_tokens").alias("t"))
    above = F.sum("t").over(Window.partitionBy(*names).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("run").alias("_run"), F.coalesce(above, F.lit(0)).alias("above"))
    inside = F.sum("n_tokens").over(Window.partitionBy(*names, "run").orderBy(F.expr("place < 0"), "place", "own", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    summed = last.withColumn("before", F.coalesce(inside, F.lit(0)))
    cut = summed.join(sums, match & (F.col("run") == F.col("_run"))).where(F.col("above") + F.col("before") < F.col("rest"))
    # a leaf's prefix ends at one place: the largest that is in
    edge = cut.groupBy(*names).agg(F.max(F.struct(F.expr("place < 0").alias("high"), F.col("place").alias("at"))).alias("edge"))
    edge = edge.select(*[F.col(n).alias(n) for n in names], "edge")
    plan = stage.write(plan.join(edge, match, "left").select(*[f"_{n}" for n in names], "full", "edge"), "passes", n_leaves)
    place = F.xxhash64("own", "full", F.lit(seed))
    inside = F.struct((place < 0).alias("high"), place.alias("at")) <= F.col("edge")
    times = F.col("full") + F.when(F.col("edge").isNotNull() & inside, 1).otherwise(0)
    taken = keyed.join(attach(plan), match).withColumn("times", times).where("times > 0")
    return taken.select("row", *names, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"))
