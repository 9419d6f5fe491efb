"""Line counts and positional access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_newlines(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))


def count_text_lines(col: Column) -> Column:
    """Lines of a text: its newlines, and one more for a last line that has none."""
    return count_newlines(col) + F.when((F.length(col) > 0) & ~F.endswith(col, F.lit("\n")), 1).otherwise(0)


def count_lines(lines: DataFrame) -> DataFrame:
    """All lines of a text scan, header and blank lines included."""
    return lines.agg(F.count(F.lit(1)).alias("n_lines"))


def count_data_lines(lines: DataFrame, skip_blank: bool = True) -> DataFrame:
    """Lines after the header; blank ones count only without ``skip_blank``."""
    counted = F.length("value") > 0 if skip_blank else F.lit(True)
    return lines.agg(F.greatest(F.count_if(counted) - 1, F.lit(0)).alias("n_lines"))


def line_range(df: DataFrame, order: Sequence[str], start: int, count: int) -> DataFrame:
    """``count`` rows from place ``start`` on in the given order; a negative start counts as 0."""
    return df.orderBy(*order).offset(max(0, start)).limit(max(0, count))


def first_lines(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in the given order; all of them if n <= 0."""
    return df.orderBy(*order).limit(n) if n > 0 else df.orderBy(*order)


def nth_line(lines: DataFrame, n: int) -> str | None:
    """Data line n (0-based, header excluded) of a text scan in file order; None out of range.

    Rows have no place in a file, so that this is the one use of an RDD: zipWithIndex.
    """
    if n < 0:
        return None
    found = lines.rdd.zipWithIndex().filter(lambda x: x[1] == n + 1).map(lambda x: x[0][0]).take(1)
    return found[0] if found else None


def nth_row(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Row n (0-based) of a table in the given order; empty out of range."""
    return line_range(df, order, n, 1) if n >= 0 else df.limit(0)
