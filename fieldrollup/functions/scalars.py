"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_field(col: Column, index: int, sep: str = "|") -> Column:
    """Field ``index`` (0-based) of a delimited text; null if there are fewer."""
    literal = "".join(f"[{c}]" if c not in "^\\" else f"\\{c}" for c in sep)
    return F.get(F.split(col, literal, -1), index)


def has_csv_extension(col: Column) -> Column:
    return F.endswith(col, F.lit(".csv"))


def format_size(col: Column) -> Column:
    """Bytes as text: ``n bytes`` below 1024, then KB, MB, GB with two decimals.

    ``bround`` first, as exact ties go to the even digit.
    """
    scaled = lambda power: F.bround(col.cast("double") / F.lit(float(1024**power)), 2)
    return (
        F.when(col < 1024, F.concat(col.cast("string"), F.lit(" bytes")))
        .when(col < 1024**2, F.format_string("%.2f KB", scaled(1)))
        .when(col < 1024**3, F.format_string("%.2f MB", scaled(2)))
        .otherwise(F.format_string("%.2f GB", scaled(3)))
    )


def trim_spaces(col: Column) -> Column:
    return F.trim(col)
