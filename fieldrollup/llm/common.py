"""What the text operators share: staged tables, SQL helpers, and the notion of a word."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrollup.sources.shared import shared_folder

# The characters that part words, and a word, in Java's and Python's regex.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


#: Rows of a file of a table of short rows. Many little files cost more than the rows in them.
FILE_ROWS = 1_000_000


def files(rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS))


class Staging:
    """Intermediate tables, written as Parquet to the shared folder, so that lost executors
    cost a re-read and never a re-computation from the start. ``drop`` removes one early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/staging/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        spark._staged = [*staged(spark), self.root]

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Writes and reads again. rows: a bound of small rows, which then go into few files."""
        path = f"{self.root}/{name}"
        df = df if rows is None else df.repartition(files(rows))
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if not self.paths:  # whatever isn't swept before goes with the application
            root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        self.paths[name] = path
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.paths[name])

    def drop(self, name: str) -> None:
        _delete(self.spark, self.paths.pop(name))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(spark: SparkSession) -> list[str]:
    """Folders of the session's staged tables. A result that is still to be read may need them."""
    return getattr(spark, "_staged", [])


def sweep(spark: SparkSession, folders: list[str]) -> None:
    """Removes staged tables, once what was made of them is written."""
    for folder in folders:
        _delete(spark, folder)
    spark._staged = [x for x in staged(spark) if x not in folders]


#: Bits of an id filter at most: 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def id_filter(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test of which only some ids pass, all of ``ids`` among them, to keep rows from a join's shuffle.

    It is a bitmap of hashed ids, broadcast, of 16 bits an id and FILTER_BITS at most: beyond
    some millions of ids more and more others pass, and the join does the work alone.
    """
    spark = ids.sparkSession
    size = 1 << max(16, min(FILTER_BITS, ids.count() * 16).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
    words = ids.select(place(F.col(column)).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(size // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def test(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    known = F.arrow_udf(test, "boolean")
    return lambda c: known(place(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def without_spaces(col: Column) -> Column:
    return F.translate(col, SPACES, "")


def words(col: Column) -> Column:
    """The words of a text as an array, empty if it has none."""
    inner = F.btrim(col, F.lit(SPACES))
    return F.when(inner != "", F.split(inner, SPACE_CLASS)).otherwise(F.array().cast("array<string>"))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
