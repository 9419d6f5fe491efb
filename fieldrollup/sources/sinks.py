"""CSV output of the rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A folder of CSV parts, each with a header; written in parallel."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_single_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """One CSV file at ``path``: a single part, renamed through the path's own file system.

    Meant for the rollup, which has a row per device, month and sensor. The order of a
    sorted frame is kept, as its range partitions are written one after another.
    """
    write_part(df, path, sep)
    publish_part(df.sparkSession, path)


def write_part(df: DataFrame, path: str, sep: str = ",") -> None:
    """The result as the only part of a folder beside ``path``."""
    df.coalesce(1).write.mode("overwrite").csv(f"{path}.parts", header=True, sep=sep)


def publish_part(spark: SparkSession, path: str) -> None:
    """Moves the part to ``path``. An older file there is set aside until the new one is in its place."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    parts, target, old = (hadoop.Path(p) for p in (f"{path}.parts", path, f"{path}.old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")]
    if not found:
        found = [hadoop.Path(parts, "part-none")]
        fs.create(found[0]).close()
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"can't set aside {path}")
    if not fs.rename(found[0], target):
        fs.rename(old, target)
        raise OSError(f"can't write {path}")
    fs.delete(old, True)
    fs.delete(parts, True)
