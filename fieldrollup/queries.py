"""The engine's operators as named queries over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldrollup.functions import scalars
from fieldrollup.operators import clean, counter, devices, lines, placement, rollup
from fieldrollup.schema import MONTH_COLUMN, SEPARATOR
from fieldrollup.sources.delimited import header_index, read_readings, read_table, summary
from fieldrollup.sources.shared import shared_folder

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CUTOFF = dt.datetime(1998, 3, 1)
Query = Callable[[SparkSession, str], DataFrame]


def readings(spark: SparkSession, d: str) -> DataFrame:
    """lineitem in the shape of sensor readings."""
    names = {"l_orderkey": "id", "l_suppkey": "device", "l_linenumber": "contagem", "l_shipdate": "data"}
    return read_table(spark, d, "lineitem").select(*[F.col(a).alias(b) for a, b in names.items()], *MEASURES)


def monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query; means over exact sums."""
    return rollup.monthly_rollup(readings(spark, d), mean=rollup.decimal_mean, cutoff=CUTOFF, sensors=MEASURES)


def delimited_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The rollup from delimited text: the readings are written as such to the shared folder first."""
    path = f"{shared_folder(spark)}/fieldrollup-{hashlib.md5(d.encode()).hexdigest()}.csv"  # written again by each call
    rows = readings(spark, d)
    rows.select(*[F.col(c).cast("string") for c in rows.columns]).write.mode("overwrite").csv(path, sep=SEPARATOR, header=True)
    return rollup.monthly_rollup(read_readings(spark, path), mean=rollup.decimal_mean, cutoff=CUTOFF, sensors=MEASURES)


def plain_mean_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The library's default mean, over a measure of whole numbers, whose sums are exact in any order."""
    return rollup.monthly_rollup(readings(spark, d), cutoff=CUTOFF, sensors=MEASURES[:1])


def _placed(df: DataFrame) -> DataFrame:
    """The rows of an ordered result with their places: ids rise with partitions and within them."""
    place = F.row_number().over(Window.orderBy("_at")).cast("bigint")
    return df.withColumn("_at", F.monotonically_increasing_id()).select("*", place.alias("place")).drop("_at")


def rollup_order(spark: SparkSession, d: str) -> DataFrame:
    return _placed(monthly_rollup(spark, d).select("device", MONTH_COLUMN, "sensor"))


def device_order(spark: SparkSession, d: str) -> DataFrame:
    return _placed(device_line_counts(spark, d))


def data_line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Data lines of the documents' texts as one file: all, and those that aren't blank."""
    value = F.explode(F.split(F.col("text"), "\n")).alias("value")
    text = read_table(spark, d, "documents").select(value)
    every = lines.count_data_lines(text, skip_blank=False).withColumnRenamed("n_lines", "n_all")
    return every.select("n_all", F.lit("all").alias("kind")).unionAll(lines.count_data_lines(text).select(F.col("n_lines").alias("n_all"), F.lit("not blank").alias("kind")))


def column_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of a column in the table's header, -1 if it has none."""
    header = " | ".join(read_table(spark, d, "lineitem").columns)
    names = ("l_orderkey", "l_shipdate", "L_SHIPDATE")
    return spark.createDataFrame([(n, header_index(header, n)) for n in names], "name string, place int")


def result_rows(spark: SparkSession, d: str) -> DataFrame:
    return lines.count_lines(monthly_rollup(spark, d))


def events_rollup(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "events").select(
        "user_id", clean.year_month(F.col("ts")).alias(MONTH_COLUMN), F.col("event_type").alias("sensor"), "value"
    )
    return df.groupBy("user_id", MONTH_COLUMN, "sensor").agg(
        F.max("value").alias("valor_maximo"),
        rollup.decimal_mean("value").alias("valor_medio"), F.min("value").alias("valor_minimo"),
    )


def year_month(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", clean.year_month(F.col("ts")).alias("month"))


def parse_date(spark: SparkSession, d: str) -> DataFrame:
    day = clean.parse_day(F.col("ts").cast("string"))
    return read_table(spark, d, "events").select("event_id", day.cast("timestamp_ntz").alias("day"))


def drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"), "value")
    return clean.drop_null_rows(df)


def drop_columns(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_columns(read_table(spark, d, "supplier"), ["s_acctbal", "s_nationkey", "absent"])


def date_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return clean.since(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", CUTOFF)


def cast_double(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", clean.to_double(F.col("p_size").cast("string")).alias("size"))


def literal_column(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "nation").select("n_nationkey", F.lit("temperatura").alias("sensor"))


def concat_sensors(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "lineitem")
    return rollup.concat_sensors(df, ["l_orderkey", "l_linenumber", "l_suppkey"], ["l_discount", "l_tax"])


def device_line_counts(spark: SparkSession, d: str) -> DataFrame:
    return devices.ranked_devices(read_table(spark, d, "lineitem"), "l_suppkey")


def distinct_devices(spark: SparkSession, d: str) -> DataFrame:
    return devices.distinct_devices(read_table(spark, d, "lineitem"), "l_suppkey")


def count_devices(spark: SparkSession, d: str) -> DataFrame:
    return devices.count_devices(read_table(spark, d, "lineitem"), "l_suppkey")


def device_lookup(spark: SparkSession, d: str) -> DataFrame:
    return devices.device_lines(read_table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), 7, "l_suppkey")


def file_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, read_table(spark, d, "nation"), "n_regionkey").drop("parallelism")


def count_rows(spark: SparkSession, d: str) -> DataFrame:
    return lines.count_lines(read_table(spark, d, "orders"))


def count_text_lines(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return read_table(spark, d, "documents").select(
        "doc_id", lines.count_newlines(text).cast("bigint").alias("n_newlines"), lines.count_text_lines(text).cast("bigint").alias("n_lines")
    )


def first_n_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.first_lines(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 10)


def line_range(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_range(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 20, 10)


def nth_line(spark: SparkSession, d: str) -> DataFrame:
    return lines.nth_row(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 41)


def extract_field(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(
        "p_partkey", *[scalars.extract_field(F.col("p_type"), i, " ").alias(f"field_{i}") for i in (0, 1, 9)]
    )


def format_size(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("n_chars") * F.element_at(F.array(*[F.lit(x) for x in (1, 1 << 10, 1 << 20)]), (F.col("doc_id") % 3 + 1).cast("int"))
    return read_table(spark, d, "documents").select("doc_id", scalars.format_size(size).alias("size"))


def csv_extension(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".csv").otherwise(".CSV"))
    return read_table(spark, d, "pages").select("page_id", scalars.has_csv_extension(name).alias("is_csv"))


def trim_spaces(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit("  "), F.col("n_name"), F.lit(" "))
    return read_table(spark, d, "nation").select("n_nationkey", scalars.trim_spaces(padded).alias("name"))


def block_sizes(spark: SparkSession, d: str) -> DataFrame:
    return placement.block_sizes(spark, 1_000_003, 8)


def balanced_placement(spark: SparkSession, d: str) -> DataFrame:
    return placement.balanced_placement(read_table(spark, d, "lineitem"), 8, "l_suppkey")


def parallel_counter(spark: SparkSession, d: str) -> DataFrame:
    return counter.parallel_count(spark, 8, 1_000_000)


CORE: tuple[Query, ...] = (
    monthly_rollup, delimited_rollup, plain_mean_rollup, rollup_order, device_order, data_line_counts, column_places, result_rows, events_rollup, year_month, parse_date, drop_nulls, drop_columns, date_cutoff, cast_double,
    literal_column, concat_sensors, device_line_counts, distinct_devices, count_devices, device_lookup, file_summary,
    count_rows, count_text_lines, first_n_lines, line_range, nth_line, extract_field, format_size, csv_extension,
    trim_spaces, block_sizes, balanced_placement, parallel_counter,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in CORE}


def oracle_sql() -> dict[str, str]:
    sensor = """SELECT CAST(l_suppkey AS BIGINT) AS device, strftime(l_shipdate, '%Y-%m') AS "ano-mes", '{0}' AS sensor,
        max({0}) AS valor_maximo, CAST(sum(CAST({0} AS DECIMAL(18,4))) AS DOUBLE) / count({0}) AS valor_medio, min({0}) AS valor_minimo
        FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-03-01' GROUP BY ALL"""
    rolled = " UNION ALL ".join(sensor.format(m) for m in MEASURES)
    cells = " + ".join(f"strlen(coalesce({c}::VARCHAR, ''))" for c in ("n_nationkey", "n_name", "n_regionkey"))
    return {
        "monthly_rollup": rolled,
        "delimited_rollup": rolled.replace("CAST(l_suppkey AS BIGINT) AS device", "l_suppkey::VARCHAR AS device"),
        "plain_mean_rollup": """SELECT CAST(l_suppkey AS BIGINT) AS device, strftime(l_shipdate, '%Y-%m') AS "ano-mes", 'l_quantity' AS sensor,
            max(l_quantity) AS valor_maximo, avg(l_quantity) AS valor_medio, min(l_quantity) AS valor_minimo
            FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-03-01' GROUP BY ALL""",
        "rollup_order": f"""SELECT device, "ano-mes", sensor, row_number() OVER (ORDER BY device, "ano-mes", sensor) AS place FROM ({rolled})""",
        "device_order": """SELECT *, row_number() OVER (ORDER BY line_count DESC, device) AS place
            FROM (SELECT l_suppkey AS device, count(*) AS line_count FROM lineitem GROUP BY 1)""",
        "data_line_counts": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
            SELECT count(*) - 1 AS n_all, 'all' AS kind FROM l UNION ALL SELECT count(*) - 1, 'not blank' FROM l WHERE length(value) > 0""",
        "column_places": """SELECT name, CAST(coalesce((SELECT min(column_index) FROM duckdb_columns() c WHERE table_name = 'lineitem' AND c.column_name = n.name), 0) - 1 AS INTEGER) AS place
            FROM (VALUES ('l_orderkey'), ('l_shipdate'), ('L_SHIPDATE')) n(name)""",
        "result_rows": f"SELECT count(*) AS n_lines FROM ({rolled})",
        "events_rollup": """SELECT user_id, strftime(ts, '%Y-%m') AS "ano-mes", event_type AS sensor, max(value) AS valor_maximo,
            CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) AS valor_medio, min(value) AS valor_minimo FROM events GROUP BY ALL""",
        "year_month": "SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events",
        "parse_date": "SELECT event_id, strptime(string_split(ts::VARCHAR, ' ')[1], '%Y-%m-%d') AS day FROM events",
        "drop_nulls": "SELECT event_id, event_type, value FROM events WHERE nullif(event_type, 'error') IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL",
        "drop_columns": "SELECT s_suppkey, s_name FROM supplier",
        "date_cutoff": "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-03-01'",
        "cast_double": "SELECT p_partkey, CAST(CAST(p_size AS VARCHAR) AS DOUBLE) AS size FROM part",
        "literal_column": "SELECT n_nationkey, 'temperatura' AS sensor FROM nation",
        "concat_sensors": """SELECT l_orderkey, l_linenumber, l_suppkey, 'l_discount' AS sensor, l_discount AS value FROM lineitem
            UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, 'l_tax', l_tax FROM lineitem""",
        "device_line_counts": "SELECT l_suppkey AS device, count(*) AS line_count FROM lineitem GROUP BY 1",
        "distinct_devices": "SELECT DISTINCT l_suppkey AS device FROM lineitem WHERE l_suppkey IS NOT NULL",
        "count_devices": "SELECT count(DISTINCT l_suppkey) AS n_devices FROM lineitem",
        "device_lookup": "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey = 7",
        "file_summary": f"""SELECT count(*) AS n_rows, count(DISTINCT n_regionkey) AS n_devices, 'n_nationkey|n_name|n_regionkey' AS header, strlen('n_nationkey|n_name|n_regionkey') AS header_size,
            CAST(sum({cells} + 3) AS BIGINT) AS data_size FROM nation""",
        "count_rows": "SELECT count(*) AS n_lines FROM orders",
        "count_text_lines": """SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n_newlines, length(text) - length(replace(text, chr(10), ''))
            + CASE WHEN length(text) > 0 AND NOT text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS n_lines FROM documents""",
        "first_n_lines": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10",
        "line_range": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
        "nth_line": "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n = 42",
        "extract_field": "SELECT p_partkey, string_split(p_type, ' ')[1] AS field_0, string_split(p_type, ' ')[2] AS field_1, string_split(p_type, ' ')[10] AS field_9 FROM part",
        "format_size": """SELECT doc_id, CASE WHEN b < 1024 THEN b::VARCHAR || ' bytes' WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0::DOUBLE)
            WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0::DOUBLE) ELSE printf('%.2f GB', b / 1073741824.0::DOUBLE) END AS size
            FROM (SELECT doc_id, n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END AS b FROM documents)""",
        "csv_extension": "SELECT page_id, (url || CASE WHEN page_id % 2 = 0 THEN '.csv' ELSE '.CSV' END) LIKE '%.csv' AS is_csv FROM pages",
        "trim_spaces": "SELECT n_nationkey, trim('  ' || n_name || ' ') AS name FROM nation",
        "block_sizes": "SELECT range AS block, 1000003 // 8 + CASE WHEN range = 7 THEN 1000003 % 8 ELSE 0 END AS size FROM range(8)",
        "balanced_placement": """WITH RECURSIVE c AS (SELECT l_suppkey AS device, count(*) AS n FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1),
            o AS (SELECT *, row_number() OVER (ORDER BY n DESC, device::VARCHAR) AS i FROM c),
            g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS device, CAST(0 AS BIGINT) AS n, CAST(-1 AS INTEGER) AS bin, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS loads
                UNION ALL SELECT o.i, o.device, o.n, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
                    list_transform(loads, lambda x, k: x + CASE WHEN k = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END)
                FROM g JOIN o ON o.i = g.i + 1)
            SELECT device, n AS line_count, bin FROM g WHERE i > 0""",
        "parallel_counter": "SELECT CAST(8000000 AS BIGINT) AS counter",
    }
