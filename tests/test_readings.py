"""Golden fixtures of the CSV rules, and the equivalence of designs."""

import itertools
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldrollup.__main__ import main
from fieldrollup.operators import counter, devices, lines, placement
from fieldrollup.operators.clean import clean_readings
from fieldrollup.operators.rollup import monthly_rollup
from fieldrollup.plans.report import rollup_file, run_report
from fieldrollup.schema import ROLLUP_SCHEMA, SENSORS
from fieldrollup.sources.delimited import has_csv_suffix, header_index, read_lines, read_readings, summary
from fieldrollup.streaming.rollup_stream import stream_readings, stream_rollup

# Fixed value: the header of the readings.
HEADER = "id|device|contagem|data|temperatura|umidade|luminosidade|ruido|eco2|etvoc|latitude|longitude"
ROWS = [
    "1|d1|10|2024-03-01 00:00:00.1|20.5|50|1|2|400|10||",
    "2|d1|11|2024-03-15 10:00:00|22.5|60|1|2|400|10|1|2",
    "3|d1|12|2024-02-29 23:59:59|99|60|1|2|400|10|1|2",
    "4|d2||2024-03-15 10:00:00|22.5|60|1|2|400|10|1|2",
    '5|""|1|2024-04-15|22.5|60|1|2|400|10|1|2',
    "6|d2|1|2024-04-15|-3|60|1|2|400|10|1|2",
    "",
    "|d3|1|2024-04-15 x y|-3|60|1|2|400|10|1|2",
]


def write(tmp_path, text, name="in.csv"):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


@pytest.fixture
def golden(tmp_path):
    return write(tmp_path, "\n".join([HEADER, *ROWS]))


def temps(df):
    return [tuple(r)[:2] + tuple(r)[3:] for r in df.where("sensor = 'temperatura'").collect()]


WANT = [("d1", "2024-03", 22.5, 21.5, 20.5), ("d2", "2024-04", -3.0, -3.0, -3.0), ("d3", "2024-04", -3.0, -3.0, -3.0)]


def test_golden(spark, golden):
    df = rollup_file(spark, golden)
    assert df.schema.simpleString() == ROLLUP_SCHEMA.simpleString()
    assert df.count() == 18
    assert temps(df) == WANT
    rows = [tuple(r)[:3] for r in df.collect()]
    assert rows == sorted(rows)


def test_crlf_and_rows_of_other_lengths(spark, tmp_path):
    assert temps(rollup_file(spark, write(tmp_path, "\r\n".join([HEADER, *ROWS]) + "\r\n"))) == WANT
    extra = ["7|d9|1|2024-04-15|1", "8|d8|1|2024-05-01|7|1|1|1|1|1|1|1|surplus"]
    got = temps(rollup_file(spark, write(tmp_path, "\n".join([HEADER, *ROWS, *extra]), "b.csv")))
    assert got == [*WANT, ("d8", "2024-05", 7.0, 7.0, 7.0)]


def test_columns_missing(spark, tmp_path):
    assert rollup_file(spark, write(tmp_path, HEADER + "\n")).count() == 0
    with pytest.raises(ValueError, match="line end"):
        rollup_file(spark, write(tmp_path, HEADER, "cut.csv"))
    none = rollup_file(spark, write(tmp_path, "data|ruido\n2024-04-01|1", "n.csv"))
    assert none.count() == 0 and none.schema == ROLLUP_SCHEMA
    with pytest.raises(ValueError):
        rollup_file(spark, write(tmp_path, "device|ruido\nd|1", "m.csv"))
    with pytest.raises(ValueError):
        rollup_file(spark, write(tmp_path, "device|data\nd|2024-04-01", "s.csv"))
    with pytest.raises(ValueError):
        read_readings(spark, write(tmp_path, "", "empty.csv"))
    with pytest.raises(ValueError):
        read_readings(spark, write(tmp_path, "a|b", "x.txt"))
    last = rollup_file(spark, write(tmp_path, "data|ruido|box\n2024-04-01|1|a\n2024-04-02|3|a", "l.csv"), device_column="box")
    assert [tuple(r) for r in last.collect()] == [("a", "2024-04", "ruido", 3.0, 2.0, 1.0)]


def test_strict_and_lenient(spark, tmp_path):
    p = write(tmp_path, "device|data|ruido\na|2024-04-01|x\na|2024-04-02|5\na|2024-4-1|6\nb|2023-01-01|bad")
    with pytest.raises(Exception, match="(?i)parse|cast"):
        rollup_file(spark, p).collect()
    assert [tuple(r)[3:] for r in rollup_file(spark, p, strict=False).collect()] == [(5.0, 5.0, 5.0)]
    old = write(tmp_path, "device|data|ruido\nb|2023-01-01|bad\nb|2024-04-01|1", "old.csv")
    assert rollup_file(spark, old).count() == 1


def test_designs_agree(spark, golden):
    raw = read_readings(spark, golden)
    rows = clean_readings(raw)
    keys = ["device", "ano-mes"]
    literal = reduce(
        DataFrame.unionByName,
        [rows.groupBy(*keys).agg(F.max(s).alias("a"), F.avg(s).alias("b"), F.min(s).alias("c")).select(*keys, F.lit(s).alias("sensor"), "a", "b", "c") for s in SENSORS],
    )
    want = sorted(map(tuple, literal.collect()))
    for k in (1, 3, 8):
        assert sorted(map(tuple, monthly_rollup(raw.repartition(k)).collect())) == want
    assert all(r[5] <= r[4] <= r[3] for r in want)


def test_output(spark, golden, tmp_path):
    out = tmp_path / "result.csv"
    out.write_text("old")
    steps = run_report(spark, golden, str(out))
    assert list(steps) == ["open", "devices", "plan", "process", "write", "total"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["in.csv", "result.csv"]
    text = out.read_text().splitlines()
    assert text[0] == "device,ano-mes,sensor,valor_maximo,valor_medio,valor_minimo" and len(text) == 19
    assert main([golden, "--show"]) == 0


def test_lines(spark, golden, tmp_path):
    scan = read_lines(spark, golden)
    assert lines.count_lines(scan).first()[0] == 9
    assert lines.count_data_lines(scan).first()[0] == 7
    assert lines.count_data_lines(scan, skip_blank=False).first()[0] == 8
    assert lines.nth_line(scan, 0) == ROWS[0] and lines.nth_line(scan, 7) == ROWS[7]
    assert lines.nth_line(scan, 8) is None and lines.nth_line(scan, -1) is None
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\n\nb",)], "t string")
    assert [r[0] for r in df.select(lines.count_text_lines(F.col("t"))).collect()] == [0, 1, 1, 3]
    nums = spark.range(5)
    assert [r[0] for r in lines.line_range(nums, ["id"], -2, 2).collect()] == [0, 1]
    assert lines.first_lines(nums, ["id"], 0).count() == 5


def test_header():
    assert header_index("id| device |x") == 1 and header_index("Device|x") == -1
    assert header_index("a||device\r\n") == 2
    assert has_csv_suffix("a.b.csv") and not has_csv_suffix("a.CSV")


def test_summary(spark, golden, tmp_path):
    rows = [r for r in ROWS if r and '"' not in r]
    path = write(tmp_path, "\n".join([HEADER, *rows]) + "\n", "s.csv")
    found = summary(spark, read_readings(spark, path)).first()
    assert (found["n_rows"], found["n_devices"]) == (len(rows), 3)
    assert found["header_size"] == len(HEADER) and found["data_size"] == sum(len(r) + 1 for r in rows)
    assert found["parallelism"] == spark.sparkContext.defaultParallelism
    wide = summary(spark, spark.createDataFrame([("a", None)], "device string, x string"), sep="::").first()
    assert wide["header"] == "device::x" and wide["data_size"] == 4


def test_placement(spark):
    counts = [(f"d{i}", n) for i, n in enumerate([7, 5, 4, 4, 3, 1])]
    for m in (1, 2, 3):
        dealt = placement.greedy_bins(counts, m)
        assert sorted(k for k, _, _ in dealt) == sorted(k for k, _ in counts)
        load = max(sum(n for _, n, b in dealt if b == i) for i in range(m))
        best = min(max(sum(n for (_, n), b in zip(counts, bs) if b == i) for i in range(m)) for bs in itertools.product(range(m), repeat=6))
        assert load <= (4 / 3 - 1 / (3 * m)) * best + 1e-9
    df = spark.createDataFrame([(k, i) for k, n in counts for i in range(n)], "device string, i int")
    placed = placement.place_rows(df, placement.balanced_placement(df, 3), 3)
    where = placed.select(F.spark_partition_id().alias("p"), "bin").distinct().collect()
    assert all(p == b for p, b in where) and placed.count() == 24
    assert placement.hash_placement(df, 3).rdd.getNumPartitions() == 3
    for n, k in ((10, 3), (0, 4), (8, 8)):
        sizes = [r[1] for r in placement.block_sizes(spark, n, k).orderBy("block").collect()]
        assert sum(sizes) == n and len(sizes) == k and sizes[-1] == n // k + n % k


def test_counter_and_devices(spark):
    assert counter.parallel_count(spark, 2, 1000).first()[0] == 2000
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "device string")
    assert devices.count_devices(df).first()[0] == 2
    assert devices.device_lines(df, "a").count() == 2


def test_stream(spark, golden, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([HEADER, *ROWS]))
    out = stream_rollup(stream_readings(spark, str(folder), HEADER.split("|")))
    q = out.writeStream.outputMode("complete").format("memory").queryName("rolled").start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("rolled").collect()))
    finally:
        q.stop()
    assert got == sorted(map(tuple, rollup_file(spark, golden).collect()))
