from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"
ORACLE_SF = "/root/testdata/sf0.01"


def as_oracle_rows(rows, columns):
    """Rows as sorted tuples in column-name order, floats rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def assert_matches_oracle(spark, name, query, sql, sf=ORACLE_SF):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    con.execute("SET TimeZone='UTC'")
    df = query(spark, sf)
    got = as_oracle_rows([tuple(r) for r in df.collect()], df.columns)
    found = con.execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns), name
    want = as_oracle_rows(found.fetchall(), columns)
    assert len(got) == len(want), name
    assert got == want, name
