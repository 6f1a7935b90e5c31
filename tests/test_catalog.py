"""Every catalogued query against its SQL in DuckDB, the driver's entry points, and streams."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sparklith.plans.catalog import ORACLE_SQL, QUERIES
from sparklith.streaming import bucket_stream, project_stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))
    if name not in ORACLE_SQL:
        assert got
        return
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    assert got == sorted(map(repr, duck.execute(f"select {columns} from ({ORACLE_SQL[name]})").fetchall()))


def test_entry_points(spark):
    assert entry.entry(spark).columns == ["l_orderkey", "l_partkey", "o_custkey"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_streams(spark, tmp_path):
    spark.range(20).selectExpr("id as a", "id * 2 as b").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a bigint, b bigint").parquet(str(tmp_path / "in"))
    for name, out, columns in (("projected", project_stream(stream, "a + b"), ["out"]), ("bucketed", bucket_stream(stream, ["a"], 3), ["a", "b", "bucket"])):
        run = out.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        run.awaitTermination(60)
        found = spark.table(name)
        assert found.columns == columns and found.count() == 20
