"""Databases as partitioned scans with pushed filters, from local files."""

import datetime
import sqlite3

import duckdb
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spreadloom.sources import databases as db
from spreadloom.sources import files


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "m.duckdb")
    con = duckdb.connect(path)
    con.execute("""CREATE TABLE macro AS SELECT CASE WHEN i % 50 = 7 THEN NULL ELSE i END::BIGINT AS id, DATE '2020-01-01' + i::INT AS date, i / 4.0::DOUBLE AS value,
        CASE WHEN i % 10 = 0 THEN NULL WHEN i % 3 = 0 THEN 'o''x' ELSE 'b' END AS name, i % 2 = 0 AS even, (i * 1.5)::DECIMAL(12, 2) AS price FROM range(-20, 180) t(i)""")
    con.close()
    return path


def test_every_row_is_read_once_by_several_tasks(spark, file):
    one = db.from_database(spark, f"duckdb:{file}|macro")
    many = db.from_database(spark, f"duckdb:{file}|macro", partitionColumn="id", lowerBound=0, upperBound=100, numPartitions=4)
    assert many.rdd.getNumPartitions() == 4 and one.rdd.getNumPartitions() == 1
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect())) and one.count() == 200
    assert dict(one.dtypes) == {"id": "bigint", "date": "date", "value": "double", "name": "string", "even": "boolean", "price": "decimal(12,2)"}
    query = db.from_database(spark, f"duckdb:{file}|SELECT name, count(*) AS n FROM macro GROUP BY 1")
    assert {r.name: r.n for r in query.collect()} == {None: 20, "o'x": 60, "b": 120}


def test_filters_reach_the_database(spark, file):
    reader = db.DatabaseReader({"database": file, "dbtable": "macro", "partitioncolumn": "id", "lowerbound": "0", "upperbound": "100", "numpartitions": "2"}, StructType.fromDDL("id long, name string"))
    later = ds.StringContains(("name",), "b")
    left = list(reader.pushFilters([ds.GreaterThan(("id",), 5), ds.EqualTo(("name",), "o'x"), later, ds.Not(ds.In(("id",), (6, 9))), ds.EqualTo(("a", "b"), 1), ds.LessThan(("date",), datetime.datetime(2020, 1, 1))]))
    assert [type(f) for f in left] == [ds.StringContains, ds.EqualTo, ds.LessThan]
    first, last = (reader.statement(p.where) for p in reader.partitions())
    assert first == """SELECT "id", "name" FROM "macro" AS source WHERE ("id" > 5) AND ("name" = 'o''x') AND (NOT ("id" IN (6, 9))) AND ("id" < 50 OR "id" IS NULL)"""
    assert last.endswith('AND ("id" >= 50)')
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == [i for i in range(6, 180) if i % 3 == 0 and i % 10 and i not in (6, 9) and i % 50 != 7]


def test_results_are_those_of_spark(spark, file):
    table = db.from_database(spark, f"duckdb:{file}|macro", partitionColumn="id", lowerBound=0, upperBound=100, numPartitions=3)
    plain = spark.createDataFrame(table.collect(), table.schema)
    for where in ("id > 50", "id IS NULL", "name = 'o''x' AND value < 10.25", "name <> 'b'", "date >= DATE '2020-03-01'", "id IN (1, 2, 500)", "NOT even", "name LIKE 'o%'", "price = 3.00", "id <=> NULL", "name IS NOT NULL AND id < -5"):
        assert sorted(map(str, table.where(where).collect())) == sorted(map(str, plain.where(where).collect())), where


def test_bounds():
    assert db.spans(None, 0, 10, 4) == [None] and db.spans("a", 5, 5, 4) == [None]
    assert db.spans("a", 0, 2, 9) == ['"a" < 1 OR "a" IS NULL', '"a" >= 1']


def test_sqlite_and_macro_sources(spark, file, tmp_path):
    path = str(tmp_path / "x.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE s (date TEXT, value REAL)")
    con.executemany("INSERT INTO s VALUES (?, ?)", [("2024-01-01", 1.5), ("2024-01-02", None)])
    con.commit()
    con.close()
    assert db.from_database(spark, f"sqlite:{path}|s", "date string, value double").where(F.col("value") > 1).count() == 1
    rows = files.macro_series(spark, f"sqlite:{path}|s", lag_days=1).orderBy("date").collect()
    assert [(str(r.date), r.value) for r in rows] == [("2024-01-02", 1.5), ("2024-01-03", None)]
    assert files.macro_series(spark, f"duckdb:{file}|SELECT date, value FROM macro WHERE value > 40").count() == 19
    for wrong in ("duckdb:x", "oracle:x|t", f"duckdb:{file}|"):
        with pytest.raises(ValueError):
            db.from_database(spark, wrong)


def test_only_reading(file):
    with pytest.raises(Exception, match="read-only"):
        db.connect({"database": file}).execute("DELETE FROM macro")
