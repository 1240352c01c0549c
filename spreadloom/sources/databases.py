"""Tables and queries of databases as partitioned scans.

``database`` is a Python data source over a DB-API module: the range of one column is dealt over the tasks, rows outside
the bounds and nulls go to the ends, so every row is read once; filters of the query are handed to the database where it
can apply them, and only the columns of the schema are fetched. URLs ``jdbc:...`` go to Spark's own JDBC source.
"""

from __future__ import annotations

import datetime
import decimal
import importlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

#: Types of databases as Spark types.
TYPES = {
    "BIGINT": "long", "INTEGER": "int", "INT": "int", "SMALLINT": "short", "TINYINT": "byte", "DOUBLE": "double", "REAL": "float", "FLOAT": "float", "VARCHAR": "string", "TEXT": "string",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "BLOB": "binary", "HUGEINT": "decimal(38,0)", "UBIGINT": "decimal(20,0)", "UINTEGER": "long",
}
OPERATORS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def spark_type(name: str) -> str:
    name = name.upper()
    if name.startswith("DECIMAL"):
        return name.lower()
    if name not in TYPES:
        raise ValueError(f"no Spark type for {name}: give the schema")
    return TYPES[name]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(value: Any, dates: bool = True) -> str | None:
    """A value in SQL, or None if it can't be written safely. ``dates``: whether the database has dates."""
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, decimal.Decimal)) or (isinstance(value, float) and value == value and abs(value) != float("inf")):
        return repr(value) if not isinstance(value, decimal.Decimal) else str(value)
    if isinstance(value, str) and "\0" not in value:
        return "'" + value.replace("'", "''") + "'"
    if dates and type(value) is datetime.date:
        return f"DATE '{value.isoformat()}'"
    return None


def condition(f: ds.Filter, dates: bool = True) -> str | None:
    """A filter in SQL, or None where Spark has to apply it."""
    if isinstance(f, ds.Not):
        inner = condition(f.child, dates)
        return None if inner is None else f"NOT ({inner})"
    if not hasattr(f, "attribute") or len(f.attribute) != 1:
        return None
    column = quoted(f.attribute[0])
    if isinstance(f, ds.IsNull):
        return f"{column} IS NULL"
    if isinstance(f, ds.IsNotNull):
        return f"{column} IS NOT NULL"
    if isinstance(f, ds.In):
        values = [literal(v, dates) for v in f.value]
        return None if None in values or not values else f"{column} IN ({', '.join(values)})"
    for kind, sign in OPERATORS.items():
        if type(f) is kind:
            value = literal(f.value, dates)
            return None if value is None else f"{column} {sign} {value}"
    return None


def connect(options: dict[str, str]) -> Any:
    """A read-only connection of the module that ``driver`` names."""
    module = importlib.import_module(options.get("driver", "duckdb"))
    if module.__name__ == "sqlite3":
        return module.connect(f"file:{options['database']}?mode=ro", uri=True)
    return module.connect(options["database"], read_only=options["database"] != ":memory:")


def source_of(options: dict[str, str]) -> str:
    query = options.get("query")
    return f"({query})" if query else ".".join(quoted(p) for p in options["dbtable"].split("."))


class Span(ds.InputPartition):
    """The condition of one task."""

    def __init__(self, where: str | None) -> None:
        self.where = where


def spans(column: str | None, low: int, high: int, n: int) -> list[str | None]:
    """Conditions that split a column's values into n ranges of equal length, the first and last one open, nulls in the
    first."""
    if column is None or n <= 1 or high <= low:
        return [None]
    n, c = min(n, high - low), quoted(column)
    cuts = [low + (high - low) * i // n for i in range(1, n)]
    inner = [f"{c} >= {a} AND {c} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{c} < {cuts[0]} OR {c} IS NULL", *inner, f"{c} >= {cuts[-1]}"]


class DatabaseReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.schema, self.conditions = options, schema, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            found = condition(f, self.options.get("driver") != "sqlite3")
            if found is None:
                yield f
            else:
                self.conditions.append(found)

    def partitions(self) -> list[Span]:
        o = self.options
        return [Span(w) for w in spans(o.get("partitioncolumn"), int(o.get("lowerbound", 0)), int(o.get("upperbound", 0)), int(o.get("numpartitions", 1)))]

    def statement(self, where: str | None) -> str:
        parts = [f"({c})" for c in [*self.conditions, where] if c]
        columns = ", ".join(quoted(f.name) for f in self.schema.fields) or "1"
        return f"SELECT {columns} FROM {source_of(self.options)} AS source" + (f" WHERE {' AND '.join(parts)}" if parts else "")

    def read(self, partition: Span) -> Iterator[tuple]:
        connection = connect(self.options)
        try:
            cursor = connection.execute(self.statement(partition.where))
            while rows := cursor.fetchmany(10_000):
                yield from rows
        finally:
            connection.close()


class Database(ds.DataSource):
    """Options: driver (a DB-API module, by default duckdb; sqlite3), database, dbtable or query, and for several tasks
    partitionColumn (whole numbers), lowerBound, upperBound, numPartitions. The schema is asked of the database if not given."""

    @classmethod
    def name(cls) -> str:
        return "database"

    def schema(self) -> str:
        connection = connect(self.options)
        try:
            rows = connection.execute(f"DESCRIBE SELECT * FROM {source_of(self.options)} AS source").fetchall()
        finally:
            connection.close()
        return ", ".join(f"`{r[0]}` {spark_type(r[1])}" for r in rows)

    def reader(self, schema: StructType) -> DatabaseReader:
        return DatabaseReader({k.lower(): v for k, v in self.options.items()}, schema)


def from_database(spark: SparkSession, url: str, schema: str | None = None, **options: Any) -> DataFrame:
    """``duckdb:FILE|TABLE_OR_QUERY``, ``sqlite:FILE|TABLE_OR_QUERY`` or ``jdbc:...|TABLE_OR_QUERY``; options as above."""
    scheme = url.split(":", 1)[0]
    at, mark, what = url.partition("|")
    if not mark or not what.strip():
        raise ValueError(f"{url}: a database and a table or query are needed, with | between them")
    asked = {"query" if what.strip().lower().startswith(("select ", "with ")) else "dbtable": what.strip()}
    if scheme == "jdbc":
        return spark.read.format("jdbc").options(url=at, **asked, **options).load()
    if scheme not in ("duckdb", "sqlite"):
        raise ValueError(f"unknown database {url}")
    spark.dataSource.register(Database)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("database").options(driver="sqlite3" if scheme == "sqlite" else "duckdb", database=at.split(":", 1)[1], **asked, **options)
    return (reader.schema(schema) if schema else reader).load()
