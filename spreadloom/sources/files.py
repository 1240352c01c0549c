"""Scans and sinks of files: fixed schemas, names folded at the scan, partitions overwritten and not tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.functions.columns import canonical_symbol, pair_key, safe
from spreadloom.operators.tables import latest
from spreadloom.sources.databases import from_database

BAR = "date date, open double, high double, low double, close double, volume double"
#: Names under which price columns are found.
ALIASES = {"date": ("date", "datetime", "timestamp", "ts"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "adj_close", "adjclose", "last_price", "price"), "volume": ("volume", "vol", "v")}


def snake(name: str) -> str:
    return "_".join(name.strip().lower().replace("-", " ").replace(".", " ").split())


def standard_columns(df: DataFrame) -> DataFrame:
    """The known price columns by their aliases, missing ones as null; NaN and infinities as null."""
    have = {snake(c): c for c in df.columns}
    out = []
    for name, names in ALIASES.items():
        found = next((have[a] for a in names if a in have), None)
        value = F.col(f"`{found}`") if found else F.lit(None)
        out.append((F.try_to_timestamp(value.cast("string")).cast("date") if name == "date" else safe(value.try_cast("double"))).alias(name))
    return df.select(*[c for c in ("symbol", "_file") if c in df.columns], *out)


def csv_files(spark: SparkSession, path: str) -> list[DataFrame]:
    """The CSV files of a path, one DataFrame for each header that occurs: files may differ in the names and the order of
    their columns. Headers are read by Spark; only their names and the paths reach the driver."""
    files = spark.read.format("binaryFile").load(path)
    header = F.trim(F.regexp_replace(F.substring_index(F.decode(F.substring("content", 1, 65536), "utf-8"), "\n", 1), "[\r\ufeff]", ""))
    groups = files.select("path", header.alias("header")).where("header <> ''").groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header").collect()
    return [spark.read.option("header", True).csv(g["paths"]) for g in groups]


def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a directory of CSV files, one a symbol; of repeated dates the last in the file stays."""
    parts = [standard_columns(x.select("*", F.col("_metadata.file_name").alias("_file"))) for x in csv_files(spark, path)]
    raw = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"_file string, {BAR}")
    bars = raw.withColumn("symbol", canonical_symbol(F.regexp_extract("_file", r"([^/]+)\.csv", 1))).drop("_file")
    placed = bars.withColumn("_at", F.monotonically_increasing_id())  # grows along a file
    return latest(placed.where("date IS NOT NULL"), ["symbol", "date"], [F.col("_at").desc()]).drop("_at")


def macro_series(spark: SparkSession, uri: str, value: str = "value", lag_days: int = 0) -> DataFrame:
    """(date, value) by scheme: local://dir of CSV, parquet://path, table:NAME, duckdb:FILE|TABLE_OR_QUERY, sqlite: and jdbc:
    alike; dates moved by the publication lag."""
    scheme, _, rest = uri.partition(":")
    if scheme == "table":
        df = spark.table(rest)
    elif scheme == "parquet":
        df = spark.read.parquet(urlparse(uri).netloc + urlparse(uri).path)
    elif scheme == "local":
        df = spark.read.option("header", True).csv(urlparse(uri).netloc + urlparse(uri).path)
    elif scheme in ("duckdb", "sqlite", "jdbc"):
        df = from_database(spark, uri, f"date string, {value} double" if scheme == "sqlite" else None)
    else:
        raise ValueError(f"unknown source {uri}")
    return df.select(F.date_add(F.to_date(F.col("date").cast("string")), lag_days).alias("date"), safe(F.col(value).try_cast("double")).alias("value"))


def parsed_pairs(df: DataFrame, text: str = "pair") -> DataFrame:
    """(sym_x, sym_y, pair_key) of texts like A/B, A-B or A_B; blank and self pairs are left out, repeats keep the first."""
    legs = F.split(F.regexp_replace(F.col(text), "[-_]", "/"), "/")
    two = df.select(canonical_symbol(F.get(legs, 0)).alias("sym_x"), canonical_symbol(F.get(legs, 1)).alias("sym_y"), F.monotonically_increasing_id().alias("_at"))
    good = two.where("sym_x IS NOT NULL AND sym_y IS NOT NULL AND sym_x <> sym_y").withColumn("pair_key", pair_key("sym_x", "sym_y"))
    return latest(good, ["pair_key"], [F.col("_at")]).drop("_at")


def trade_logs(spark: SparkSession, glob: str, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """CSV logs of a glob with their columns under common names."""

    def folded(raw: DataFrame) -> DataFrame:
        have = {snake(c): c for c in raw.columns}
        pick = lambda names: next((F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None).cast("string"))
        return raw.select(*[pick(names).alias(name) for name, names in aliases.items()])

    parts = [folded(x) for x in csv_files(spark, glob)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ", ".join(f"{name} string" for name in aliases))


def with_run(df: DataFrame, run_id: str, section: str, env: str, now: Column | None = None) -> DataFrame:
    return df.withColumns({"ts_utc": now if now is not None else F.current_timestamp(), "run_id": F.lit(run_id), "section": F.lit(section), "env": F.lit(env)})


def append(df: DataFrame, path: str, by: Sequence[str] = ("env",)) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrites the partitions that occur in df, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export(df: DataFrame, path: str, kind: str) -> None:
    getattr(df.write.mode("overwrite").option("header", True), kind)(path)
