"""Every query with SQL gives the same rows in Spark and in DuckDB; those without are held against numpy elsewhere."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from spreadloom.plans import market

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    yield c
    c.close()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith("datetime") or kind in ("object", "str", "string"):
            df[c] = df[c].astype(object).map(lambda v: "" if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v).removesuffix(" 00:00:00"))
        else:
            df[c] = df[c].astype(float) + 0.0
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(market.oracle_sql()))
def test_spark_equals_duckdb(spark, con, name):
    got, want = canonical(market.queries()[name](spark, SMALL).toPandas()), canonical(con.execute(market.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float:
            np.testing.assert_allclose(got[c].to_numpy(), want[c].to_numpy(), rtol=1e-6, atol=2e-5, equal_nan=True)
        else:
            assert got[c].tolist() == want[c].tolist()


def test_every_query_has_a_stable_schema(spark):
    for name in sorted(set(market.queries()) - set(market.oracle_sql())):
        assert market.queries()[name](spark, SMALL).schema.fields, name
