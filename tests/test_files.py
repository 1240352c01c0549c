"""Scans and sinks of files."""

from pyspark.sql import functions as F

from spreadloom.sources import files


def test_csv_bars_fold_names_and_keep_the_last(spark, tmp_path):
    (tmp_path / "aaa.csv").write_text("Date,Open,High,Low,Adj Close,Vol\n2024-01-01,1,2,0.5,1.5,10\n2024-01-01,1,2,0.5,1.7,11\n2024-01-02,x,2,1,inf,12\n")
    rows = files.csv_bars(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.symbol, r.close, r.open, r.volume) for r in rows] == [("AAA", 1.7, 1.0, 11.0), ("AAA", None, None, 12.0)]


def test_files_with_other_headers_and_a_bad_date(spark, tmp_path):
    (tmp_path / "aaa.csv").write_text("date,open,close\n2024-01-01,1,2\nnot a date,3,4\n")
    (tmp_path / "bbb.csv").write_text("close,date,open\n7,2024-01-02,6\n")
    (tmp_path / "empty.csv").write_text("")
    rows = files.csv_bars(spark, str(tmp_path)).collect()
    assert sorted((r.symbol, str(r.date), r.open, r.close) for r in rows) == [("AAA", "2024-01-01", 1.0, 2.0), ("BBB", "2024-01-02", 6.0, 7.0)]
    logs = files.trade_logs(spark, str(tmp_path / "*.csv"), {"at": ["date"], "price": ["close"]})
    assert sorted(map(tuple, logs.collect())) == [("2024-01-01", "2"), ("2024-01-02", "7"), ("not a date", "4")]


def test_pair_texts(spark):
    rows = spark.createDataFrame([(t,) for t in ["a/b", "B-A", "c_d", "e/e", "", None, "x", "nan/q"]], "pair string").coalesce(1)
    assert sorted((r.sym_x, r.sym_y) for r in files.parsed_pairs(rows).collect()) == [("A", "B"), ("C", "D")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, v int")
    files.append(files.with_run(df, "r1", "s", "dev", F.lit("2024-01-01").cast("timestamp")), str(tmp_path / "t"))
    files.append(files.with_run(df, "r2", "s", "prod", F.lit("2024-01-01").cast("timestamp")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    files.replace_partitions(df, str(tmp_path / "p"), ["symbol"])
    files.replace_partitions(spark.createDataFrame([("a", 9)], "symbol string, v int"), str(tmp_path / "p"), ["symbol"])
    assert sorted((r.symbol, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("a", 9), ("b", 2)]
    files.export(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_macro_sources(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.csv").write_text("date,value\n2024-01-01,5\n2024-01-02,bad\n")
    rows = files.macro_series(spark, f"local://{tmp_path}/m", lag_days=3).orderBy("date").collect()
    assert [(str(r.date), r.value) for r in rows] == [("2024-01-04", 5.0), ("2024-01-05", None)]


def test_trade_logs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Pair,PnL\nA/B,5\n")
    assert files.trade_logs(spark, str(tmp_path / "*.csv"), {"pair": ["pair", "symbol"], "pnl": ["profit", "pnl"], "side": ["side"]}).first() == ("A/B", "5", None)
