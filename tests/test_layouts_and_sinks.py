"""Files by their own header, page checks, and what sinks leave behind."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from ledgerflow.sources import layouts as ly, sinks

NEW = "TradDt,TckrSymb,SctySrs,FinInstrmTp,ISIN,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol"
OLD = " SYMBOL, SERIES, OPEN, HIGH, LOW, CLOSE, PREVCLOSE, TOTTRDQTY, TIMESTAMP, ISIN"


def folder(tmp_path, **files):
    for name, text in files.items():
        name = name.replace("_dot_", ".")
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    return f"file://{tmp_path}"


def test_both_layouts_and_a_foreign_file_in_one_folder(spark, tmp_path):
    at = folder(
        tmp_path,
        a_dot_csv=f"{NEW}\n2024-01-02, abc ,EQ,STK,INE1,1,3,1,2,1,10.0\n2024-01-02,def,GB,STK,INE2,1,3,1,2,1,10\n2024-01-02,ghi,EQ,OPT,INE2,1,3,1,2,1,10\n2024-01-02,jkl,BE,STK,INE3,1,3,1,9,1,\n",
        b_dot_csv=f"{OLD}\r\nxyz,EQ,1,3,1,2,1,5,02-JAN-2023,INE4\r\n\r\n",
        c_dot_csv="Name,Price\nabc,1\nabd,2\n",
        d_dot_csv="",
        e_dot_csv_dot_gz=f"{NEW}\nnonsense,zip,EQ,STK,INE1,1,3,1,2,1,10\n",
    )
    got = {(r.layout, r.symbol): r for r in ly.daily(spark, at).collect()}
    assert set(got) == {("new", "ABC"), ("new", "JKL"), ("old", "XYZ"), ("unknown", None), ("new", "ZIP")}
    assert got["new", "ABC"].problem is None and got["new", "ABC"].volume == 10
    assert got["new", "JKL"].problem == got["new", "ZIP"].problem == "bad price row" and got["new", "JKL"].volume == 0
    assert got["old", "XYZ"].date == dt.date(2023, 1, 2) and got["old", "XYZ"].problem is None
    checks = {r.layout: r for r in ly.daily_checks(ly.daily(spark, at), 1).collect() if r.layout == "old"}
    assert checks["old"].ok
    assert "TckrSymb" in got["unknown", None].problem


def test_a_file_is_read_in_parts_with_its_own_header(spark, tmp_path):
    """No row holds a whole file: parts of a few lines, blank lines, a file of a header only, one of blanks."""
    day = lambda i: f"{1 + i % 28:02d}-JAN-2023"
    at = folder(
        tmp_path,
        a_dot_csv=f"\ufeff\n\n{NEW}\n" + "".join(f"2024-01-02,a{i},EQ,STK,INE1,1,3,1,2,1,{i}\n\n" for i in range(400)),
        b_dot_csv=f"{OLD}\r\n" + "".join(f"b{i},EQ,1,3,1,2,1,{i},{day(i)},INE4\r\n" for i in range(300)),
        c_dot_csv=f"{NEW}\n",
        d_dot_csv="\n \n",
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        raw = ly.rows(spark, at)
        got = raw.collect()
        assert raw.where("file like '%a.csv'").select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = {}
    for r in got:
        by.setdefault(r.file[-5], []).append(r)
    assert [r.row for r in sorted(by["a"], key=lambda r: r.row)] == list(range(1, 401))
    assert all(r.cells[1] == f"a{r.row - 1}" and r.header == NEW.split(",") for r in by["a"])
    assert sorted(r.row for r in by["b"]) == list(range(1, 301)) and all(r.cells[0] == f"b{r.row - 1}" and r.header[0] == "SYMBOL" for r in by["b"])
    assert [(r.row, r.cells, len(r.header)) for r in by["c"]] == [(None, None, 11)]
    assert [(r.row, r.header) for r in by["d"]] == [(None, [])]


def test_lines_of_prices_are_cut_in_generated_code_and_headers_are_looked_at_once_a_part(spark, tmp_path):
    """A lambda would leave generated code for each line; a name must not be looked up in the header for each line."""
    at = folder(tmp_path, a_dot_csv=f"{NEW}\n2024-01-02,abc,EQ,STK,INE1,1,3,1,2,1,10\n")
    plan = ly.daily(spark, at)._jdf.queryExecution().optimizedPlan().toString()
    cut = [x for x in plan.split("\n") if "Generate inline" in x]
    assert cut and not any("lambda" in x or "array_position" in x for x in cut)
    above = plan[: plan.index("Generate inline")]
    assert "array_position" not in above and "array_except" not in above


def test_quoted_lines_have_the_cells_that_the_same_lines_have_without_quotes(spark):
    lines = ['a , b,c', '"a, ""x""" ,, " b "', '"",""""," "', 'a"b,"c', '"a","b""c",d', ' "1,234.5" ,%,"x""y"', ",,", '"q"']
    want = [["a", "b", "c"], ['a, "x"', None, "b"], [None, '"', None], ['a"b,"c'], ["a", 'b"c', "d"], ["1,234.5", "%", 'x"y'], [None, None, None], ["q"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", ly._cells(F.col("line")).alias("cells"))
    assert [r.cells for r in sorted(df.collect(), key=lambda r: r.i)] == want


def test_many_rows_of_one_key_lie_in_several_files(spark, tmp_path):
    from ledgerflow.catalog.files import _csv

    size, one = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(size, "20000")
    spark.conf.set(one, "10000")
    try:
        _csv(spark.range(0, 40000, 1, 4).select(F.lit("1998-1").alias("file"), F.col("id").alias("Name"), F.sha2(F.col("id").cast("string"), 256).alias("Price")), f"file://{tmp_path}/x", "file")
    finally:
        spark.conf.unset(size)
        spark.conf.unset(one)
    assert len(list((tmp_path / "x" / "file=1998-1").glob("*.csv"))) > 1
    got = ly.rows(spark, f"file://{tmp_path}/x/*").collect()
    assert sorted(int(r.cells[0]) for r in got) == list(range(40000)) and all(r.header == ["Name", "Price"] for r in got)


def test_a_file_without_one_column_says_which(spark, tmp_path):
    at = folder(tmp_path, a_dot_csv=NEW.replace("ClsPric,", "") + "\n2024-01-02,abc,EQ,STK,INE1,1,3,1,1,10\n")
    assert [r.problem for r in ly.daily(spark, at).collect()] == ["columns are missing: ClsPric"]


def test_quotes_and_commas_in_fields(spark, tmp_path):
    at = folder(tmp_path, x_20240105120000_dot_csv='Company Name,Industry,Symbol,Series,ISIN Code\n"A, ""big"" one",Steel,aa,EQ,INE000000001\nB,Steel,,EQ,INE000000002\nC,,cc,RR,INE000000003\nD,Steel,dd,EQ,X\n')
    got = {r.symbol: r for r in ly.constituents(spark, at).collect()}
    assert got["AA"].company_name == 'A, "big" one' and got["AA"].week_start == dt.date(2024, 1, 5) and got["AA"].problem is None
    assert [got[k].problem for k in ("", "CC", "DD")] == ["missing symbol", "no industry", "bad ISIN"] and got["CC"].instrument_type == "reit"
    check = ly.constituent_checks(ly.constituents(spark, at), 1, 10).first()
    assert (check.usable, check.skipped, check.duplicates, check.ok) == (1, 3, 0, True)


def test_a_changed_constituent_header_stops_the_file(spark, tmp_path):
    at = folder(tmp_path, x_20240105120000_dot_csv="Company Name,Sector,Symbol,Series,ISIN Code\nA,Steel,AA,EQ,INE000000001\n")
    assert [r.problem for r in ly.constituents(spark, at).collect()] == ["header changed"]
    assert not ly.constituent_checks(ly.constituents(spark, at), 0, 10).first().ok


def test_index_levels(spark, tmp_path):
    head = "Index Name,Index Date,Open Index Value,High Index Value,Low Index Value,Closing Index Value,P/E\n"
    at = folder(tmp_path, a_dot_csv=head + 'Bench,05-01-2024,"1,000.5",-,.34,"2,000",-\nOther,05 Jan 2024,1,1,1,1,1\nBench,2024-01-06,1,1,1,-,1\n', b_dot_csv="Index Name\nBench\n")
    rows = ly.index(spark, at, ("BENCH",)).collect()
    good = [r for r in rows if r.problem is None]
    assert [(r.date, r.open, r.high, r.low, r.close, r.pe) for r in good] == [(dt.date(2024, 1, 5), 1000.5, None, 0.34, 2000.0, None)]
    assert [r.problem[:19] for r in rows if r.problem] == ["columns are missing"]


def test_live_feed(spark, tmp_path):
    doc = {"timestamp": "05-Jan-2024 10:00", "data": [{"index": "Bench ", "last": "1,234.5", "open": "-", "percentChange": 0.5}, {"index": "Other", "last": 1}]}
    at = folder(tmp_path, a_dot_json=json.dumps(doc), b_dot_json='{"timestamp": "x", "data": []}', c_dot_json="no json")
    rows = ly.live_index(spark, at, ("bench",)).collect()
    assert [(r.name, r.last, r.open, r.pct_change, r.as_of) for r in rows if not r.problem] == [("Bench", 1234.5, None, 0.5, "05-Jan-2024 10:00")]
    assert [r.problem for r in rows if r.problem] == ["no data", "no data"]


def test_page_checks_name_the_first_problem(spark):
    a = spark.createDataFrame([("ok", 1.0, 10.0), ("ok", -1.0, 5000.0), ("loss", -1.0, 1.0), ("none", None, 1.0), ("wild", 5.0, 2000.0), ("noq", 1.0, 1.0), ("odd", 1.0, 1.0)], "p string, revenue double, opm double")
    q = spark.createDataFrame([(k,) for k in ("ok", "loss", "none", "wild", "odd", "noa")], "p string")
    h = spark.createDataFrame([("ok", 100.0), ("ok", 0.0), ("odd", 80.0)], "p string, total double")
    got = {r.p: r.problem for r in ly.sane(a, q, h, ["p"]).collect()}
    assert got == {"ok": None, "loss": "no revenue above zero", "none": "no revenue in any year", "wild": "margins are no percentages", "noq": "no quarterly table", "odd": "holders do not sum to a whole", "noa": "no annual table"}


def test_the_live_basis(spark):
    d = dt.date
    pages = [("a", "consolidated", 5, 5, d(2023, 12, 31)), ("a", "standalone", 5, 5, d(2023, 12, 31)), ("b", "consolidated", 5, 5, d(2020, 12, 31)), ("b", "standalone", 5, 5, d(2023, 12, 31)), ("c", "consolidated", 0, 0, None), ("c", "standalone", 1, 1, d(2010, 1, 1)), ("e", "consolidated", 5, 5, d(2022, 12, 31)), ("f", "consolidated", 3, 0, d(2023, 12, 31))]
    df = spark.createDataFrame(pages, "symbol string, basis string, years int, quarters int, newest date")
    got = {r.symbol: r.basis for r in ly.live_basis(df, F.lit("2024-07-03").cast("date")).collect()}
    assert got == {"a": "consolidated", "b": "standalone", "c": "standalone", "e": "consolidated"}  # 550 days are still live


def test_a_run_is_seen_when_it_is_whole_and_may_be_made_again(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    one = spark.createDataFrame([(1, 1.0), (2, float("nan"))], "symbol int, x double")
    for _ in range(2):
        sinks.publish_documents(one, "symbol", at, "r1")
    assert {r.key: r.x for r in sinks.documents(spark, at, "key int, x double").collect()} == {1: 1.0, 2: None}
    # A run that fails leaves the last whole one in place.
    with pytest.raises(Exception):
        sinks.publish_documents(one.withColumn("x", F.raise_error("broken").cast("double")), "symbol", at, "r2")
    assert sinks.current(spark, at).endswith("/runs/r1") and sinks.documents(spark, at, "key int, x double").count() == 2
    sinks.publish_documents(one.limit(1), "symbol", at, "r3")
    assert sinks.documents(spark, at, "key int, x double").count() == 1


def test_documents_are_strict_and_keep_nulls(spark, tmp_path):
    at = f"file://{tmp_path}/doc"
    df = spark.sql("select 7 symbol, array(double('nan'), 1.23456, double('infinity')) c, named_struct('a', double('nan'), 'b', array(named_struct('z', double('-infinity')))) s, cast(null as double) n")
    sinks.publish_documents(df, "symbol", at, "r")
    files = [p for p in (tmp_path / "doc/runs/r/symbol=7").iterdir() if p.suffix == ".txt"]
    assert len(files) == 1
    assert json.loads(files[0].read_text()) == {"key": 7, "c": [None, 1.2346, None], "s": {"a": None, "b": [{"z": None}]}, "n": None}


def test_ranked_snapshot_puts_unknown_last(spark, tmp_path):
    at = f"file://{tmp_path}/r"
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i % 7)) for i in range(50)], "symbol long, blended double")
    sinks.publish_ranked(df, at, "r", "blended", "symbol")
    rows = sorted(sinks.ranked(spark, at, "symbol long, blended double").collect(), key=lambda r: (r.file, r.place))
    assert [(r.blended, r.symbol) for r in rows] == sorted([(r.blended, r.symbol) for r in rows], key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
