"""File readers on small generated files and streams on the events table."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import tables as tb
from ledgerflow.sources import files
from ledgerflow.streaming import live


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def test_daily_layouts(spark, tmp_path):
    new = put(tmp_path, "n.csv", "TradDt,TckrSymb,SctySrs,FinInstrmTp,ISIN,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol\n2024-01-02,abc ,EQ,STK,X,10,12,9,11,10,\"1,000\"\n2024-01-02,DEF,GS,STK,X,1,1,1,1,1,1\n2024-01-02,FUT,EQ,FUT,X,1,1,1,1,1,1\n")
    old = put(tmp_path, "o.csv", "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TIMESTAMP,ISIN\nABC,EQ,10,12,9,11,10,,29-DEC-2023,X\n".replace("DEC", "Dec"))
    rows = sorted(map(tuple, files.daily_unified([files.daily_prices(files.raw_csv(spark, p)) for p in (new, old)]).select("symbol", "date", "close", "volume").collect()))
    assert rows == [("ABC", dt.date(2023, 12, 29), 11.0, 0), ("ABC", dt.date(2024, 1, 2), 11.0, 1000)]
    bad = put(tmp_path, "b.csv", "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TIMESTAMP,ISIN\nABC,EQ,10,12,9,13,10,5,29-Dec-2023,X\n")
    raw = files.raw_csv(spark, bad)
    with pytest.raises(Exception, match="bad price row"):
        files.daily_prices(raw).collect()
    assert [r["ok"] for r in files.daily_prices(raw, strict=False).collect()] == [False]
    with pytest.raises(ValueError):
        files.daily_prices(raw.drop("CLOSE"))


def test_index_and_constituents(spark, tmp_path):
    p = put(tmp_path, "i.csv", "Index Name,Index Date,Open Index Value,High Index Value,Low Index Value,Closing Index Value,P/E\nBroad,02-01-2024,1,2,.5,\"1,234.5\",-\nOther,02 Jan 2024,-,-,-,-,.34\nThird,2024-01-02,1,1,1,1,.34\n")
    got = {r["index_name"]: (r["date"], r["close"], r["pe"]) for r in files.index_prices(files.raw_csv(spark, p)).collect()}
    day = dt.date(2024, 1, 2)
    assert got == {"Broad": (day, 1234.5, None), "Third": (day, 1.0, 0.34)}
    text = "Company Name,Industry,Symbol,Series,ISIN Code\n" + "".join(f"C{i},I,S{i},EQ,INE{i:09d}\n" for i in range(460)) + "D,I,BAD,EQ,XX\n"
    c = files.constituents(files.raw_csv(spark, put(tmp_path, "c.csv", text)))
    assert files.constituent_checks(c).first().asDict() == {"usable": 460, "skipped": 1, "duplicates": 0, "ok": True}


def test_chart_and_statements(spark):
    chart = {"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [0, 86400], "indicators": {"quote": [{"open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1.5, None], "volume": [5, 6]}]}}]}}
    got = files.chart_bars(spark.createDataFrame([(json.dumps(chart),)], "value string")).collect()
    assert [(r["date"], r["close"], r["adj_close"]) for r in got] == [(dt.date(1970, 1, 1), 1.5, 1.5)]
    chart["chart"]["result"][0]["timestamp"] = [0]
    with pytest.raises(Exception, match="ragged"):
        files.chart_bars(spark.createDataFrame([(json.dumps(chart),)], "value string")).collect()
    html = '<section id="quarters" class="c"><table class="t"><tr><th></th><th>Mar 2024</th><th>Jun 2024</th></tr><tr><td>Sales&nbsp;+</td><td>1,200</td><td>-</td></tr><tr><td>OPM %</td><td>12%</td><td>13%</td></tr></table></section>'
    cells = files.statement_tables(spark.createDataFrame([("A", html), ("B", None)], "symbol string, html string"))
    recs = {r["period"]: (r["revenue"], r["opm"]) for r in files.statement_records(cells, {"Sales": "revenue", "OPM %": "opm"}).collect()}
    assert recs == {"Mar 2024": (1200.0, 12.0), "Jun 2024": (None, 13.0)}


def run(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def test_streams(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    run(live.latest_quotes(events(spark, sf_dir).select(F.col("event_type").alias("name"), "ts", "value")), "complete", "q1")
    want = {r["event_type"]: r["ts"] for r in batch.groupBy("event_type").agg(F.max("ts").alias("ts")).collect()}
    assert {r["name"]: r["ts"] for r in spark.table("q1").collect()} == want
    run(live.transitions(events(spark, sf_dir), "user_id", "ts", "value", 50.0), "append", "q2")
    side = batch.select("user_id", "ts", "value").where("value is not null").toPandas().sort_values(["user_id", "ts", "value"])
    side["s"] = side.value >= 50
    n = int(((side.s != side.groupby("user_id").s.shift()) & side.groupby("user_id").s.shift().notna()).sum())
    assert spark.table("q2").count() == n
    run(live.tumbling(events(spark, sf_dir), "ts", "1 day", "event_type"), "complete", "q3")
    assert spark.table("q3").agg(F.sum("n")).first()[0] == batch.count()
    run(live.sessions(events(spark, sf_dir), "ts", "30 minutes", "user_id"), "complete", "q4")
    assert spark.table("q4").agg(F.sum("n")).first()[0] == batch.count()
    run(live.dedupe(events(spark, sf_dir), "event_type", "ts", "60 days"), "append", "q5")
    assert spark.table("q5").count() == batch.select("event_type").distinct().count()


def test_upsert_stream(spark, sf_dir, tmp_path):
    src = events(spark, sf_dir).select("user_id", "ts", "value")
    q = live.upsert_batches(src, f"file://{tmp_path}/t", ["user_id"], "ts", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/t/v=0")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert got.count() == batch.select("user_id").distinct().count()


def test_tables_edges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted(map(tuple, tb.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, None), (3, "c")]
    assert [tuple(r) for r in tb.replace_keys(old, old.where("k = 1"), new.limit(0), "k").collect()] == [(2, "b")]
    seen = spark.createDataFrame([("x", dt.date(2024, 1, d)) for d in (1, 5, 12, 20, 23)], "key string, date date")
    assert sorted(r["date"].day for r in tb.suppress_seen(seen, "key", "date", 10).collect()) == [1, 12, 23]
