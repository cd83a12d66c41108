"""Books marked to market, shortlists, reads by name and texts, against their rules."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import text as tx
from ledgerflow.operators import portfolio as pf, reads, scoring

HELD = "book int, symbol string, id int, price double, qty double, stop double"


def marked(spark):
    held = spark.createDataFrame([(1, "A", 1, 100.0, 10.0, 90.0), (1, "B", 2, 50.0, 4.0, 60.0), (1, "C", 3, 10.0, 1.0, None), (2, "D", 4, 10.0, 1.0, 9.0)], HELD)
    prices = spark.createDataFrame([("A", 120.0), ("B", 40.0), ("C", 12.0)], "symbol string, close double")
    failed = spark.createDataFrame([("A", []), ("B", ["loss_making"])], "symbol string, names array<string>")
    return pf.marked(held, prices, failed)


def test_marks(spark):
    got = {r.symbol: r for r in marked(spark).collect()}
    a, b, c, d = (got[k] for k in "ABCD")
    assert (a.value, a.pnl, round(a.ret, 9), a.r_multiple, round(a.stop_distance, 9), a.risk_left, a.intact) == (1200.0, 200.0, 0.2, 2.0, round(120 / 90 - 1, 9), 300.0, True)
    assert b.r_multiple is None and b.risk_left == -80.0 and b.intact is False
    assert c.stop_distance is None and c.risk_left is None and c.intact is None and c.value == 12.0
    assert d.value is None and d.pnl is None


def test_totals_and_capacity(spark):
    t = {r.book: r for r in pf.totals(marked(spark), "book").collect()}
    assert (t[1].positions, t[1].invested, t[1].value, t[1].risk_left, t[1].broken) == (3, 1210.0, 1372.0, 220.0, 1)
    assert t[2].value == 0.0 and t[2].pnl == -10.0
    cap = spark.createDataFrame([(1, 10_000.0, 0.01)], "book int, capital double, risk_pct double")
    c = pf.capacity(pf.totals(marked(spark), "book"), cap, "book").collect()
    assert len(c) == 1 and (c[0].unit, c[0].free, c[0].risked, c[0].units_free) == (100.0, 8628.0, 220.0, 3)


def test_shortlist_rules(spark):
    rows = [("A", 1, 9.0, 100.0, 90.0, False), ("B", 2, None, 100.0, 90.0, False), ("C", 3, 9.0, 100.0, 100.0, False), ("D", 4, 9.0, 100.0, 90.0, True), ("E", 5, 9.0, 100.0, 99.0, None), ("F", 6, 9.0, 5000.0, 4000.0, False), ("G", 7, 9.0, 10.0, None, False)]
    cand = spark.createDataFrame(rows, "symbol string, rank int, conviction double, close double, stop double, failed boolean")
    held = spark.createDataFrame([(1, "A")], "book int, symbol string")
    cap = spark.createDataFrame([(1, 10_000.0, 0.01), (2, 10_000.0, 0.01)], "book int, capital double, risk_pct double")
    got = sorted((r.book, r.place, r.symbol, r.shares, r.cost, r.risk, r.capped) for r in pf.shortlist(cand, held, cap).collect())
    assert got == [(1, 1, "E", 10, 1000.0, 10.0, True), (2, 1, "A", 10, 1000.0, 100.0, False), (2, 2, "E", 10, 1000.0, 10.0, True)]
    many = spark.range(40).select(F.concat(F.lit("S"), "id").alias("symbol"), F.col("id").cast("int").alias("rank"), F.lit(1.0).alias("conviction"), F.lit(10.0).alias("close"), F.lit(9.0).alias("stop"), F.lit(False).alias("failed"))
    assert [r.rank for r in pf.shortlist(many, held, cap.where("book = 1")).orderBy("place").collect()] == list(range(12))


def test_insights(spark):
    cap = spark.createDataFrame([(1, 10_000.0, 0.01), (2, 10_000.0, 0.01)], "book int, capital double, risk_pct double")
    got = {(r.symbol, r.insight) for r in pf.insights(marked(spark), cap).collect()}
    assert got == {("A", "it is 12.0% of the capital"), ("A", "it still risks 3.0% of the capital"), ("B", "the close is at or under the stop"), ("B", "it fails a gate"), ("D", "no price to mark it at")}


def test_reads_by_name(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "b", None)], "r_regionkey int, k string, v double")
    ids = lambda x: sorted(r.r_regionkey for r in x.collect())
    assert ids(reads.select(df, "region", where={"k": None})) == [2] and ids(reads.select(df, "region", within={"k": ["a", "b"]}, since=("v", 1.0))) == [1]
    assert reads.select(df, "region", ("k",)).columns == ["k"]
    with pytest.raises(KeyError, match="nowhere"):
        reads.select(df, "nowhere")
    assert [r.r_regionkey for r in reads.newest(df, "v", 3, "r_regionkey").collect()] == [2, 1, 3]
    assert [r.r_regionkey for r in reads.page(df, "region", 2, 1).collect()] == [3]


def test_every_order_is_total(spark, sf_dir):
    for table, keys in reads.ORDER.items():
        if table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys)
            assert df.count() == df.distinct().count(), table


def test_update_and_insert(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0)], "i int, k string, v double")
    assert [tuple(r) for r in reads.update(df, {"v": None, "k": "z"}, {"k": "a"}).orderBy("i").collect()] == [(1, "z", None), (2, None, 2.0)]
    assert [r.v for r in reads.update(df, {"v": 9}, {"k": None}).orderBy("i").collect()] == [1.0, 9.0]
    with pytest.raises(ValueError):
        reads.update(df, {"v": 0}, {})
    assert [tuple(r) for r in reads.insert(df, spark.createDataFrame([(3,)], "i int")).orderBy("i").collect()][-1] == (3, None, None)
    with pytest.raises(ValueError):
        reads.insert(df, spark.createDataFrame([(3, 1)], "i int, w int"))


def test_texts(spark):
    x = spark.createDataFrame([(0.0691, 99.6), (-0.05, 1500.0), (None, None), (0.0, 250_000.0), (1.0, -2000.0)], "v double, m double")
    got = [tuple(r) for r in x.select(tx.change("v"), tx.share(F.abs("v")), tx.crore("m")).collect()]
    assert got == [("+6.9%", "6.9%", "100 Cr"), ("-5.0%", "5.0%", "1.5K Cr"), ("-", "-", "-"), ("+0.0%", "0.0%", "2.50L Cr"), ("+100.0%", "100.0%", "-2.0K Cr")]


def test_carried_events_and_fading_share(spark):
    h = spark.sql("select 's' symbol, date_add(date'2024-01-01', cast(id as int)) date, id * 1.0D close, id = 3 as doji, cast(null as boolean) as star from range(70)")
    r = scoring.carried(h, ("doji", "star"), 67).first()
    assert (r.close, r.doji, r.star) == (69.0, True, False) and scoring.carried(h, ("doji",), 66).first().doji is False
    d = spark.sql("select array(named_struct('feature', 'tm_score', 'points', 3.0D), named_struct('feature', 'headroom', 'points', 1.0D), named_struct('feature', 'value_score', 'points', -9.0D)) drivers union all select array(named_struct('feature', 'tm_score', 'points', -1.0D))")
    assert [r[0] for r in d.select(scoring.fading_share()).collect()] == [0.75, None]


def test_lenders_and_equities(spark):
    x = spark.createDataFrame([("financial", "IT", None), (None, "Banks", "etf"), ("general", None, "equity"), (None, None, "reit")], "company_type string, sector string, instrument_type string")
    assert [tuple(r) for r in x.select(scoring.is_lender(("Banks",)), scoring.is_equity()).collect()] == [(True, True), (True, False), (False, True), (False, False)]
