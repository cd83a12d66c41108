"""Point-in-time reads: what was filed, what zones had done, and setups as of a bar."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerflow.catalog import QUERIES
from ledgerflow.operators import indicators as ind, overhead as oh, pointintime as pt, setups as st
from ledgerflow.plans.cut import cut

D = dt.date
YEAR = "symbol long, period_end date, filed_on date, " + ", ".join(f"{c} double" for c in pt.ANNUAL)
QUARTER = "symbol long, period_end date, filed_on date, " + ", ".join(f"{c} double" for c in pt.QUARTERLY)
HOLDING = "symbol long, quarter_end date, promoter_pct double, fii_pct double, dii_pct double, has_promoter boolean"


def year(symbol, y, filed=None, **more):
    base = dict.fromkeys(pt.ANNUAL, 1.0) | {"revenue": 100.0, "pat": 10.0, "eps": 5.0, "equity": 50.0, "debt": 20.0, "ebitda": 15.0, "cfo": 9.0, "debtor_days": 40.0} | more
    return (symbol, D(y, 12, 31), filed or D(y + 1, 3, 1), *[base[c] for c in pt.ANNUAL])


def quarter(symbol, y, q, filed=None, **more):
    end = {1: D(y, 3, 31), 2: D(y, 6, 30), 3: D(y, 9, 30), 4: D(y, 12, 31)}[q]
    base = {"revenue": 25.0, "pat": 2.5, "opm": 10.0, "eps": 1.25} | more
    return (symbol, end, filed if filed != "never" else None, *[base[c] for c in pt.QUARTERLY]) if filed else (symbol, end, end + dt.timedelta(45), *[base[c] for c in pt.QUARTERLY])


def metrics(spark, years=(), quarters=(), holds=(), at=(D(2005, 6, 30),), close=100.0, shares=10, lender=False, prices=((1, D(2000, 1, 1), 60.0),)):
    book = pt.books(spark.createDataFrame(list(years), YEAR), spark.createDataFrame(list(quarters), QUARTER), spark.createDataFrame(list(holds), HOLDING), spark.createDataFrame(list(prices), "symbol long, date date, close double"))
    rows = spark.createDataFrame([(d, 1, close, shares, lender) for d in at], "as_of date, symbol long, close double, shares int, is_financial boolean")
    return {r.as_of: r for r in pt.fundamentals(pt.as_filed(rows, book)).collect()}


def test_results_count_from_the_day_they_are_filed(spark):
    years = [year(1, 2003), year(1, 2004, filed=D(2005, 7, 1), revenue=900.0, eps=50.0)]
    got = metrics(spark, years, at=(D(2005, 6, 30), D(2005, 7, 1)))
    assert got[D(2005, 6, 30)].pe == 20.0 and got[D(2005, 7, 1)].pe == 2.0


def test_never_filed_is_never_known(spark):
    r = metrics(spark, quarters=[quarter(1, 2004, q, filed="never") for q in (1, 2, 3, 4)])[D(2005, 6, 30)]
    assert r.pe is None and r.eps is None


def test_a_later_filing_changes_no_earlier_row(spark):
    dates = tuple(D(y, m, 28) for y in (2003, 2004, 2005) for m in (2, 5, 8, 11))
    base_y, base_q = [year(1, y, revenue=50.0 * (y - 1999), pat=5.0 * (y - 1998)) for y in range(2000, 2005)], [quarter(1, y, q, pat=1.0 + q * y % 7, revenue=20.0 + y % 5 + q) for y in range(2000, 2006) for q in (1, 2, 3, 4)]
    holds = [(1, D(y, 3 * q, 30), 50.0 + q, 10.0 + y % 4, 5.0, True) for y in range(2001, 2006) for q in (1, 2, 3, 4)]
    a = metrics(spark, base_y, base_q, holds, at=dates)
    # Every filing after May 2004 is another one now.
    other = lambda rows, f: [f(r) if r[2] > D(2004, 5, 28) else r for r in rows]
    b = metrics(spark, other(base_y, lambda r: (*r[:3], *[9.0 * x + 1 for x in r[3:]])), other(base_q, lambda r: (*r[:3], *[7.0 * x + 2 for x in r[3:]])), [h if h[1] + dt.timedelta(31) <= D(2004, 5, 28) else (h[0], h[1], 3.0, 3.0, 3.0, False) for h in holds], at=dates)
    for d in dates:
        assert (a[d] == b[d]) == (d <= D(2004, 5, 28)), d


def test_trailing_earnings_are_four_quarters_else_the_year(spark):
    quarters = [quarter(1, 2004, q, eps=float(q)) for q in (1, 2, 3, 4)]
    assert metrics(spark, [year(1, 2004, eps=3.0)], quarters)[D(2005, 6, 30)].eps == 10.0
    assert metrics(spark, [year(1, 2004, eps=3.0)], quarters[:3])[D(2005, 6, 30)].eps == 3.0
    assert metrics(spark)[D(2005, 6, 30)].eps is None


def test_multiples_need_what_they_divide_by(spark):
    r = metrics(spark, [year(1, 2004)])[D(2005, 6, 30)]
    assert (r.pe, r.pb, r.ev_ebitda, r.ev_sales) == (20.0, 20.0, 1020 / 15, 10.2)
    r = metrics(spark, [year(1, 2004, eps=-1.0, equity=0.0, ebitda=-3.0)], shares=0)[D(2005, 6, 30)]
    assert (r.pe, r.pb, r.ev_ebitda, r.ev_sales) == (None,) * 4


def test_own_multiple_is_the_median_of_three_years_or_more(spark):
    prices = [(1, D(y, 12, 30), 10.0 * (y - 1999)) for y in range(2000, 2005)]
    years = [year(1, y) for y in range(2000, 2005)]
    assert metrics(spark, years, prices=prices)[D(2005, 6, 30)].pe_5y_median == 6.0
    assert metrics(spark, years[:2] + [year(1, 2004, eps=-1.0)], prices=prices)[D(2005, 6, 30)].pe_5y_median is None
    assert metrics(spark, years[1:], prices=prices)[D(2005, 6, 30)].pe_5y_median == 7.0


def verdicts(r):
    return {f["name"]: f["verdict"] for f in r.flags}


def test_gates_from_histories(spark):
    hold = [(1, D(2004, 3 * q, 28), p, 1.0, 1.0, True) for q, p in ((1, 50.0), (2, 50.0), (3, 46.0))]
    years = [year(1, y, cfo=2.0, pat=10.0, debtor_days=30.0 * (y - 2001)) for y in (2002, 2003, 2004)]
    r = metrics(spark, years, holds=hold)[D(2005, 6, 30)]
    assert verdicts(r) == {"promoter_pledge": "unknown", "promoter_selling": "fail", "cash_conversion": "fail", "receivable_bloat": "fail", "loss_making": "pass", "illiquid": "unknown"} and r.excluded
    r = metrics(spark, years, holds=[h[:5] + (False,) for h in hold], lender=True)[D(2005, 6, 30)]
    assert verdicts(r)["promoter_selling"] == verdicts(r)["cash_conversion"] == verdicts(r)["receivable_bloat"] == "not_applicable" and not r.excluded
    r = metrics(spark, years[:1])[D(2005, 6, 30)]
    assert verdicts(r)["cash_conversion"] == verdicts(r)["loss_making"] == "unknown"
    r = metrics(spark, [year(1, y, pat=-1.0) for y in (2003, 2004)])[D(2005, 6, 30)]
    assert verdicts(r)["loss_making"] == "fail" and verdicts(r)["cash_conversion"] == "unknown"


def test_holdings_are_public_after_a_month(spark):
    hold = [(1, D(2005, 3, 31), 40.0, 1.0, 1.0, True), (1, D(2005, 6, 30), 30.0, 1.0, 1.0, True)]
    got = metrics(spark, holds=hold, at=(D(2005, 7, 30), D(2005, 7, 31)))
    assert got[D(2005, 7, 30)].promoter_delta_1q is None and got[D(2005, 7, 31)].promoter_delta_1q == -10.0


def wander(spark, symbols=(1, 2), n=220, seed=3):
    rng, day, rows = random.Random(seed), D(2000, 1, 3), []
    for s in symbols:
        p = 100.0
        for i in range(n):
            o = p * (1 + rng.gauss(0, 0.01))
            c = o * (1 + rng.gauss(0, 0.03)) + (100 - o) * 0.05
            rows.append((s, day + dt.timedelta(7 * i), o, max(o, c) * (1 + abs(rng.gauss(0, 0.01))), min(o, c) * (1 - abs(rng.gauss(0, 0.01))), c, 1000.0 + rng.randint(0, 500)))
            p = c
    return spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume double")


def test_zone_state_at_any_bar_is_the_event_list_cut_there(spark):
    bars = cut(wander(spark), "symbol")
    built = cut(st.build(bars, "daily"))
    assert built.where("size(ev) > 2").count() > 5
    bars_at = [60, 100, 150, 219]
    at = spark.createDataFrame([(i, s, i, 100.0) for s in (1, 2) for i in bars_at], "as_of int, symbol long, i int, close double")
    got = oh.rated_at(oh.summed(built), at, "daily")
    key = lambda r: (r.i, r.symbol, r.kind, r.source, r.zone)
    state = lambda r: (r.touches, r.rejections, r.breaks, r.respect and round(r.respect, 9), round(r.strength, 2))
    got = {key(r): state(r) for r in got.collect()}
    want = {}
    for i in bars_at:
        z = st.properties(built.select("symbol", "kind", "source", "zone", "formed", "floor", "ceil", "ev").withColumn("i", F.lit(i)), "i")
        want |= {key(r): state(r) for r in z.where("live").withColumn("strength", st.strength("daily", "i")).collect()}
    assert got == want and len(want) > 40


def test_setups_at_the_last_bar_are_those_of_the_plain_evaluation(spark):
    bars = cut(wander(spark, symbols=tuple(range(1, 9))), "symbol")
    long = cut(bars.groupBy("symbol", F.floor(F.unix_date("date") / 28).alias("m")).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.max("date").alias("date")).drop("m"), "symbol")
    last = bars.groupBy("symbol").agg(F.max("date").alias("date"))
    flags = cut(st.flags(bars, "daily").withColumn("i", F.row_number().over(ind.W()) - 1).join(last, ["symbol", "date"]))
    rows = flags.withColumn("as_of", F.col("date"))
    scored = rows.select("as_of", "symbol", F.lit(80.0).alias("quality_score"), (F.col("symbol") == 3).alias("excluded"))
    n_long = long.groupBy("symbol").agg((F.count("*") - 1).cast("int").alias("i"))
    no_shelf = F.col("source") != "volume_shelf"  # those are capped at the end of history only
    target = pt.resistance_at(bars, rows)
    got = pt.setups_at(rows, scored, pt.zones_at(bars, rows.select("as_of", "symbol", "i", "close"), "daily").where(no_shelf), pt.zones_at(long, rows.select("as_of", "symbol", "close").join(n_long, "symbol"), "weekly").where(no_shelf), target)
    plain = st.evaluate(flags.withColumns({"quality": F.lit(80.0), "excluded": F.col("symbol") == 3}), st.build(bars, "daily").where(no_shelf), st.build(long, "weekly").where(no_shelf), target.drop("as_of"))
    a = {r.symbol: (r.ts_score, r.setup_status) for r in got.collect()}
    assert a == {r.symbol: (r.score, r.status) for r in plain.collect()} and len(a) == 8


def test_target_sees_no_later_swing(spark):
    bars = cut(wander(spark, n=200), "symbol")
    place = bars.withColumn("i", F.row_number().over(ind.W()) - 1)
    at = ind.atr(place, out="atr").withColumn("year_high", F.max("high").over(ind.W().rowsBetween(-251, 0)))
    day = D(2000, 1, 3) + dt.timedelta(7 * 120)
    rows = at.where(F.col("i") == 120).withColumn("as_of", F.lit(day))
    early = pt.resistance_at(bars, rows)
    cut_bars = bars.where(F.col("date") <= day)
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, pt.resistance_at(cut_bars, rows).collect()))


def test_full_panel_has_the_setups(spark, sf_dir):
    x = QUERIES["j20_full_panel"](spark, sf_dir)
    rows = x.collect()
    assert {"ts_score", "technical", "winning_setup", "forward_return", "rsi_div_bearish_weekly"} <= set(x.columns)
    assert rows and len({(r.as_of, r.symbol) for r in rows}) == len(rows)
    for r in rows:
        tm, ts = r.tm_score, r.ts_score
        assert r.winning_setup == ("support" if ts is not None and (tm is None or ts > tm) else "momentum" if tm is not None else "none")
        assert r.technical == max((v for v in (tm, ts) if v is not None), default=None)
