"""Further queries: adjustment, freshness, snapshots, alerts, positions, sinks (sections B-L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import actions, asof, indicators as ind
from ..operators.indicators import W
from ..plans.views import Market
from .prices import OVER, _roll
from .registry import query
from .tables import _LATEST, latest

_ADJ = "adj AS (SELECT *, CASE WHEN symbol % 9 = 0 THEN NULL WHEN date < DATE '1998-01-01' THEN close / 2 ELSE close END AS adj_close FROM bars)"


@query("SELECT symbol, date, round(open * f, 6) AS open, round(high * f, 6) AS high, round(low * f, 6) AS low, round(close * f, 6) AS close, round(volume / f, 6) AS volume FROM (SELECT *, coalesce(adj_close / nullif(close, 0), 1) AS f FROM adj)", more=_ADJ)
def c01_adjusted_bars(m: Market) -> DataFrame:
    adj = F.when(F.col("symbol") % 9 != 0, F.when(F.col("date") < "1998-01-01", F.col("close") / 2).otherwise(F.col("close")))
    return actions.apply_factor(m.bars().withColumn("adj_close", adj))


@query(f"SELECT symbol, date, round(r, 6) AS gap FROM (SELECT symbol, date, open / nullif(lag(close) {OVER}, 0) AS r, date - lag(date) {OVER} AS days FROM bars) WHERE days <= 5 AND (r < 0.78 OR r > 1.28)")
def i23_gap_detector(m: Market) -> DataFrame:
    return m.bars().withColumn("gap", actions.gap_ratio()).where("gap is not null").select("symbol", "date", "gap")


@query()
def i24_i25_adjusted_history(m: Market) -> DataFrame:
    return actions.adjust(m.bars(), actions.plausible_ratios(m.spark)).select("symbol", "date", "action", "adj_close")


@query("SELECT symbol, name FROM stocks LEFT JOIN latest USING (symbol) WHERE coalesce(mcap > 0, true) AND date >= (SELECT max(date) FROM bars) - 5", views="bars stocks", more=_LATEST)
def c05_active_and_fresh(m: Market) -> DataFrame:
    last = m.bars().agg(F.max("date").alias("newest"))  # one row
    x = m.stocks().join(latest(m).select("symbol", "date"), "symbol").crossJoin(F.broadcast(last))
    return x.where(F.coalesce(F.col("mcap") > 0, F.lit(True)) & (F.col("date") >= F.date_sub("newest", 5))).select("symbol", "name")


@query("SELECT symbol, date, CAST((SELECT max(date) FROM bars) - date AS INTEGER) AS age FROM latest", more=_LATEST)
def e22_freshness(m: Market) -> DataFrame:
    newest = m.bars().agg(F.max("date").alias("newest"))  # one row
    return latest(m).crossJoin(F.broadcast(newest)).select("symbol", "date", F.datediff("newest", "date").alias("age"))


@query("SELECT round((max(date) - min(date)) / 365.25, 6) AS years, count(DISTINCT date) AS sessions FROM bars")
def e25_span(m: Market) -> DataFrame:
    return m.bars().agg((F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"), F.countDistinct("date").alias("sessions"))


@query(
    "SELECT month, round(used, 6) AS used, round(used / days * month_days, 6) AS projected FROM (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, sum(value) AS used, max(day(ts)) AS days, day(last_day(CAST(date_trunc('month', ts) AS DATE))) AS month_days FROM events GROUP BY 1, 4)",
    views="",
)
def e21_k06_month_projection(m: Market) -> DataFrame:
    month = F.trunc("ts", "month")
    e = m.table("events").withColumn("month", month).groupBy("month").agg(F.sum("value").alias("used"), F.max(F.dayofmonth("ts")).alias("days"))
    return e.select("month", "used", (F.col("used") / F.col("days") * F.dayofmonth(F.last_day("month"))).alias("projected"))


@query("SELECT symbol, date, round(s50, 6) AS sma50, round(s200, 6) AS sma200 FROM (SELECT *, " + _roll("avg", "close", 50) + " AS s50, " + _roll("avg", "close", 200) + " AS s200 FROM bars) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 520")
def f25_chart_averages(m: Market) -> DataFrame:
    df = m.bars().withColumns({"sma50": ind.sma("close", 50), "sma200": ind.sma("close", 200)})
    return asof.tail(df, "symbol", "date", 520).select("symbol", "date", "sma50", "sma200")


@query(f"SELECT symbol, date, round(max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), 6) AS high_52w FROM bars")
def f35_high_52w(m: Market) -> DataFrame:
    return m.bars().select("symbol", "date", F.max("high").over(W().rowsBetween(-251, 0)).alias("high_52w"))


def _snapshots(bars: DataFrame, m: Market) -> DataFrame:
    ws = bars.select(F.date_trunc("week", "date").cast("date").alias("week_start")).distinct()
    at = m.spark.sql("SELECT explode(array(DATE'1990-01-01', DATE'1996-03-29', DATE'1998-01-15')) AS as_of")
    return asof.snapshot_at(ws, at)


@query(
    "SELECT as_of, CAST(coalesce(max(w.week_start), (SELECT min(week_start) FROM ws)) AS DATE) AS week_start FROM (SELECT unnest([DATE '1990-01-01', DATE '1996-03-29', DATE '1998-01-15']) AS as_of) a LEFT JOIN ws w ON w.week_start <= a.as_of GROUP BY as_of",
    more="ws AS (SELECT DISTINCT CAST(date_trunc('week', date) AS DATE) AS week_start FROM bars)",
)
def d07_membership_snapshot_all(m: Market) -> DataFrame:
    """The snapshot weeks of every symbol."""
    return _snapshots(m.bars(), m)


@query("SELECT as_of, symbol, period_end, round(pat, 6) AS pat FROM a, quarters WHERE period_end + 31 <= as_of QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY period_end DESC) = 1", views="quarters", more="a AS (SELECT unnest([DATE '1996-03-29', DATE '1998-01-15']) AS as_of)")
def d10_disclosure_lag(m: Market) -> DataFrame:
    at = m.spark.sql("SELECT explode(array(DATE'1996-03-29', DATE'1998-01-15')) AS as_of")
    return asof.latest(asof.known_by(m.quarters(), at, "period_end", 31), ["as_of", "symbol"], "period_end").select("as_of", "symbol", "period_end", "pat")


@query(
    "SELECT a.symbol, a.period_end, round(a.revenue, 6) AS revenue, round(b.pat, 6) AS pat, round(c.revenue / nullif(a.revenue, 0), 6) AS next_ratio FROM quarters a LEFT JOIN (SELECT * FROM quarters WHERE pat > 0) b USING (symbol, period_end) LEFT JOIN (SELECT symbol, last_day(period_end - INTERVAL 3 MONTH) AS period_end, revenue FROM quarters) c USING (symbol, period_end)",
    views="quarters",
)
def d03_c03_statement_join(m: Market) -> DataFrame:
    q = m.quarters()
    nxt = q.select("symbol", F.last_day(F.add_months("period_end", -3)).alias("period_end"), F.col("revenue").alias("nr"))
    x = q.select("symbol", "period_end", "revenue").join(q.where("pat > 0").select("symbol", "period_end", "pat"), ["symbol", "period_end"], "left").join(nxt, ["symbol", "period_end"], "left")
    return x.select("symbol", "period_end", "revenue", "pat", (F.col("nr") / F.nullif("revenue", F.lit(0.0))).alias("next_ratio"))


_POS = "pos AS (SELECT symbol, symbol % 7 + 1 AS qty, first(close ORDER BY date) AS entry, first(close ORDER BY date) * 0.9 AS stop, last(close ORDER BY date) AS close FROM bars GROUP BY symbol)"


def positions(m: Market) -> DataFrame:
    p = m.bars().groupBy("symbol").agg(F.min_by("close", "date").alias("entry"), F.max_by("close", "date").alias("close"))
    return p.select("symbol", (F.col("symbol") % 7 + 1).alias("qty"), "entry", (F.col("entry") * 0.9).alias("stop"), "close")


@query("SELECT symbol, round((close - entry) * qty, 6) AS pnl, round(close / entry - 1, 6) AS ret, round((close - entry) / nullif(entry - stop, 0), 6) AS r_multiple, round(greatest(close - stop, 0) * qty, 6) AS at_risk, close <= stop AS broken FROM pos", more=_POS)
def i32_mark_to_market(m: Market) -> DataFrame:
    c = F.col
    return positions(m).select(
        "symbol", ((c("close") - c("entry")) * c("qty")).alias("pnl"), (c("close") / c("entry") - 1).alias("ret"), ((c("close") - c("entry")) / F.nullif(c("entry") - c("stop"), F.lit(0.0))).alias("r_multiple"),
        (F.greatest(c("close") - c("stop"), F.lit(0.0)) * c("qty")).alias("at_risk"), (c("close") <= c("stop")).alias("broken"),
    )


@query("SELECT symbol, 'stop_breached' AS rule, 0 AS severity FROM pos WHERE close <= stop UNION ALL SELECT symbol, 'target_reached', 1 FROM pos WHERE close >= entry * 1.25 UNION ALL SELECT symbol, 'doubled', 2 FROM pos WHERE close >= entry * 2 ORDER BY severity, symbol", more=_POS)
def l12_g05_all_alerts(m: Market) -> DataFrame:
    c = F.col
    rule = lambda ok, name, s: F.when(ok, F.struct(F.lit(name).alias("rule"), F.lit(s).alias("severity")))
    rules = F.array_compact(F.array(rule(c("close") <= c("stop"), "stop_breached", 0), rule(c("close") >= c("entry") * 1.25, "target_reached", 1), rule(c("close") >= c("entry") * 2, "doubled", 2)))
    return positions(m).select("symbol", F.explode(rules).alias("r")).select("symbol", "r.rule", "r.severity").orderBy("severity", "symbol")


@query("SELECT symbol, round(CASE WHEN close * 0.95 > stop THEN close * 0.95 ELSE stop END, 6) AS stop, close * 0.95 > stop AS moved FROM pos", more=_POS)
def i31_stop_moves_up(m: Market) -> DataFrame:
    c = F.col
    return positions(m).select("symbol", F.greatest(c("close") * 0.95, c("stop")).alias("stop"), (c("close") * 0.95 > c("stop")).alias("moved"))


_PLANS = """rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars),
plans AS (SELECT symbol, date AS plan_date, close * CASE WHEN symbol % 17 = 0 THEN 1.1 ELSE 0.9 END AS stop, close * 1.25 AS target FROM rk WHERE k = 3 AND symbol % 10 <> 4),
held AS (SELECT symbol, CASE WHEN symbol % 9 <> 0 THEN 1.0 END AS stop FROM stocks WHERE symbol % 2 = 1 UNION ALL SELECT -1, 1.0)"""


@query(
    """SELECT n, planned >= 0.8 * n AS enough_plans, ordered, planned - ordered AS disordered, stale_plans, unknown_holdings, unstopped_holdings, stale_prices, bad_prices FROM
    (SELECT count(*) AS n FROM stocks), (SELECT count(*) AS planned, count(*) FILTER (p.stop < b.close AND b.close < p.target) AS ordered, count(*) FILTER ((SELECT max(date) FROM bars) - plan_date > 30) AS stale_plans FROM plans p JOIN bars b ON b.symbol = p.symbol AND b.date = p.plan_date),
    (SELECT count(*) FILTER (symbol NOT IN (SELECT symbol FROM stocks)) AS unknown_holdings, count(*) FILTER (stop IS NULL) AS unstopped_holdings FROM held), (SELECT count(*) FILTER (date < (SELECT max(date) FROM bars) - 5) AS stale_prices, count(*) FILTER (close <= 0) AS bad_prices FROM rk WHERE k = 1)""",
    views="bars stocks",
    more=_PLANS,
)
def d17_k03_k04_k05_plan_checks(m: Market) -> DataFrame:
    """One row of counts: plans against the price of their own date, holdings against the universe, prices against the calendar."""
    c, bars = F.col, m.bars()
    newest = bars.agg(F.max("date").alias("newest"))  # one row
    third = asof.tail(bars, "symbol", "date", 3).groupBy("symbol").agg(F.min("date").alias("plan_date"), F.count("*").alias("n"), F.min_by("close", "date").alias("p"))
    factor = F.when(c("symbol") % 17 == 0, 1.1).otherwise(0.9)
    plans = third.where((c("n") == 3) & (c("symbol") % 10 != 4)).select("symbol", "plan_date", (c("p") * factor).alias("stop"), (c("p") * 1.25).alias("target"))
    on_date = plans.join(bars.select("symbol", c("date").alias("plan_date"), "close"), ["symbol", "plan_date"]).crossJoin(F.broadcast(newest))
    on_date = on_date.agg(
        F.count("*").alias("planned"),
        F.count_if((c("stop") < c("close")) & (c("close") < c("target"))).alias("ordered"),
        F.count_if(F.datediff("newest", "plan_date") > 30).alias("stale_plans"),
    )
    held = m.stocks().where("symbol % 2 = 1").select("symbol", F.when(c("symbol") % 9 != 0, F.lit(1.0)).alias("stop"))
    held = held.unionByName(m.spark.createDataFrame([(-1, 1.0)], "symbol long, stop double"))
    known = held.join(m.stocks().select("symbol", F.lit(True).alias("known")), "symbol", "left")
    known = known.agg(F.count_if(c("known").isNull()).alias("unknown_holdings"), F.count_if(c("stop").isNull()).alias("unstopped_holdings"))
    prices = latest(m).crossJoin(F.broadcast(newest)).agg(F.count_if(c("date") < F.date_sub("newest", 5)).alias("stale_prices"), F.count_if(c("close") <= 0).alias("bad_prices"))
    x = m.stocks().agg(F.count("*").alias("n")).crossJoin(on_date).crossJoin(known).crossJoin(prices)  # single rows
    return x.select("n", (c("planned") >= 0.8 * c("n")).alias("enough_plans"), "ordered", (c("planned") - c("ordered")).alias("disordered"), "stale_plans", "unknown_holdings", "unstopped_holdings", "stale_prices", "bad_prices")


@query("SELECT s.symbol FROM stocks s JOIN latest l USING (symbol) WHERE s.mcap <= 0", views="bars stocks", more=_LATEST)
def k02_inactive_but_scored(m: Market) -> DataFrame:
    return m.stocks().where("mcap <= 0").join(latest(m), "symbol", "left_semi").select("symbol")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)", views="")
def k07_keep_max_key(m: Market) -> DataFrame:
    return m.table("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.max("o_orderkey").alias("o_orderkey")).drop("d")


@query("SELECT symbol, CAST(len(b) AS INTEGER) AS n, b[1].d AS first_date, round(b[-1].c, 6) AS last_close FROM (SELECT symbol, list({'d': date, 'c': close} ORDER BY date) AS b FROM bars GROUP BY symbol)")
def b10_detail_document(m: Market) -> DataFrame:
    b = F.array_sort(F.collect_list(F.struct(F.col("date").alias("d"), F.col("close").alias("c"))))
    docs = m.bars().groupBy("symbol").agg(b.alias("b"))
    return docs.select("symbol", F.size("b").alias("n"), F.expr("b[0].d").alias("first_date"), F.element_at("b", -1)["c"].alias("last_close"))


@query("SELECT symbol, date, round(CASE WHEN v = 'Infinity'::DOUBLE OR isnan(v) THEN NULL ELSE v END, 6) AS v FROM (SELECT symbol, date, CASE WHEN symbol % 2 = 0 THEN 'NaN'::DOUBLE WHEN symbol % 3 = 0 THEN 'Infinity'::DOUBLE ELSE close END AS v FROM latest)", more=_LATEST)
def b11_strict_numbers(m: Market) -> DataFrame:
    from ..functions.num import clean

    v = F.when(F.col("symbol") % 2 == 0, float("nan")).when(F.col("symbol") % 3 == 0, float("inf")).otherwise(F.col("close"))
    return latest(m).select("symbol", "date", clean(v).alias("v"))


@query("SELECT symbol, date, round(r6, 6) AS r6 FROM (SELECT symbol, date, close / nullif(lag(close, 250) OVER (PARTITION BY symbol ORDER BY date), 0) AS r6 FROM bars) WHERE r6 IS NOT NULL")
def b14_drop_missing_rows(m: Market) -> DataFrame:
    df = ind.returns(m.bars(), "close", {"r": 250}).select("symbol", "date", (F.col("r") + 1).alias("r6"))
    return df.dropna(how="all", subset=["r6"])
