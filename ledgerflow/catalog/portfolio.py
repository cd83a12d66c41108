"""Queries on books marked to market, on reads by name, and on what carries a score (sections A, B, C, E, G, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import book as bk, candles, indicators as ind, levels as lv, market, pointintime as pt, portfolio as pf, reads, scoring
from ..operators.indicators import W
from ..plans.cut import cut
from ..plans.views import Market
from .asfiled import _RANKS, CONVICTION, wide_panel
from .asfiled import _PANEL as _WIDE
from .desk import _COMMANDS, _FOLD, _HELD, commands, folded
from .prices import _CANDLE, NTR, OVER, _roll, _wilder_sql
from .registry import query, r6

# --- books ----------------------------------------------------------------------
_CAPITAL = """, cc AS (SELECT book, amount, risk_pct, row_number() OVER (PARTITION BY book ORDER BY seq) AS n FROM cmd WHERE kind = 'capital'),
cap0 AS (SELECT DISTINCT book, 0::BIGINT AS n, NULL::DOUBLE AS capital, NULL::DOUBLE AS risk_pct FROM cc UNION ALL
  SELECT book, n, CASE WHEN ok THEN amount ELSE capital END, CASE WHEN ok THEN risk ELSE had END FROM (SELECT c.*, p.capital, p.risk_pct AS had, coalesce(c.risk_pct, p.risk_pct, 0.01) AS risk, coalesce(c.amount > 0 AND coalesce(c.risk_pct, p.risk_pct, 0.01) > 0 AND coalesce(c.risk_pct, p.risk_pct, 0.01) < 1, false) AS ok FROM cap0 p JOIN cc c ON c.book = p.book AND c.n = p.n + 1)),
cap AS (SELECT book, capital, risk_pct FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC) AS k FROM cap0) WHERE k = 1 AND capital IS NOT NULL)"""
_MARKS = """, lp AS (SELECT symbol, arg_max(close, date) / 8 AS close FROM nbars GROUP BY symbol),
mk AS (SELECT p.book, p.symbol, p.id, p.price, p.qty, p.stop, l.close, p.price * p.qty AS invested, l.close * p.qty AS value, (l.close - p.price) * p.qty AS pnl, l.close / p.price - 1 AS ret, (l.close - p.price) / CASE WHEN p.price > p.stop THEN p.price - p.stop END AS r_multiple, l.close / nullif(p.stop, 0) - 1 AS stop_distance, (l.close - p.stop) * p.qty AS risk_left, CASE WHEN l.close IS NOT NULL THEN p.symbol = 0 END AS intact FROM ps p LEFT JOIN lp l USING (symbol) WHERE exit_id IS NULL)"""
_BOOKS = f"{_COMMANDS}, {_FOLD}, {_HELD}{_CAPITAL}{_MARKS}"
_SUMS = "SELECT book, count(*) AS positions, sum(invested) AS invested, coalesce(sum(value), 0) AS value, coalesce(sum(risk_left), 0) AS risk_left, count(*) FILTER (NOT intact) AS broken FROM mk GROUP BY book"


def marks(m: Market) -> DataFrame:
    """Open positions at an eighth of their nation's last price; nation 1 fails a gate."""
    held = bk.positions(folded(m)).where("exit_id is null").select("book", "symbol", "id", "price", "qty", "stop")
    prices = m.nation_bars().groupBy("symbol").agg((F.max_by("close", "date") / 8).alias("close"))
    failed = prices.select("symbol", F.when(F.col("symbol") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("loss_making"))).alias("names"))
    return pf.marked(held, prices, failed)


def capitals(m: Market) -> DataFrame:
    return bk.capital(commands(m).where("kind = 'capital'"))


@query(f"SELECT book, symbol, id, {r6('invested', 'value', 'pnl', 'ret', 'r_multiple', 'stop_distance', 'risk_left')}, intact FROM mk", views="nbars", more=_BOOKS, recursive=True)
def i32_marked_positions(m: Market) -> DataFrame:
    return marks(m).select("book", "symbol", "id", "invested", "value", "pnl", "ret", "r_multiple", "stop_distance", "risk_left", "intact")


@query(f"SELECT book, positions, {r6('invested', 'value', 'risk_left')}, broken, round(value - invested, 6) AS pnl, round(value / nullif(invested, 0) - 1, 6) AS ret FROM ({_SUMS})", views="nbars", more=_BOOKS, recursive=True)
def e18_marked_book_totals(m: Market) -> DataFrame:
    """Each book's positions, money, return, risk and broken cases."""
    return pf.totals(marks(m), "book")


@query(
    f"SELECT book, {r6('capital')}, round(capital * risk_pct, 6) AS unit, round(value, 6) AS deployed, round(capital - value, 6) AS free, round(value / capital, 6) AS deployed_pct, round(greatest(risk_left, 0), 6) AS risked, round(greatest(risk_left, 0) / capital, 6) AS risked_pct, CAST(greatest(0, floor((capital * 0.06 - greatest(risk_left, 0)) / (capital * risk_pct))) AS BIGINT) AS units_free FROM ({_SUMS}) JOIN cap USING (book)",
    views="nbars",
    more=_BOOKS,
    recursive=True,
)
def e20_book_capacity(m: Market) -> DataFrame:
    """What each book has deployed and risked, and the units of risk it may still take."""
    return pf.capacity(pf.totals(marks(m), "book"), capitals(m), "book")


_LIST = f"""cd AS (SELECT symbol, row_number() OVER (ORDER BY close DESC, symbol) AS rank, CASE WHEN symbol % 8 <> 3 THEN close END AS conviction, close / 8 AS close, close / 8 * CASE WHEN symbol % 9 = 4 THEN 1.1 ELSE 0.9 END AS stop, symbol % 10 = 6 AS failed FROM (SELECT symbol, arg_max(close, date) AS close FROM nbars GROUP BY symbol)),
sl AS (SELECT c.book, d.*, c.capital, least(floor(capital * risk_pct / (d.close - d.stop)), floor(capital * 0.1 / d.close)) AS shares, floor(capital * 0.1 / d.close) < floor(capital * risk_pct / (d.close - d.stop)) AS capped FROM cap c, cd d WHERE rank <= 20 AND conviction IS NOT NULL AND NOT failed AND d.close > d.stop AND NOT EXISTS (SELECT 1 FROM mk WHERE mk.book = c.book AND mk.symbol = d.symbol))"""


@query("SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY rank, symbol) AS INTEGER) AS place, symbol, CAST(rank AS INTEGER) AS rank, CAST(shares AS BIGINT) AS shares, round(shares * close, 6) AS cost, round(shares * (close - stop), 6) AS risk, capped FROM sl WHERE shares >= 1 QUALIFY row_number() OVER (PARTITION BY book ORDER BY rank, symbol) <= 12", views="nbars", more=f"{_BOOKS}, {_LIST}", recursive=True)
def g04_sized_shortlist(m: Market) -> DataFrame:
    """For each book the buy-list names it can act on, in rank order, sized by its capital."""
    last = m.nation_bars().groupBy("symbol").agg(F.max_by("close", "date").alias("p"))
    s = F.col("symbol")
    rank = F.row_number().over(Window.orderBy(F.desc("p"), "symbol"))  # one row a symbol
    price = F.col("p") / 8
    few = last.select("symbol", rank.alias("rank"), F.when(s % 8 != 3, F.col("p")).alias("conviction"), price.alias("close"), (price * F.when(s % 9 == 4, 1.1).otherwise(0.9)).alias("stop"), (s % 10 == 6).alias("failed")).where("rank <= 20")
    return pf.shortlist(few, marks(m), capitals(m))


_SAY = "unnest(list_filter([CASE WHEN close IS NULL THEN 'no price to mark it at' END, CASE WHEN close <= stop THEN 'the close is at or under the stop' END, CASE WHEN close > stop AND stop_distance < 0.03 THEN 'the stop is ' || printf('%.1f%%', stop_distance * 100) || ' away' END, CASE WHEN value / capital > 0.1 THEN 'it is ' || printf('%.1f%%', value / capital * 100) || ' of the capital' END, CASE WHEN risk_left / capital > 0.02 THEN 'it still risks ' || printf('%.1f%%', risk_left / capital * 100) || ' of the capital' END, CASE WHEN NOT intact THEN 'it fails a gate' END], lambda x: x IS NOT NULL))"


@query(f"SELECT book, symbol, id, {_SAY} AS insight FROM mk JOIN cap USING (book)", views="nbars", more=_BOOKS, recursive=True)
def i32_position_insights(m: Market) -> DataFrame:
    return pf.insights(marks(m), capitals(m))


# --- reads and writes by name -----------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_shipdate >= TIMESTAMP '1998-01-01'", views="")
def a01_a27_select_since(m: Market) -> DataFrame:
    """Three columns of the rows that meet two equalities and a lower bound."""
    return reads.select(m.table("lineitem"), "lineitem", ("l_orderkey", "l_linenumber", "l_extendedprice"), {"l_returnflag": "R", "l_linestatus": "F"}, ("l_shipdate", "1998-01-01"))


@query("SELECT s_suppkey, n_name, round(s_acctbal, 6) AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey IN (1, 3, 5, 8, 13) AND s_acctbal >= 0 ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 20", views="")
def a28_newest_with_names(m: Market) -> DataFrame:
    """Filtered by membership and bound, joined to its names, the first 20 in falling order."""
    s = reads.select(m.table("supplier"), "supplier", within={"s_nationkey": [1, 3, 5, 8, 13]}, since=("s_acctbal", 0.0))
    named = s.join(m.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return reads.newest(named, "s_acctbal", 20, "s_suppkey").select("s_suppkey", "n_name", "s_acctbal")


@query("SELECT c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 150", views="")
def a03_page_in_order(m: Market) -> DataFrame:
    """The fourth page of fifty in the table's own order."""
    return reads.page(m.table("customer"), "customer", 50, 3).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' AND p_size = 7 THEN 0 ELSE round(p_retailprice, 6) END AS p_retailprice FROM part UNION ALL SELECT p_partkey + 1000000000, NULL FROM part WHERE p_size = 50", views="")
def b05_update_and_insert(m: Market) -> DataFrame:
    """Prices of one brand and size set to 0, and copies of the largest parts put in without a price."""
    part = m.table("part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    new = part.where("p_size = 50").select((F.col("p_partkey") + 1_000_000_000).alias("p_partkey"))
    return reads.insert(reads.update(part, {"p_retailprice": 0.0}, {"p_brand": "Brand#13", "p_size": 7}), new).select("p_partkey", "p_retailprice")


@query("SELECT symbol, sector IN ('ASIA') OR coalesce(kind = 'financial', false) AS lender, coalesce(instrument, 'equity') = 'equity' AS equity FROM (SELECT *, CASE WHEN symbol % 7 = 2 THEN 'financial' WHEN symbol % 7 = 3 THEN 'general' END AS kind, CASE WHEN symbol % 5 = 1 THEN 'etf' WHEN symbol % 5 = 2 THEN 'equity' END AS instrument FROM stocks) WHERE true", views="stocks")
def c04_c06_lenders_and_equities(m: Market) -> DataFrame:
    """Which companies count as lenders (by type or by sector) and which as equities (unknown does)."""
    s = F.col("symbol")
    x = m.stocks().withColumns({"company_type": F.when(s % 7 == 2, "financial").when(s % 7 == 3, "general"), "instrument_type": F.when(s % 5 == 1, "etf").when(s % 5 == 2, "equity")})
    return x.select("symbol", scoring.is_lender(("ASIA",)).alias("lender"), scoring.is_equity().alias("equity"))


@query("SELECT symbol, first_date, bars, CASE WHEN first_date > (SELECT min(date) FROM bars) THEN 'newer' ELSE 'whole' END AS depth FROM (SELECT symbol, min(date) AS first_date, count(*) AS bars FROM bars GROUP BY symbol)")
def g09_history_depth(m: Market) -> DataFrame:
    """How far back each history goes, and which begin after the oldest of all."""
    x = m.bars().groupBy("symbol").agg(F.min("date").alias("first_date"), F.count("*").alias("bars"))
    oldest = x.agg(F.min("first_date").alias("oldest"))  # one row
    return x.crossJoin(F.broadcast(oldest)).select("symbol", "first_date", "bars", F.when(F.col("first_date") > F.col("oldest"), "newer").otherwise("whole").alias("depth"))


@query("SELECT symbol FROM (SELECT symbol FROM bars EXCEPT SELECT symbol FROM bars WHERE date >= DATE '2001-10-28')")
def h02_gone_quiet(m: Market) -> DataFrame:
    """Symbols that have traded but not in the last days."""
    b = m.bars()
    return b.select("symbol").subtract(b.where(F.col("date") >= "2001-10-28").select("symbol"))


# --- what carries a score -----------------------------------------------------------
_CARRIED = ("doji", "bullish_engulfing", "bearish_engulfing")


@query(
    f"SELECT symbol, max(date) AS date, round(arg_max(close, date), 6) AS close, {', '.join(f'bool_or({c}) AS {c}' for c in _CARRIED)} FROM (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, coalesce(ok AND body <= 0.10 * span, false) AS doji, coalesce(ok AND pok AND pc < po AND close > open AND close >= po AND open <= pc, false) AS bullish_engulfing, coalesce(ok AND pok AND pc > po AND close < open AND close <= po AND open >= pc, false) AS bearish_engulfing FROM c) WHERE k <= 63 GROUP BY symbol",
    views="nbars",
    more=_CANDLE,
)
def e17_carried_events(m: Market) -> DataFrame:
    """One row a symbol: events that fired in its last 63 bars, all else from its newest bar."""
    df = candles.two_bar(m.nation_bars().select("*", *candles.shapes()))
    return scoring.carried(df.select("symbol", "date", "close", *_CARRIED), _CARRIED, 63)


_FADING = scoring.FADING_IN_WEAK
_POINTS = ", ".join(f"{{'f': '{f}', 'p': (r[{k + 1}] - 0.5) * 100 / n}}" for k, f in enumerate(CONVICTION))


@query(
    f"SELECT as_of, symbol, round(CASE WHEN list_sum([x.p FOR x IN up]) > 0 THEN coalesce(list_sum([x.p FOR x IN up IF x.f IN ({', '.join(repr(f) for f in _FADING)})]), 0) / list_sum([x.p FOR x IN up]) END, 6) AS fading FROM (SELECT as_of, symbol, list_filter([{_POINTS}], lambda x: x.p > 0) AS up FROM (SELECT *, len(list_filter(r, lambda v: v IS NOT NULL)) AS n FROM (SELECT as_of, symbol, [{', '.join(_RANKS)}] AS r FROM (SELECT as_of, symbol, {', '.join(f'{f} * {s} AS x_{f}' for f, s in CONVICTION.items())} FROM pan))))",
    views="nbars",
    more=_WIDE,
    recursive=True,
)
def i29_fading_share(m: Market) -> DataFrame:
    """How much of a name's lift comes from features that fade when the market is weak."""
    panel = wide_panel(m, cut(m.nation_bars(), "symbol")).select(*pt.KEYS, *CONVICTION)
    x = scoring.conviction(panel, "as_of", features=CONVICTION)
    return x.select("as_of", "symbol", scoring.fading_share().alias("fading"))


@query(
    f"SELECT symbol, date, coalesce(abs(close - a200) <= 0.75 * atr14, false) OR coalesce(abs(close - a250) <= 0.75 * atr14, false) AS near_long_ma, CASE WHEN n > 30 AND h > l THEN CASE WHEN abs(close - (h - 0.382 * (h - l))) <= 0.6 * atr14 THEN 0.382 WHEN abs(close - (h - 0.5 * (h - l))) <= 0.6 * atr14 THEN 0.5 WHEN abs(close - (h - 0.618 * (h - l))) <= 0.6 * atr14 THEN 0.618 END END::DOUBLE AS near_fib FROM (SELECT *, {_roll('avg', 'close', 200)} AS a200, {_roll('avg', 'close', 250)} AS a250, max(high) OVER w AS h, min(low) OVER w AS l, count(*) OVER w AS n FROM ({_wilder_sql('tr', 14, 't', 'atr14')}) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))",
    views="nbars",
    more=NTR,
)
def i36_agreement_at_every_bar(m: Market) -> DataFrame:
    """Whether the close agrees with a 200 or 250 bar average, and with which retracement of the year, by its own ATR."""
    year = W().rowsBetween(-251, 0)
    x = ind.atr(m.nation_bars()).withColumns({"a200": ind.sma("close", 200), "a250": ind.sma("close", 250), "h": F.max("high").over(year), "l": F.min("low").over(year), "n": F.count("*").over(year)})
    near = [F.coalesce(F.abs(F.col("close") - F.col(a)) <= lv.LONG_MA_ATR * F.col("atr14"), F.lit(False)) for a in ("a200", "a250")]
    _, fib = lv.agrees("close", "a200", "h", "l", "atr14")
    return x.select("symbol", "date", (near[0] | near[1]).alias("near_long_ma"), F.when((F.col("n") > 30) & (F.col("h") > F.col("l")), fib).alias("near_fib"))


@query(
    "SELECT symbol, CASE WHEN v IS NULL THEN '-' ELSE CASE WHEN v >= 0 THEN '+' ELSE '' END || printf('%.1f%%', v * 100) END AS change, CASE WHEN v IS NULL THEN '-' ELSE printf('%.1f%%', abs(v) * 100) END AS share, CASE WHEN m IS NULL THEN '-' WHEN abs(m) >= 100000 THEN printf('%.2fL Cr', m / 100000) WHEN abs(m) >= 1000 THEN printf('%.1fK Cr', m / 1000) ELSE printf('%.0f Cr', m) END AS money, strftime(date, '%b %y') AS day FROM (SELECT symbol, date, CASE WHEN symbol % 9 <> 4 THEN close / open - 1 END AS v, CASE WHEN symbol % 8 <> 5 THEN volume * close / 7.3 END AS m FROM nbars)",
    views="nbars",
)
def i33_display_texts(m: Market) -> DataFrame:
    """Changes signed, shares unsigned, money in crore, thousands and lakhs of them, months short; unknown is a dash."""
    from ..functions import text as tx

    s = F.col("symbol")
    x = m.nation_bars().withColumns({"v": F.when(s % 9 != 4, F.col("close") / F.col("open") - 1), "m": F.when(s % 8 != 5, F.col("volume") * F.col("close") / 7.3)})
    return x.select("symbol", tx.change("v").alias("change"), tx.share(F.abs("v")).alias("share"), tx.crore("m").alias("money"), tx.month("date").alias("day"))


@query(
    f"""SELECT b.date, {r6('drawdown', 'vs_200dma', 'return_3m', 'breadth')}, regime, CASE regime WHEN 'weak' THEN 16 WHEN 'strong' THEN 22 END AS hist_months, CASE regime WHEN 'weak' THEN 0.156 WHEN 'strong' THEN 0.214 END::DOUBLE AS hist_top, CASE regime WHEN 'weak' THEN 0.096 WHEN 'strong' THEN 0.12 END::DOUBLE AS hist_avg, CASE WHEN regime IS NOT NULL THEN 1.0 END::DOUBLE AS hist_ic_positive, CASE regime WHEN 'weak' THEN 3 END AS hist_episodes FROM
    (SELECT date, lvl / max(lvl) OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1 AS drawdown, lvl / avg(lvl) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) - 1 AS vs_200dma, lvl / lag(lvl, 63) OVER (ORDER BY date) - 1 AS return_3m
      FROM (SELECT date, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY date)) AS lvl FROM (SELECT date, avg(r) AS r FROM (SELECT symbol, date, CASE WHEN lag(close) {OVER} IS NOT NULL THEN least(greatest(close / lag(close) {OVER} - 1, -0.5), 0.5) END AS r FROM bars) GROUP BY date))) b
    JOIN (SELECT date, avg(above) AS breadth, CASE WHEN avg(above) < 0.5 THEN 'weak' WHEN avg(above) IS NOT NULL THEN 'strong' END AS regime FROM (
      SELECT date, CASE WHEN count(close) OVER w >= 150 THEN CAST(close > avg(close) OVER w AS DOUBLE) END AS above FROM bars JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)) USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY i RANGE BETWEEN 199 PRECEDING AND CURRENT ROW)) GROUP BY date) USING (date)"""
)
def i43_backdrop_rows(m: Market) -> DataFrame:
    """Each date's backdrop with its regime and what the study found for it."""
    return market.backdrop_rows(m.bars())
