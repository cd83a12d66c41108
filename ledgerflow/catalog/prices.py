"""Queries on bars: indicators, candles, resampling, as-of reads (sections A, C, D, E, F, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import safe_div
from ..operators import asof, candles, indicators as ind, resample
from ..operators.indicators import W
from ..plans.views import Market
from .registry import query, r6

OVER = "OVER (PARTITION BY symbol ORDER BY date)"


def _roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} >= {least or n} THEN {agg}({x}) {f} END"


@query(f"SELECT symbol, date, {r6('open', 'high', 'low', 'close', 'volume')} FROM bars")
def a10_bars(m: Market) -> DataFrame:
    return m.bars()


@query("SELECT symbol, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY symbol")
def a11_bar_stats(m: Market) -> DataFrame:
    return m.bars().groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM bars")
def a06_a12_counts(m: Market) -> DataFrame:
    return m.bars().agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"))


@query(f"SELECT symbol, date, {r6('close', 'volume')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
def a07_latest_bar(m: Market) -> DataFrame:
    return asof.latest(m.bars(), "symbol", "date").select("symbol", "date", "close", "volume")


@query(f"SELECT symbol, date, {r6('close')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 5")
def a09_tail(m: Market) -> DataFrame:
    return asof.tail(m.bars(), "symbol", "date", 5).select("symbol", "date", "close")


@query("SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 7")
def a04_recent_dates(m: Market) -> DataFrame:
    return m.bars().select("date").distinct().orderBy(F.desc("date")).limit(7)


@query(f"SELECT symbol, date, {r6('close')} FROM bars WHERE date = (SELECT max(date) FROM bars)")
def a05_select_latest(m: Market) -> DataFrame:
    bars = m.bars()
    last = bars.agg(F.max("date").alias("date"))  # one row
    return bars.join(F.broadcast(last), "date", "left_semi").select("symbol", "date", "close")


@query(f"SELECT symbol, date, {r6('close')} FROM bars WHERE symbol > 3 OR (symbol = 3 AND date > DATE '1997-01-01') ORDER BY symbol, date LIMIT 500")
def a02_keyset_page(m: Market) -> DataFrame:
    return asof.seek(m.bars(), {"symbol": 3, "date": "1997-01-01"}, 500).select("symbol", "date", "close")


@query(
    f"SELECT symbol, date, {r6('sma20', 'sma50', 'sma200', 'wma50')} FROM (SELECT symbol, date, {_roll('avg', 'close', 20)} AS sma20, {_roll('avg', 'close', 50)} AS sma50, {_roll('avg', 'close', 200)} AS sma200, {_roll('avg', 'close', 250)} AS wma50 FROM bars)"
)
def f01_sma(m: Market) -> DataFrame:
    spans = {"sma20": 20, "sma50": 50, "sma200": 200, "wma50": 250}
    return ind.rolled(m.bars(), {a: ("mean", "close", n, n) for a, n in spans.items()}).select("symbol", "date", *spans)


def _ema_sql(x: str, span: int, src: str, out: str) -> str:
    a = f"(2.0::DOUBLE / {span + 1})"
    return (
        f"SELECT * EXCLUDE (i), {a} * pow(1 - {a}, i) * sum(CASE WHEN i = 0 THEN {x} / {a} ELSE {x} / pow(1 - {a}, i) END) {OVER} AS {out} "
        f"FROM (SELECT *, row_number() {OVER} - 1 AS i FROM {src})"
    )


@query(f"SELECT symbol, date, {r6('ema12')} FROM ({_ema_sql('close', 12, 'bars', 'ema12')})")
def f02_ema(m: Market) -> DataFrame:
    return ind.ema(m.bars(), "close", 12, "ema12").select("symbol", "date", "ema12")


@query(
    f"SELECT symbol, date, round(line - sig, 6) AS macd_hist FROM ({_ema_sql('line', 9, 'l', 'sig')})",
    more=f"e1 AS ({_ema_sql('close', 12, 'bars', 'f')}), e2 AS ({_ema_sql('close', 26, 'e1', 's')}), l AS (SELECT *, f - s AS line FROM e2)",
)
def f08_macd_histogram(m: Market) -> DataFrame:
    return ind.macd_histogram(m.bars()).select("symbol", "date", "macd_hist")


def _wilder_sql(x: str, n: int, src: str, out: str) -> str:
    a = f"(1.0::DOUBLE / {n})"
    return (
        f"SELECT * EXCLUDE (k), CASE WHEN k >= {n} THEN (sum(CASE WHEN k <= {n} THEN {x} END) {OVER} / {n} + {a} * coalesce(sum(CASE WHEN k > {n} THEN {x} / pow(1 - {a}, k - {n}) END) {OVER}, 0)) * pow(1 - {a}, k - {n}) END AS {out} "
        f"FROM (SELECT *, count({x}) {OVER} AS k FROM {src})"
    )


_TR = f"d AS (SELECT *, close - lag(close) {OVER} AS delta, lag(close) {OVER} AS pc, high - lag(high) {OVER} AS up, lag(low) {OVER} - low AS dn FROM bars), t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, greatest(delta, 0) * (CASE WHEN delta IS NULL THEN NULL ELSE 1 END) AS gain, greatest(-delta, 0) * (CASE WHEN delta IS NULL THEN NULL ELSE 1 END) AS loss, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM d)"
NTR = _TR.replace("FROM bars", "FROM nbars")


@query(
    "SELECT symbol, date, round(CASE WHEN ag IS NULL THEN NULL WHEN ag = 0 AND al = 0 THEN 50 WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END, 6) AS rsi14 FROM w2",
    more=f"{_TR}, w1 AS ({_wilder_sql('gain', 14, 't', 'ag')}), w2 AS ({_wilder_sql('loss', 14, 'w1', 'al')})",
)
def f04_rsi(m: Market) -> DataFrame:
    return ind.rsi(m.bars()).select("symbol", "date", "rsi14")


@query(f"SELECT symbol, date, {r6('tr', 'atr14')} FROM ({_wilder_sql('tr', 14, 't', 'atr14')})", more=_TR)
def f03_f05_f06_atr(m: Market) -> DataFrame:
    return ind.atr(ind.blocked(m.bars()).withColumn("tr", ind.true_range(ind.B()))).select("symbol", "date", "tr", "atr14")


@query(
    f"SELECT symbol, date, {r6('adx14')} FROM ({_wilder_sql('dx', 14, 'x', 'adx14')})",
    more=f"{_TR}, w1 AS ({_wilder_sql('pdm', 14, 't', 'sp')}), w2 AS ({_wilder_sql('mdm', 14, 'w1', 'sm')}), w3 AS ({_wilder_sql('tr', 14, 'w2', 'st')}), "
    "di AS (SELECT *, 100 * sp / nullif(st, 0) AS p, 100 * sm / nullif(st, 0) AS q FROM w3), x AS (SELECT *, 100 * abs(p - q) / nullif(p + q, 0) AS dx FROM di)",
)
def f07_adx(m: Market) -> DataFrame:
    return ind.adx(m.bars()).select("symbol", "date", "adx14")


@query(
    "SELECT symbol, date, " + ", ".join(f"round(close / nullif(lag(close, {n}) {OVER}, 0) - 1, 6) AS {a}" for a, n in (("ret_1m", 21), ("ret_3m", 63), ("ret_6m", 126), ("ret_12m", 252)))
    + f", round(lag(close, 21) {OVER} / nullif(lag(close, 252) {OVER}, 0) - 1, 6) AS mom_12_1 FROM bars"
)
def f09_f10_returns(m: Market) -> DataFrame:
    spans = {"ret_1m": 21, "ret_3m": 63, "ret_6m": 126, "ret_12m": 252}
    return ind.returns(m.bars(), "close", spans).select("symbol", "date", *spans, ind.momentum_12_1("close").alias("mom_12_1"))


@query(f"SELECT symbol, date, round((top - close) / nullif(top, 0), 6) AS dist_52w_high FROM (SELECT *, {_roll('max', 'high', 252, 126)} AS top FROM bars)")
def f11_dist_high(m: Market) -> DataFrame:
    return ind.rolled(m.bars(), {"top": ("high", "high", 252, 126)}).select("symbol", "date", ind.distance_from_high("top").alias("dist_52w_high"))


@query(
    f"SELECT symbol, date, round({_roll('max', 'dd', 126, 63)}, 6) AS max_dd_6m FROM (SELECT *, (peak - close) / nullif(peak, 0) AS dd FROM (SELECT *, {_roll('max', 'close', 126, 63)} AS peak FROM bars))"
)
def f12_max_drawdown(m: Market) -> DataFrame:
    return ind.max_drawdown(m.bars()).select("symbol", "date", "max_dd_6m")


@query(f"SELECT symbol, date, round({_roll('avg', 'volume', 20)} / nullif({_roll('avg', 'volume', 100)}, 0), 6) AS vol_ratio_20_100 FROM bars")
def f13_volume_ratio(m: Market) -> DataFrame:
    df = ind.rolled(m.bars(), {"v20": ("mean", "volume", 20, 20), "v100": ("mean", "volume", 100, 100)})
    return df.select("symbol", "date", safe_div("v20", "v100").alias("vol_ratio_20_100"))


@query(f"SELECT symbol, date, round((sma200 - past) / nullif(abs(past), 0), 6) AS sma200_slope FROM (SELECT *, lag(sma200, 21) {OVER} AS past FROM (SELECT *, {_roll('avg', 'close', 200)} AS sma200 FROM bars))")
def f14_slope(m: Market) -> DataFrame:
    return ind.rolled(m.bars(), {"sma200": ("mean", "close", 200, 200)}).select("symbol", "date", ind.slope("sma200").alias("sma200_slope"))


@query(
    f"SELECT symbol, date, round((close / nullif(lag(close, 126) {OVER}, 0)) / nullif(filled / nullif(lag(filled, 126) {OVER}, 0), 0) - 1, 6) AS rs_vs_index FROM (SELECT b.*, last_value(i.close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY b.date) AS filled FROM bars b LEFT JOIN idx i USING (date))",
    views="bars idx",
)
def f15_d11_relative_strength(m: Market) -> DataFrame:
    return ind.relative_strength(m.bars(), m.index_prices()).select("symbol", "date", "rs_vs_index")


@query(
    "SELECT symbol, date, round(CASE WHEN count(v) OVER w >= 20 THEN quantile_cont(v, 0.5) OVER w END, 6) AS turnover_60d_cr FROM (SELECT *, close * volume / 1e7 AS v FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
)
def f16_i39_median_turnover(m: Market) -> DataFrame:
    return ind.median_turnover(m.bars()).select("symbol", "date", "turnover_60d_cr")


@query(
    """SELECT symbol, week, round(arg_min(open, date), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, date), 6) AS close, sum(volume) AS volume, max(date) AS date
    FROM (SELECT *, CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS DATE) AS week FROM bars) GROUP BY 1, 2"""
)
def e01_l09_weekly_bars(m: Market) -> DataFrame:
    return resample.weekly(m.bars())


@query(
    """SELECT month, max(date) AS date FROM (SELECT date, CAST(date_trunc('month', date) AS DATE) AS month, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))
    WHERE rn > 252 AND rn <= n - 126 GROUP BY month"""
)
def e02_month_ends(m: Market) -> DataFrame:
    return resample.month_ends(m.bars().select("date").distinct(), 252, 126)


@query("SELECT symbol, n FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) ORDER BY n DESC, symbol LIMIT 1")
def e03_calendar_symbol(m: Market) -> DataFrame:
    return m.bars().groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(1)


_AT = "a AS (SELECT unnest([DATE '1996-03-29', DATE '1997-06-30', DATE '1998-01-15']) AS as_of)"


@query(f"SELECT as_of, symbol, date, round(close, 6) AS close FROM a, bars WHERE date <= as_of QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY date DESC) = 1 AND count(*) OVER (PARTITION BY as_of, symbol) >= 252", more=_AT)
def d06_asof_bar(m: Market) -> DataFrame:
    at = m.spark.sql("SELECT explode(array(DATE'1996-03-29', DATE'1997-06-30', DATE'1998-01-15')) AS as_of")
    return asof.asof_latest(m.bars(), at, "symbol", "date", 252).select("as_of", "symbol", "date", "close")


@query(f"SELECT as_of, symbol, period_end, {r6('revenue', 'pat')} FROM a, quarters WHERE filed_on <= as_of QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY period_end DESC) = 1", views="quarters", more=_AT)
def d09_filed_by(m: Market) -> DataFrame:
    at = m.spark.sql("SELECT explode(array(DATE'1996-03-29', DATE'1997-06-30', DATE'1998-01-15')) AS as_of")
    seen = asof.known_by(m.quarters(), at, "filed_on")
    return asof.latest(seen, ["as_of", "symbol"], "period_end").select("as_of", "symbol", "period_end", "revenue", "pat")


@query(f"SELECT symbol, date, round(lead(close, 126) {OVER} / nullif(lead(open, 1) {OVER}, 0) - 1, 6) AS forward_return FROM bars")
def d12_forward_return(m: Market) -> DataFrame:
    return m.bars().select("symbol", "date", asof.forward_return(126).alias("forward_return"))


@query(
    f"SELECT symbol, date, round(close, 6) AS close, round(prev, 6) AS previous FROM (SELECT *, lag(close) {OVER} AS prev, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn = 1"
)
def d16_latest_vs_previous(m: Market) -> DataFrame:
    return asof.latest(m.bars().withColumn("previous", F.lag("close").over(W())), "symbol", "date").select("symbol", "date", "close", "previous")


_CANDLE = f"c AS (SELECT *, abs(close - open) AS body, high - low AS span, high - greatest(open, close) AS upper, least(open, close) - low AS lower, lag(open) {OVER} AS po, lag(close) {OVER} AS pc, high > low AS ok, coalesce(lag(high) {OVER} > lag(low) {OVER}, false) AS pok FROM nbars)"


@query(
    """SELECT symbol, date, CASE WHEN ok THEN lower >= 2.0 * greatest(body, span * 0.05) AND upper <= 0.25 * span END AS hammer_shape,
      CASE WHEN ok THEN upper >= 2.0 * greatest(body, span * 0.05) AND lower <= 0.25 * span END AS inverted_hammer_shape,
      CASE WHEN ok THEN body <= 0.10 * span END AS doji, CASE WHEN ok THEN body >= 0.90 * span END AS marubozu,
      CASE WHEN ok THEN close > open END AS bullish_body, CASE WHEN ok THEN close < open END AS bearish_body FROM c""",
    views="nbars",
    more=_CANDLE,
)
def i19_candle_shapes(m: Market) -> DataFrame:
    return m.nation_bars().select("symbol", "date", *candles.shapes())


@query(
    """SELECT symbol, date, coalesce(ok AND pok AND pc < po AND close > open AND close >= po AND open <= pc, false) AS bullish_engulfing,
      coalesce(ok AND pok AND pc > po AND close < open AND close <= po AND open >= pc, false) AS bearish_engulfing,
      coalesce(ok AND pok AND pc < po AND close > open AND open < pc AND close > (po + pc) / 2 AND close < po, false) AS piercing_line,
      coalesce(ok AND pok AND pc > po AND close < open AND open > pc AND close < (po + pc) / 2 AND close > po, false) AS dark_cloud FROM c""",
    views="nbars",
    more=_CANDLE,
)
def i20_two_bar_patterns(m: Market) -> DataFrame:
    names = ("bullish_engulfing", "bearish_engulfing", "piercing_line", "dark_cloud")
    return candles.two_bar(m.nation_bars()).select("symbol", "date", *names)


@query(
    """SELECT symbol, date, low = lo AND n = 11 AND below = 0 AS is_low, high = hi AND n = 11 AND above = 0 AS is_high, confirmed
    FROM (SELECT *, lead(date, 5) OVER (PARTITION BY symbol ORDER BY date) AS confirmed, min(low) OVER w AS lo, max(high) OVER w AS hi, count(*) OVER w AS n, len(list_filter(list(low) OVER w, lambda v: v <= low)) - 1 AS below, len(list_filter(list(high) OVER w, lambda v: v >= high)) - 1 AS above
      FROM nbars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
    WHERE n = 11 AND ((low = lo AND below = 0) OR (high = hi AND above = 0))""",
    views="nbars",
)
def f26_fractals(m: Market) -> DataFrame:
    return candles.fractals(m.nation_bars(), 5)


@query(
    f"""SELECT symbol, date, p3 IS NOT NULL AND (coalesce(close < p1 AND p1 < p2 AND p2 < p3, false) OR coalesce(atr14 > 0 AND p1 - close > 2.5 * atr14, false)) AS falling_knife,
      coalesce((high <= ph AND low >= pl) OR close > p1, false) AS stabilised
    FROM (SELECT *, lag(close, 1) {OVER} p1, lag(close, 2) {OVER} p2, lag(close, 3) {OVER} p3, lag(high) {OVER} ph, lag(low) {OVER} pl FROM ({_wilder_sql('tr', 14, 't', 'atr14')}))""",
    more=_TR,
)
def f29_f30_falling_and_stabilised(m: Market) -> DataFrame:
    df, w = ind.atr(ind.blocked(m.bars())), ind.B()
    return df.select("symbol", "date", candles.falling_knife(df, w=w).alias("falling_knife"), candles.stabilised(w).alias("stabilised"))


@query(
    f"""SELECT symbol, date, coalesce(close > m AND pc <= pm, false) AS reclaimed, coalesce(n >= 30 AND dry < 0.85 * base AND volume > 1.2 * base, false) AS volume_surge FROM (
      SELECT *, lag(close) {OVER} AS pc, lag(m) {OVER} AS pm FROM (SELECT *, {_roll('avg', 'close', 20)} AS m,
        avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND 5 PRECEDING) AS base,
        avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS dry,
        count(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n FROM bars))"""
)
def f32_f33_reclaim_and_volume(m: Market) -> DataFrame:
    df = m.bars().withColumn("sma20", ind.sma("close", 20))
    return df.select("symbol", "date", candles.reclaimed().alias("reclaimed"), candles.volume_surge().alias("volume_surge"))


@query(
    """SELECT symbol, date, n >= 20 AND list_max(w[(n // 2) + 1:]) < list_max(w[:(n // 2)]) AS lower_highs FROM (
      SELECT symbol, date, list(high) OVER f AS w, count(*) OVER f AS n FROM nbars WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND CURRENT ROW))""",
    views="nbars",
)
def f28_lower_highs(m: Market) -> DataFrame:
    return candles.with_lower_highs(m.nation_bars()).select("symbol", "date", "lower_highs")


@query(
    "SELECT symbol, date, round(exp(sum(ln(f)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 6) AS later_factor FROM (SELECT symbol, date, CASE WHEN day(date) = 1 THEN 0.5 ELSE 1.0 END AS f FROM bars)"
)
def f23_later_factors(m: Market) -> DataFrame:
    f = F.when(F.dayofmonth("date") == 1, 0.5).otherwise(F.lit(1.0))
    later = F.product("f").over(W().rowsBetween(1, Window.unboundedFollowing))
    return m.bars().select("symbol", "date", f.alias("f")).select("symbol", "date", later.alias("later_factor"))


@query(
    f"SELECT date, count(r) AS n, round(avg(r), 6) AS mean_return FROM (SELECT symbol, date, CASE WHEN lag(close) {OVER} IS NOT NULL THEN least(greatest(close / lag(close) {OVER} - 1, -0.5), 0.5) END AS r FROM bars) GROUP BY date"
)
def e16_market_return(m: Market) -> DataFrame:
    from ..operators import market

    return market.daily_mean_return(m.bars())


@query(
    """SELECT date, round(ln(index_level), 6) AS log_index, round(index_level / max(index_level) OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1, 6) AS drawdown,
      round(index_level / avg(index_level) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) - 1, 6) AS vs_200dma, round(index_level / lag(index_level, 63) OVER (ORDER BY date) - 1, 6) AS return_3m
    FROM (SELECT date, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY date)) AS index_level FROM (SELECT date, avg(r) AS r FROM (SELECT symbol, date, CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY date) IS NOT NULL THEN least(greatest(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, -0.5), 0.5) END AS r FROM bars) GROUP BY date))"""
)
def e16_backdrop(m: Market) -> DataFrame:
    from ..operators import market

    return market.backdrop(m.bars()).withColumn("index_level", F.log("index_level")).withColumnRenamed("index_level", "log_index")


@query(
    """SELECT date, round(avg(above), 6) AS breadth, count(above) AS n, CASE WHEN avg(above) < 0.5 THEN 'weak' WHEN avg(above) IS NOT NULL THEN 'strong' END AS regime FROM (
      SELECT date, CASE WHEN count(close) OVER w >= 150 THEN CAST(close > avg(close) OVER w AS DOUBLE) END AS above
      FROM bars JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)) USING (date)
      WINDOW w AS (PARTITION BY symbol ORDER BY i RANGE BETWEEN 199 PRECEDING AND CURRENT ROW)) GROUP BY date"""
)
def f24_breadth(m: Market) -> DataFrame:
    from ..operators import market

    return market.breadth(m.bars())
