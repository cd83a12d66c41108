"""Divergence between swings and what stands above a price, at every bar and at each month end (sections J, L).

The nations' weekly bars stand for sessions, their four-week bars for the longer timeframe.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, divergence as dv, indicators as ind, levels as lv, overhead as oh, resample, setups as st, zones as zn
from ..operators.indicators import W
from ..plans.cut import cut
from ..plans.views import NBARS, Market
from .levels import _PIVOTS
from .prices import _CANDLE, NTR, OVER, _wilder_sql
from .registry import query
from .setups import _MORE, _RATED

WARM_UP, HOLD = 104, 26  # weeks of history that a score needs, weeks that a position is held

_RS = f"w1 AS ({_wilder_sql('gain', 14, 't', 'ag')}), w2 AS ({_wilder_sql('loss', 14, 'w1', 'al')}), rs AS (SELECT symbol, row_number() {OVER} - 1 AS i, CASE WHEN ag IS NULL THEN NULL WHEN ag = 0 AND al = 0 THEN 50 WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi14 FROM w2)"


def _found_sql(timeframe: str) -> str:
    """The pair at every bar, by asking every bar for its two swings."""
    back, apart = dv.LOOKBACK[timeframe], dv.MIN_SEPARATION[timeframe]
    return f"""rec AS (SELECT rs.symbol, rs.i, p.kind, max(p.idx) AS idx FROM rs JOIN piv p ON p.symbol = rs.symbol AND p.confirmed <= rs.i AND p.idx >= rs.i - {back} GROUP BY 1, 2, 3),
pri AS (SELECT r.symbol, r.i, r.kind, r.idx, max(p.idx) AS prior_idx FROM rec r JOIN piv p ON p.symbol = r.symbol AND p.kind = r.kind AND p.confirmed <= r.i AND p.idx >= r.i - {back} AND p.idx <= r.idx - {apart} GROUP BY 1, 2, 3, 4),
fnd AS (SELECT k.symbol, k.i, CASE WHEN k.kind = 'low' THEN 'bullish' ELSE 'bearish' END AS kind, k.prior_idx, b.price AS prior_price, y.rsi14 AS prior_rsi, k.idx, a.price, x.rsi14 AS rsi, a.confirmed
  FROM pri k JOIN piv a ON a.symbol = k.symbol AND a.kind = k.kind AND a.idx = k.idx JOIN piv b ON b.symbol = k.symbol AND b.kind = k.kind AND b.idx = k.prior_idx JOIN rs x ON x.symbol = k.symbol AND x.i = k.idx JOIN rs y ON y.symbol = k.symbol AND y.i = k.prior_idx
  WHERE abs(x.rsi14 - y.rsi14) >= 2 AND CASE WHEN k.kind = 'low' THEN a.price < b.price AND x.rsi14 > y.rsi14 ELSE a.price > b.price AND x.rsi14 < y.rsi14 END)"""


def _alive_sql(timeframe: str) -> str:
    keep = dv.MEMORY_BARS[timeframe]
    flag = lambda k: f"coalesce(bool_or(f.kind = '{k}' AND rs.i - f.confirmed <= {keep}), false) AS rsi_div_{k}"
    return f"SELECT rs.symbol, CAST(rs.i AS INTEGER) AS i, {flag('bullish')}, {flag('bearish')} FROM rs LEFT JOIN fnd f ON f.symbol = rs.symbol AND f.i = rs.i GROUP BY rs.symbol, rs.i"


_LONG_BARS = f"{NBARS.replace('nbars AS', 'weeks AS')}, nbars AS (SELECT symbol, max(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM weeks GROUP BY symbol, floor((date - DATE '1970-01-01') / 28))"


def four_weeks(bars: DataFrame) -> DataFrame:
    """Bars of 28 days, stamped with their last session."""
    return bars.groupBy("symbol", F.floor(F.unix_date("date") / 28).alias("_m")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.max("date").alias("date")
    ).drop("_m")


def momentum_of(bars: DataFrame) -> DataFrame:
    """symbol, date, i and rsi14 of every bar."""
    return ind.rsi(bars).select("symbol", "date", (F.row_number().over(W()) - 1).alias("i"), "rsi14")


def divergences(bars: DataFrame, timeframe: str) -> tuple[DataFrame, DataFrame]:
    read = momentum_of(bars)
    return dv.pairs(zn.pivots(bars), read, timeframe), read


@query(
    "SELECT symbol, CAST(i AS INTEGER) AS i, kind, CAST(prior_idx AS INTEGER) AS prior_idx, round(prior_price, 6) AS prior_price, round(prior_rsi, 6) AS prior_rsi, CAST(idx AS INTEGER) AS idx, round(price, 6) AS price, round(rsi, 6) AS rsi, CAST(confirmed AS INTEGER) AS confirmed FROM fnd",
    views="nbars",
    more=f"{_PIVOTS}, {NTR}, {_RS}, {_found_sql('daily')}",
    recursive=True,
)
def j11_swing_divergence(m: Market) -> DataFrame:
    """At every bar the pair of swings that diverges there, if one does."""
    found, read = divergences(cut(m.nation_bars(), "symbol"), "daily")
    at = found.withColumn("i", F.explode(F.sequence("confirmed", "until"))).join(read.select("symbol", "i"), ["symbol", "i"])
    return at.select("symbol", "i", "kind", "prior_idx", "prior_price", "prior_rsi", "idx", "price", "rsi", "confirmed")


@query(_alive_sql("daily"), views="nbars", more=f"{_PIVOTS}, {NTR}, {_RS}, {_found_sql('daily')}", recursive=True)
def l06_divergence_memory(m: Market) -> DataFrame:
    found, read = divergences(cut(m.nation_bars(), "symbol"), "daily")
    return dv.alive(found, read)


@query(_alive_sql("weekly"), views="", more=f"{_LONG_BARS}, {_PIVOTS}, {NTR}, {_RS}, {_found_sql('weekly')}", recursive=True)
def l06_divergence_memory_long(m: Market) -> DataFrame:
    found, read = divergences(cut(four_weeks(m.nation_bars()), "symbol"), "weekly")
    return dv.alive(found, read)


_AT = f"""me AS (SELECT max(date) AS as_of FROM (SELECT date, CAST(date_trunc('month', date) AS DATE) AS mth, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM nbars)) WHERE rn > {WARM_UP} AND rn <= n - {HOLD} GROUP BY mth),
asat AS (SELECT as_of, n.symbol, max(i) AS i, arg_max(close, i) AS price FROM me JOIN n ON n.date <= as_of GROUP BY 1, 2 HAVING max(i) >= {WARM_UP})"""
_RATED_AT = """inv AS (SELECT z.*, b.invalidated FROM zs z LEFT JOIN (SELECT id, max(i) FILTER (event = 'break') AS invalidated FROM ev GROUP BY id) b USING (id)),
lz AS (SELECT a.as_of, a.symbol, a.i, a.price, z.id, z.kind, z.source, z.zone, z.formed, z.floor, z.ceil, count(e.i) FILTER (event IN ('touch', 'rejection')) AS touches, count(e.i) FILTER (event = 'rejection') AS rejections, count(e.i) FILTER (event = 'break') AS breaks, avg(e.reaction) AS reaction, avg(e.ratio) AS volume_ratio
  FROM asat a JOIN inv z ON z.symbol = a.symbol AND z.formed <= a.i AND coalesce(z.invalidated > a.i, true) LEFT JOIN ev e ON e.id = z.id AND e.i <= a.i WHERE a.symbol IN (SELECT symbol FROM nbars GROUP BY symbol HAVING count(*) >= 30) GROUP BY ALL),
rz AS (SELECT *, rejections / nullif(rejections + breaks, 0) AS respect, round(
    0.28 * CASE WHEN touches = 0 THEN 45 WHEN touches <= 2 THEN 70 WHEN touches <= 4 THEN 100 WHEN touches <= 6 THEN 70 ELSE 40 END + 0.20 * CASE WHEN reaction IS NULL THEN 40 ELSE greatest(0, least(100, reaction / 4 * 100)) END + 0.14 * CASE WHEN touches > 0 THEN rejections / touches * 100 ELSE 40 END
    + 0.14 * coalesce(rejections / nullif(rejections + breaks, 0) * 100, 50) + 0.12 * CASE WHEN volume_ratio IS NULL THEN 50 ELSE greatest(0, least(100, (volume_ratio - 0.7) / 0.8 * 100)) END + 0.12 * greatest(20, least(100, 100 * (1 - greatest(i - formed - 750, 0) / 750.0))), 2) AS strength FROM lz)"""
_NEAR = """bl AS (SELECT * FROM rz WHERE kind = 'low' AND floor <= price QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY price - (floor + ceil) / 2, formed, source, zone) = 1),
ab AS (SELECT * FROM rz WHERE kind = 'high' AND ceil >= price QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY (floor + ceil) / 2 - price, formed, source, zone) = 1)"""
_WICK = "span > 0 AND po IS NOT NULL AND ((upper > 1.8 * greatest(body, span * 0.05) AND close < low + 0.5 * span) OR (pc > po AND close < open AND close <= po AND open >= pc))"
_READINGS = f"""cx AS (SELECT *, row_number() {OVER} - 1 AS i, {', '.join(f'lag(close, {k}) {OVER} AS c{k}' for k in range(1, 6))} FROM c),
ov AS (SELECT a.as_of, a.symbol, a.i, x.open, x.high, x.low, x.close, ab.strength AS resistance_strength, ab.respect AS resistance_respect, ab.floor / x.close - 1 AS headroom,
    coalesce(a.i >= 6 AND x.close < ab.ceil AND greatest(c1, c2, c3, c4, c5) > ab.ceil, false)::INT::DOUBLE AS false_breakout, coalesce({_WICK} AND high >= ab.floor AND close < ab.ceil, false)::INT::DOUBLE AS rejected_at_resistance, bl.respect AS zone_respect, bl.strength AS zone_strength,
    {', '.join(f"coalesce(ok AND low <= bl.ceil AND high >= bl.floor AND close > bl.floor AND {p}, false)::INT::DOUBLE AS {n}" for n, p in (
        ('hammer_at_support', 'lower >= 2 * greatest(body, span * 0.05) AND upper <= 0.25 * span'), ('inverted_hammer_at_support', 'upper >= 2 * greatest(body, span * 0.05) AND lower <= 0.25 * span'), ('doji_at_support', 'body <= 0.10 * span'),
        ('bullish_engulfing_at_support', 'pok AND pc < po AND close > open AND close >= po AND open <= pc'), ('piercing_at_support', 'pok AND pc < po AND close > open AND open < pc AND close > (po + pc) / 2 AND close < po')))},
    {', '.join(f"coalesce(ok AND low <= ab.ceil AND high >= ab.floor AND close < ab.ceil AND {p}, false)::INT::DOUBLE AS {n}" for n, p in (
        ('shooting_star_at_resistance', 'upper >= 2 * greatest(body, span * 0.05) AND lower <= 0.25 * span'), ('hanging_man_at_resistance', 'lower >= 2 * greatest(body, span * 0.05) AND upper <= 0.25 * span'), ('doji_at_resistance', 'body <= 0.10 * span'),
        ('bearish_engulfing_at_resistance', 'pok AND pc > po AND close < open AND close <= po AND open >= pc'), ('dark_cloud_at_resistance', 'pok AND pc > po AND close < open AND open > pc AND close < (po + pc) / 2 AND close > po')))}
  FROM asat a JOIN cx x ON x.symbol = a.symbol AND x.i = a.i LEFT JOIN bl ON bl.symbol = a.symbol AND bl.as_of = a.as_of LEFT JOIN ab ON ab.symbol = a.symbol AND ab.as_of = a.as_of)"""
BUNDLE = ("resistance_strength", "resistance_respect", "headroom", "false_breakout", "rejected_at_resistance", "zone_respect", "zone_strength", *oh.SUPPORT, *oh.RESISTANCE)
OVERHEAD_SQL = f"{_MORE}, {_AT}, {_RATED_AT}, {_NEAR}, {_CANDLE}, {_READINGS}"


def month_rows(bars: DataFrame, warm_up: int = WARM_UP, ahead: int = HOLD) -> DataFrame:
    """as_of, symbol, date: each symbol's last bar at each month end, if ``warm_up`` bars lie before it."""
    ends = resample.month_ends(bars.select("date").distinct(), warm_up, ahead).select(F.col("date").alias("as_of"))
    return asof.asof_latest(bars.select("symbol", "date"), ends, "symbol", "date", warm_up + 1).select("as_of", "symbol", "date")


def overhead_rows(bars: DataFrame, at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bundle at each row of ``at`` (as_of, symbol, date), and all zones live and rated there."""
    rows = oh.bar_readings(bars).join(at, ["symbol", "date"])
    zones = oh.summed(st.build(bars, "daily"))
    rated = cut(oh.rated_at(zones, rows.select("as_of", "symbol", "i", "close"), "daily"))
    return oh.bundle(rows, oh.nearest(rated, "as_of", "symbol"), "as_of", "symbol"), rated


@query(f"SELECT as_of, symbol, CAST(i AS INTEGER) AS i, {', '.join(f'round({c}, 6) AS {c}' for c in BUNDLE)} FROM ov", views="nbars", more=OVERHEAD_SQL, recursive=True)
def j17_overhead_bundle(m: Market) -> DataFrame:
    """What stands over and under each symbol at each month end, with zones walked once and read as of the bar."""
    bars = cut(m.nation_bars(), "symbol")
    return overhead_rows(bars, month_rows(bars))[0].select("as_of", "symbol", "i", *BUNDLE)


@query("SELECT as_of, symbol, kind, source, CAST(zone AS INTEGER) AS zone, CAST(touches AS INTEGER) AS touches, CAST(rejections AS INTEGER) AS rejections, CAST(breaks AS INTEGER) AS breaks, round(strength, 6) AS strength FROM rz", views="nbars", more=f"{_MORE}, {_AT}, {_RATED_AT}", recursive=True)
def j17_zones_at_month_ends(m: Market) -> DataFrame:
    """Every zone live at each month end with its counts and strength as of that bar."""
    bars = cut(m.nation_bars(), "symbol")
    return overhead_rows(bars, month_rows(bars))[1].select("as_of", "symbol", "kind", "source", "zone", "touches", "rejections", "breaks", "strength")


def renamed(sql: str, prefix: str = "l_") -> str:
    """The same tables over other bars, under names of their own."""
    return re.sub(r"\b(nbars|n|walk|piv|d|t|nw|pts|clus|bands|rd|every|zs|wk|ev|w1|w2|rs|rec|pri|fnd)\b", rf"{prefix}\1", sql)


LONG_OF_WEEKS = "l_nbars AS (SELECT symbol, max(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM nbars GROUP BY symbol, floor((date - DATE '1970-01-01') / 28))"
_LIVE = "SELECT z.* FROM {zs} z WHERE z.symbol IN (SELECT symbol FROM {nbars} GROUP BY symbol HAVING count(*) >= 30) AND NOT EXISTS (SELECT 1 FROM {ev} e WHERE e.id = z.id AND e.event = 'break')"


@query(
    "SELECT symbol, source, CAST(zone AS INTEGER) AS zone, round(floor, 6) AS floor, round(ceil, 6) AS ceil, EXISTS (SELECT 1 FROM lw WHERE lw.symbol = dl.symbol AND lw.kind = 'low' AND lw.floor <= dl.ceil AND lw.ceil >= dl.floor) AS overlaps FROM dl WHERE kind = 'low'",
    views="nbars",
    more=f"{_MORE}, {LONG_OF_WEEKS}, {renamed(_MORE)}, dl AS ({_LIVE.format(zs='zs', nbars='nbars', ev='ev')}), lw AS ({_LIVE.format(zs='l_zs', nbars='l_nbars', ev='l_ev')})",
    recursive=True,
)
def d14_zone_overlap(m: Market) -> DataFrame:
    """Each live support and whether a live support of the longer timeframe overlaps it."""
    bars = cut(m.nation_bars(), "symbol")
    live = lambda z: z.where("live and kind = 'low'").select("symbol", "source", "zone", "floor", "ceil")
    long = live(st.build(cut(four_weeks(bars), "symbol"), "weekly"))
    return lv.overlaps(live(st.build(bars, "daily")), long)


@query(
    "SELECT symbol, kind, round(price, 6) AS price, round(floor, 6) AS floor, round(ceil, 6) AS ceil, round(strength, 6) AS strength FROM (SELECT r.*, p.price FROM rated r JOIN (SELECT symbol, arg_max(close, date) AS price FROM nbars GROUP BY symbol) p USING (symbol)) WHERE live AND CASE WHEN kind = 'low' THEN floor <= price ELSE ceil >= price END QUALIFY row_number() OVER (PARTITION BY symbol, kind ORDER BY CASE WHEN kind = 'low' THEN price - (floor + ceil) / 2 ELSE (floor + ceil) / 2 - price END, formed, source, zone) = 1",
    views="nbars",
    more=f"{_MORE}, {_RATED}",
    recursive=True,
)
def d15_nearest_zones(m: Market) -> DataFrame:
    """The nearest live zone on each side of the last close."""
    bars = cut(m.nation_bars(), "symbol")
    last = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    z = st.build(bars, "daily").where("live").join(last, "symbol")
    near = oh.nearest(z, "symbol").join(last, "symbol")
    sides = F.array(F.struct(F.lit("low").alias("kind"), F.col("below").alias("z")), F.struct(F.lit("high").alias("kind"), F.col("above").alias("z")))
    x = near.select("symbol", F.col("close").alias("price"), F.explode(sides).alias("s")).where("s.z is not null")
    return x.select("symbol", "s.kind", "price", "s.z.floor", "s.z.ceil", "s.z.strength")
