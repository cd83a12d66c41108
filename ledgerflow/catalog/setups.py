"""Queries on what zones have done and on setups at them (sections F, I, J).

The nations' weekly bars stand for sessions, their four-week bars for the longer timeframe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts as al, asof, candles, setups as st
from ..plans.views import Market
from .levels import _NATR, _PIVOTS, _SHELVES, SWINGS, _bands
from .more import resistance
from .prices import NTR, OVER
from .misc import _POS, positions
from .registry import query
from .tables import _LATEST, latest

_WIN = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
_POINTS = f"""{SWINGS} UNION ALL SELECT symbol, kind, i AS idx, price, i + 5 AS confirmed FROM (
  SELECT symbol, i, unnest([CASE WHEN n = 11 AND low = lo AND len(list_filter(ls, lambda v: v > low)) >= 5 THEN {{'kind': 'low', 'price': low}} END, CASE WHEN n = 11 AND high = hi AND len(list_filter(hs, lambda v: v < high)) >= 5 THEN {{'kind': 'high', 'price': high}} END], recursive := true)
  FROM (SELECT symbol, date, low, high, row_number() {OVER} - 1 AS i, min(low) OVER w AS lo, max(high) OVER w AS hi, count(*) OVER w AS n, list(low) OVER w AS ls, list(high) OVER w AS hs FROM nbars WINDOW w AS {_WIN})) WHERE kind IS NOT NULL"""
_READ = f"""rd AS (SELECT symbol, i, date, high, low, close, atr14 AS atr, max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS up, min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS down,
  CASE WHEN i >= 20 AND avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 0 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) END AS ratio, count(*) OVER (PARTITION BY symbol) AS n FROM nw)"""
_ALL = f"""every AS (SELECT symbol, kind, CASE WHEN members > 1 THEN 'cluster' ELSE 'pivot' END AS source, cluster AS zone, formed, floor, ceil, NULL::DOUBLE AS share FROM bands
  UNION ALL SELECT s.symbol, 'low', 'volume_shelf', bin, greatest(0, n.n - 500), floor, ceil, share FROM ({_SHELVES}) s JOIN (SELECT symbol, count(*) AS n FROM nbars GROUP BY symbol) n USING (symbol)),
zs AS (SELECT *, row_number() OVER (ORDER BY symbol, kind, source, zone) AS id, CASE WHEN kind = 'low' THEN floor ELSE -ceil END AS lo, CASE WHEN kind = 'low' THEN ceil ELSE -floor END AS hi FROM every)"""
_WALK = """wk AS (
  SELECT id, formed AS i, -1000000000 AS last, false AS broken, NULL::VARCHAR AS event, NULL::DOUBLE AS reaction, NULL::DOUBLE AS ratio FROM zs
  UNION ALL
  SELECT id, i, CASE WHEN visit THEN i ELSE last END, coalesce(breaks OR (broken AND NOT back), false), CASE WHEN breaks THEN 'break' WHEN back THEN 'reclaim' WHEN visit AND c > hi THEN 'rejection' WHEN visit THEN 'touch' END,
    CASE WHEN visit THEN coalesce((best - hi) / unit, 0) END, CASE WHEN visit THEN ratio END
  FROM (SELECT *, NOT broken AND NOT breaks AND near <= hi AND i - last >= 5 AS visit FROM (SELECT *, NOT broken AND c < lo - 0.25 * unit AS breaks, broken AND c > hi AS back FROM (
    SELECT w.id, r.i, w.last, w.broken, z.lo, z.hi, r.ratio, CASE WHEN kind = 'low' THEN close ELSE -close END AS c, CASE WHEN kind = 'low' THEN r.low ELSE -r.high END AS near, CASE WHEN kind = 'low' THEN r.up ELSE -r.down END AS best,
      coalesce(nullif(r.atr, 0), nullif(z.hi - z.lo, 0), 1) AS unit
    FROM wk w JOIN zs z USING (id) JOIN rd r ON r.symbol = z.symbol AND r.i = w.i + 1)))),
ev AS (SELECT z.*, w.i, w.event, w.reaction, w.ratio FROM wk w JOIN zs z USING (id) WHERE event IS NOT NULL)"""
_MORE = f"{_PIVOTS}, {NTR}, {_NATR}, {_bands(_POINTS)}, {_READ}, {_ALL}, {_WALK}"
_RATED = """props AS (SELECT z.*, n - 1 AS last_i, coalesce(touches, 0) AS touches, coalesce(rejections, 0) AS rejections, coalesce(breaks, 0) AS breaks, reaction, volume_ratio, rejections / nullif(rejections + breaks, 0) AS respect, invalidated FROM zs z JOIN (SELECT symbol, count(*) AS n FROM nbars GROUP BY symbol HAVING count(*) >= 30) USING (symbol)
  LEFT JOIN (SELECT id, count(*) FILTER (event IN ('touch', 'rejection')) AS touches, count(*) FILTER (event = 'rejection') AS rejections, count(*) FILTER (event = 'break') AS breaks, avg(reaction) AS reaction, avg(ratio) AS volume_ratio, max(i) FILTER (event = 'break') AS invalidated FROM ev GROUP BY id) USING (id)),
rated AS (SELECT *, formed <= last_i AND coalesce(invalidated > last_i, true) AS live, CASE WHEN source = 'volume_shelf' THEN round(least(s, 20 + share * 700), 2) ELSE s END AS strength FROM (SELECT *, round(
    0.28 * CASE WHEN touches = 0 THEN 45 WHEN touches <= 2 THEN 70 WHEN touches <= 4 THEN 100 WHEN touches <= 6 THEN 70 ELSE 40 END + 0.20 * CASE WHEN reaction IS NULL THEN 40 ELSE greatest(0, least(100, reaction / 4 * 100)) END + 0.14 * CASE WHEN touches > 0 THEN rejections / touches * 100 ELSE 40 END
    + 0.14 * coalesce(respect * 100, 50) + 0.12 * CASE WHEN volume_ratio IS NULL THEN 50 ELSE greatest(0, least(100, (volume_ratio - 0.7) / 0.8 * 100)) END + 0.12 * greatest(20, least(100, 100 * (1 - greatest(last_i - formed - 750, 0) / 750.0))), 2) AS s FROM props))"""


@query("SELECT symbol, kind, source, CAST(zone AS INTEGER) AS zone, CAST(i AS INTEGER) AS i, event, round(reaction, 6) AS reaction, round(ratio, 6) AS ratio FROM ev WHERE symbol IN (SELECT symbol FROM nbars GROUP BY symbol HAVING count(*) >= 30)", views="nbars", more=_MORE, recursive=True)
def j06_j07_zone_events(m: Market) -> DataFrame:
    z = st.build(m.nation_bars(), "daily").select("symbol", "kind", "source", "zone", F.explode("ev").alias("e"))
    return z.select("symbol", "kind", "source", "zone", "e.i", F.col("e.kind").alias("event"), "e.reaction", "e.ratio")


@query(
    "SELECT symbol, kind, source, CAST(zone AS INTEGER) AS zone, CAST(formed AS INTEGER) AS formed, round(floor, 6) AS floor, round(ceil, 6) AS ceil, CAST(touches AS INTEGER) AS touches, CAST(rejections AS INTEGER) AS rejections, CAST(breaks AS INTEGER) AS breaks, round(respect, 6) AS respect, round(reaction, 6) AS reaction, round(volume_ratio, 6) AS volume_ratio, live, round(strength, 6) AS strength FROM rated",
    views="nbars",
    more=f"{_MORE}, {_RATED}",
    recursive=True,
)
def j08_j09_j10_e24_rated_zones(m: Market) -> DataFrame:
    return st.build(m.nation_bars(), "daily").select(
        "symbol", "kind", "source", "zone", "formed", "floor", "ceil", "touches", "rejections", "breaks", "respect", "reaction", "volume_ratio", "live", "strength"
    )


def last_bars(m: Market) -> DataFrame:
    return asof.latest(st.flags(m.nation_bars(), "daily"), "symbol", "date")


@query()
def j13_j14_i35_support_setup(m: Market) -> DataFrame:
    """The setup of every nation at its last week; quality and red flags are read off the symbol's number."""
    bars = m.nation_bars()
    month = bars.withColumn("_m", F.floor(F.unix_date("date") / 28)).groupBy("symbol", "_m").agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.max("date").alias("date")
    )
    last = last_bars(m).withColumns({"quality": F.when(F.col("symbol") % 7 != 3, 60.0 + F.col("symbol") % 5 - F.when(F.col("symbol") % 6 == 0, 10).otherwise(0)), "excluded": F.col("symbol") % 11 == 5})
    over = resistance(bars).select("symbol", F.col("floor").alias("target"))
    return st.evaluate(last, st.build(bars, "daily"), st.build(month.drop("_m"), "weekly"), over)


@query()
def i21_i22_f27_readings_at_zones(m: Market) -> DataFrame:
    """The last bar's patterns at the nearest live support and resistance, the rejection there, and a breakout that failed."""
    bars = m.nation_bars()
    z = st.build(bars, "daily").where("live").select("symbol", "kind", "floor", "ceil", "formed", "source", "zone")
    price = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("p"))
    mid = (F.col("floor") + F.col("ceil")) / 2
    z = z.join(price, "symbol").where(F.when(F.col("kind") == "low", F.col("floor") <= F.col("p")).otherwise(F.col("ceil") >= F.col("p")))
    near = z.groupBy("symbol", "kind").agg(F.min_by(F.struct("floor", "ceil"), F.struct(F.abs(F.col("p") - mid), "formed", "source", "zone")).alias("z")).select("symbol", "kind", "z.floor", "z.ceil")
    read = candles.two_bar(bars.select("*", *candles.shapes())).withColumns({"turns_down": st._wick_or_engulfing(False), "turns_up": st._wick_or_engulfing(True)})
    out = None
    for kind in ("low", "high"):
        df = read.join(near.where(F.col("kind") == kind), "symbol")
        if kind == "low":
            more = {"bullish_candle": F.col("turns_up") & (F.col("low") <= F.col("ceil")) & (F.col("close") > F.col("floor")), "false_breakout": F.lit(None).cast("int")}
        else:
            more = {"rejected": F.col("turns_down") & (F.col("high") >= F.col("floor")) & (F.col("close") < F.col("ceil")), "false_breakout": st.false_breakout("daily")}
        df = df.withColumns(st.at_levels(df, kind) | more)
        names = [*st.at_levels(df, kind), *[k for k in more if k != "false_breakout"]]
        df = asof.latest(df.select("symbol", "date", "kind", "floor", "ceil", "false_breakout", *names), "symbol", "date")
        seen = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in names]))
        df = df.select("symbol", "date", "kind", "floor", "ceil", "false_breakout", F.array_join(seen, ",").alias("patterns"))
        out = df if out is None else out.unionByName(df)
    return out


_STATE = """td AS (SELECT symbol, symbol % 10 + 1 AS decile, CASE WHEN symbol % 5 <> 0 THEN symbol * 3 % 10 + 1 END AS cdecile, symbol % 3 AS status, symbol % 2 = 0 AS gone, CAST(symbol % 50 AS VARCHAR) AS zone_floor,
  list_concat(CASE WHEN symbol % 6 = 0 THEN ['illiquid'] ELSE []::VARCHAR[] END, CASE WHEN symbol % 9 = 0 THEN ['loss_making'] ELSE []::VARCHAR[] END) AS flags FROM latest),
yd AS (SELECT symbol, (symbol + 1) % 10 + 1 AS decile, (symbol + 1) % 3 AS status, CASE WHEN symbol % 12 = 0 THEN ['illiquid'] ELSE []::VARCHAR[] END AS flags FROM latest WHERE symbol % 8 <> 0),
ps AS (SELECT pos.symbol, symbol % 7 AS id, stop, entry * 1.25 AS target, close FROM pos WHERE symbol % 2 = 1),
al AS (
  SELECT symbol, 'stop_breached' AS rule, 0 AS severity, CAST(id AS VARCHAR) AS extra FROM ps JOIN td USING (symbol) WHERE close <= stop
  UNION ALL SELECT symbol, 'target_reached', 1, CAST(id AS VARCHAR) FROM ps JOIN td USING (symbol) WHERE close >= target
  UNION ALL SELECT symbol, 'thesis_broken', 0, array_to_string(flags, ',') FROM ps JOIN td USING (symbol) WHERE len(flags) > 0
  UNION ALL SELECT symbol, 'score_decayed', 1, CASE WHEN cdecile IS NULL THEN 'blended score' ELSE 'conviction' END || ':' || CAST(coalesce(cdecile, decile) AS VARCHAR) FROM ps JOIN td USING (symbol) WHERE coalesce(cdecile, decile) < 7
  UNION ALL SELECT td.symbol, 'setup_triggered', 1, zone_floor FROM td LEFT JOIN yd USING (symbol) WHERE td.status = 2 AND yd.status IS DISTINCT FROM 2
  UNION ALL SELECT td.symbol, 'entered_top_decile', 2, NULL FROM td JOIN yd USING (symbol) WHERE td.decile >= 10 AND yd.decile < 10
  UNION ALL SELECT td.symbol, 'zone_broken', 2, NULL FROM td JOIN yd USING (symbol) WHERE yd.status <> 0 AND td.status = 0 AND gone
  UNION ALL SELECT symbol, 'new_red_flag', 2, array_to_string(fresh, ',') FROM (SELECT td.symbol, list_filter(td.flags, lambda f: NOT list_contains(yd.flags, f)) AS fresh FROM td JOIN yd USING (symbol)) WHERE len(fresh) > 0)"""


def score_states(m: Market) -> tuple[DataFrame, DataFrame]:
    """Today's and yesterday's scores, read off the symbol's number."""
    s = F.col("symbol")
    flag = lambda ok, name: F.when(ok, F.struct(F.lit(name).alias("name"), F.lit("fail").alias("verdict")))
    status = lambda k: F.element_at(F.array(F.lit("none"), F.lit("watching"), F.lit("triggered")), (k % 3 + 1).cast("int"))
    x = latest(m).select("symbol")
    today = x.withColumns(
        {
            "decile": s % 10 + 1,
            "conviction_decile": F.when(s % 5 != 0, s * 3 % 10 + 1),
            "setup_status": status(s),
            "reason": F.when(s % 3 == 0, F.when(s % 2 == 0, "no live zone below price").otherwise("quality below the gate")),
            "zone_floor": s % 50,
            "flags": F.array_compact(F.array(flag(s % 6 == 0, "illiquid"), flag(s % 9 == 0, "loss_making"))),
        }
    )
    yesterday = x.where(s % 8 != 0).withColumns({"decile": (s + 1) % 10 + 1, "setup_status": status(s + 1), "flags": F.array_compact(F.array(flag(s % 12 == 0, "illiquid")))})
    return today, yesterday


@query("SELECT symbol, rule, severity, concat_ws(':', CAST(symbol AS VARCHAR), rule, extra) AS dedupe_key FROM al WHERE NOT (rule = 'target_reached' AND symbol % 3 = 0)", more=f"{_LATEST}, {_POS}, {_STATE}")
def l02_l12_l13_alert_rules(m: Market) -> DataFrame:
    """All eight rules over positions and screen, without the targets of every third symbol, which were told before."""
    today, yesterday = score_states(m)
    held = positions(m).where("symbol % 2 = 1").select("symbol", (F.col("symbol") % 7).alias("id"), "stop", (F.col("entry") * 1.25).alias("target"), "close")
    alerts = al.for_positions(held, today).unionByName(al.for_screen(today, yesterday))
    seen = held.where("symbol % 3 = 0").select(F.concat_ws(":", F.col("symbol").cast("string"), F.lit("target_reached"), F.col("id").cast("string")).alias("dedupe_key"))
    return al.dispatch(alerts, seen)
