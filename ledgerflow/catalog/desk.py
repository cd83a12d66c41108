"""The desk: a book of positions, what to tell about it, the chart's zones, and runs that survive bad symbols (sections B, D, G, L, M)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts as al, book as bk, setups as st, zones as zn
from ..plans.cut import cut
from ..plans.isolate import isolated, watched
from ..plans.nightly import Audit, audit_frame
from ..plans.views import Market
from .misc import _POS, positions
from .registry import query
from .setups import _MORE, _RATED, _STATE, score_states
from .tables import _LATEST, latest

# --- the book ------------------------------------------------------------------
_COMMANDS = """cmd AS (SELECT o_custkey AS book, o_orderkey % 2 AS symbol, o_orderkey AS seq, CASE WHEN o_orderkey % 7 <= 1 THEN 'open' WHEN o_orderkey % 7 = 2 THEN 'close' WHEN o_orderkey % 7 <= 4 THEN 'move_stop' WHEN o_orderkey % 7 = 5 THEN 'edit' ELSE 'capital' END AS kind,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 END AS price, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 50 + 1 END::DOUBLE AS qty, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 1000 * (0.7 + (o_orderkey % 8) / 20.0) END AS stop, o_orderkey % 5 = 0 AS force,
    row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2, o_orderkey % 7 = 6 ORDER BY o_orderkey) AS nth, o_totalprice - 100000 AS amount, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 4) * 0.4 END AS risk_pct FROM orders)"""
_UP = "(p.stop IS NULL AND c.stop IS NOT NULL) OR coalesce(abs(c.stop - p.stop) >= 1e-9 AND (c.stop >= p.stop OR c.force), false)"
_FOLD = f"""fold AS (
  SELECT book, symbol, 0::BIGINT AS nth, []::STRUCT(id BIGINT, day DATE, price DOUBLE, qty DOUBLE, stop DOUBLE, exit_id BIGINT, exit_day DATE, exit_price DOUBLE)[] AS open, NULL::STRUCT(id BIGINT, day DATE, price DOUBLE, qty DOUBLE, stop DOUBLE, exit_id BIGINT, exit_day DATE, exit_price DOUBLE) AS gone, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS why FROM (SELECT DISTINCT book, symbol FROM cmd WHERE kind <> 'capital')
  UNION ALL
  SELECT book, symbol, nth, CASE WHEN why IS NOT NULL THEN open WHEN kind = 'open' THEN list_append(open, {{'id': seq, 'day': day, 'price': price, 'qty': qty, 'stop': stop, 'exit_id': NULL::BIGINT, 'exit_day': NULL::DATE, 'exit_price': NULL::DOUBLE}}) WHEN kind = 'close' THEN open[:-2]
      WHEN kind = 'move_stop' THEN list_transform(open, lambda p: {{'id': p.id, 'day': p.day, 'price': p.price, 'qty': p.qty, 'stop': CASE WHEN {_UP.replace('c.', '')} THEN stop ELSE p.stop END, 'exit_id': p.exit_id, 'exit_day': p.exit_day, 'exit_price': p.exit_price}})
      ELSE list_transform(open, lambda p: {{'id': p.id, 'day': coalesce(day, p.day), 'price': coalesce(price, p.price), 'qty': coalesce(qty, p.qty), 'stop': p.stop, 'exit_id': p.exit_id, 'exit_day': p.exit_day, 'exit_price': p.exit_price}}) END,
    CASE WHEN why IS NULL AND kind = 'close' THEN {{'id': open[-1].id, 'day': open[-1].day, 'price': open[-1].price, 'qty': open[-1].qty, 'stop': open[-1].stop, 'exit_id': seq, 'exit_day': day, 'exit_price': price}} END, seq, kind, why
  FROM (SELECT f.open, c.*, CASE WHEN c.kind = 'open' THEN CASE WHEN c.qty IS NULL OR c.price IS NULL THEN 'quantity and price are required' WHEN c.stop IS NULL THEN 'a stop is required' WHEN c.stop >= c.price THEN 'the stop must sit below the entry' END
      WHEN len(f.open) = 0 THEN 'no open position' WHEN c.kind = 'close' AND c.price IS NULL THEN 'a price is required'
      WHEN c.kind = 'move_stop' THEN CASE WHEN c.stop IS NULL THEN 'no stop is given' WHEN len(list_filter(f.open, lambda p: {_UP})) = 0 THEN CASE WHEN len(list_filter(f.open, lambda p: coalesce(abs(p.stop - c.stop) < 1e-9, false))) = len(f.open) THEN 'already there' ELSE 'would lower the stop' END END
      WHEN c.kind = 'edit' AND c.price IS NULL AND c.qty IS NULL AND c.day IS NULL THEN 'nothing to change' END AS why
    FROM fold f JOIN (SELECT * FROM cmd WHERE kind <> 'capital') c ON c.book = f.book AND c.symbol = f.symbol AND c.nth = f.nth + 1))"""
_HELD = "ps AS (SELECT book, symbol, unnest(gone, recursive := true) FROM fold WHERE gone IS NOT NULL UNION ALL SELECT book, symbol, unnest(open, recursive := true) FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY book, symbol ORDER BY nth DESC) = 1))"


def commands(m: Market) -> DataFrame:
    """A customer's orders as commands on a book of two symbols; what each asks for follows from the order."""
    k = F.col("o_orderkey")
    p = F.col("o_totalprice") / 1000
    kind = F.when(k % 7 <= 1, "open").when(k % 7 == 2, "close").when(k % 7 <= 4, "move_stop").when(k % 7 == 5, "edit").otherwise("capital")
    return m.table("orders").select(
        F.col("o_custkey").alias("book"), (k % 2).alias("symbol"), k.cast("long").alias("seq"), kind.alias("kind"), F.when(k % 3 != 0, F.col("o_orderdate").cast("date")).alias("day"), F.when(k % 11 != 0, p).alias("price"),
        F.when(k % 17 != 0, k % 50 + 1).cast("double").alias("qty"), F.when(k % 13 != 0, p * (0.7 + (k % 8) / 20.0)).alias("stop"), F.lit(None).cast("double").alias("target"), (k % 5 == 0).alias("force"), (F.col("o_totalprice") - 100000).alias("amount"), F.when(k % 3 > 0, (k % 4) * 0.4).alias("risk_pct"),
    )


def folded(m: Market) -> DataFrame:
    return bk.fold(commands(m).where("kind <> 'capital'"))


@query("SELECT book, symbol, id, day, round(price, 6) AS price, qty, round(stop, 6) AS stop, exit_id, exit_day, round(exit_price, 6) AS exit_price, round((exit_price - price) * qty, 6) AS profit FROM ps", views="", more=f"{_COMMANDS}, {_FOLD}, {_HELD}", recursive=True)
def m04_position_book(m: Market) -> DataFrame:
    """Every position, open and closed, after all commands."""
    return bk.positions(folded(m)).drop("target")


@query("SELECT book, symbol, seq, kind, why IS NULL AS accepted, why AS reason FROM fold WHERE seq IS NOT NULL", views="", more=f"{_COMMANDS}, {_FOLD}", recursive=True)
def m04_command_log(m: Market) -> DataFrame:
    """Every command with whether it was accepted and, if not, why."""
    return bk.log(folded(m))


@query(
    "SELECT book, round(capital, 6) AS capital, round(risk_pct, 6) AS risk_pct FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC) AS k FROM cap) WHERE k = 1 AND capital IS NOT NULL",
    views="",
    more=_COMMANDS + """, cc AS (SELECT book, amount, risk_pct, row_number() OVER (PARTITION BY book ORDER BY seq) AS n FROM cmd WHERE kind = 'capital'),
    cap AS (SELECT DISTINCT book, 0::BIGINT AS n, NULL::DOUBLE AS capital, NULL::DOUBLE AS risk_pct FROM cc UNION ALL
      SELECT c.book, c.n, CASE WHEN ok THEN c.amount ELSE capital END, CASE WHEN ok THEN risk ELSE c.had END FROM (SELECT c.*, p.capital, p.risk_pct AS had, coalesce(c.risk_pct, p.risk_pct, 0.01) AS risk, coalesce(c.amount > 0 AND coalesce(c.risk_pct, p.risk_pct, 0.01) > 0 AND coalesce(c.risk_pct, p.risk_pct, 0.01) < 1, false) AS ok FROM cap p JOIN cc c ON c.book = p.book AND c.n = p.n + 1) c)""",
    recursive=True,
)
def m04_capital(m: Market) -> DataFrame:
    return bk.capital(commands(m).where("kind = 'capital'"))


@query(
    "SELECT p.book, p.symbol, id, round(price, 6) AS price, qty, round(stop, 6) AS stop, round(close, 6) AS close, day_of, round(score, 6) AS score FROM ps p LEFT JOIN (SELECT symbol, arg_max(close, date) AS close, max(date) AS day_of FROM nbars GROUP BY symbol) USING (symbol) LEFT JOIN (SELECT symbol, arg_max(close / open - 1, date) AS score FROM nbars WHERE symbol % 2 = 0 GROUP BY symbol) USING (symbol) WHERE exit_id IS NULL",
    views="nbars",
    more=f"{_COMMANDS}, {_FOLD}, {_HELD}",
    recursive=True,
)
def d18_positions_at_a_glance(m: Market) -> DataFrame:
    """Open positions with the newest price and score of their symbol."""
    held = bk.positions(folded(m)).where("exit_id is null").select("book", "symbol", "id", "price", "qty", "stop")
    bars = m.nation_bars()
    scores = bars.where("symbol % 2 = 0").select("symbol", "date", (F.col("close") / F.col("open") - 1).alias("score"))
    return bk.at_a_glance(held, scores, bars.select("symbol", "date", "close"), bars.select("symbol", "date", F.col("date").alias("day_of")))


# --- what to tell --------------------------------------------------------------
_WATCHED = "symbol % 4 = 1"
_TOLD = f"tl AS (SELECT * FROM al WHERE rule IN ('stop_breached', 'target_reached', 'thesis_broken', 'score_decayed', 'setup_triggered') OR {_WATCHED})"


def told(m: Market) -> tuple[DataFrame, DataFrame, DataFrame]:
    today, yesterday = score_states(m)
    held = positions(m).where("symbol % 2 = 1").select("symbol", (F.col("symbol") % 7).alias("id"), "entry", "stop", (F.col("entry") * 1.25).alias("target"), "close")
    screen = al.worth_telling(al.for_screen(today, yesterday), latest(m).where(_WATCHED))
    return al.for_positions(held, today).unionByName(screen), held, today


@query("SELECT symbol, rule, severity, concat_ws(':', CAST(symbol AS VARCHAR), rule, extra) AS dedupe_key FROM tl", more=f"{_LATEST}, {_POS}, {_STATE}, {_TOLD}")
def l12_watched_alerts(m: Market) -> DataFrame:
    """All position alerts, triggered setups of all symbols, and the other screen alerts of watched ones."""
    alerts, _, _ = told(m)
    return al.dispatch(alerts, alerts.limit(0))


_SIGNS = "sn AS (SELECT symbol, list_filter([CASE WHEN symbol % 2 = 0 THEN 'bullish_candle' END, CASE WHEN symbol % 7 < 3 THEN 'rsi_divergence' END], lambda x: x IS NOT NULL) AS signs, CASE WHEN symbol % 5 <> 0 THEN 1 + (symbol % 40) / 7.0 END AS reward_risk FROM latest WHERE symbol % 11 <> 3)"
_TEXT = """SELECT t.symbol, t.rule, CASE t.rule
    WHEN 'stop_breached' THEN printf('close %.2f is at or under the stop %.2f', p.close, p.stop)
    WHEN 'target_reached' THEN printf('close %.2f has met the target %.2f, ', p.close, p.target) || CASE WHEN p.close >= p.entry THEN '+' ELSE '' END || printf('%.0f%% since entry', (p.close / p.entry - 1) * 100)
    WHEN 'thesis_broken' THEN 'a holding fails a gate: ' || replace(replace(extra, '_', ' '), ',', ', ') WHEN 'score_decayed' THEN split_part(extra, ':', 1) || ' is down to decile ' || split_part(extra, ':', 2)
    WHEN 'entered_top_decile' THEN 'new in the top decile, blend ' || printf('%.1f', t.symbol % 90 + 0.5) WHEN 'setup_triggered' THEN 'turning at support (' || CASE WHEN len(s.signs) > 0 THEN replace(array_to_string(s.signs, ', '), '_', ' ') ELSE 'confirmed' END || ')' || CASE WHEN s.reward_risk IS NOT NULL THEN printf(', reward to risk %.1f', s.reward_risk) ELSE '' END
    WHEN 'zone_broken' THEN 'the support under it has gone' WHEN 'new_red_flag' THEN 'fails a gate it passed before: ' || replace(replace(extra, '_', ' '), ',', ', ') END AS message
  FROM tl t LEFT JOIN (SELECT pos.symbol, entry, stop, entry * 1.25 AS target, close FROM pos) p USING (symbol) LEFT JOIN sn s USING (symbol)"""


@query(_TEXT, more=f"{_LATEST}, {_POS}, {_STATE}, {_TOLD}, {_SIGNS}")
def l13_alert_texts(m: Market) -> DataFrame:
    """Each alert in words, a setup's with its signs and its odds."""
    alerts, held, today = told(m)
    s = F.col("symbol")
    signs = F.array_compact(F.array(F.when(s % 2 == 0, "bullish_candle"), F.when(s % 7 < 3, "rsi_divergence")))
    setups = latest(m).where("symbol % 11 <> 3").select("symbol", signs.alias("signs"), F.when(s % 5 != 0, 1 + (s % 40) / 7.0).alias("reward_risk"))
    return al.explained(alerts, held, today.withColumn("blended", s % 90 + 0.5), setups).select("symbol", "rule", "message")


# --- the chart -----------------------------------------------------------------
SHOWN = 250
_CHART = f"""gr AS (SELECT r.*, p.price, CASE WHEN NOT live AND invalidated >= last_i - {SHOWN - 1} AND floor <= price * 1.25 AND ceil >= price * 0.75 THEN 'broken' WHEN live AND kind = 'high' AND ceil >= price THEN 'overhead' WHEN live AND kind = 'low' AND floor <= price THEN 'live' END AS part FROM rated r JOIN (SELECT symbol, arg_max(close, date) AS price FROM nbars GROUP BY symbol) p USING (symbol)),
ch AS (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY CASE part WHEN 'broken' THEN -invalidated WHEN 'overhead' THEN (floor + ceil) / 2 ELSE -(floor + ceil) / 2 END, kind, source, zone) AS place FROM gr WHERE part IS NOT NULL)"""


@query("SELECT symbol, part, CAST(place AS INTEGER) AS place, kind, source, CAST(zone AS INTEGER) AS zone, round(floor, 6) AS floor, round(ceil, 6) AS ceil FROM ch WHERE place <= CASE part WHEN 'live' THEN 3 ELSE 2 END", views="nbars", more=f"{_MORE}, {_RATED}, {_CHART}", recursive=True)
def g06_chart_zones(m: Market) -> DataFrame:
    """The zones a chart of the last 250 bars shows: three live below, two overhead, two that broke lately and near."""
    bars = cut(m.nation_bars(), "symbol")
    price = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    return zn.chart_zones(st.build(bars, "daily").join(price, "symbol"), SHOWN)


# --- runs that survive ---------------------------------------------------------
_LEAST = 60


def spread_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Deviation of a symbol's log returns; raises on a price that is missing and on short histories."""
    rows = rows.sort_values("date")
    if rows.close.isna().any():
        raise ValueError("a close is missing")
    if len(rows) < _LEAST:
        raise ValueError(f"fewer than {_LEAST} bars")
    r = np.diff(np.log(rows.close.to_numpy()))
    return pd.DataFrame({"symbol": [int(rows.symbol.iloc[0])], "n": [len(rows)], "spread": [float(r.std(ddof=1))]})


def spreads(m: Market) -> DataFrame:
    bars = m.nation_bars().select("symbol", "date", F.when(~((F.col("symbol") == 7) & (F.month("date") == 5)), F.col("close")).alias("close"))
    return isolated(bars.where("symbol <> 9 or year(date) = 1997"), "symbol", spread_of, "symbol int, n long, spread double")


_SPREADS = "sp AS (SELECT symbol, CASE WHEN symbol = 7 THEN 'ValueError: a close is missing' WHEN count(*) < 60 THEN 'ValueError: fewer than 60 bars' END AS error, count(*) AS n, stddev_samp(r) AS spread FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM nbars WHERE symbol <> 9 OR year(date) = 1997) GROUP BY symbol)"


@query("SELECT symbol, CASE WHEN error IS NULL THEN n END AS n, CASE WHEN error IS NULL THEN round(spread, 6) END AS spread, error FROM sp", views="nbars", more=_SPREADS)
def m02_isolated_symbols(m: Market) -> DataFrame:
    """A step on which two symbols fail: each is a row with its reason, all others have their figures."""
    return spreads(m)


@query("SELECT 'spreads' AS job, CASE WHEN count(error) = 0 THEN 'ok' WHEN count(error) = count(*) THEN 'failed' ELSE 'partial' END AS status, count(*) AS rows_in, count(*) FILTER (error IS NULL) AS rows_out, CASE WHEN count(error) > 0 THEN count(error) || ' failed, the first: ' || min(symbol || ': ' || error) END AS notes FROM sp", views="nbars", more=_SPREADS)
def b13_m03_run_audit(m: Market) -> DataFrame:
    """The audit row of that run, its counters observed while it ran."""
    sink: list[Audit] = []
    watched(spreads(m), "symbol", "spreads", sink)
    return audit_frame(m.spark, sink).select("job", "status", "rows_in", "rows_out", F.array_join("errors", "; ").alias("notes"))
