"""Scores of every month end as they could have been known, and the panel on them (sections D, E, I, J)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, divergence as dv, indicators as ind, pointintime as pt, research as rs, scoring, setups as st
from ..plans import statements as sm
from ..plans.cut import cut
from ..plans.views import Market
from .cross import _avg_rank, _pct
from .levels import _PIVOTS
from .pillars import _CAGR, _accel_sql, _blend_sql, _mean_sql, _sue_sql
from .prices import NTR
from .registry import query, r6
from .research import _COLS, _ic, _nw
from .structure import _AT, BUNDLE, OVERHEAD_SQL, HOLD, WARM_UP, _RS, _found_sql, divergences, four_weeks, month_rows, overhead_rows
from .technical import _CHAIN, _M, _WEIGHTS

METRICS = ("revenue_cagr_3y", "pat_cagr_3y", "quarter_yoy", "roe", "roce", "opm", "opm_trend", "debt_equity", "interest_cover", "debt_trend", "cfo_to_pat", "fcf_positive", "pe", "peg", "pb", "ev_ebitda", "ev_sales", "pe_5y_median")
MOVES = ("sue_pat", "sue_revenue", "accel_pat", "accel_revenue", "margin_revision", "consistency", "promoter_delta_4q", "promoter_delta_1q", "fii_delta_4q", "fii_delta_2q", "dii_delta_4q")
SCORES = ("quality_score", "value_score", "revision_score", "ownership_score", "tm_score")
# The panel's features and the direction each is tried in.
FEATURES = {
    "quality_score": 1, "value_score": 1, "revision_score": 1, "ownership_score": 1, "tm_score": 1, "ts_score": 1, "sue_pat": 1, "sue_revenue": 1, "accel_pat": 1, "margin_revision": 1, "consistency": 1, "promoter_delta_4q": 1, "fii_delta_4q": 1, "dii_delta_4q": 1,
    "resistance_strength": 1, "headroom": -1, "false_breakout": 1, "rejected_at_resistance": 1, "dist_52w_high": -1, "zone_respect": 1, "zone_strength": 1, "turnover_60d_cr": 1,
    "hammer_at_support": 1, "inverted_hammer_at_support": 1, "doji_at_support": 1, "bullish_engulfing_at_support": 1, "piercing_at_support": 1,
    "shooting_star_at_resistance": -1, "hanging_man_at_resistance": -1, "doji_at_resistance": -1, "bearish_engulfing_at_resistance": -1, "dark_cloud_at_resistance": -1,
    "rsi_div_bullish_daily": 1, "rsi_div_bearish_daily": -1, "rsi_div_bullish_weekly": 1, "rsi_div_bearish_weekly": -1,
}
DIVERGENCE = tuple(f"rsi_div_{k}_{t}" for t in ("daily", "weekly") for k in ("bullish", "bearish"))
LEAST_NAMES = 15  # a date's correlation needs so many; there are 25 nations


def members(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of symbols in the last snapshot at or before the date."""
    snap = sm.snapshots(bars)
    which = asof.snapshot_at(snap, rows.select("as_of").distinct())
    return rows.join(which, "as_of").join(snap, ["week_start", "symbol"], "left_semi").drop("week_start")


def known(m: Market, bars: DataFrame) -> DataFrame:
    """as_of, symbol, date, i, the technicals at that bar and the fundamentals filed by then."""
    year, quarter = sm.statements(m)
    book = pt.books(year, quarter, sm.holdings(m), bars)
    place = bars.select("symbol", "date", (F.row_number().over(ind.W()) - 1).alias("i"))
    rows = members(bars, month_rows(bars)).join(place, ["symbol", "date"])
    rows = pt.technicals_at(bars, rows).join(sm.nations(m), "symbol").where("close > 0")
    return pt.fundamentals(pt.as_filed(rows, book))


def scored(m: Market, bars: DataFrame) -> DataFrame:
    return pt.pillars(known(m, bars))


def lived(rows: DataFrame, bars: DataFrame, long: DataFrame, at_long: DataFrame) -> DataFrame:
    """as_of, symbol and the four divergence flags; the longer timeframe is read from its thirtieth bar on."""
    keys = list(pt.KEYS)
    out = rows.select(*keys, "i")
    for timeframe, b, at in (("daily", bars, rows), ("weekly", long, at_long.where("i >= 30"))):
        found, read = divergences(b, timeframe)
        flags = at.select(*keys, "i").join(dv.alive(found, read, suffix=f"_{timeframe}"), ["symbol", "i"])
        out = out.join(flags.drop("i"), keys, "left")
    return out.select(*keys, *[F.coalesce(n, F.lit(False)).cast("double").alias(n) for n in DIVERGENCE])


def wide_panel(m: Market, bars: DataFrame) -> DataFrame:
    """(as_of, symbol): all features, the setup, the better technical score and the forward return; excluded rows are out.

    The scores, the bundle and the rated zones are cut once; every read after that is by (as_of, symbol).
    """
    keys = list(pt.KEYS)
    rows = cut(scored(m, bars))
    bundle, rated = overhead_rows(bars, rows.select(*keys, "date"))
    long = cut(four_weeks(bars), "symbol")
    place = long.select("symbol", "date", (F.row_number().over(ind.W()) - 1).alias("w"))
    at_long = asof.asof_join(rows.select(*keys, "date", "close"), place, "symbol", "date", "w", "i").where("i is not null")
    rated_long = pt.zones_at(long, at_long.select(*keys, "i", "close"), "weekly")
    flags = cut(st.flags(bars, "daily").join(rows.select(*keys, "date", "i"), ["symbol", "date"]))
    setup = pt.setups_at(flags, rows, rated, rated_long, pt.resistance_at(bars, flags))
    x = rows.join(bundle.select(*keys, *BUNDLE), keys).join(lived(rows, bars, long, at_long), keys).join(setup, keys, "left")
    x = x.join(pt.forward_returns(bars, HOLD), ["symbol", "date"], "left")
    return pt.technical(x).where("not excluded and forward_return is not null")


# --- the same in SQL -----------------------------------------------------------
_BOOK = f"""mem AS (SELECT asat.* FROM asat JOIN (SELECT as_of, coalesce(max(week_start) FILTER (week_start <= as_of), min(week_start)) AS w FROM me, (SELECT DISTINCT week_start FROM snap) GROUP BY as_of) s USING (as_of) JOIN snap ON snap.week_start = s.w AND snap.symbol = asat.symbol WHERE price > 0),
yp AS (SELECT ys.*, b.close AS price_then FROM ys ASOF LEFT JOIN nbars b ON b.symbol = ys.symbol AND b.date <= ys.period_end),
bk AS (SELECT m.as_of, m.symbol, m.i, m.price AS close, n.sector, n.is_financial, n.shares, coalesce(y.l, []) AS y, coalesce(q.l, []) AS q, coalesce(h.l, []) AS h FROM mem m JOIN nat n USING (symbol)
  LEFT JOIN (SELECT as_of, symbol, list(yp ORDER BY period_end) AS l FROM me JOIN yp ON filed_on <= as_of GROUP BY 1, 2) y USING (as_of, symbol) LEFT JOIN (SELECT as_of, symbol, list(qs ORDER BY period_end) AS l FROM me JOIN qs ON filed_on <= as_of GROUP BY 1, 2) q USING (as_of, symbol)
  LEFT JOIN (SELECT as_of, symbol, list(hs ORDER BY quarter_end) AS l FROM me JOIN hs ON quarter_end + 31 <= as_of GROUP BY 1, 2) h USING (as_of, symbol)),
ar AS (SELECT as_of, symbol, i, close, sector, is_financial, shares, y[-1] AS ly, [x.revenue FOR x IN y] AS rev, [x.pat FOR x IN y] AS pat, [x.cfo FOR x IN y] AS cfo, [x.ebitda FOR x IN y] AS ebi, [x.debt FOR x IN y] AS debt, [x.debtor_days FOR x IN y] AS dd, list_sort([x.price_then / x.eps FOR x IN y[-5:] IF x.eps > 0 AND x.price_then IS NOT NULL]) AS own,
  [x.pat FOR x IN q] AS qpat, [x.revenue FOR x IN q] AS qrev, [x.opm FOR x IN q] AS qopm, [x.eps FOR x IN q] AS qeps, [x.promoter_pct FOR x IN h] AS pr, [x.fii_pct FOR x IN h] AS fii, [x.dii_pct FOR x IN h] AS dii, coalesce(h[-1].has_promoter, false) AS has_promoter FROM bk),
ep AS (SELECT *, CASE WHEN len(qeps) >= 4 THEN list_sum(qeps[-4:]) ELSE ly.eps END AS eps FROM ar),"""
_TREND = "CASE WHEN len({a}) >= 3 THEN ({a}[-1] - {a}[-3]) / 2 WHEN len({a}) = 2 THEN {a}[-1] - {a}[-2] END"
_ABOVE = "CASE WHEN {x} > 0 THEN {x} END"
_KNOWN = f"""{_BOOK}
mt AS (SELECT *, close / {_ABOVE.format(x='eps')} AS pe, close / {_ABOVE.format(x='(ly.equity / shares)')} AS pb, (close * shares + coalesce(ly.debt, 0)) / {_ABOVE.format(x='ly.ebitda')} AS ev_ebitda, (close * shares + coalesce(ly.debt, 0)) / {_ABOVE.format(x='ly.revenue')} AS ev_sales, CASE WHEN len(own) >= 3 THEN list_median(own) END AS pe_5y_median,
  {_CAGR.format(a='rev')} AS revenue_cagr_3y, {_CAGR.format(a='pat')} AS pat_cagr_3y, CASE WHEN qpat[-5] > 0 THEN qpat[-1] / qpat[-5] - 1 END AS quarter_yoy, ly.roe AS roe, ly.roce AS roce, ebi[-1] AS opm, {_TREND.format(a='ebi')} AS opm_trend, ly.debt_equity AS debt_equity, ly.interest_cover AS interest_cover, {_TREND.format(a='debt')} AS debt_trend,
  CASE WHEN list_sum(pat[-3:]) > 0 THEN list_sum(cfo[-3:]) / list_sum(pat[-3:]) END AS cfo_to_pat, CASE WHEN ly.fcf IS NOT NULL THEN (ly.fcf > 0)::INT::DOUBLE END AS fcf_positive,
  {_sue_sql('qpat')} AS sue_pat, {_sue_sql('qrev')} AS sue_revenue, {_accel_sql('qpat')} AS accel_pat, {_accel_sql('qrev')} AS accel_revenue, qopm[-1] - (qopm[-2] + qopm[-3] + qopm[-4] + qopm[-5]) / 4 AS margin_revision,
  CASE WHEN len(qpat) >= 8 THEN ((qpat[-1] > qpat[-5])::INT + (qpat[-2] > qpat[-6])::INT + (qpat[-3] > qpat[-7])::INT + (qpat[-4] > qpat[-8])::INT) / 4.0 END AS consistency, coalesce(qopm[-3] < qopm[-2] AND qopm[-2] < qopm[-1], false) AS margin_expanding,
  CASE WHEN has_promoter THEN pr[-1] - pr[-5] END AS promoter_delta_4q, CASE WHEN has_promoter THEN pr[-1] - pr[-2] END AS promoter_delta_1q, fii[-1] - fii[-5] AS fii_delta_4q, fii[-1] - fii[-3] AS fii_delta_2q, dii[-1] - dii[-5] AS dii_delta_4q,
  coalesce(has_promoter AND len(pr) >= 2 AND pr[-least(len(pr), 5)] - pr[-1] > 3, false) OR (NOT is_financial AND (coalesce(len(pat) >= 2 AND list_sum(pat[-3:]) > 0 AND list_sum(cfo[-3:]) / list_sum(pat[-3:]) < 0.5, false) OR coalesce(dd[-2] > 0 AND dd[-1] / dd[-2] > 1.4, false))) OR coalesce(len(pat) >= 2 AND len(list_filter(pat[-3:], lambda v: v < 0)) >= 2, false) AS excluded
  FROM ep),
kn AS (SELECT mt.*, CASE WHEN pe <> 0 AND pat_cagr_3y > 0 THEN pe / (pat_cagr_3y * 100) END AS peg, CASE WHEN sector IS NULL OR count(*) OVER (PARTITION BY as_of, sector) < 10 THEN '__POOLED__' ELSE sector END AS peer, NULL::DOUBLE AS dividend_yield FROM mt)"""
_PEER = "as_of, peer"
_Q = {
    "q_growth": _mean_sql(*[_pct(c, _PEER) for c in ("revenue_cagr_3y", "pat_cagr_3y", "quarter_yoy")]),
    "q_profitability": _mean_sql(*[_pct(c, _PEER) for c in ("roe", "roce", "opm", "opm_trend")]),
    "q_balance_sheet": _mean_sql(_pct("debt_equity", _PEER, "DESC"), _pct("interest_cover", _PEER), _pct("debt_trend", _PEER, "DESC")),
    "q_cash_quality": _mean_sql(_pct("cfo_to_pat", _PEER), "fcf_positive * 100"),
    "q_valuation": _mean_sql(_pct("peg", _PEER, "DESC"), _pct("pe", _PEER, "DESC")),
}
_V = {
    "multiples": _mean_sql(*[_pct(c, _PEER, "DESC") for c in ("pe", "pb", "ev_ebitda", "ev_sales")]),
    "own_history": "CASE WHEN pe / nullif(pe_5y_median, 0) IS NOT NULL THEN greatest(0, least(100, 200 * (1 - pe / nullif(pe_5y_median, 0)) + 50)) END",
    "earnings_yield": "CASE WHEN pe > 0 THEN greatest(0, least(100, 12 * (100 / pe - 6.5) + 50)) END",
    "turnaround": "CASE WHEN margin_expanding THEN 100.0 ELSE 25.0 END::DOUBLE",
    "dividend": "NULL::DOUBLE",
}
_R = {
    "r_surprise": _pct("sue_pat", _PEER),
    "r_acceleration": _mean_sql(_pct("accel_pat", _PEER), _pct("accel_revenue", _PEER)),
    "r_revenue_surprise": _pct("sue_revenue", _PEER),
    "r_margin_revision": _pct("margin_revision", _PEER),
    "r_consistency": "consistency * 100",
}
_O = {
    "o_promoter": _blend_sql({_pct("promoter_delta_4q", _PEER): 0.65, _pct("promoter_delta_1q", _PEER): 0.35}),
    "o_fii": _blend_sql({_pct("fii_delta_4q", _PEER): 0.6, _pct("fii_delta_2q", _PEER): 0.4}),
    "o_dii": _pct("dii_delta_4q", _PEER),
}
_T = {k: v.replace("PARTITION BY peer", f"PARTITION BY {_PEER}") for k, v in _M.items()}
_PARTS = ", ".join(f"{v} AS {k}" for k, v in (_Q | _V | _R | _O | _T).items())
_TECH = f"bars AS (SELECT * FROM nbars), idx AS (SELECT date, avg(close) AS close FROM bars GROUP BY date), {_CHAIN.replace('d AS (', 'dx0 AS (', 1).replace('FROM d)', 'FROM dx0)', 1)}, tk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM tech)"
_SCORED = f"""{_TECH}, {sm.STATEMENTS}, {_KNOWN},
pp AS (SELECT *, {_PARTS} FROM (SELECT kn.*, tk.* EXCLUDE (symbol, i, close) FROM kn JOIN tk USING (symbol, i))),
sc AS (SELECT *, CASE WHEN is_financial THEN {_blend_sql(scoring.QUALITY_LENDER, 0.5)} ELSE {_blend_sql(scoring.QUALITY, 0.5)} END AS quality_score, {_blend_sql(scoring.VALUE, 0.5)} AS value_score, {_blend_sql({f'r_{k}': w for k, w in scoring.REVISION.items()}, 0.5)} AS revision_score, {_blend_sql(scoring.OWNERSHIP)} AS ownership_score,
  CASE WHEN close < sma200 AND raw > 40 THEN 40 ELSE raw END AS tm_score FROM (SELECT *, {_blend_sql(_WEIGHTS, scoring.MOMENTUM_COVERAGE)} AS raw FROM pp))"""
_N = "n AS (SELECT symbol, date, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM nbars)"


@query(f"SELECT as_of, symbol, {r6(*METRICS)}, {r6(*MOVES)}, margin_expanding, excluded FROM kn", views="nbars", more=f"{_N}, {_AT}, {sm.STATEMENTS}, {_KNOWN}")
def j18_metrics_as_filed(m: Market) -> DataFrame:
    """Growth, quality, valuation, revision and ownership inputs and the gates of each member, from what was filed by each month end."""
    return known(m, cut(m.nation_bars(), "symbol")).select("as_of", "symbol", *METRICS, *MOVES, "margin_expanding", "excluded")


@query(f"SELECT as_of, symbol, sector, excluded, {r6(*SCORES)} FROM sc", views="nbars", more=f"{_N}, {_AT}, {_SCORED}")
def j18_pillars_as_filed(m: Market) -> DataFrame:
    """The five pillar scores of each member at each month end."""
    return scored(m, cut(m.nation_bars(), "symbol")).select("as_of", "symbol", "sector", "excluded", *SCORES)


_TESTED = [f for f in FEATURES if f != "ts_score"]


def _renamed(sql: str) -> str:
    """The same tables over the long bars, under names of their own."""
    return re.sub(r"\b(nbars|n|walk|piv|d|t|w1|w2|rs|rec|pri|fnd)\b", r"l_\1", sql)


def _flags_at(timeframe: str, source: str, place: str) -> str:
    hit = f"i - confirmed <= {dv.MEMORY_BARS[timeframe]}"
    return f"(SELECT symbol, i AS {place}, bool_or(kind = 'bullish' AND {hit})::INT::DOUBLE AS rsi_div_bullish_{timeframe}, bool_or(kind = 'bearish' AND {hit})::INT::DOUBLE AS rsi_div_bearish_{timeframe} FROM {source} GROUP BY 1, 2)"


_LONG = f"l_nbars AS (SELECT symbol, max(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM nbars GROUP BY symbol, floor((date - DATE '1970-01-01') / 28)), {_renamed(f'{_PIVOTS}, {NTR}, {_RS}, ' + _found_sql('weekly'))}"
_PANEL = f"""{OVERHEAD_SQL}, {_RS}, {_found_sql('daily')}, {_LONG}, {_SCORED.replace('w1 AS', 'v1 AS').replace('w2 AS', 'v2 AS').replace('FROM w1', 'FROM v1').replace('FROM w2', 'FROM v2').replace('t AS (SELECT *, greatest(high', 'tt AS (SELECT *, greatest(high').replace('FROM t)', 'FROM tt)')},
fw AS (SELECT symbol, row_number() OVER w - 1 AS i, date, lead(close, {HOLD}) OVER w / CASE WHEN lead(open, 1) OVER w > 0 THEN lead(open, 1) OVER w END - 1 AS forward_return FROM nbars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
pan AS (SELECT s.as_of, s.symbol, s.sector, {', '.join(f'coalesce({f}, 0)::DOUBLE AS {f}' if f in DIVERGENCE else f'{f}::DOUBLE AS {f}' for f in _TESTED)}, forward_return FROM sc s JOIN (SELECT * EXCLUDE (i, open, high, low, close) FROM ov) o USING (as_of, symbol) JOIN fw f ON f.symbol = s.symbol AND f.i = s.i
  LEFT JOIN {_flags_at('daily', 'fnd', 'di')} x ON x.symbol = s.symbol AND x.di = s.i ASOF LEFT JOIN (SELECT symbol, date AS ld, i AS li FROM l_n) g ON g.symbol = s.symbol AND g.ld <= f.date LEFT JOIN {_flags_at('weekly', 'l_fnd', 'wi')} y ON y.symbol = s.symbol AND y.wi = g.li AND g.li >= 30
  WHERE NOT excluded AND forward_return IS NOT NULL)"""


@query(f"SELECT as_of, symbol, sector, {r6(*_TESTED)}, round(forward_return, 6) AS forward_return FROM pan", views="nbars", more=_PANEL, recursive=True)
def j20_wide_panel(m: Market) -> DataFrame:
    """All features of the panel but the setup's score, and the forward return."""
    return wide_panel(m, cut(m.nation_bars(), "symbol")).select("as_of", "symbol", "sector", *_TESTED, "forward_return")


@query()
def j20_full_panel(m: Market) -> DataFrame:
    """The panel with the setup's score, the better technical score and which setup won."""
    x = wide_panel(m, cut(m.nation_bars(), "symbol"))
    return x.select("as_of", "symbol", "sector", *FEATURES, "setup_status", "technical", "winning_setup", "forward_return")


_SIGNED = f"sg AS (SELECT as_of, symbol, forward_return, feature, value * sign AS value FROM (UNPIVOT pan ON {', '.join(_TESTED)} INTO NAME feature VALUE value) JOIN (VALUES {', '.join(f'({f!r}, {FEATURES[f]})' for f in _TESTED)}) v(feature, sign) USING (feature))"


def signed(panel: DataFrame, features: dict[str, int]) -> DataFrame:
    """The panel with each feature turned so that theory says more is better."""
    return panel.withColumns({f: F.col(f).cast("double") * s for f, s in features.items()})


_EXACT = "((count(*) * sum(4 * a * b) - sum(2 * a) * sum(2 * b)) / nullif(sqrt((count(*) * sum(4 * a * a) - sum(2 * a) * sum(2 * a)) * (count(*) * sum(4 * b * b) - sum(2 * b) * sum(2 * b))), 0))"
_SIGNED_IC = _ic("sg", "value", "feature, as_of").replace(">= 30", f">= {LEAST_NAMES}").replace("corr(a, b)", _EXACT)


@query(f"SELECT feature, {_COLS} FROM ({_nw(_SIGNED_IC, 'ic', 'feature')})", views="nbars", more=f"{_PANEL}, {_SIGNED}", recursive=True)
def e10_signed_features(m: Market) -> DataFrame:
    """Each feature on its own, signed as theory has it: its rank correlation with the forward return over the dates."""
    panel = cut(wide_panel(m, cut(m.nation_bars(), "symbol")).select(*pt.KEYS, "forward_return", *_TESTED))
    return rs.feature_ic(signed(panel, {f: FEATURES[f] for f in _TESTED}), _TESTED, least=LEAST_NAMES)


# The features of conviction as the panel names them.
CONVICTION = {
    "false_breakout": 1, "hanging_man_at_resistance": 1, "rejected_at_resistance": 1, "shooting_star_at_resistance": 1, "bearish_engulfing_at_resistance": 1, "doji_at_resistance": 1, "resistance_strength": 1, "tm_score": 1,
    "zone_respect": 1, "value_score": 1, "headroom": -1, "ownership_score": -1, "margin_revision": -1,
}
_RANKS = [f"({_avg_rank(f'x_{f}', 'as_of')}) / count(x_{f}) OVER (PARTITION BY as_of)" for f in CONVICTION]


@query(
    f"SELECT as_of, symbol, CAST(n AS INTEGER) AS features, round(CASE WHEN n >= {scoring.MIN_FEATURES} THEN list_avg(r) * 100 END, 6) AS conviction FROM (SELECT *, len(list_filter(r, lambda v: v IS NOT NULL)) AS n FROM (SELECT as_of, symbol, [{', '.join(_RANKS)}] AS r FROM (SELECT as_of, symbol, {', '.join(f'{f} * {s} AS x_{f}' for f, s in CONVICTION.items())} FROM pan)))",
    views="nbars",
    more=_PANEL,
    recursive=True,
)
def j16_conviction_as_filed(m: Market) -> DataFrame:
    """Conviction on its thirteen features at each month end."""
    panel = wide_panel(m, cut(m.nation_bars(), "symbol")).select(*pt.KEYS, *CONVICTION)
    x = scoring.conviction(panel, "as_of", features=CONVICTION)
    return x.select("as_of", "symbol", F.size("drivers").alias("features"), "conviction")
