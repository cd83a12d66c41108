"""The whole technicals row and the momentum pillar on it (sections F, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import indicators as ind, scoring
from ..operators.endpoints import last_technicals
from ..plans.views import Market
from .cross import _pct
from .pillars import _blend_sql, _mean_sql
from .prices import _TR, OVER, _ema_sql, _roll, _wilder_sql
from .registry import query, r6

_CHAIN = f"""{_TR}, w1 AS ({_wilder_sql('gain', 14, 't', 'ag')}), w2 AS ({_wilder_sql('loss', 14, 'w1', 'al')}), w3 AS ({_wilder_sql('pdm', 14, 'w2', 'sp')}), w4 AS ({_wilder_sql('mdm', 14, 'w3', 'sm')}), w5 AS ({_wilder_sql('tr', 14, 'w4', 'atr14')}),
di AS (SELECT *, 100 * sp / nullif(atr14, 0) AS p_di, 100 * sm / nullif(atr14, 0) AS m_di FROM w5), dxs AS (SELECT *, 100 * abs(p_di - m_di) / nullif(p_di + m_di, 0) AS dx FROM di), w6 AS ({_wilder_sql('dx', 14, 'dxs', 'adx14')}),
e1 AS ({_ema_sql('close', 12, 'w6', 'f')}), e2 AS ({_ema_sql('close', 26, 'e1', 's')}), ln AS (SELECT *, f - s AS line FROM e2), e3 AS ({_ema_sql('line', 9, 'ln', 'sig')}),
j1 AS (SELECT b.*, i.close AS iclose, b.close * b.volume / 1e7 AS value FROM e3 b LEFT JOIN idx i USING (date)),
t1 AS (SELECT *, {_roll('avg', 'close', 20)} AS sma20, {_roll('avg', 'close', 50)} AS sma50, {_roll('avg', 'close', 200)} AS sma200, {_roll('avg', 'close', 250)} AS wma50, {_roll('max', 'close', 126, 63)} AS peak, {_roll('max', 'high', 252, 126)} AS top,
  {_roll('avg', 'volume', 20)} AS v20, {_roll('avg', 'volume', 100)} AS v100, last_value(iclose IGNORE NULLS) {OVER} AS filled FROM j1),
t2 AS (SELECT *, (peak - close) / nullif(peak, 0) AS dd FROM t1),
tech AS (SELECT symbol, date, close, sma20, sma50, sma200, wma50, (sma200 - lag(sma200, 21) {OVER}) / nullif(abs(lag(sma200, 21) {OVER}), 0) AS sma200_slope,
  CASE WHEN ag IS NULL THEN NULL WHEN ag = 0 AND al = 0 THEN 50 WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi14, line - sig AS macd_hist, adx14, atr14, atr14 / nullif(close, 0) AS atr_pct,
  close / nullif(lag(close, 21) {OVER}, 0) - 1 AS ret_1m, close / nullif(lag(close, 63) {OVER}, 0) - 1 AS ret_3m, close / nullif(lag(close, 126) {OVER}, 0) - 1 AS ret_6m, close / nullif(lag(close, 252) {OVER}, 0) - 1 AS ret_12m,
  lag(close, 21) {OVER} / nullif(lag(close, 252) {OVER}, 0) - 1 AS mom_12_1, (close / nullif(lag(close, 126) {OVER}, 0)) / nullif(filled / nullif(lag(filled, 126) {OVER}, 0), 0) - 1 AS rs_vs_index,
  (top - close) / nullif(top, 0) AS dist_52w_high, v20 / nullif(v100, 0) AS vol_ratio_20_100, {_roll('max', 'dd', 126, 63)} AS max_dd_6m,
  CASE WHEN count(value) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) >= 20 THEN quantile_cont(value, 0.5) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS turnover_60d_cr FROM t2)"""


@query(f"SELECT symbol, date, {r6(*ind.TECHNICALS)} FROM tech", views="bars idx", more=_CHAIN)
def f17_all_technicals(m: Market) -> DataFrame:
    return ind.technicals(m.bars(), m.index_prices()).select("symbol", "date", *ind.TECHNICALS)


_BAND = "CASE WHEN rsi14 IS NULL THEN NULL ELSE greatest(0, least(100, CASE WHEN rsi14 < 55 THEN (rsi14 - 35) / 20 * 100 WHEN rsi14 > 75 THEN (90 - rsi14) / 15 * 100 ELSE 100 END)) END"
_M = {
    "momentum": _mean_sql(_pct("mom_12_1", "peer"), _pct("rs_vs_index", "peer")),
    "trend": "CASE WHEN sma50 IS NOT NULL AND sma200 IS NOT NULL AND sma200_slope IS NOT NULL THEN 40.0 * (close > sma200)::INT + 20 * (close > sma50)::INT + 20 * (sma50 > sma200)::INT + 20 * (sma200_slope > 0)::INT END",
    "proximity": _pct("dist_52w_high", "peer", "DESC"),
    "volume_score": _pct("vol_ratio_20_100", "peer"),
    "oscillators": _mean_sql(_BAND, "CASE WHEN macd_hist IS NOT NULL THEN 100.0 * (macd_hist > 0)::INT END", "CASE WHEN adx14 IS NOT NULL THEN greatest(0, least(100, (adx14 - 15) / 20 * 100)) END"),
    "volatility": _mean_sql(_pct("atr_pct", "peer", "DESC"), _pct("max_dd_6m", "peer", "DESC")),
}
_WEIGHTS = {("volume_score" if k == "volume" else k): w for k, w in scoring.MOMENTUM.items()}


@query(
    f"SELECT symbol, peer, {r6(*_M)}, round(CASE WHEN close < sma200 AND raw > 40 THEN 40 ELSE raw END, 6) AS tm_score FROM (SELECT *, {_blend_sql(_WEIGHTS, scoring.MOMENTUM_COVERAGE)} AS raw FROM (SELECT symbol, peer, close, sma200, {', '.join(f'{v} AS {k}' for k, v in _M.items())} FROM y))",
    views="bars stocks idx",
    more=f"{_CHAIN}, y AS (SELECT t.*, CASE WHEN s.sector IS NULL OR count(*) OVER (PARTITION BY s.sector) < 10 THEN '__POOLED__' ELSE s.sector END AS peer FROM (SELECT * FROM tech QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) t JOIN stocks s USING (symbol))",
)
def j15_momentum_pillar(m: Market) -> DataFrame:
    x = last_technicals(m.bars(), m.index_prices()).join(m.stocks(), "symbol")
    return scoring.momentum_score(x).select("symbol", "peer", *_M, "tm_score")
