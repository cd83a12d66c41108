"""Queries on the point-in-time panel (sections D, E, F, G, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import research as rs, resample, scoring
from ..operators.endpoints import month_end_features
from ..plans.cut import cut
from ..plans.views import Market
from .cross import _DECILE, _FEAT, _avg_rank
from .prices import OVER
from .registry import query

_PANEL = f"""{_FEAT}, fwd AS (SELECT *, lead(close, 126) {OVER} / nullif(lead(open, 1) {OVER}, 0) - 1 AS forward_return, row_number() {OVER} AS nth FROM feat),
  me AS (SELECT max(date) AS as_of FROM (SELECT date, CAST(date_trunc('month', date) AS DATE) AS mth, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)) WHERE rn > 252 AND rn <= n - 126 GROUP BY mth),
  panel AS (SELECT me.as_of, f.symbol, s.sector, mom, ret3, dist, vr, forward_return FROM (SELECT as_of, symbol AS sy FROM me, stocks) me ASOF JOIN fwd f ON f.symbol = me.sy AND f.date <= me.as_of JOIN stocks s ON s.symbol = f.symbol WHERE f.nth >= 252)"""
FEATURES = ["mom", "ret3", "dist", "vr"]


def panel(m: Market) -> DataFrame:
    """(as_of, symbol): features of the last bar at each month end and its forward return."""
    bars = m.bars()
    ends = resample.month_ends(bars.select("date").distinct(), 252, 126).select(F.col("date").alias("as_of"))
    return month_end_features(bars, ends).join(m.stocks().select("symbol", "sector"), "symbol")


@query("SELECT as_of, symbol, sector, round(mom, 6) AS mom, round(ret3, 6) AS ret3, round(dist, 6) AS dist, round(vr, 6) AS vr, round(forward_return, 6) AS forward_return FROM panel", views="bars stocks", more=_PANEL)
def j20_panel(m: Market) -> DataFrame:
    return panel(m).select("as_of", "symbol", "sector", *FEATURES, "forward_return")


def _ic(src: str, x: str, keys: str) -> str:
    return f"(SELECT {keys}, corr(a, b) AS ic, count(*) AS names FROM (SELECT {keys}, {_avg_rank(x, keys)} AS a, {_avg_rank('forward_return', keys)} AS b FROM {src} WHERE {x} IS NOT NULL AND forward_return IS NOT NULL) GROUP BY {keys} HAVING count(*) >= 30 AND corr(a, b) IS NOT NULL AND NOT isnan(corr(a, b)))"


@query(f"SELECT as_of, round(ic, 6) AS ic, names FROM {_ic('panel', 'mom', 'as_of')}", views="bars stocks", more=_PANEL)
def e09_date_ic(m: Market) -> DataFrame:
    return rs.date_ic(panel(m), "mom")


def _nw(src: str, x: str, g: str = "") -> str:
    p = f"PARTITION BY {g}" if g else ""
    lags = ", ".join(f"e * lag(e, {k}) OVER ({p} ORDER BY as_of) AS p{k}" for k in range(1, 6))
    sums = ", ".join(f"sum(p{k}) AS g{k}" for k in range(1, 6))
    terms = " + ".join(f"2 * (1 - {k} / 6.0) * coalesce(g{k} / n, 0)" for k in range(1, 6))
    key = f"{g}, " if g else ""
    group = f"GROUP BY {g}" if g else ""
    return (
        f"SELECT {key}n, mean, sd / sqrt(n) AS naive_se, nw_se, mean / nullif(nw_se, 0) AS nw_t, share_positive FROM (SELECT *, CASE WHEN n >= 4 THEN sqrt(greatest(g0 + {terms}, 1e-12) / n) END AS nw_se FROM ("
        f"SELECT {key}count({x}) AS n, avg({x}) AS mean, stddev_samp({x}) AS sd, avg(({x} > 0)::DOUBLE) AS share_positive, avg(e * e) AS g0, {sums} FROM (SELECT *, {lags} FROM (SELECT *, {x} - avg({x}) OVER ({p}) AS e FROM {src})) {group})) WHERE n >= 3"
    )


_COLS = "n, round(mean, 6) AS mean, round(naive_se, 6) AS naive_se, round(nw_se, 6) AS nw_se, round(nw_t, 6) AS nw_t, round(share_positive, 6) AS share_positive"


@query(f"SELECT {_COLS} FROM ({_nw(_ic('panel', 'mom', 'as_of'), 'ic')})", views="bars stocks", more=_PANEL)
def e11_newey_west(m: Market) -> DataFrame:
    return rs.information_coefficient(panel(m), "mom")


_LONG = "long AS (SELECT * FROM (UNPIVOT (SELECT as_of, symbol, forward_return, mom, ret3, dist, vr FROM panel) ON mom, ret3, dist, vr INTO NAME feature VALUE value))"


@query(f"SELECT feature, {_COLS} FROM ({_nw(_ic('long', 'value', 'feature, as_of'), 'ic', 'feature')})", views="bars stocks", more=f"{_PANEL}, {_LONG}")
def e10_feature_ic(m: Market) -> DataFrame:
    return rs.feature_ic(panel(m), FEATURES)


_CUT = "1999-01-01"


@query(
    f"""SELECT feature, sign(a.mean)::DOUBLE AS sign, round(a.mean, 6) AS train_ic, round(a.nw_t, 6) AS train_t, round(b.mean, 6) AS test_ic, round(b.nw_t, 6) AS test_t, abs(a.nw_t) >= 2 AS selected, sign(b.mean) = sign(a.mean) AS held
    FROM ({_nw(_ic("(SELECT * FROM long WHERE as_of < DATE '" + _CUT + "')", 'value', 'feature, as_of'), 'ic', 'feature')}) a LEFT JOIN ({_nw(_ic("(SELECT * FROM long WHERE as_of >= DATE '" + _CUT + "')", 'value', 'feature, as_of'), 'ic', 'feature')}) b USING (feature)""",
    views="bars stocks",
    more=f"{_PANEL}, {_LONG}",
)
def e13_e15_e23_holdout(m: Market) -> DataFrame:
    return rs.holdout(panel(m), FEATURES, _CUT)


@query(
    f"SELECT as_of, symbol, round(avg(r), 6) AS composite FROM (SELECT as_of, symbol, feature, ({_avg_rank('v', 'as_of, feature')}) / count(v) OVER (PARTITION BY as_of, feature) AS r FROM (SELECT as_of, symbol, feature, CASE WHEN feature = 'dist' THEN -value ELSE value END AS v FROM long WHERE feature IN ('mom', 'dist'))) GROUP BY 1, 2",
    views="bars stocks",
    more=f"{_PANEL}, {_LONG}",
)
def e14_composite(m: Market) -> DataFrame:
    return rs.composite(panel(m), {"mom": 1, "dist": -1}).select("as_of", "symbol", "composite")


_DEC = f"dec AS (SELECT *, {_DECILE.format(x='mom', p='PARTITION BY as_of', q='as_of,')} AS decile FROM panel)"
_STUDY = "study AS (SELECT decile, count(forward_return) AS n, avg(forward_return) AS mean, quantile_cont(forward_return, 0.5) AS median, avg((forward_return > 0)::DOUBLE) AS hit_rate, avg((forward_return >= 0.25)::DOUBLE) AS hit_rate_25pct, quantile_cont(forward_return, 0.1) AS p10, quantile_cont(forward_return, 0.9) AS p90 FROM dec WHERE decile IS NOT NULL AND forward_return IS NOT NULL GROUP BY decile HAVING count(forward_return) >= 20)"


@query("SELECT as_of, symbol, decile FROM dec", views="bars stocks", more=f"{_PANEL}, {_DEC}")
def f21_date_deciles(m: Market) -> DataFrame:
    return rs.with_deciles(panel(m), "mom").select("as_of", "symbol", "decile")


@query("SELECT decile, n, round(mean, 6) AS mean, round(median, 6) AS median, round(hit_rate, 6) AS hit_rate, round(hit_rate_25pct, 6) AS hit_rate_25pct, round(p10, 6) AS p10, round(p90, 6) AS p90 FROM study", views="bars stocks", more=f"{_PANEL}, {_DEC}, {_STUDY}")
def e07_decile_study(m: Market) -> DataFrame:
    return rs.decile_study(rs.with_deciles(panel(m), "mom"), "decile")


@query(
    f"SELECT deciles, round(rm, 6) AS rho_median, round(rh, 6) AS rho_hit, round(spread, 6) AS spread, CASE WHEN rm >= 0.6 THEN 'ranks' WHEN rm >= 0.3 THEN 'weak' WHEN rm > -0.3 THEN 'none' ELSE 'inverted' END AS verdict FROM (SELECT count(*) AS deciles, corr(d, m) AS rm, corr(d, h) AS rh, arg_max(median, decile) - arg_min(median, decile) AS spread FROM (SELECT *, {_avg_rank('decile', '')} AS d, {_avg_rank('median', '')} AS m, {_avg_rank('hit_rate', '')} AS h FROM study)) WHERE deciles >= 4",
    views="bars stocks",
    more=f"{_PANEL}, {_DEC}, {_STUDY}",
)
def e08_rank_quality(m: Market) -> DataFrame:
    return rs.rank_quality(rs.decile_study(rs.with_deciles(panel(m), "mom"), "decile"))


_TRADES = "trades AS (SELECT as_of, symbol, sector, forward_return - 0.004 AS net_return FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY mom DESC, symbol) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY as_of, sector ORDER BY mom DESC, symbol) AS k FROM panel WHERE mom IS NOT NULL) WHERE k <= 5) WHERE pick <= 20)"


def trades(m: Market) -> DataFrame:
    """Top 20 by momentum at each month end, sector cap 25%, round-trip cost 0.4%."""
    picks = scoring.capped_top(panel(m), "mom", 20, 0.25, "as_of")
    return picks.withColumn("net_return", F.col("forward_return") - 0.004)


@query("SELECT as_of, symbol, sector, round(net_return, 6) AS net_return FROM trades", views="bars stocks", more=f"{_PANEL}, {_TRADES}")
def j19_simulate(m: Market) -> DataFrame:
    return trades(m).select("as_of", "symbol", "sector", "net_return")


@query(
    """SELECT t.*, rebalances, round(mean_per_hold, 6) AS mean_per_hold, round(max_drawdown, 6) AS max_drawdown, drawdown_periods, round(pow(1 + mean_per_hold, 252.0 / 126) - 1, 6) AS annualised FROM
    (SELECT count(*) AS trades, round(quantile_cont(net_return, 0.5), 6) AS median_return, round(avg(net_return), 6) AS mean_return, round(avg((net_return > 0)::DOUBLE), 6) AS hit_rate, round(avg((net_return >= 0.25)::DOUBLE), 6) AS hit_rate_25pct,
      round(quantile_cont(net_return, 0.5) FILTER (net_return > 0), 6) AS median_winner, round(quantile_cont(net_return, 0.5) FILTER (net_return <= 0), 6) AS median_loser, round(min(net_return), 6) AS worst, round(max(net_return), 6) AS best, round(quantile_cont(net_return, 0.1), 6) AS p10 FROM trades WHERE net_return IS NOT NULL) t,
    (SELECT count(*) AS rebalances, avg(m) AS mean_per_hold FROM per),
    (SELECT max((peak - eq) / peak) AS max_drawdown, count(*) AS drawdown_periods FROM (SELECT *, max(eq) OVER (ORDER BY as_of) AS peak FROM (SELECT as_of, exp(sum(ln(1 + m)) OVER (ORDER BY as_of)) AS eq FROM (SELECT *, row_number() OVER (ORDER BY as_of) - 1 AS i FROM per) WHERE i % 6 = 0)))""",
    views="bars stocks",
    more=f"{_PANEL}, {_TRADES}, per AS (SELECT as_of, avg(net_return) AS m FROM trades WHERE net_return IS NOT NULL GROUP BY as_of)",
)
def e05_summary(m: Market) -> DataFrame:
    return rs.summary(trades(m), 126)


@query("SELECT sector, n, round(mean, 6) AS mean, round(median, 6) AS median FROM (SELECT sector, count(*) AS n, avg(net_return) AS mean, quantile_cont(net_return, 0.5) AS median FROM trades WHERE net_return IS NOT NULL GROUP BY GROUPING SETS ((sector), ()) HAVING count(*) >= 5)", views="bars stocks", more=f"{_PANEL}, {_TRADES}")
def e06_block_stats(m: Market) -> DataFrame:
    t = trades(m).where("net_return is not null")
    return t.rollup("sector").agg(F.count("*").alias("n"), F.avg("net_return").alias("mean"), F.median("net_return").alias("median")).where("n >= 5")


_GRID = "grid AS (SELECT q AS wq, v AS wv, 100 - q - v AS wt FROM range(0, 101, 10) a(q), range(0, 101, 10) b(v) WHERE q + v <= 100 UNION SELECT 5, 45, 50), cand AS (SELECT panel.*, wq, wv, wt, (coalesce(mom, 0) * wq + coalesce(ret3, 0) * wv + coalesce(vr, 0) * wt) / nullif(CASE WHEN mom IS NULL THEN 0 ELSE wq END + CASE WHEN ret3 IS NULL THEN 0 ELSE wv END + CASE WHEN vr IS NULL THEN 0 ELSE wt END, 0) AS blended FROM panel, grid)"


@query("SELECT wq::INT AS q, wv::INT AS v, wt::INT AS t, count(blended) AS scored, round(avg(blended), 6) AS mean_blended FROM cand GROUP BY ALL", views="bars stocks", more=f"{_PANEL}, {_GRID}")
def g10_weight_grid(m: Market) -> DataFrame:
    """Every candidate of the grid with the rows of the panel that it scores."""
    scored = rs.blended(panel(m), rs.weight_grid(m.spark), "mom", "ret3", "vr")
    return scored.groupBy(F.col("wq").alias("q"), F.col("wv").alias("v"), F.col("wt").alias("t")).agg(F.count("blended").alias("scored"), F.avg("blended").alias("mean_blended"))


@query(f"SELECT wq::INT AS wq, wv::INT AS wv, wt::INT AS wt, {_COLS} FROM ({_nw(_ic('cand', 'blended', 'wq, wv, wt, as_of'), 'ic', 'wq, wv, wt')})", views="bars stocks", more=f"{_PANEL}, {_GRID}")
def g11_weight_search(m: Market) -> DataFrame:
    return rs.weight_search(panel(m), rs.weight_grid(m.spark), "mom", "ret3", "vr")


_KEYS = "period, wq, wv, wt"
_HALVES = f"""{_GRID.split(', cand AS')[0]}, cutd AS (SELECT CASE WHEN len(d) >= 4 THEN d[len(d) // 2 + 1] END AS cut FROM (SELECT list(as_of ORDER BY as_of) AS d FROM (SELECT DISTINCT as_of FROM panel))),
pp AS (SELECT panel.*, unnest(['all', CASE WHEN cut IS NULL OR as_of < cut THEN 'first' ELSE 'second' END]) AS period FROM panel, cutd),
cand AS MATERIALIZED (SELECT pp.*, wq, wv, wt, (coalesce(mom, 0) * wq + coalesce(ret3, 0) * wv + coalesce(vr, 0) * wt) / nullif(CASE WHEN mom IS NULL THEN 0 ELSE wq END + CASE WHEN ret3 IS NULL THEN 0 ELSE wv END + CASE WHEN vr IS NULL THEN 0 ELSE wt END, 0) AS blended FROM pp, grid),
ics AS (SELECT * FROM ({_nw(_ic('cand', 'blended', _KEYS + ', as_of'), 'ic', _KEYS)})),
dcs AS (SELECT *, {_DECILE.format(x='blended', p=f'PARTITION BY {_KEYS}, as_of', q=f'{_KEYS}, as_of,')} AS decile FROM cand WHERE blended IS NOT NULL),
pd AS (SELECT {_KEYS}, decile, quantile_cont(forward_return, 0.5) AS median, avg((forward_return >= 0.25)::DOUBLE) AS hit25, quantile_cont(forward_return, 0.1) AS p10 FROM dcs WHERE decile IS NOT NULL AND forward_return IS NOT NULL GROUP BY {_KEYS}, decile HAVING count(forward_return) >= 20),
sy AS (SELECT {_KEYS}, CASE WHEN NOT isnan(corr(d, m)) THEN corr(d, m) END AS median_rho, CASE WHEN NOT isnan(corr(d, h)) THEN corr(d, h) END AS hit_rho, arg_max(median, decile) - arg_min(median, decile) AS spread, arg_max(median, decile) AS top_median, arg_max(hit25, decile) AS top_hit25, arg_max(p10, decile) AS top_p10, arg_min(hit25, decile) AS bottom_hit25
  FROM (SELECT *, {_avg_rank('decile', _KEYS)} AS d, {_avg_rank('median', _KEYS)} AS m, {_avg_rank('hit25', _KEYS)} AS h FROM pd) GROUP BY {_KEYS} HAVING count(*) >= 4),
ev AS (SELECT sy.*, n, mean, naive_se, nw_se, nw_t, share_positive FROM sy LEFT JOIN ics USING ({_KEYS}))"""
_R6 = lambda *c: ", ".join(f"round(a.{x}, 6) AS {x}" for x in c)


@query(
    f"SELECT a.wq::INT AS wq, a.wv::INT AS wv, a.wt::INT AS wt, {_R6('median_rho', 'hit_rho', 'spread', 'top_median', 'top_hit25', 'top_p10', 'bottom_hit25', 'mean', 'naive_se', 'nw_se', 'nw_t', 'share_positive')}, a.n, CASE WHEN round(a.median_rho, 9) >= 0.6 THEN 'ranks' WHEN round(a.median_rho, 9) >= 0.3 THEN 'weak' WHEN round(a.median_rho, 9) > -0.3 THEN 'none' ELSE 'inverted' END AS verdict, round(f.mean, 6) AS ic_first_half, round(f.median_rho, 6) AS rho_first_half, round(s.mean, 6) AS ic_second_half, round(s.median_rho, 6) AS rho_second_half, coalesce(f.mean > 0 AND s.mean > 0, false) AS stable"
    " FROM (SELECT * FROM ev WHERE period = 'all') a LEFT JOIN (SELECT * FROM ev WHERE period = 'first') f USING (wq, wv, wt) LEFT JOIN (SELECT * FROM ev WHERE period = 'second') s USING (wq, wv, wt)",
    views="bars stocks",
    more=f"{_PANEL}, {_HALVES}",
)
def g11_weight_search_halves(m: Market) -> DataFrame:
    """The whole grid in steps of 10 and the incumbent, over all dates and both halves."""
    return rs.weight_search_halves(cut(panel(m)), rs.weight_grid(m.spark), "mom", "ret3", "vr")
