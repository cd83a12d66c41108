"""Queries on the pillar scores and their inputs (sections I, J).

Quarters stand for statements: cash flow, debt and holdings are fixed functions of
revenue and profit, so that every input has a history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import histories as hs, scoring
from ..plans.views import Market
from .cross import _pct
from .registry import query, r6
from .tables import _LATEST, latest

_HIST = """hist AS (SELECT symbol, list(revenue ORDER BY period_end) AS rev, list(pat ORDER BY period_end) AS pat, list(pat / revenue ORDER BY period_end) AS opm, list(pat + 0.1 * revenue ORDER BY period_end) AS cfo, list(0.4 * revenue - pat ORDER BY period_end) AS debt,
  list(40 + 20 * pat / revenue ORDER BY period_end) AS promoter, list(15 + (floor(revenue)::BIGINT % 97) / 10.0 ORDER BY period_end) AS fii, list(10 + (floor(revenue)::BIGINT % 89) / 10.0 ORDER BY period_end) AS dii FROM quarters GROUP BY symbol),
base AS (SELECT h.*, s.sector, s.mcap, l.close, CASE WHEN s.sector IS NULL OR count(*) OVER (PARTITION BY s.sector) < 10 THEN '__POOLED__' ELSE s.sector END AS peer, pat[-1] + pat[-2] + pat[-3] + pat[-4] AS tpat, rev[-1] + rev[-2] + rev[-3] + rev[-4] AS trev FROM hist h JOIN stocks s USING (symbol) JOIN latest l USING (symbol)),
based AS (SELECT *, CASE WHEN tpat > 0 THEN close / (tpat / 1e5) END AS pe FROM base)"""


def base(m: Market, held: bool = False) -> DataFrame:
    """symbol, sector, mcap, close, the histories and trailing sums; those of holdings if ``held``."""
    q = m.quarters(whole=held).withColumns(
        {
            "opm": F.col("pat") / F.col("revenue"),
            "cfo": F.col("pat") + 0.1 * F.col("revenue"),
            "debt": 0.4 * F.col("revenue") - F.col("pat"),
        }
    )
    names = ("revenue", "pat", "opm", "cfo", "debt")
    if held:
        whole = F.col("whole")
        q = q.withColumns({"promoter": 40 + 20 * F.col("pat") / F.col("revenue"), "fii": 15 + (whole % 97) / 10.0, "dii": 10 + (whole % 89) / 10.0})
        names += ("promoter", "fii", "dii")
    h = q.groupBy("symbol").agg(*[hs.history(q, c) for c in names]).withColumnRenamed("opm", "opm_history")
    x = h.join(m.stocks().select("symbol", "sector", "mcap"), "symbol").join(latest(m).select("symbol", "close"), "symbol")
    x = x.withColumns({"tpat": hs.trailing("pat"), "trev": hs.trailing("revenue")})
    return x.withColumn("pe", F.when(F.col("tpat") > 0, F.col("close") / (F.col("tpat") / 1e5)))


def quality_inputs(m: Market) -> DataFrame:
    x = base(m).withColumns({"quarterly_pat": F.col("pat"), "is_financial": F.col("sector") == "ASIA", "fcf": hs.at("cfo", 1) - 0.15 * hs.at("revenue", 1)})
    x = x.withColumns({"roe": F.col("tpat") / 1e6, "roce": F.col("tpat") / F.col("trev"), "debt_equity": hs.at("debt", 1) / 1e6, "interest_cover": F.col("tpat") / F.nullif(0.05 * hs.at("debt", 1), F.lit(0.0))})
    return hs.quality_metrics(x)


_CAGR = "CASE WHEN len({a}) >= 4 AND {a}[-4] > 0 AND {a}[-1] > 0 THEN pow({a}[-1] / {a}[-4], 1.0 / 3) - 1 END"
_QIN = f"""qi AS (SELECT *, CASE WHEN pe <> 0 AND pat_cagr_3y > 0 THEN pe / (pat_cagr_3y * 100) END AS peg FROM (SELECT symbol, sector, peer, sector = 'ASIA' AS is_financial, pe, {_CAGR.format(a='rev')} AS revenue_cagr_3y, {_CAGR.format(a='pat')} AS pat_cagr_3y, CASE WHEN pat[-5] > 0 THEN pat[-1] / pat[-5] - 1 END AS quarter_yoy,
  tpat / 1e6 AS roe, tpat / trev AS roce, opm[-1] AS opm, (opm[-1] - opm[-3]) / 2 AS opm_trend, debt[-1] / 1e6 AS debt_equity, tpat / nullif(0.05 * debt[-1], 0) AS interest_cover, (debt[-1] - debt[-3]) / 2 AS debt_trend,
  CASE WHEN pat[-1] + pat[-2] + pat[-3] > 0 THEN (cfo[-1] + cfo[-2] + cfo[-3]) / (pat[-1] + pat[-2] + pat[-3]) END AS cfo_to_pat, (cfo[-1] - 0.15 * rev[-1] > 0)::INT::DOUBLE AS fcf_positive FROM based))"""
_QUALITY_IN = ("revenue_cagr_3y", "pat_cagr_3y", "quarter_yoy", "roe", "roce", "opm", "opm_trend", "debt_equity", "interest_cover", "debt_trend", "cfo_to_pat", "fcf_positive", "pe", "peg")


def _mean_sql(*parts: str) -> str:
    return f"list_avg([{', '.join(parts)}])"


def _blend_sql(weights: dict[str, float], least: float = 0.0) -> str:
    total = " + ".join(f"coalesce({c}, 0) * {w}" for c, w in weights.items())
    have = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, w in weights.items())
    return f"CASE WHEN ({have}) >= {least * sum(weights.values())} THEN ({total}) / nullif({have}, 0) END"


@query(f"SELECT symbol, {r6(*_QUALITY_IN)} FROM qi", views="bars stocks quarters", more=f"{_LATEST}, {_HIST}, {_QIN}")
def i04_quality_metrics(m: Market) -> DataFrame:
    return quality_inputs(m).select("symbol", *_QUALITY_IN)


_Q = {
    "q_growth": _mean_sql(*[_pct(c, "peer") for c in ("revenue_cagr_3y", "pat_cagr_3y", "quarter_yoy")]),
    "q_profitability": _mean_sql(*[_pct(c, "peer") for c in ("roe", "roce", "opm", "opm_trend")]),
    "q_balance_sheet": _mean_sql(_pct("debt_equity", "peer", "DESC"), _pct("interest_cover", "peer"), _pct("debt_trend", "peer", "DESC")),
    "q_cash_quality": _mean_sql(_pct("cfo_to_pat", "peer"), "fcf_positive * 100"),
    "q_valuation": _mean_sql(_pct("peg", "peer", "DESC"), _pct("pe", "peer", "DESC")),
}


@query(
    f"SELECT symbol, {r6(*_Q)}, round(CASE WHEN is_financial THEN {_blend_sql(scoring.QUALITY_LENDER, 0.5)} ELSE {_blend_sql(scoring.QUALITY, 0.5)} END, 6) AS quality_score FROM (SELECT symbol, is_financial, {', '.join(f'{v} AS {k}' for k, v in _Q.items())} FROM qi)",
    views="bars stocks quarters",
    more=f"{_LATEST}, {_HIST}, {_QIN}",
)
def j15_quality_pillar(m: Market) -> DataFrame:
    return scoring.quality_score(quality_inputs(m)).select("symbol", *_Q, "quality_score")


def value_inputs(m: Market) -> DataFrame:
    c, debt = F.col, hs.at("debt", 1)
    ev = c("close") * 1e5 + debt
    return base(m).withColumns(
        {
            "pb": c("close") / F.nullif(F.when(c("mcap") > 0, c("mcap")), F.lit(0.0)),
            "ev_ebitda": ev / F.nullif(c("tpat") + 0.1 * c("trev"), F.lit(0.0)),
            "ev_sales": ev / F.nullif(c("trev"), F.lit(0.0)),
            "pe_5y_median": c("pe") * (1 + (c("symbol") % 7 - 3) / 10.0),
            "dividend_yield": F.when(c("symbol") % 13 > 3, (c("symbol") % 13) / 10.0),
            "margin_expanding": hs.expanding("opm_history"),
        }
    )


_VIN = """vi AS (SELECT symbol, peer, pe, close / nullif(CASE WHEN mcap > 0 THEN mcap END, 0) AS pb, (close * 1e5 + debt[-1]) / nullif(tpat + 0.1 * trev, 0) AS ev_ebitda, (close * 1e5 + debt[-1]) / nullif(trev, 0) AS ev_sales, pe * (1 + (symbol % 7 - 3) / 10.0) AS pe_5y_median,
  CASE WHEN symbol % 13 > 3 THEN (symbol % 13) / 10.0 END AS dividend_yield, coalesce(opm[-3] < opm[-2] AND opm[-2] < opm[-1], false) AS margin_expanding FROM based)"""
_V = {
    "multiples": _mean_sql(*[_pct(c, "peer", "DESC") for c in ("pe", "pb", "ev_ebitda", "ev_sales")]),
    "own_history": "CASE WHEN pe / nullif(pe_5y_median, 0) IS NOT NULL THEN greatest(0, least(100, 200 * (1 - pe / nullif(pe_5y_median, 0)) + 50)) END",
    "earnings_yield": "CASE WHEN pe > 0 THEN greatest(0, least(100, 12 * (100 / pe - 6.5) + 50)) END",
    "turnaround": "CASE WHEN margin_expanding THEN 100.0 ELSE 25.0 END::DOUBLE",
    "dividend": _pct("dividend_yield", "peer"),
}


@query(
    f"SELECT symbol, {r6(*_V)}, round({_blend_sql(scoring.VALUE, 0.5)}, 6) AS value_score FROM (SELECT symbol, {', '.join(f'{v} AS {k}' for k, v in _V.items())} FROM vi)",
    views="bars stocks quarters",
    more=f"{_LATEST}, {_HIST}, {_VIN}",
)
def j15_value_pillar(m: Market) -> DataFrame:
    return scoring.value_score(value_inputs(m)).select("symbol", *_V, "value_score")


def revision_inputs(m: Market) -> DataFrame:
    return hs.revision_metrics(base(m).withColumnsRenamed({"pat": "quarterly_pat", "revenue": "quarterly_revenue", "opm_history": "quarterly_opm"}))


def _sue_sql(a: str) -> str:
    d = f"[{a}[i] - {a}[i - 4] FOR i IN range(5, len({a}) + 1)]"
    before = f"({d})[-5:-2]"
    return f"CASE WHEN len({a}) >= 8 AND list_stddev_samp({before}) > 0 THEN greatest(-8, least(8, (({d})[-1] - list_avg({before})) / list_stddev_samp({before}))) END"


def _accel_sql(a: str) -> str:
    return f"CASE WHEN len({a}) >= 6 AND {a}[-5] > 0 AND {a}[-6] > 0 THEN {a}[-1] / {a}[-5] - {a}[-2] / {a}[-6] END"


_RIN = f"""ri AS (SELECT symbol, peer, {_sue_sql('pat')} AS sue_pat, {_sue_sql('rev')} AS sue_revenue, {_accel_sql('pat')} AS accel_pat, {_accel_sql('rev')} AS accel_revenue, opm[-1] - (opm[-2] + opm[-3] + opm[-4] + opm[-5]) / 4 AS margin_revision,
  CASE WHEN len(pat) >= 8 THEN ((pat[-1] > pat[-5])::INT + (pat[-2] > pat[-6])::INT + (pat[-3] > pat[-7])::INT + (pat[-4] > pat[-8])::INT) / 4.0 END AS consistency FROM based)"""
_REVISION_IN = ("sue_pat", "sue_revenue", "accel_pat", "accel_revenue", "margin_revision", "consistency")
_R = {
    "r_surprise": _pct("sue_pat", "peer"),
    "r_acceleration": _mean_sql(_pct("accel_pat", "peer"), _pct("accel_revenue", "peer")),
    "r_revenue_surprise": _pct("sue_revenue", "peer"),
    "r_margin_revision": _pct("margin_revision", "peer"),
    "r_consistency": "consistency * 100",
}


@query(f"SELECT symbol, {r6(*_REVISION_IN)} FROM ri", views="bars stocks quarters", more=f"{_LATEST}, {_HIST}, {_RIN}")
def i42_revision_metrics(m: Market) -> DataFrame:
    return revision_inputs(m).select("symbol", *_REVISION_IN)


@query(
    f"SELECT symbol, {r6(*_R)}, round({_blend_sql({f'r_{k}': w for k, w in scoring.REVISION.items()}, 0.5)}, 6) AS revision_score FROM (SELECT symbol, {', '.join(f'{v} AS {k}' for k, v in _R.items())} FROM ri)",
    views="bars stocks quarters",
    more=f"{_LATEST}, {_HIST}, {_RIN}",
)
def j15_revision_pillar(m: Market) -> DataFrame:
    return scoring.revision_score(revision_inputs(m)).select("symbol", *_R, "revision_score")


_OIN = """oi AS (SELECT symbol, peer, CASE WHEN symbol % 4 <> 0 THEN promoter[-1] - promoter[-5] END AS promoter_delta_4q, CASE WHEN symbol % 4 <> 0 THEN promoter[-1] - promoter[-2] END AS promoter_delta_1q, fii[-1] - fii[-5] AS fii_delta_4q, fii[-1] - fii[-3] AS fii_delta_2q, dii[-1] - dii[-5] AS dii_delta_4q FROM based)"""
_O = {
    "o_promoter": _blend_sql({_pct("promoter_delta_4q", "peer"): 0.65, _pct("promoter_delta_1q", "peer"): 0.35}),
    "o_fii": _blend_sql({_pct("fii_delta_4q", "peer"): 0.6, _pct("fii_delta_2q", "peer"): 0.4}),
    "o_dii": _pct("dii_delta_4q", "peer"),
}


@query(
    f"SELECT symbol, {r6(*_O)}, round({_blend_sql(scoring.OWNERSHIP)}, 6) AS ownership_score FROM (SELECT symbol, {', '.join(f'{v} AS {k}' for k, v in _O.items())} FROM oi)",
    views="bars stocks quarters",
    more=f"{_LATEST}, {_HIST}, {_OIN}",
)
def j15_ownership_pillar(m: Market) -> DataFrame:
    x = hs.ownership_metrics(base(m, held=True).withColumn("has_promoter", F.col("symbol") % 4 != 0))
    return scoring.ownership_score(x).select("symbol", *_O, "ownership_score")
