"""Cross-section scores: pillars, conviction, gates, plans and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import band, blend, clamp, decile, mean_of, pct_rank, peer_groups, percentile_score

# Pillar weights and gates.
MOMENTUM = {"momentum": 30, "trend": 22, "proximity": 16, "volume": 14, "oscillators": 10, "volatility": 8}
MOMENTUM_COVERAGE, BELOW_TREND_CAP = 0.6, 40.0
BLEND = {"quality": 5, "value": 45, "technical": 50, "revision": 0, "ownership": 0}
VALUE = {"multiples": 35, "own_history": 25, "earnings_yield": 20, "turnaround": 12, "dividend": 8}
REVISION = {"surprise": 35, "acceleration": 25, "revenue_surprise": 20, "margin_revision": 10, "consistency": 10}
QUALITY = {"q_growth": 30, "q_profitability": 25, "q_balance_sheet": 20, "q_cash_quality": 15, "q_valuation": 10}
QUALITY_LENDER = {"q_growth": 42, "q_profitability": 42, "q_valuation": 16}
OWNERSHIP = {"o_promoter": 40, "o_fii": 35, "o_dii": 25}
CONVICTION = {
    "false_breakout": 1, "hanging_man": 1, "rejected": 1, "shooting_star": 1, "bearish_engulfing": 1, "doji": 1, "resistance_strength": 1, "tm_score": 1,
    "zone_respect": 1, "value_score": 1, "headroom": -1, "ownership_score": -1, "margin_revision": -1,
}
MIN_FEATURES = 7


def momentum_score(x: DataFrame, out: str = "tm_score", within: tuple[str, ...] = ()) -> DataFrame:
    """Add the six components and their weighted score; capped while below the long average.

    ``x`` has sector, close, sma50, sma200, sma200_slope, mom_12_1, rs_vs_index,
    dist_52w_high, vol_ratio_20_100, rsi14, macd_hist, adx14, atr_pct, max_dd_6m.
    """
    x = peer_groups(x, within=within)
    up = lambda c: F.when(c, 1.0).otherwise(0.0)
    trend = 40 * up(F.col("close") > F.col("sma200")) + 20 * up(F.col("close") > F.col("sma50")) + 20 * up(F.col("sma50") > F.col("sma200")) + 20 * up(F.col("sma200_slope") > 0)
    known = F.col("sma50").isNotNull() & F.col("sma200").isNotNull() & F.col("sma200_slope").isNotNull()
    x = x.withColumns(
        {
            "momentum": mean_of(percentile_score("mom_12_1", *within, "peer"), percentile_score("rs_vs_index", *within, "peer")),
            "trend": F.when(known, trend),
            "proximity": percentile_score("dist_52w_high", *within, "peer", descending=True),
            "volume_score": percentile_score("vol_ratio_20_100", *within, "peer"),
            "oscillators": mean_of(
                band("rsi14", 35, 55, 75, 90),
                F.when(F.col("macd_hist").isNotNull(), up(F.col("macd_hist") > 0) * 100),
                clamp((F.col("adx14") - 15) / 20 * 100, 0, 100),
            ),
            "volatility": mean_of(percentile_score("atr_pct", *within, "peer", descending=True), percentile_score("max_dd_6m", *within, "peer", descending=True)),
        }
    )
    weights = {("volume_score" if k == "volume" else k): w for k, w in MOMENTUM.items()}
    raw = blend(weights, MOMENTUM_COVERAGE)
    # an unknown score stays unknown under the cap
    return x.withColumn(out, F.when((F.col("close") < F.col("sma200")) & (raw > BELOW_TREND_CAP), BELOW_TREND_CAP).otherwise(raw))


def value_score(x: DataFrame, out: str = "value_score", within: tuple[str, ...] = ()) -> DataFrame:
    """``x`` has sector, pe, pb, ev_ebitda, ev_sales, pe_5y_median, dividend_yield, margin_expanding."""
    x = peer_groups(x, within=within)
    x = x.withColumns(
        {
            "multiples": mean_of(*[percentile_score(c, *within, "peer", descending=True) for c in ("pe", "pb", "ev_ebitda", "ev_sales")]),
            "own_history": clamp(200 * (1 - F.col("pe") / F.nullif("pe_5y_median", F.lit(0.0))) + 50, 0, 100),
            "earnings_yield": F.when(F.col("pe") > 0, clamp(12 * (100 / F.col("pe") - 6.5) + 50, 0, 100)),
            "turnaround": F.when(F.coalesce("margin_expanding", F.lit(False)), 100.0).otherwise(25.0),
            "dividend": percentile_score("dividend_yield", *within, "peer"),
        }
    )
    return x.withColumn(out, blend(VALUE, 0.5))


def quality_score(x: DataFrame, out: str = "quality_score", within: tuple[str, ...] = ()) -> DataFrame:
    """Add the five components (q_) and their weighted score; lenders are not asked for balance sheet and cash.

    ``x`` has sector, is_financial and the columns of ``histories.quality_metrics``.
    """
    up = lambda c: percentile_score(c, *within, "peer")
    down = lambda c: percentile_score(c, *within, "peer", descending=True)
    x = peer_groups(x, within=within).withColumns(
        {
            "q_growth": mean_of(up("revenue_cagr_3y"), up("pat_cagr_3y"), up("quarter_yoy")),
            "q_profitability": mean_of(up("roe"), up("roce"), up("opm"), up("opm_trend")),
            "q_balance_sheet": mean_of(down("debt_equity"), up("interest_cover"), down("debt_trend")),
            "q_cash_quality": mean_of(up("cfo_to_pat"), F.col("fcf_positive") * 100),
            "q_valuation": mean_of(down("peg"), down("pe")),
        }
    )
    lender = F.coalesce("is_financial", F.lit(False))
    return x.withColumn(out, F.when(lender, blend(QUALITY_LENDER, 0.5)).otherwise(blend(QUALITY, 0.5)))


def revision_score(x: DataFrame, out: str = "revision_score", within: tuple[str, ...] = ()) -> DataFrame:
    """Add the five components (r_) and their weighted score.

    ``x`` has sector and the columns of ``histories.revision_metrics``.
    """
    up = lambda c: percentile_score(c, *within, "peer")
    x = peer_groups(x, within=within).withColumns(
        {
            "r_surprise": up("sue_pat"),
            "r_acceleration": mean_of(up("accel_pat"), up("accel_revenue")),
            "r_revenue_surprise": up("sue_revenue"),
            "r_margin_revision": up("margin_revision"),
            "r_consistency": F.col("consistency") * 100,
        }
    )
    return x.withColumn(out, blend({f"r_{k}": w for k, w in REVISION.items()}, 0.5))


def ownership_score(x: DataFrame, out: str = "ownership_score", within: tuple[str, ...] = ()) -> DataFrame:
    """Add the three components (o_) and their weighted score over those that are there.

    ``x`` has sector and the changes in points of ``histories.ownership_metrics``.
    """
    up = lambda c: percentile_score(c, *within, "peer")
    x = peer_groups(x, within=within).withColumns({f"_{c}": up(c) for c in ("promoter_delta_4q", "promoter_delta_1q", "fii_delta_4q", "fii_delta_2q")})
    x = x.withColumns(
        {
            "o_promoter": blend({"_promoter_delta_4q": 0.65, "_promoter_delta_1q": 0.35}),
            "o_fii": blend({"_fii_delta_4q": 0.6, "_fii_delta_2q": 0.4}),
            "o_dii": up("dii_delta_4q"),
        }
    )
    return x.withColumn(out, blend(OWNERSHIP)).drop("_promoter_delta_4q", "_promoter_delta_1q", "_fii_delta_4q", "_fii_delta_2q")


def conviction(x: DataFrame, *groups: str, features: dict | None = None, least: int = MIN_FEATURES, out: str = "conviction") -> DataFrame:
    """Mean of the signed percentile ranks within a date, times 100; NULL with too few features.

    Adds ``drivers``: array of (feature, points), each (rank - 0.5) * 100 / n.
    """
    features = features or CONVICTION
    for name, sign in features.items():
        x = x.withColumn(f"_s_{name}", F.col(name).cast("double") * sign)
    x = x.withColumns({f"_r_{n}": pct_rank(f"_s_{n}", *groups) for n in features})
    ranks = [F.col(f"_r_{n}") for n in features]
    n = sum((r.isNotNull().cast("int") for r in ranks[1:]), ranks[0].isNotNull().cast("int"))
    x = x.withColumn("_n", n).withColumn(out, F.when(F.col("_n") >= least, mean_of(*ranks) * 100))
    points = [F.when(F.col(f"_r_{f}").isNotNull(), F.struct(F.lit(f).alias("feature"), ((F.col(f"_r_{f}") - 0.5) * 100 / F.col("_n")).alias("points"))) for f in features]
    x = x.withColumn("drivers", F.array_compact(F.array(*points)))
    return x.drop("_n", *[f"_s_{f}" for f in features], *[f"_r_{f}" for f in features])


def top_drivers(n: int = 3) -> Column:
    """The n largest positive drivers, largest first."""
    good = F.filter("drivers", lambda d: d["points"] > 0)
    order = F.array_sort(good, lambda a, b: F.when(a["points"] > b["points"], -1).when(a["points"] < b["points"], 1).otherwise(0))
    return F.slice(order, 1, n)


def capped_top(df: DataFrame, score: str, size: int, cap: float, *groups: str, sector: str = "sector", tiebreak: str = "symbol") -> DataFrame:
    """The best ``size`` rows of each group with at most max(1, int(size * cap)) of a sector.

    Greedy choice equals two rank limits, because a sector's cap depends on nothing else.
    """
    order = [F.desc(score), F.col(tiebreak)]
    inside = F.row_number().over(Window.partitionBy(*groups, sector).orderBy(*order))
    df = df.where(F.col(score).isNotNull()).withColumn("_k", inside).where(F.col("_k") <= max(1, int(size * cap)))
    keys = list(groups) or [F.lit(0)]
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("pick") <= size).drop("_k")


def apply_band(ranked: DataFrame, held: DataFrame, enter: int = 10, leave: int = 25) -> DataFrame:
    """Buy-list hysteresis: holders stay to rank ``leave``; free places go to the top ``enter``.

    ``ranked`` has symbol and rank; ``held`` symbol and since.
    """
    df = ranked.join(held.select("symbol", "since"), "symbol", "left")
    df = df.withColumn("stays", F.col("since").isNotNull() & (F.col("rank") <= leave))
    all_rows = Window.partitionBy(F.lit(0))
    df = df.where(F.col("rank") <= leave)  # no more rows than ``leave`` and ties
    df = df.withColumn("free", enter - F.sum(F.col("stays").cast("int")).over(all_rows))
    fresh = ~F.col("stays") & (F.col("rank") <= enter)
    df = df.withColumn("turn", F.row_number().over(Window.partitionBy(fresh).orderBy("rank", "symbol")))
    return df.where(F.col("stays") | (fresh & (F.col("turn") <= F.col("free")))).select("symbol", "rank", "since", (~F.col("stays")).alias("entered"))


def deciles(df: DataFrame, score: str, *groups: str, out: str = "decile") -> DataFrame:
    return df.withColumn(out, decile(score, "symbol", *groups))


# Fixed values of the position plan.
MIN_STOP_ATR, ZONE_BUFFER_ATR, VOLATILITY_ATR, MAX_STOP, MAX_POSITION = 1.5, 0.5, 2.5, 0.30, 0.10


def suggest_stop(price="close", atr="atr14", zone="zone_floor", swing="swing_low") -> Column:
    """Below a zone under the price, else below a swing low under it, else a volatility stop.

    A candidate beyond the farthest distance leaves the volatility stop in its place.
    Too near a stop is moved away, and only one that was not too near is held to the
    farthest distance.
    """
    p, a, z, s = (F.col(c) for c in (price, atr, zone, swing))
    far, near = p * (1 - MAX_STOP), p - MIN_STOP_ATR * a
    below = F.when(z < p, z).when(s < p, s) - ZONE_BUFFER_ATR * a
    raw = F.when(below > far, below).otherwise(p - VOLATILITY_ATR * a)
    return F.when((p > 0) & (a > 0), F.when(raw > near, near).otherwise(F.greatest(raw, far)))


def quantity(capital: float, risk: float, price="close", stop="stop") -> Column:
    """Whole shares within the risk budget and the position cap."""
    p, s = F.col(price), F.col(stop)
    return F.when(s < p, F.floor(F.least(capital * risk / (p - s), capital * MAX_POSITION / p)).cast("long"))


# The features whose lift has not held in weak markets.
FADING_IN_WEAK = ("tm_score", "value_score", "margin_revision")


def fading_share(drivers: str = "drivers") -> Column:
    """The share of a name's positive points that comes from features that fade in weak markets; NULL without any."""
    lift = F.filter(drivers, lambda d: d["points"] > 0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, d: s + d["points"])
    return total(F.filter(lift, lambda d: d["feature"].isin(*FADING_IN_WEAK))) / F.when(total(lift) > 0, total(lift))


def carried(history: DataFrame, events: tuple[str, ...], sessions: int, key: str = "symbol", order: str = "date") -> DataFrame:
    """One row a symbol: an event counts if it fired in the last ``sessions`` rows, all other columns are the newest row's."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rest = [c for c in history.columns if c not in (key, order, *events)]
    recent = history.withColumn("_k", back).where(F.col("_k") <= sessions)
    return recent.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in events])


def is_lender(sectors: tuple[str, ...], kind: str = "company_type", sector: str = "sector") -> Column:
    return F.coalesce(F.col(kind) == "financial", F.lit(False)) | F.coalesce(F.col(sector).isin(*sectors), F.lit(False))


def is_equity(kind: str = "instrument_type") -> Column:
    """An unknown type counts as equity."""
    return F.coalesce(F.col(kind), F.lit("equity")) == "equity"
