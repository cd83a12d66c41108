"""Every score as it would have stood on past dates, all dates at once.

A symbol's statements are one small array in the order of their periods; what had been
filed by a date is a filter of that array, so a date costs a row and no pass of its own.
Ranks are taken within a date. Zones and divergences are read at the bar of the date from
walks made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import safe_div
from . import asof, histories as hs, indicators as ind, levels as lv, overhead as oh, scoring, setups as st, zones as zn
from .indicators import W

# Days until a quarter's holdings are public, years of own multiples.
DISCLOSURE_DAYS, OWN_YEARS, LEAST_YEARS = 31, 5, 3
ANNUAL = ("revenue", "pat", "cfo", "ebitda", "debt", "equity", "eps", "debtor_days", "roe", "roce", "debt_equity", "interest_cover", "fcf")
QUARTERLY = ("revenue", "pat", "opm", "eps")
HOLDING = ("promoter_pct", "fii_pct", "dii_pct", "has_promoter")
KEYS = ("as_of", "symbol")


def books(annual: DataFrame, quarterly: DataFrame, holding: DataFrame, prices: DataFrame) -> DataFrame:
    """symbol with the arrays annual, quarterly and holding, oldest period first.

    ``annual`` and ``quarterly`` have symbol, period_end, filed_on and the columns of
    ``ANNUAL`` and ``QUARTERLY``; ``holding`` symbol, quarter_end and ``HOLDING``. Each year
    carries the last close (``prices``: symbol, date, close) at or before its end.
    """
    dated = annual.withColumn("date", F.col("period_end"))
    year = asof.asof_join(dated, prices.select("symbol", "date", "close"), "symbol", "date", "close", "price_then")

    def gathered(df: DataFrame, order: str, columns: tuple[str, ...], out: str) -> DataFrame:
        return df.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(out))

    a = gathered(year, "period_end", ("filed_on", *ANNUAL, "price_then"), "annual")
    q = gathered(quarterly, "period_end", ("filed_on", *QUARTERLY), "quarterly")
    h = gathered(holding, "quarter_end", HOLDING, "holding")
    return a.join(q, "symbol", "full").join(h, "symbol", "full")


def as_filed(at: DataFrame, book: DataFrame) -> DataFrame:
    """The rows of ``at`` (as_of, symbol and more) with the arrays cut to what was public on ``as_of``.

    A row without a filing date was never filed; holdings come out 31 days after the quarter.
    """
    x = at.join(book, "symbol", "left")
    filed = lambda a: F.filter(F.coalesce(a, F.array()), lambda r: r["filed_on"] <= F.col("as_of"))
    public = F.filter(F.coalesce("holding", F.array()), lambda r: F.date_add(r["quarter_end"], DISCLOSURE_DAYS) <= F.col("as_of"))
    return x.withColumns({"annual": filed(F.col("annual")), "quarterly": filed(F.col("quarterly")), "holding": public})


def _of(book: str, name: str) -> Column:
    return F.transform(book, lambda r: r[name])


def _last_known(book: str, name: str) -> Column:
    known = F.filter(_of(book, name), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.try_element_at(known, F.lit(-1))


def gate_inputs(x: DataFrame) -> DataFrame:
    """Add what ``histories.red_flags`` judges, from the arrays as filed; pledges and turnover are not part of filings.

    Needs two known values of each history: of the last five holdings, of three years' cash
    and profit (together above 0), of two years' debtor days (the first above 0), of three years' profit.
    """
    known = lambda a: F.filter(a, lambda v: v.isNotNull() & ~F.isnan(v))
    last = lambda b, c, n: known(F.slice(_of(b, c), F.greatest(F.size(b) - (n - 1), F.lit(1)), n))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    two = lambda a: F.size(a) >= 2
    x = x.withColumns({"_p": last("holding", "promoter_pct", 5), "_c": last("annual", "cfo", 3), "_n": last("annual", "pat", 3), "_d": last("annual", "debtor_days", 2)})
    first = lambda a: F.try_element_at(a, F.lit(1))
    end = lambda a: F.try_element_at(a, F.lit(-1))
    profit = total(F.col("_n"))
    return x.withColumns(
        {
            "has_promoter": F.coalesce(F.try_element_at("holding", F.lit(-1))["has_promoter"], F.lit(False)),
            "pledge": F.lit(None).cast("double"),
            "promoter_change": F.when(two(F.col("_p")), end(F.col("_p")) - first(F.col("_p"))),
            "cash_ratio": F.when(two(F.col("_c")) & two(F.col("_n")) & (profit > 0), total(F.col("_c")) / profit),
            "receivable_ratio": F.when(two(F.col("_d")) & (first(F.col("_d")) > 0), end(F.col("_d")) / first(F.col("_d"))),
            "loss_years": F.when(two(F.col("_n")), F.size(F.filter("_n", lambda v: v < 0))),
            "turnover": F.lit(None).cast("double"),
            "is_lender": F.coalesce("is_financial", F.lit(False)),
        }
    ).drop("_p", "_c", "_n", "_d")


def valuation(x: DataFrame) -> DataFrame:
    """Add pe, pb, ev_ebitda, ev_sales and pe_5y_median from ``close``, ``shares`` and the arrays as filed.

    Earnings are the last four known quarters, else the last known year; equity, debt and the
    enterprise figures are the last year's. The own multiple is the median over the last five
    years with earnings and a price, of three at least.
    """
    year = F.try_element_at("annual", F.lit(-1))
    quarters = F.filter(_of("quarterly", "eps"), lambda v: v.isNotNull() & ~F.isnan(v))
    four = F.when(F.size(quarters) >= 4, F.aggregate(F.slice(quarters, F.greatest(F.size(quarters) - 3, F.lit(1)), 4), F.lit(0.0), lambda s, v: s + v))
    x = x.withColumns({"eps": F.coalesce(four, _last_known("annual", "eps")), "_y": year})
    above = lambda c: F.when(c > 0, c)
    value = F.col("close") * above(F.col("shares")) + F.coalesce("_y.debt", F.lit(0.0))
    lately = F.slice("annual", F.greatest(F.size("annual") - (OWN_YEARS - 1), F.lit(1)), OWN_YEARS)
    own = F.transform(F.filter(lately, lambda r: (r["eps"] > 0) & r["price_then"].isNotNull()), lambda r: r["price_then"] / r["eps"])
    x = x.withColumn("_m", F.array_sort(own))
    n = F.size("_m")
    lo, hi = F.try_element_at("_m", F.ceil(n / 2).cast("int")), F.try_element_at("_m", (F.floor(n / 2) + 1).cast("int"))
    return x.withColumns(
        {
            "pe": F.col("close") / above(F.col("eps")),
            "pb": F.col("close") / above(above(F.col("_y.equity")) / above(F.col("shares"))),
            "ev_ebitda": value / above(F.col("_y.ebitda")),
            "ev_sales": value / above(F.col("_y.revenue")),
            "pe_5y_median": F.when(n >= LEAST_YEARS, (lo + hi) / 2),
        }
    ).drop("_y", "_m")


def fundamentals(x: DataFrame) -> DataFrame:
    """Add the gates, the multiples and the inputs of the quality, revision and ownership scores to rows of ``as_filed``.

    ``x`` has close, shares and is_financial too.
    """
    x = valuation(gate_inputs(x)).withColumn("flags", hs.red_flags()).withColumn("excluded", hs.excluded("flags"))
    arrays = {"revenue": _of("annual", "revenue"), "pat": _of("annual", "pat"), "cfo": _of("annual", "cfo"), "opm_history": _of("annual", "ebitda"), "debt": _of("annual", "debt")}
    arrays |= {"quarterly_pat": _of("quarterly", "pat"), "quarterly_revenue": _of("quarterly", "revenue"), "quarterly_opm": _of("quarterly", "opm")}
    arrays |= {"promoter": _of("holding", "promoter_pct"), "fii": _of("holding", "fii_pct"), "dii": _of("holding", "dii_pct")}
    arrays |= {c: _last_known("annual", c) for c in ("roe", "roce", "debt_equity", "interest_cover", "fcf")}
    x = x.withColumns(arrays).withColumns({"margin_expanding": hs.expanding("quarterly_opm"), "dividend_yield": F.lit(None).cast("double")})
    x = hs.ownership_metrics(hs.revision_metrics(hs.quality_metrics(x)))
    return x.drop("annual", "quarterly", "holding", "revenue", "pat", "cfo", "opm_history", "debt", "quarterly_pat", "quarterly_revenue", "quarterly_opm", "promoter", "fii", "dii")


def pillars(x: DataFrame) -> DataFrame:
    """Add quality, value, revision, ownership and momentum scores, ranked within each ``as_of``.

    ``x`` has sector, the columns of ``fundamentals`` and those of ``indicators.technicals``.
    """
    day = ("as_of",)
    x = scoring.quality_score(x, within=day)
    x = scoring.value_score(x, within=day)
    x = scoring.revision_score(x, within=day)
    x = scoring.ownership_score(x, within=day)
    return scoring.momentum_score(x, within=day)


def resistance_at(bars: DataFrame, at: DataFrame, span: int = 10) -> DataFrame:
    """as_of, symbol, target: the next resistance above the close, from swings and fractal highs confirmed by the bar.

    ``at`` has as_of, symbol, i, close, atr and year_high.
    """
    swings = zn.pivots(bars).where("kind = 'high'").select("symbol", F.col("price").alias("level"), "confirmed")
    wide = st.fractal_points(bars, span).where("kind = 'high'").select("symbol", F.col("price").alias("level"), "confirmed")
    rows = at.select(*KEYS, "i", F.col("close").alias("price"), "atr", "year_high")
    levels = rows.drop("year_high").join(swings.unionByName(wide), "symbol").where(F.col("confirmed") <= F.col("i"))
    year = rows.select(*KEYS, "price", F.col("year_high").alias("high"))
    return lv.next_resistance(levels, year=year, keys=KEYS).select(*KEYS, F.col("floor").alias("target"))


def setups_at(flags: DataFrame, scored: DataFrame, rated: DataFrame, rated_long: DataFrame, target: DataFrame) -> DataFrame:
    """as_of, symbol, ts_score, setup_status: the support setup at the bar of each row.

    ``flags`` are the rows of ``setups.flags`` at that bar, ``scored`` has quality_score and
    excluded, the zones are rated as of the bar on both timeframes.
    """
    last = flags.join(scored.select(*KEYS, F.col("quality_score").alias("quality"), "excluded"), list(KEYS))
    live = lambda z: z.select(*KEYS, "kind", "source", "zone", "formed", "floor", "ceil", "strength").withColumn("live", F.lit(True))
    out = st.evaluate(last, live(rated), live(rated_long), target, KEYS)
    return out.select(*KEYS, F.col("score").alias("ts_score"), F.col("status").alias("setup_status"))


def technical(x: DataFrame) -> DataFrame:
    """Add the better of momentum and setup, and which one it was."""
    tm, ts = F.col("tm_score"), F.col("ts_score")
    won = F.when(ts.isNotNull() & (tm.isNull() | (ts > tm)), "support").when(tm.isNotNull(), "momentum").otherwise("none")
    return x.withColumns({"technical": F.greatest(tm, ts), "winning_setup": won, "setup_status": F.coalesce("setup_status", F.lit("none"))})


def forward_returns(bars: DataFrame, hold: int) -> DataFrame:
    """symbol, date, forward_return: from the next open to the close ``hold`` sessions on; no open above 0 or no such close gives none."""
    entry = F.lead("open", 1).over(W())
    return bars.select("symbol", "date", safe_div(F.lead("close", hold).over(W()), F.when(entry > 0, entry)) - 1).toDF("symbol", "date", "forward_return")


def technicals_at(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """The twenty technical columns at each row (as_of, symbol, date); the index is the mean close of a day."""
    index = bars.groupBy("date").agg(F.avg("close").alias("close"))
    t = ind.technicals(bars, index).select("symbol", "date", "close", *ind.TECHNICALS)
    return rows.join(t, ["symbol", "date"])


def zones_at(bars: DataFrame, rows: DataFrame, timeframe: str) -> DataFrame:
    """All zones live at each row (as_of, symbol, i, close), rated there."""
    return oh.rated_at(oh.summed(st.build(bars, timeframe)), rows, timeframe)
