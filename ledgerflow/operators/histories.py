"""Statement histories as arrays, oldest first: growth, surprise, trend and gates by array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minimum lengths and limits.
MIN_QUARTERS_SUE, MIN_QUARTERS_ACCEL, SUE_CLIP = 8, 6, 8.0
PLEDGE_MAX, PROMOTER_DROP, CASH_MIN, RECEIVABLE_MAX, LOSS_YEARS, TURNOVER_MIN = 20.0, 3.0, 0.5, 1.4, 2, 2.0


def history(df: DataFrame, value: str, *keys: str, order: str = "period_end", out: str | None = None) -> Column:
    """Aggregate: the values of a key ordered by period, nulls kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(out or value)


def cleaned(a: str) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))


def at(a, back: int) -> Column:
    """The element ``back`` from the end (1: the last), NULL if there is none."""
    a = F.col(a) if isinstance(a, str) else a
    return F.when(F.size(a) >= back, F.element_at(a, -back))


def cagr(a: str, years: int) -> Column:
    c = cleaned(a)
    first, last = at(c, years + 1), at(c, 1)
    return F.when((first > 0) & (last > 0), F.pow(last / first, F.lit(1.0 / years)) - 1)


def yoy(a: str, lag: int = 4) -> Column:
    c = cleaned(a)
    base = at(c, lag + 1)
    return F.when(base > 0, at(c, 1) / base - 1)


def trend(a: str) -> Column:
    """Least-squares slope of the last three known values (two: their difference)."""
    c = cleaned(a)
    return F.when(F.size(c) >= 3, (at(c, 1) - at(c, 3)) / 2).when(F.size(c) == 2, at(c, 1) - at(c, 2))


def seasonal(a: str, lag: int = 4) -> Column:
    """Differences to the value ``lag`` places before."""
    c = cleaned(a)
    n = F.greatest(F.size(c) - lag, F.lit(0))
    return F.zip_with(F.slice(c, lag + 1, n), F.slice(c, 1, n), lambda x, y: x - y)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _std(a: Column) -> Column:
    m = _mean(a)
    return F.sqrt(F.aggregate(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x) / (F.size(a) - 1))


def with_sue(df: DataFrame, a: str, out: str, lookback: int = 4) -> DataFrame:
    """Latest seasonal difference against the mean and deviation of those before it, clipped."""
    df = df.withColumn("_d", F.when(F.size(cleaned(a)) >= MIN_QUARTERS_SUE, seasonal(a)))
    n = F.size("_d") - 1
    df = df.withColumn("_h", F.when(n >= 1, F.slice("_d", F.greatest(n - lookback + 1, F.lit(1)), F.least(n, F.lit(lookback)))))
    df = df.withColumn("_s", F.when(F.size("_h") >= 2, _std(F.col("_h"))))
    raw = (at("_d", 1) - _mean(F.col("_h"))) / F.col("_s")
    return df.withColumn(out, F.when(F.col("_s") > 0, F.greatest(F.lit(-SUE_CLIP), F.least(raw, F.lit(SUE_CLIP))))).drop("_d", "_h", "_s")


def acceleration(a: str) -> Column:
    c = cleaned(a)
    now, before = at(c, 5), at(c, 6)
    return F.when((F.size(c) >= MIN_QUARTERS_ACCEL) & (now > 0) & (before > 0), at(c, 1) / now - at(c, 2) / before)


def margin_revision(a: str) -> Column:
    c = cleaned(a)
    return F.when(F.size(c) >= 5, at(c, 1) - (at(c, 2) + at(c, 3) + at(c, 4) + at(c, 5)) / 4)


def consistency(a: str, quarters: int = 4) -> Column:
    d = seasonal(a)
    last = F.slice(d, F.size(d) - quarters + 1, quarters)
    return F.when(F.size(cleaned(a)) >= 4 + quarters, F.size(F.filter(last, lambda x: x > 0)) / F.lit(float(quarters)))


def expanding(a: str) -> Column:
    """The last three are known and rise."""
    a, b, c = at(a, 3), at(a, 2), at(a, 1)
    return F.coalesce((a < b) & (b < c), F.lit(False))


def delta(a: str, quarters: int) -> Column:
    """Change of the known values over so many quarters."""
    c = cleaned(a)
    return at(c, 1) - at(c, quarters + 1)


def _last_three(a: str) -> Column:
    """Those of the last three values that are known."""
    return F.filter(F.slice(a, F.greatest(F.size(a) - 2, F.lit(1)), 3), lambda x: x.isNotNull() & ~F.isnan(x))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def quality_metrics(df: DataFrame) -> DataFrame:
    """Add the inputs of the quality score from the arrays revenue, pat, quarterly_pat, cfo, opm_history and debt, and from pe and fcf."""
    cash, profit = _last_three("cfo"), _sum(_last_three("pat"))
    df = df.withColumns(
        {
            "revenue_cagr_3y": cagr("revenue", 3),
            "pat_cagr_3y": cagr("pat", 3),
            "quarter_yoy": yoy("quarterly_pat"),
            "opm": at("opm_history", 1),
            "opm_trend": trend("opm_history"),
            "debt_trend": trend("debt"),
            "cfo_to_pat": F.when((profit > 0) & (F.size(cash) > 0), _sum(cash) / profit),
            "fcf_positive": F.when(F.col("fcf").isNotNull(), (F.col("fcf") > 0).cast("double")),
        }
    )
    return df.withColumn("peg", F.when((F.col("pe") != 0) & (F.col("pat_cagr_3y") > 0), F.col("pe") / (F.col("pat_cagr_3y") * 100)))


def revision_metrics(df: DataFrame) -> DataFrame:
    """Add the inputs of the revision score from the arrays quarterly_pat, quarterly_revenue and quarterly_opm."""
    df = with_sue(with_sue(df, "quarterly_pat", "sue_pat"), "quarterly_revenue", "sue_revenue")
    return df.withColumns(
        {
            "accel_pat": acceleration("quarterly_pat"),
            "accel_revenue": acceleration("quarterly_revenue"),
            "margin_revision": margin_revision("quarterly_opm"),
            "consistency": consistency("quarterly_pat"),
        }
    )


def ownership_metrics(df: DataFrame) -> DataFrame:
    """Add the changes in points from the arrays promoter, fii and dii; without a promoter (has_promoter) its changes are unknown."""
    held = F.coalesce("has_promoter", F.lit(False))
    return df.withColumns(
        {
            "promoter_delta_4q": F.when(held, delta("promoter", 4)),
            "promoter_delta_1q": F.when(held, delta("promoter", 1)),
            "fii_delta_4q": delta("fii", 4),
            "fii_delta_2q": delta("fii", 2),
            "dii_delta_4q": delta("dii", 4),
        }
    )


def trailing(a: str, n: int = 4) -> Column:
    """Sum of the last n known values."""
    c = cleaned(a)
    return F.when(F.size(c) >= n, F.aggregate(F.slice(c, F.size(c) - n + 1, n), F.lit(0.0), lambda s, x: s + x))


def annualised(columns: list[str], months: str) -> dict[str, Column]:
    """Flows of a period of ``months`` months scaled to twelve (3 for quarters)."""
    return {c: F.col(c) * 12 / F.nullif(F.col(months), F.lit(0)) for c in columns}


def period(label: str) -> tuple[Column, Column]:
    """('Mar 2024', 'Mar 2023 15m') to the month's last day and the number of months (12)."""
    end = F.last_day(F.try_to_date(F.concat(F.lit("01 "), F.regexp_extract(label, r"([A-Z][a-z]{2} \d{4})", 1)), "dd MMM yyyy"))
    n = F.regexp_extract(label, r"(\d+)m", 1)
    return end, F.coalesce(F.try_to_number(n, F.lit("99")).cast("int"), F.lit(12))


# --- gates -------------------------------------------------------------------
def gate(name: str, unknown: Column, fail: Column, inapplicable: Column | None = None) -> Column:
    verdict = F.when(F.coalesce(inapplicable, F.lit(False)) if inapplicable is not None else F.lit(False), "not_applicable")
    return F.struct(F.lit(name).alias("name"), verdict.when(F.coalesce(unknown, F.lit(True)), "unknown").when(fail, "fail").otherwise("pass").alias("verdict"))


def red_flags() -> Column:
    """Six verdicts; selling does not apply without a promoter, two others not to lenders. From has_promoter, pledge, promoter_change, cash_ratio, receivable_ratio, loss_years, turnover and is_lender."""
    c = F.col
    return F.array(
        gate("promoter_pledge", c("pledge").isNull(), c("pledge") > PLEDGE_MAX),
        gate("promoter_selling", c("promoter_change").isNull(), c("promoter_change") < -PROMOTER_DROP, ~c("has_promoter")),
        gate("cash_conversion", c("cash_ratio").isNull(), c("cash_ratio") < CASH_MIN, c("is_lender")),
        gate("receivable_bloat", c("receivable_ratio").isNull(), c("receivable_ratio") > RECEIVABLE_MAX, c("is_lender")),
        gate("loss_making", c("loss_years").isNull(), c("loss_years") >= LOSS_YEARS),
        gate("illiquid", c("turnover").isNull(), c("turnover") < TURNOVER_MIN),
    )


def excluded(flags: str) -> Column:
    return F.exists(flags, lambda f: f["verdict"] == "fail")


def noted(flags: str) -> Column:
    return F.filter(flags, lambda f: f["verdict"].isin("fail", "unknown"))
