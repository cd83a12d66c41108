"""Candle shapes, two-bar patterns and fractal swings as window columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from .indicators import W

# Shape limits.
WICK_TO_BODY = 2.0
OPPOSITE_WICK_MAX = 0.25
DOJI_BODY_MAX = 0.10
MARUBOZU_BODY_MIN = 0.90


def _parts() -> tuple[Column, Column, Column, Column, Column]:
    """body, span, upper wick, lower wick and the body that wicks are held against."""
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    return body, span, upper, lower, F.greatest(body, span * 0.05)


def readable() -> Column:
    inside = F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high"))
    return F.coalesce(inside & (F.col("high") > F.col("low")), F.lit(False))


def shapes() -> list[Column]:
    """Every shape a bar has; they do not exclude each other. An unreadable bar has NULLs."""
    body, span, upper, lower, reference = _parts()
    found = {
        "hammer_shape": (lower >= WICK_TO_BODY * reference) & (upper <= OPPOSITE_WICK_MAX * span),
        "inverted_hammer_shape": (upper >= WICK_TO_BODY * reference) & (lower <= OPPOSITE_WICK_MAX * span),
        "doji": body <= DOJI_BODY_MAX * span,
        "marubozu": body >= MARUBOZU_BODY_MIN * span,
        "bullish_body": F.col("close") > F.col("open"),
        "bearish_body": F.col("close") < F.col("open"),
    }
    return [F.when(readable(), c).alias(k) for k, c in found.items()]


def two_bar(df: DataFrame) -> DataFrame:
    """Add engulfing, piercing and dark-cloud flags against the bar before."""
    ok = readable()
    df = df.withColumns({"_po": F.lag("open").over(W()), "_pc": F.lag("close").over(W()), "_ok": ok})
    both = F.col("_ok") & F.coalesce(F.lag("_ok").over(W()), F.lit(False))
    o, c, po, pc = (F.col(x) for x in ("open", "close", "_po", "_pc"))
    mid = (po + pc) / 2
    found = {
        "bullish_engulfing": (pc < po) & (c > o) & (c >= po) & (o <= pc),
        "bearish_engulfing": (pc > po) & (c < o) & (c <= po) & (o >= pc),
        "piercing_line": (pc < po) & (c > o) & (o < pc) & (c > mid) & (c < po),
        "dark_cloud": (pc > po) & (c < o) & (o > pc) & (c < mid) & (c > po),
    }
    return df.withColumns({k: F.coalesce(both & v, F.lit(False)) for k, v in found.items()}).drop("_po", "_pc", "_ok")


def fractals(df: DataFrame, span: int) -> DataFrame:
    """Bars whose low (high) is strictly below (above) all of the ``span`` bars on both sides, with the bar that confirms them."""
    f = W().rowsBetween(-span, span)
    lows, highs = F.collect_list("low").over(f), F.collect_list("high").over(f)
    df = df.withColumns({"_l": lows, "_h": highs, "confirmed": F.lead("date", span).over(W())})
    whole = F.size("_l") == 2 * span + 1
    low = F.size(F.filter("_l", lambda v: v <= F.col("low"))) == 1
    high = F.size(F.filter("_h", lambda v: v >= F.col("high"))) == 1
    return df.where(whole & (low | high)).select("symbol", "date", low.alias("is_low"), high.alias("is_high"), "confirmed")


def falling_knife(df: DataFrame, bars: int = 3, atr: str = "atr14", drop: float = 2.5, w: WindowSpec | None = None) -> Column:
    """Straight lower closes, or one fall of more than ``drop`` ATR."""
    c = [F.col("close")] + [F.lag("close", k).over(w or W()) for k in range(1, bars + 1)]
    straight = c[0] < c[1]
    for a, b in zip(c[1:], c[2:]):
        straight = straight & (a < b)
    violent = (F.col(atr) > 0) & (c[1] - c[0] > drop * F.col(atr))
    return c[-1].isNotNull() & (F.coalesce(straight, F.lit(False)) | F.coalesce(violent, F.lit(False)))


def stabilised(w: WindowSpec | None = None) -> Column:
    """An inside bar or an up close."""
    h, low, c = (F.lag(x).over(w or W()) for x in ("high", "low", "close"))
    return F.coalesce(((F.col("high") <= h) & (F.col("low") >= low)) | (F.col("close") > c), F.lit(False))


def lower_highs(bars: int = 60, least: int = 20) -> Column:
    """The later half of the last bars peaked below the earlier half."""
    f = W().rowsBetween(-bars, 0)
    half = F.floor(F.size("_w") / 2).cast("int")
    n = F.size("_w")
    late, early = F.array_max(F.slice("_w", half + 1, n)), F.array_max(F.slice("_w", 1, half))
    return F.collect_list("high").over(f), F.when(n >= least, late < early).otherwise(False)


def with_lower_highs(df: DataFrame, out: str = "lower_highs", bars: int = 60, least: int = 20) -> DataFrame:
    window, flag = lower_highs(bars, least)
    return df.withColumn("_w", window).withColumn(out, flag).drop("_w")


def macd_turning_up(w: WindowSpec | None = None) -> Column:
    """Three rising values with the oldest below zero."""
    a, b = F.lag("macd_hist", 2).over(w or W()), F.lag("macd_hist", 1).over(w or W())
    return F.coalesce((F.col("macd_hist") > b) & (b > a) & (a < 0), F.lit(False))


def reclaimed(ma: str = "sma20") -> Column:
    """The close crossed its average upwards on this bar."""
    return F.coalesce((F.lag("close").over(W()) <= F.lag(ma).over(W())) & (F.col("close") > F.col(ma)), F.lit(False))


def volume_surge() -> Column:
    """Volume dried up, then came back: three frames of averages."""
    base = F.avg("volume").over(W().rowsBetween(-29, -5))
    dry = F.avg("volume").over(W().rowsBetween(-4, -1))
    full = F.count("volume").over(W().rowsBetween(-29, 0)) >= 30
    return F.coalesce(full & (dry < 0.85 * base) & (F.col("volume") > 1.2 * base), F.lit(False))
