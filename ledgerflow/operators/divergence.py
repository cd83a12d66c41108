"""Divergence of price and oscillator between the last two confirmed swings, kept alive for some bars.

A swing is seen from the bar that confirms it. Which earlier swing it is held against does
not depend on the bar that asks, only for how long: so every swing gives one pair at most,
with the bars in which it is the latest and in its window, and no bar walks back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, by timeframe.
LOOKBACK = {"daily": 120, "weekly": 52}
MIN_SEPARATION = {"daily": 5, "weekly": 2}
MEMORY_BARS = {"daily": 20, "weekly": 4}
MIN_RSI_GAP = 2.0


def pairs(swings: DataFrame, read: DataFrame, timeframe: str) -> DataFrame:
    """symbol, kind (bullish or bearish), the earlier and the recent swing with their oscillator, confirmed, until, alive_until.

    ``swings`` has symbol, kind (low or high), idx, price, confirmed; ``read`` symbol, i and
    rsi14. Lows that fall while the oscillator rises are bullish, highs the other way. The
    earlier swing is the last one at least ``MIN_SEPARATION`` bars before. A pair holds from
    ``confirmed`` to ``until``: to the bar before the next swing of its kind is confirmed, and
    while the earlier swing is within ``LOOKBACK``; it is alive for ``MEMORY_BARS`` of these.
    An unknown oscillator at either swing, or one that moved less than 2 points, gives no pair.
    """
    value = read.select("symbol", F.col("i").alias("idx"), "rsi14")
    s = swings.select("symbol", "kind", "idx", "price", "confirmed").join(value, ["symbol", "idx"], "left")
    own = Window.partitionBy("symbol", "kind")
    far = own.orderBy("idx").rangeBetween(Window.unboundedPreceding, -MIN_SEPARATION[timeframe])
    s = s.withColumns({"p": F.max(F.struct("idx", "price", "rsi14")).over(far), "next": F.lead("confirmed").over(own.orderBy("confirmed"))})
    up = F.col("kind") == "low"
    price, rsi = F.col("price") - F.col("p.price"), F.col("rsi14") - F.col("p.rsi14")
    apart = (F.abs(rsi) >= MIN_RSI_GAP) & F.when(up, (price < 0) & (rsi > 0)).otherwise((price > 0) & (rsi < 0))
    until = F.least(F.col("next") - 1, F.col("p.idx") + LOOKBACK[timeframe])
    s = s.withColumn("until", until).where(apart & (F.col("until") >= F.col("confirmed")))
    return s.select(
        "symbol",
        F.when(up, "bullish").otherwise("bearish").alias("kind"),
        F.col("p.idx").alias("prior_idx"),
        F.col("p.price").alias("prior_price"),
        F.col("p.rsi14").alias("prior_rsi"),
        "idx",
        "price",
        F.col("rsi14").alias("rsi"),
        "confirmed",
        "until",
        F.least("until", F.col("confirmed") + MEMORY_BARS[timeframe]).alias("alive_until"),
    )


def alive(found: DataFrame, read: DataFrame, prefix: str = "rsi_div_", suffix: str = "") -> DataFrame:
    """symbol, i and a flag for each direction: whether a pair is alive at the bar.

    A pair is written out over its few bars, so that the bars meet it by equality.
    """
    names = {k: f"{prefix}{k}{suffix}" for k in ("bullish", "bearish")}
    hit = found.select("symbol", "kind", F.explode(F.sequence("confirmed", "alive_until")).alias("i"))
    hit = hit.groupBy("symbol", "i").agg(*[F.bool_or(F.col("kind") == k).alias(n) for k, n in names.items()])
    out = read.select("symbol", "i").join(hit, ["symbol", "i"], "left")
    return out.select("symbol", "i", *[F.coalesce(n, F.lit(False)).alias(n) for n in names.values()])
