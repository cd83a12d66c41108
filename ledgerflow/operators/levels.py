"""Distances to levels: overhead supply, nearest bands, overlap, proximity and reward scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.num import clamp
from .indicators import W

# Fixed values of the setup score.
PROXIMITY_FULL, PROXIMITY_ZERO, REWARD_ZERO, REWARD_FULL = 0.5, 2.0, 2.5, 5.0
LONG_MA_ATR, FIB_ATR, FIBS = 0.75, 0.6, (0.382, 0.5, 0.618)


def fractal_highs(bars: DataFrame, span: int = 10) -> DataFrame:
    """symbol, level: highs that none of the ``span`` bars on both sides exceeds and at least ``span`` of them stay below."""
    w = W().rowsBetween(-span, span)
    df = bars.withColumns({"_n": F.count("high").over(w), "_top": F.max("high").over(w), "_h": F.collect_list("high").over(w)})
    below = F.size(F.filter("_h", lambda v: v < F.col("high")))
    return df.where((F.col("_n") == 2 * span + 1) & (F.col("high") == F.col("_top")) & (below >= span)).select("symbol", F.col("high").alias("level"))


def next_resistance(highs: DataFrame, tolerance: float = 0.6, least: int = 2, year: DataFrame | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """For each symbol the band of swing highs above its price that a rise meets first.

    ``highs`` has symbol, level, price, atr. Levels chain while the gap to the one
    before is within tolerance * atr, so bands are islands of a sorted column; the
    first band of ``least`` levels is taken, else the nearest level. ``year`` (symbol,
    price, high) has the year's high of every symbol: where no level lies above the
    price it is the last resort (touches 0) if it lies above it. With ``keys`` both
    have these instead, a symbol on a date for instance.
    """
    w = Window.partitionBy(*keys).orderBy("level")
    df = highs.where(F.col("level") > F.col("price"))
    gap = F.col("level") - F.lag("level").over(w)
    df = df.withColumn("_new", F.when((F.col("atr") > 0) & (gap <= tolerance * F.col("atr")), 0).otherwise(1))
    df = df.withColumn("_band", F.sum("_new").over(w))
    bands = df.groupBy(*keys, "_band").agg(F.min("level").alias("floor"), F.max("level").alias("ceil"), F.count("*").alias("touches"))
    best = bands.groupBy(*keys).agg(F.min(F.when(F.col("touches") >= least, F.struct("floor", "ceil", "touches"))).alias("good"), F.min("floor").alias("nearest"))
    out = best.select(*keys, F.coalesce("good.floor", "nearest").alias("floor"), F.coalesce("good.ceil", "nearest").alias("ceil"), F.coalesce("good.touches", F.lit(1)).alias("touches"))
    if year is None:
        return out
    rest = year.where(F.col("high") > F.col("price")).join(out, list(keys), "left_anti")
    return out.unionByName(rest.select(*keys, F.col("high").alias("floor"), F.col("high").alias("ceil"), F.lit(0).alias("touches")))


def nearest_below(bands: DataFrame, prices: DataFrame) -> DataFrame:
    """The band whose middle is nearest to the price among those with a floor under it."""
    mid = (F.col("floor") + F.col("ceil")) / 2
    x = bands.join(prices.select("symbol", "price"), "symbol").where(F.col("floor") < F.col("price"))
    near = F.struct(F.abs(F.col("price") - mid).alias("d"), F.col("floor"))
    return x.groupBy("symbol", "price").agg(F.min_by(F.struct("floor", "ceil"), near).alias("b")).select("symbol", "price", "b.floor", "b.ceil")


def overlaps(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """left with whether any band of right overlaps it; both sides keyed, so the range test runs inside an equi-join."""
    r = right.groupBy(*keys).agg(F.collect_list(F.struct(F.col("floor").alias("f"), F.col("ceil").alias("c"))).alias("_o"))
    hit = F.exists("_o", lambda o: (o["f"] <= F.col("ceil")) & (o["c"] >= F.col("floor")))
    return left.join(r, list(keys), "left").withColumn("overlaps", F.coalesce(hit, F.lit(False))).drop("_o")


def proximity(distance_atr: str) -> Column:
    d = F.col(distance_atr)
    return clamp((PROXIMITY_ZERO - d) / (PROXIMITY_ZERO - PROXIMITY_FULL) * 100, 0, 100)


def reward_risk(ratio: str) -> Column:
    return clamp((F.col(ratio) - REWARD_ZERO) / (REWARD_FULL - REWARD_ZERO) * 100, 0, 100)


def confirmation(flags: list[str]) -> Column:
    """45 points a confirmed sign, at most 100."""
    n = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags[1:]), F.coalesce(F.col(flags[0]), F.lit(False)).cast("int"))
    return F.least(F.lit(100), n * 45)


def agrees(level: str, ma: str, high: str, low: str, atr: str) -> tuple[Column, Column]:
    """Whether a level agrees with a long average, and the first retracement of the year's range that it agrees with."""
    v, a = F.col(level), F.col(atr)
    fib = F.lit(None).cast("double")
    for f in reversed(FIBS):
        at = F.col(high) - f * (F.col(high) - F.col(low))
        fib = F.when(F.abs(v - at) <= FIB_ATR * a, F.lit(f)).otherwise(fib)
    return F.coalesce(F.abs(v - F.col(ma)) <= LONG_MA_ATR * a, F.lit(False)), fib


def rsi_divergence(lookback: int = 60, separation: int = 8, w: WindowSpec | None = None) -> Column:
    """A lower low than the lowest of an earlier stretch (first of equals) with a higher oscillator."""
    f = (w or W()).rowsBetween(-lookback, -separation)
    low = F.min("low").over(f)
    then = F.min_by("rsi14", F.struct("low", "date")).over(f)
    return F.coalesce((F.col("low") < low) & (F.col("rsi14") > then), F.lit(False))


def membership_history(ranked: DataFrame, enter: int = 10, leave: int = 25) -> DataFrame:
    """The buy list after each date: a fold over the dates, in one row of ``leave`` symbols a date.

    ``ranked`` has date, symbol, rank with ranks up to ``leave``.
    """
    day = ranked.where(F.col("rank") <= leave).groupBy("date").agg(F.array_sort(F.collect_list(F.struct("rank", "symbol"))).alias("r"))
    days = day.agg(F.array_sort(F.collect_list(F.struct("date", "r"))).alias("days"))
    stay = "filter(s.m, y -> exists(d.r, z -> z.symbol = y))"
    fresh = f"transform(filter(slice(d.r, 1, {enter}), z -> not array_contains(s.m, z.symbol)), z -> z.symbol)"
    now = f"concat({stay}, slice({fresh}, 1, greatest({enter} - size({stay}), 0)))"
    kind = "struct<m: array<bigint>, o: array<struct<date: date, m: array<bigint>>>>"
    step = f"cast(transform(array({now}), m -> named_struct('m', m, 'o', concat(s.o, array(named_struct('date', d.date, 'm', m)))))[0] as {kind})"
    fold = f"aggregate(days, cast(named_struct('m', array(), 'o', array()) as {kind}), (s, d) -> {step}).o"
    return days.select(F.explode(F.expr(fold)).alias("x")).select(F.col("x.date").alias("date"), F.explode("x.m").alias("symbol"))
