"""What a zone has done so far, how strong that makes it, and whether price stands at one.

The walk over the bars after a zone has formed depends on what came before, so it is
a fold over a symbol's sorted bars inside the JVM; all the rest are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import clamp
from . import candles, indicators as ind, levels as lv, zones as zn
from .indicators import W

# Fixed values of the walk, by timeframe.
REACTION_WINDOW = {"daily": 20, "weekly": 8}
MIN_BARS_BETWEEN_TOUCHES = {"daily": 5, "weekly": 2}
BREAK_BUFFER_ATR = 0.25
AGE_FADE_BARS = {"daily": 750, "weekly": 156}
FALSE_BREAKOUT_WINDOW = {"daily": 5, "weekly": 3}
DIVERGENCE = {"daily": (60, 8), "weekly": (26, 3)}  # lookback, separation
# Fixed values of the strength and of the setup.
STRENGTH = {"touch": 0.28, "reaction": 0.20, "quality": 0.14, "respect": 0.14, "volume": 0.12, "age": 0.12}
WEEKLY_UPLIFT = 1.15
HAMMER_WICK_RATIO = 1.8
SETUP = {"zone_strength": 26.0, "confirmation": 26.0, "confluence": 16.0, "proximity": 16.0, "reward_risk": 16.0}
WATCHING_CAP, DOWNTREND_CAP, KNIFE_CAP = 55.0, 45.0, 30.0
STOP_BUFFER_ATR, MIN_STOP_ATR, MIN_HEADROOM, QUALITY_GATE = 0.5, 1.5, 0.25, 60.0

_EVENT = "struct<i: int, kind: string, reaction: double, ratio: double>"
_STATE = f"struct<last: int, broken: boolean, ev: array<{_EVENT}>>"


def fractal_points(bars: DataFrame, span: int = 5) -> DataFrame:
    """symbol, kind, idx, price, confirmed: extremes of the ``span`` bars on both sides that at least ``span`` of them stay short of."""
    w = W().rowsBetween(-span, span)
    df = bars.withColumns({"idx": F.row_number().over(W()) - 1, "_l": F.collect_list("low").over(w), "_h": F.collect_list("high").over(w)})
    whole = F.size("_l") == 2 * span + 1
    low = whole & (F.col("low") == F.array_min("_l")) & (F.size(F.filter("_l", lambda v: v > F.col("low"))) >= span)
    high = whole & (F.col("high") == F.array_max("_h")) & (F.size(F.filter("_h", lambda v: v < F.col("high"))) >= span)
    found = F.array_compact(
        F.array(
            F.when(low, F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"))),
            F.when(high, F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))),
        )
    )
    df = df.select("symbol", "idx", F.explode(found).alias("p"))
    return df.select("symbol", "p.kind", "idx", "p.price", (F.col("idx") + span).alias("confirmed"))


def readings(bars: DataFrame, timeframe: str) -> DataFrame:
    """Each bar with its place, the ATR, the extremes of the bars in which a reaction shows, and recent over usual volume."""
    ahead = W().rowsBetween(1, REACTION_WINDOW[timeframe])
    mean = lambda n: F.avg("volume").over(W().rowsBetween(-(n - 1), 0))
    df = ind.atr(bars, out="atr").withColumns({"i": F.row_number().over(W()) - 1, "up": F.max("high").over(ahead), "down": F.min("low").over(ahead)})
    return df.withColumn("ratio", F.when((F.col("i") >= 20) & (mean(100) > 0), mean(20) / mean(100)))


def events(zones: DataFrame, read: DataFrame, timeframe: str) -> DataFrame:
    """Add ``ev``: the touches, rejections, breaks and reclaims of each zone after the bar ``formed``, in order.

    A support (kind low) is met from above: a close well under its floor breaks it, a
    close over its ceiling takes it back; otherwise a low in the band is a touch, and a
    rejection if the close is back above. Visits closer than the spacing are one. A
    resistance is the mirror image, so both are walked with signed prices.
    """
    bar = F.struct("i", "high", "low", "close", "atr", "up", "down", "ratio")
    arrays = read.groupBy("symbol").agg(F.array_sort(F.collect_list(bar)).alias("b"))
    support = F.col("kind") == "low"
    z = zones.join(arrays, "symbol").withColumns(
        {"_lo": F.when(support, F.col("floor")).otherwise(-F.col("ceil")), "_hi": F.when(support, F.col("ceil")).otherwise(-F.col("floor")), "_s": support}
    )

    def step(s: Column, b: Column) -> Column:
        c = F.when(F.col("_s"), b["close"]).otherwise(-b["close"])
        near = F.when(F.col("_s"), b["low"]).otherwise(-b["high"])
        best = F.when(F.col("_s"), b["up"]).otherwise(-b["down"])
        unit = F.coalesce(F.nullif(b["atr"], F.lit(0.0)), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(1.0))
        breaks = ~s["broken"] & (c < F.col("_lo") - BREAK_BUFFER_ATR * unit)
        back = s["broken"] & (c > F.col("_hi"))
        visit = ~s["broken"] & ~breaks & (near <= F.col("_hi")) & (b["i"] - s["last"] >= MIN_BARS_BETWEEN_TOUCHES[timeframe])
        kind = F.when(breaks, "break").when(back, "reclaim").when(visit & (c > F.col("_hi")), "rejection").when(visit, "touch")
        reaction = F.when(visit, F.coalesce((best - F.col("_hi")) / unit, F.lit(0.0)))
        event = F.struct(b["i"].alias("i"), kind.alias("kind"), reaction.alias("reaction"), F.when(visit, b["ratio"]).alias("ratio")).cast(_EVENT)
        return F.struct(
            F.when(visit, b["i"]).otherwise(s["last"]).alias("last"),
            F.coalesce(breaks | (s["broken"] & ~back), F.lit(False)).alias("broken"),
            F.when(kind.isNotNull(), F.concat(s["ev"], F.array(event))).otherwise(s["ev"]).alias("ev"),
        ).cast(_STATE)

    start = F.struct(F.lit(-(10**9)).alias("last"), F.lit(False).alias("broken"), F.array().cast(f"array<{_EVENT}>").alias("ev")).cast(_STATE)
    later = F.slice("b", F.col("formed") + 2, F.size("b"))
    walked = F.aggregate(later, start, step)["ev"]
    return z.withColumn("ev", walked).withColumn("last_i", F.size("b") - 1).drop("b", "_lo", "_hi", "_s")


def _of(kinds: tuple[str, ...], at: Column) -> Column:
    return F.filter("ev", lambda e: e["kind"].isin(*kinds) & (e["i"] <= at))


def _mean(values: Column) -> Column:
    there = F.filter(values, lambda v: v.isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(there).cast("double"), F.lit(0.0))


def properties(z: DataFrame, at: str = "last_i") -> DataFrame:
    """Touches, rejections, breaks, the share of decisive tests that held, reaction and volume as of bar ``at``, and whether the zone is live there."""
    a = F.col(at)
    z = z.withColumns({"_t": _of(("touch", "rejection"), a), "rejections": F.size(_of(("rejection",), a)), "breaks": F.size(_of(("break",), a))})
    z = z.withColumns(
        {
            "touches": F.size("_t"),
            "reaction": _mean(F.transform("_t", lambda e: e["reaction"])),
            "volume_ratio": _mean(F.transform("_t", lambda e: e["ratio"])),
            "respect": F.col("rejections") / F.nullif((F.col("rejections") + F.col("breaks")).cast("double"), F.lit(0.0)),
            "invalidated": F.array_max(F.transform(F.filter("ev", lambda e: e["kind"] == "break"), lambda e: e["i"])),
            "last_touch": F.array_max(F.transform("_t", lambda e: e["i"])),
        }
    )
    return z.withColumn("live", (F.col("formed") <= a) & (F.col("invalidated").isNull() | (F.col("invalidated") > a))).drop("_t")


def strength(timeframe: str, at: str = "last_i") -> Column:
    """0 to 100 from the properties: three or four touches are best, then reactions, quality, respect, volume and age."""
    n, fade = F.col("touches"), float(AGE_FADE_BARS[timeframe])
    parts = {
        "touch": F.when(n == 0, 45.0).when(n <= 2, 70.0).when(n <= 4, 100.0).when(n <= 6, 70.0).otherwise(40.0),
        "reaction": F.coalesce(clamp(F.col("reaction") / 4.0 * 100, 0, 100), F.lit(40.0)),
        "quality": F.when(n > 0, F.col("rejections") / n * 100).otherwise(40.0),
        "respect": F.coalesce(F.col("respect") * 100, F.lit(50.0)),
        "volume": F.coalesce(clamp((F.col("volume_ratio") - 0.7) / 0.8 * 100, 0, 100), F.lit(50.0)),
        "age": clamp(100 * (1 - F.greatest(F.col(at) - F.col("formed") - fade, F.lit(0.0)) / fade), 20, 100),
    }
    total = sum((c * STRENGTH[k] for k, c in parts.items()), F.lit(0.0))
    return F.round(F.least(F.lit(100.0), total * WEEKLY_UPLIFT) if timeframe == "weekly" else total, 2)


def build(bars: DataFrame, timeframe: str) -> DataFrame:
    """All zones of every symbol with 30 bars: clusters of swings and fractals, and volume shelves, rated at the last bar."""
    read = readings(bars, timeframe)
    long = read.groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 30")
    atr = read.select("symbol", F.col("i").alias("idx"), "atr")
    swings = zn.pivots(bars).select("symbol", "kind", "idx", "price", "confirmed").unionByName(fractal_points(bars))
    swings = swings.join(long.select("symbol"), "symbol", "left_semi").join(atr, ["symbol", "idx"])
    bands = zn.zones(zn.clusters(swings, "low").unionByName(zn.clusters(swings, "high")), atr)
    bands = bands.select("symbol", "kind", F.when(F.col("members") > 1, "cluster").otherwise("pivot").alias("source"), F.col("cluster").alias("zone"), "formed", "floor", "ceil", F.lit(None).cast("double").alias("share"))
    shelf = zn.shelves(bars).join(long, "symbol")
    shelf = shelf.select("symbol", F.lit("low").alias("kind"), F.lit("volume_shelf").alias("source"), F.col("bin").alias("zone"), F.greatest(F.lit(0), F.col("n") - zn.SHELF_LOOKBACK).cast("int").alias("formed"), "floor", "ceil", "share")
    z = properties(events(bands.unionByName(shelf), read, timeframe))
    rated = strength(timeframe)
    return z.withColumn("strength", F.when(F.col("source") == "volume_shelf", F.round(F.least(rated, 20 + F.col("share") * 700), 2)).otherwise(rated))


def at_levels(df: DataFrame, kind: str) -> dict[str, Column]:
    """The candle patterns that count at a band (floor, ceil) the bar traded into: bullish ones at a support, bearish ones at a resistance.

    ``df`` has the shapes and two-bar patterns. A support must hold the close above
    its floor, a resistance below its ceiling; otherwise nothing is read.
    """
    reached = candles.readable() & (F.col("low") <= F.col("ceil")) & (F.col("high") >= F.col("floor"))
    if kind == "low":
        here = reached & (F.col("close") > F.col("floor"))
        names = {"hammer_at_support": "hammer_shape", "inverted_hammer_at_support": "inverted_hammer_shape", "doji_at_support": "doji", "bullish_engulfing_at_support": "bullish_engulfing", "piercing_at_support": "piercing_line"}
    else:
        here = reached & (F.col("close") < F.col("ceil"))
        names = {"shooting_star_at_resistance": "inverted_hammer_shape", "hanging_man_at_resistance": "hammer_shape", "doji_at_resistance": "doji", "bearish_engulfing_at_resistance": "bearish_engulfing", "dark_cloud_at_resistance": "dark_cloud"}
    return {out: F.coalesce(here & F.col(shape), F.lit(False)) for out, shape in names.items()}


def _wick_or_engulfing(bullish: bool) -> Column:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    po, pc = F.lag("open").over(W()), F.lag("close").over(W())
    body, span = F.abs(c - o), h - low
    held = F.greatest(body, span * 0.05)
    if bullish:
        wick, half, engulfing = F.least(o, c) - low, c > low + 0.5 * span, (pc < po) & (c > o) & (c >= po) & (o <= pc)
    else:
        wick, half, engulfing = h - F.greatest(o, c), c < low + 0.5 * span, (pc > po) & (c < o) & (c <= po) & (o >= pc)
    return F.coalesce((span > 0) & po.isNotNull() & ((wick > HAMMER_WICK_RATIO * held) & half | engulfing), F.lit(False))


def flags(bars: DataFrame, timeframe: str) -> DataFrame:
    """The bars with all that a setup asks of them: turning candles, divergence, momentum, average, volume, and the vetoes."""
    lookback, separation = DIVERGENCE[timeframe]
    df = ind.macd_histogram(ind.rsi(ind.atr(bars, out="atr")))
    df = df.withColumns({"sma20": ind.sma("close", 20), "sma200": ind.sma("close", 200), "sma250": ind.sma("close", 250), "_n": F.row_number().over(W())})
    year = W().rowsBetween(-251, 0)
    df = df.withColumns(
        {
            "turning_up_candle": _wick_or_engulfing(True),
            "turning_down_candle": _wick_or_engulfing(False),
            "rsi_divergence": (F.least(F.col("_n"), F.lit(lookback + 1)) >= 2 * separation) & lv.rsi_divergence(lookback, separation),
            "macd_turning_up": candles.macd_turning_up(),
            "reclaimed_short_ma": candles.reclaimed(),
            "volume_pattern": (F.col("_n") > 30) & candles.volume_surge(),
            "falling_knife": candles.falling_knife(df, atr="atr"),
            "stabilised": candles.stabilised(),
            "year_high": F.max("high").over(year),
            "year_low": F.min("low").over(year),
            "_w": F.collect_list("low").over(W().rowsBetween(-40, 0)),
        }
    )
    # The later half of the last bars bottomed above the earlier half.
    n = F.size("_w")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("higher_low", (n >= 20) & (F.array_min(F.slice("_w", half + 1, n)) > F.array_min(F.slice("_w", F.lit(1), half)))).drop("_w", "_n")
    return candles.with_lower_highs(df)


def false_breakout(timeframe: str, ceil: str = "ceil") -> Column:
    """Bars since a close above the ceiling that the last close is no longer above; NULL without one in the window."""
    window = FALSE_BREAKOUT_WINDOW[timeframe]
    held = F.lit(None).cast("int")
    for back in range(window, 0, -1):
        at = F.lag("close", back).over(W())
        held = F.when((at > F.col(ceil)) & F.lag("close", back + 1).over(W()).isNotNull(), back).otherwise(held)
    return F.when((F.row_number().over(W()) >= window + 2) & (F.col("close") < F.col(ceil)), held)


def evaluate(last: DataFrame, zones: DataFrame, higher: DataFrame, resistance: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The support setup of each symbol at its last bar.

    ``last`` has one row a symbol with the ``flags`` columns and, if known, ``quality``
    and ``excluded``; ``zones`` and ``higher`` are rated zones of the bars and of the
    longer timeframe, ``resistance`` the level overhead (symbol, target). The first
    reason against a setup ends it with status none and no score; a null quality is
    not yet known, a symbol without overhead has no reward. With ``keys`` all tables have
    one row, or their zones, for each of these: a symbol on a date for instance.
    """
    x = last.join(resistance, list(keys), "left")
    live = zones.where("live and kind = 'low'").join(x.select(*keys, F.col("close").alias("_p")), list(keys)).where("floor <= _p")
    nearest = live.groupBy(*keys).agg(
        F.min_by(F.struct("floor", "ceil", "strength"), F.struct(F.col("_p") - (F.col("floor") + F.col("ceil")) / 2, "formed", "source", "zone")).alias("z")
    )
    x = x.join(nearest, list(keys), "left").withColumns({"floor": F.col("z.floor"), "ceil": F.col("z.ceil"), "strength": F.col("z.strength")})
    over = higher.where("kind = 'low' and live").select(*keys, "floor", "ceil")
    x = lv.overlaps(x, over, keys).withColumnRenamed("overlaps", "weekly_zone")
    p, a = F.col("close"), F.col("atr")
    distance = F.when(p.between(F.col("floor"), F.col("ceil")), 0.0).otherwise(F.greatest(p - F.col("ceil"), F.lit(0.0))) / a
    near_ma = (F.abs(p - F.col("sma200")) <= lv.LONG_MA_ATR * a) | (F.abs(p - F.col("sma250")) <= lv.LONG_MA_ATR * a)
    spread = F.col("year_high") - F.col("year_low")
    near_fib = F.lit(False)
    for f in lv.FIBS:
        near_fib = near_fib | (F.abs(p - (F.col("year_high") - f * spread)) <= lv.FIB_ATR * a)
    x = x.withColumns(
        {
            "distance_atr": distance,
            "stop": F.round(F.least(F.col("floor") - STOP_BUFFER_ATR * a, p - MIN_STOP_ATR * a), 4),
            "bullish_candle": F.col("turning_up_candle") & (F.col("low") <= F.col("ceil")) & (p > F.col("floor")),
            "near_long_ma": F.coalesce(near_ma, F.lit(False)),
            "near_fib": F.coalesce(near_fib, F.lit(False)),
        }
    )
    x = x.withColumns({"reward_risk": F.round((F.col("target") - p) / F.nullif(p - F.col("stop"), F.lit(0.0)), 2), "headroom": F.round(F.col("target") / p - 1, 4)})
    signs = ["bullish_candle", "rsi_divergence", "macd_turning_up", "reclaimed_short_ma", "volume_pattern"]
    count = sum((F.coalesce(F.col(s), F.lit(False)).cast("int") for s in signs[1:]), F.coalesce(F.col(signs[0]), F.lit(False)).cast("int"))
    reason = (
        F.when(F.coalesce("excluded", F.lit(False)), "excluded by a red flag")
        .when(F.col("quality").isNull(), "quality score not yet available")
        .when(F.col("quality") < QUALITY_GATE, "quality below the gate")
        .when(a.isNull() | (a <= 0), "no ATR")
        .when(F.col("floor").isNull(), "no live zone below price")
        .when(F.col("distance_atr") >= lv.PROXIMITY_ZERO, "too far above the zone")
        .when(p <= F.col("stop"), "price already below the stop")
        .when(F.col("headroom") < MIN_HEADROOM, "too little room to the next resistance")
    )
    x = x.withColumns({"signals": count, "reason": reason})
    parts = {
        "zone_strength": F.coalesce("strength", F.lit(50.0)),
        "confirmation": F.least(F.lit(100.0), F.col("signals") * 45.0),
        "confluence": F.least(F.lit(100.0), F.col("weekly_zone").cast("int") * 55.0 + F.col("near_long_ma").cast("int") * 25.0 + F.col("near_fib").cast("int") * 20.0),
        "proximity": lv.proximity("distance_atr"),
        "reward_risk": F.when(F.col("reward_risk") >= lv.REWARD_ZERO, lv.reward_risk("reward_risk")).otherwise(0.0),
    }
    score = sum((c * SETUP[k] for k, c in parts.items()), F.lit(0.0)) / sum(SETUP.values())
    knife = F.col("falling_knife") & ~F.col("stabilised")
    falling = F.col("lower_highs") & ~(F.coalesce("rsi_divergence", F.lit(False)) | F.col("higher_low"))
    score = F.least(score, F.when(knife, KNIFE_CAP), F.when(falling, DOWNTREND_CAP), F.when(F.col("signals") == 0, WATCHING_CAP))
    score = F.round(clamp(score, 0, 100), 2)
    open_ = F.col("reason").isNull()
    return x.select(
        *keys,
        F.when(~open_, "none").when(F.col("signals") >= 1, "triggered").otherwise("watching").alias("status"),
        F.when(open_, score).alias("score"),
        *[F.when(F.col("reason").isNull() | (F.col("reason") == "too little room to the next resistance"), F.col(c)).alias(c) for c in ("floor", "ceil", "stop", "target", "reward_risk", "headroom")],
        *[F.when(open_, F.round(c, 2)).alias(f"c_{k}") for k, c in parts.items()],
        F.when(open_, F.col("signals")).alias("signals"),
        "reason",
    )
