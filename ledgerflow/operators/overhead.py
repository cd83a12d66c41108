"""What stands above and below a price at any bar, read from zones that were walked once.

A zone's events are summed up as they come, so its state at a bar is the last sum at or
before it; no zone is built again for a date, and no later event is seen. Every pair of a
date and a zone of the same symbol is read, inside one equi-join by symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import candles, setups as st
from .indicators import W

_STEP = "struct<i: int, touches: int, rejections: int, breaks: int, reaction: double, ratio: double, ratios: int>"
SUPPORT = ("hammer_at_support", "inverted_hammer_at_support", "doji_at_support", "bullish_engulfing_at_support", "piercing_at_support")
RESISTANCE = ("shooting_star_at_resistance", "hanging_man_at_resistance", "doji_at_resistance", "bearish_engulfing_at_resistance", "dark_cloud_at_resistance")


def summed(zones: DataFrame) -> DataFrame:
    """Replace ``ev`` by ``steps``: after each event the touches, rejections, breaks, and the sums behind reaction and volume so far."""

    def step(done: Column, e: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        so_far = lambda k: F.coalesce(last[k], F.lit(0))
        touch = e["kind"].isin("touch", "rejection")
        now = F.struct(
            e["i"].alias("i"),
            (so_far("touches") + touch.cast("int")).alias("touches"),
            (so_far("rejections") + (e["kind"] == "rejection").cast("int")).alias("rejections"),
            (so_far("breaks") + (e["kind"] == "break").cast("int")).alias("breaks"),
            (so_far("reaction") + F.when(touch, e["reaction"]).otherwise(0.0)).alias("reaction"),
            (so_far("ratio") + F.coalesce(e["ratio"], F.lit(0.0))).alias("ratio"),
            (so_far("ratios") + e["ratio"].isNotNull().cast("int")).alias("ratios"),
        ).cast(_STEP)
        return F.concat(done, F.array(now))

    return zones.withColumn("steps", F.aggregate("ev", F.array().cast(f"array<{_STEP}>"), step)).drop("ev")


def rated_at(zones: DataFrame, at: DataFrame, timeframe: str) -> DataFrame:
    """The zones live at each row of ``at`` (symbol, i and more), with touches, respect and strength as of that bar.

    ``zones`` comes from ``summed``. ``invalidated`` is the zone's last break of all: from
    there on it is dead, before it alive.
    """
    z = zones.select("symbol", "kind", "source", "zone", "formed", "floor", "ceil", "invalidated", "steps")
    z = at.join(z, "symbol").where((F.col("formed") <= F.col("i")) & (F.col("invalidated").isNull() | (F.col("invalidated") > F.col("i"))))
    state = F.try_element_at(F.filter("steps", lambda s: s["i"] <= F.col("i")), F.lit(-1))
    z = z.withColumn("_s", state).drop("steps")
    some = lambda k: F.coalesce(F.col(f"_s.{k}"), F.lit(0))
    z = z.withColumns({"touches": some("touches"), "rejections": some("rejections"), "breaks": some("breaks")})
    over = lambda a, b: F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))
    z = z.withColumns({"reaction": over("_s.reaction", "_s.touches"), "volume_ratio": over("_s.ratio", "_s.ratios"), "respect": F.col("rejections") / F.nullif((F.col("rejections") + F.col("breaks")).cast("double"), F.lit(0.0))})
    return z.withColumn("strength", st.strength(timeframe, "i")).drop("_s")


def nearest(rated: DataFrame, *keys: str) -> DataFrame:
    """For each key the nearest live support not above the price (below) and resistance not below it (above), as structs."""
    price, mid = F.col("close"), (F.col("floor") + F.col("ceil")) / 2
    band = F.struct("floor", "ceil", "strength", "respect", "touches")
    order = lambda d: F.struct(d.alias("d"), "formed", "source", "zone")
    under, over = (F.col("kind") == "low") & (F.col("floor") <= price), (F.col("kind") == "high") & (F.col("ceil") >= price)
    return rated.groupBy(*keys).agg(
        F.min_by(F.when(under, band), F.when(under, order(price - mid))).alias("below"),
        F.min_by(F.when(over, band), F.when(over, order(mid - price))).alias("above"),
    )


def bar_readings(bars: DataFrame) -> DataFrame:
    """Bars with their place i, candle shapes and two-bar patterns, turning candles, and the closes of the bars before (closes[k]: k + 1 back)."""
    df = candles.two_bar(bars.select("*", *candles.shapes()))
    window = max(st.FALSE_BREAKOUT_WINDOW.values())
    return df.withColumns(
        {
            "i": F.row_number().over(W()) - 1,
            "turns_up": st._wick_or_engulfing(True),
            "turns_down": st._wick_or_engulfing(False),
            "closes": F.array(*[F.lag("close", k).over(W()) for k in range(1, window + 1)]),
        }
    )


def failed_breakout(ceil: Column, timeframe: str) -> Column:
    """Whether one of the bars just before closed above a ceiling that this close is under."""
    window = st.FALSE_BREAKOUT_WINDOW[timeframe]
    # Only bars after the first count.
    before = F.slice("closes", F.lit(1), F.least(F.lit(window), F.greatest(F.col("i") - 1, F.lit(0))))
    return (F.col("i") >= window + 1) & (F.col("close") < ceil) & F.exists(before, lambda c: c > ceil)


def bundle(at: DataFrame, near: DataFrame, *keys: str, timeframe: str = "daily") -> DataFrame:
    """The overhead features of each row of ``at`` (bar readings by ``keys``): strength and respect of the nearest bands, headroom, breakout, rejection and ten patterns.

    No band gives nulls, and false for what needs one. Patterns and flags are 0 or 1.
    """
    df = at.join(near, list(keys), "left")
    parts = {}
    for side, kind in (("below", "low"), ("above", "high")):
        band = df.withColumns({"floor": F.col(f"{side}.floor"), "ceil": F.col(f"{side}.ceil")})
        df = band.withColumns({k: F.coalesce(c, F.lit(False)).cast("double") for k, c in st.at_levels(band, kind).items()}).drop("floor", "ceil")
    ceil, floor = F.col("above.ceil"), F.col("above.floor")
    parts = {
        "resistance_strength": F.col("above.strength"),
        "resistance_respect": F.col("above.respect"),
        "headroom": floor / F.col("close") - 1,
        "false_breakout": F.coalesce(failed_breakout(ceil, timeframe), F.lit(False)).cast("double"),
        "rejected_at_resistance": F.coalesce(F.col("turns_down") & (F.col("high") >= floor) & (F.col("close") < ceil), F.lit(False)).cast("double"),
        "zone_respect": F.col("below.respect"),
        "zone_strength": F.col("below.strength"),
    }
    return df.withColumns(parts)
