"""Corporate actions: detect a split or bonus from an open gap, snap it to a ratio, adjust the history."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .indicators import W

# Gap limits and tolerances.
FALL_BELOW, RISE_ABOVE, SNAP, EXACT, MAX_GAP_DAYS = 0.78, 1.28, 0.03, 0.005, 5
SPLITS = ("1/2", "2/5", "1/4", "1/5", "1/10", "1/20", "1/25", "1/50", "1/100")
BONUS_MAX = 10  # a free shares for b held, both up to this
LOW, HIGH = 0.005, 200.0


def plausible_ratios(spark: SparkSession) -> DataFrame:
    """ratio and complexity of splits, bonuses a:b, a split with a bonus, and inverses, within bounds; a list of fixed size."""
    span = range(1, BONUS_MAX + 1)
    split, bonus = {Fraction(x) for x in SPLITS}, {Fraction(b, a + b) for a in span for b in span}
    every = split | bonus | {x * y for x in split for y in bonus}
    every |= {1 / x for x in every}
    rows = [(float(x), x.numerator + x.denominator) for x in sorted(every) if LOW <= float(x) <= HIGH and x != 1]
    return spark.createDataFrame(rows, "ratio double, complexity int")


def gap_ratio() -> Column:
    """Open over the close before if it lies outside the limits and the sessions are near, else NULL."""
    before, day = F.lag("close").over(W()), F.lag("date").over(W())
    r = F.col("open") / F.nullif(before, F.lit(0.0))
    near = F.datediff("date", day) <= MAX_GAP_DAYS
    return F.when(near & ((r < FALL_BELOW) | (r > RISE_ABOVE)), r)


def snapped(gaps: DataFrame, ratios: DataFrame, key: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """The factor of each gap: the nearest ratio within 0.5%, else the simplest within 3%; gaps without one are left out."""
    near = F.abs(F.col("gap") / F.col("ratio") - 1)
    df = gaps.join(F.broadcast(ratios), near <= SNAP).withColumn("err", near)
    stage = F.when(F.col("err") <= EXACT, 0).otherwise(1)
    order = F.struct(stage.alias("s"), F.when(stage == 0, F.lit(0)).otherwise(F.col("complexity")).alias("c"), "err", "ratio")
    return df.groupBy(*key, "gap").agg(F.min_by("ratio", order).alias("factor"))


def adjust(bars: DataFrame, ratios: DataFrame) -> DataFrame:
    """Add action (the factor of the day, NULL if none) and adj_close: the close times all later factors."""
    gaps = bars.withColumn("gap", gap_ratio()).where("gap is not null").select("symbol", "date", "gap")
    found = snapped(gaps, ratios).select("symbol", "date", F.col("factor").alias("action"))
    df = bars.join(found, ["symbol", "date"], "left")
    later = F.product(F.coalesce("action", F.lit(1.0))).over(W().rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("adj_close", F.col("close") * F.coalesce(later, F.lit(1.0)))


def unexplained(bars: DataFrame, ratios: DataFrame) -> DataFrame:
    """Gaps outside the limits that no ratio explains."""
    gaps = bars.withColumn("gap", gap_ratio()).where("gap is not null").select("symbol", "date", "gap")
    return gaps.join(snapped(gaps, ratios).select("symbol", "date"), ["symbol", "date"], "left_anti")


def apply_factor(bars: DataFrame) -> DataFrame:
    """Prices times adj_close / close (NULL: 1), volume over it."""
    f = F.coalesce(F.col("adj_close") / F.nullif("close", F.lit(0.0)), F.lit(1.0))
    df = bars.withColumn("_f", F.when(f > 0, f).otherwise(1.0))
    return df.select("symbol", "date", *[(F.col(c) * F.col("_f")).alias(c) for c in ("open", "high", "low", "close")], (F.col("volume") / F.col("_f")).alias("volume"))
