"""The numeric contract: missing is NULL, division by zero is NULL, ranks are average ranks.

Every function takes and returns columns, so Catalyst keeps them in one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


SHIFT = 2.5e-10


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x) -> Column:
    """NaN and infinities become NULL."""
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def safe_div(a, b) -> Column:
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def clamp(x, low: float, high: float) -> Column:
    """Spark's greatest and least skip nulls, so a null is guarded."""
    c = col(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(c, F.lit(float(high)))))


GRAIN = 2.0**18


def steady_sum(x) -> Column:
    """Aggregate: a sum that does not hang on the order of its terms, so that equal groups are exact ties.

    Multiples of 2 ** -18 and what is left of them are added apart, both without rounding
    while the absolute terms sum to under 2 ** 35; beyond that it is a plain sum.
    """
    c = col(x)
    coarse = F.floor(c * GRAIN).cast("double") / GRAIN
    return F.sum(coarse) + F.sum(c - coarse)


def correlation(a, b) -> Column:
    """Aggregate: Pearson's coefficient; NULL where one of the two does not vary."""
    both = F.stddev_pop(col(a)) * F.stddev_pop(col(b))
    return F.covar_pop(col(a), col(b)) / F.nullif(both, F.lit(0.0))


def band(x, zero_low: float, ideal_low: float, ideal_high: float, zero_high: float) -> Column:
    """100 within the ideal range, falling in a straight line to 0 at the outer bounds."""
    c = col(x)
    up = (c - zero_low) / (ideal_low - zero_low) * 100
    down = (F.lit(zero_high) - c) / (zero_high - ideal_high) * 100
    score = F.when(c < ideal_low, up).when(c > ideal_high, down).otherwise(F.lit(100.0))
    return F.when(c.isNotNull(), clamp(score, 0, 100))


def mean_of(*parts) -> Column:
    """Mean of the parts that are there."""
    cs = [col(p) for p in parts]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    return total / F.nullif(n.cast("double"), F.lit(0.0))


def blend(weights: dict, minimum: float = 0.0) -> Column:
    """Weighted mean over the parts that are there, NULL below a share of the weight."""
    items = [(col(c), float(w)) for c, w in weights.items()]
    whole = sum(w for _, w in items)
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in items[1:]), F.coalesce(items[0][0], F.lit(0.0)) * items[0][1])
    have = sum((c.isNotNull().cast("double") * w for c, w in items[1:]), items[0][0].isNotNull().cast("double") * items[0][1])
    return F.when(have >= minimum * whole, total / F.nullif(have, F.lit(0.0)))


def avg_rank(x: str, *groups: str, descending: bool = False) -> Column:
    """Average rank among the non-null values of a group; null stays null."""
    present = F.col(x).isNotNull()
    keys = [F.col(g) for g in groups] + [present]
    order = F.col(x).desc() if descending else F.col(x).asc()
    ties = Window.partitionBy(*keys, F.col(x))
    r = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    return F.when(present, r + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def present_count(x: str, *groups: str) -> Column:
    w = Window.partitionBy(*[F.col(g) for g in groups]) if groups else Window.partitionBy(F.lit(0))
    return F.count(F.col(x)).over(w)


def percentile_score(x: str, *groups: str, descending: bool = False) -> Column:
    """0 to 100 by average rank; a lone member has 50."""
    n = present_count(x, *groups)
    r = avg_rank(x, *groups, descending=descending)
    return F.when(F.col(x).isNotNull(), F.when(n == 1, F.lit(50.0)).otherwise((r - 1) / F.nullif(n - 1, F.lit(0)) * 100))


def pct_rank(x: str, *groups: str, descending: bool = False) -> Column:
    """Average rank over the number present, in (0, 1]."""
    return avg_rank(x, *groups, descending=descending) / present_count(x, *groups)


def decile(x: str, tiebreak: str, *groups: str, least: int = 10) -> Column:
    """Ten quantile bins of first-come ranks: 1 to 10, NULL with fewer than ``least`` values."""
    present = F.col(x).isNotNull()
    keys = [F.col(g) for g in groups] + [present]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(x), F.col(tiebreak)))
    n = present_count(x, *groups)
    d = F.greatest(F.lit(1), F.ceil((rn - 1) * 10 / F.nullif(n - 1, F.lit(0))).cast("int"))
    return F.when(present & (n >= least), d)


def roll(agg: Column, x, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """``agg`` over the last n rows, NULL until ``least`` (default n) of them are non-null."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(x)).over(f) >= (least or n), agg.over(f))


def peer_groups(df: DataFrame, group: str = "sector", least: int = 10, out: str = "peer", within: tuple[str, ...] = ()) -> DataFrame:
    """Groups with fewer than ``least`` members (on each date of ``within``), or without a name, are pooled."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*within, group))
    return df.withColumn(out, F.when(F.col(group).isNull() | (n < least), "__POOLED__").otherwise(F.col(group)))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round once, at the sink; NaN and infinities become NULL.

    Prices are quotients of short decimals, so exact ties are common; the shift puts
    them on one side whatever the engine's rounding. Adding 0 drops a negative zero.
    """
    return df.select([(F.round(clean(c) + SHIFT, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
