"""Latest-row, as-of, bitemporal and forward reads; only filings meet their short list of dates in a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import W


def latest(df: DataFrame, keys, order: str) -> DataFrame:
    """The last row of each key (``order`` is unique in it); a hash aggregation that combines before the shuffle."""
    keys = [keys] if isinstance(keys, str) else keys
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])
    return best.select(*[c for c in df.columns])


def tail(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key; the rank filter is limited before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def seek(df: DataFrame, cursor: dict, n: int) -> DataFrame:
    """The page of n rows after a cursor in the order of its columns (struct comparison is lexicographic)."""
    keys = list(cursor)
    at = F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in cursor.items()])
    return df.where(F.struct(*keys) > at).orderBy(*keys).limit(n)


def asof_latest(df: DataFrame, at: DataFrame, key: str, order: str, warm_up: int = 1) -> DataFrame:
    """For each ``as_of`` the key's last row at or before it, if ``warm_up`` rows lie there.

    ``at`` is a short list of dates. A row goes to the first of them that sees it, so
    an aggregation keeps one row a key and date and nothing is multiplied; that row
    then holds until the key's next one, and counts run on.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    dates = at.agg(F.array_sort(F.collect_set("as_of")).alias("all"))
    seen = df.withColumn("_all", dates.scalar()).withColumn("_at", F.try_element_at(F.filter("_all", lambda a: a >= F.col(order)), F.lit(1)))
    best = seen.where("_at is not null").groupBy(key, "_at").agg(
        F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest], F.count("*").alias("_n")
    )
    w = Window.partitionBy(key).orderBy("_at")
    best = best.withColumns({"_next": F.lead("_at").over(w), "_n": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": dates.scalar()})
    held = F.filter("_all", lambda a: (a >= F.col("_at")) & (F.col("_next").isNull() | (a < F.col("_next"))))
    return best.where(F.col("_n") >= warm_up).select(F.explode(held).alias("as_of"), key, *[c for c in df.columns if c != key])


def asof_join(left: DataFrame, right: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Backward as-of join of two histories by union and last non-null: one shuffle by key, no range join."""
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(key, order, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def known_by(df: DataFrame, at: DataFrame, filed: str, lag_days: int = 0) -> DataFrame:
    """Rows filed (plus a disclosure lag) by each ``as_of``; rows without a filing date are never known."""
    return df.join(F.broadcast(at), F.date_add(filed, lag_days) <= F.col("as_of"))


def forward_return(hold: int) -> Column:
    """From the next session's open to the close ``hold`` sessions ahead."""
    return F.lead("close", hold).over(W()) / F.nullif(F.lead("open", 1).over(W()), F.lit(0.0)) - 1


def snapshot_at(snapshots: DataFrame, at: DataFrame, date: str = "week_start") -> DataFrame:
    """as_of with the newest snapshot date at or before it, else the earliest."""
    dates = snapshots.select(date).distinct()
    first = dates.agg(F.min(date).alias("_first"))
    got = at.join(dates, F.col(date) <= F.col("as_of"), "left").groupBy("as_of").agg(F.max(date).alias(date))
    return got.crossJoin(F.broadcast(first)).select("as_of", F.coalesce(date, "_first").alias(date))
