"""Table mutation as set operations: replace, update, retention, dedupe, reconcile and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Duplicates within a batch: the last row of a key in arrival order wins."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-row replacement by key; rows are never merged field by field."""
    return old.join(new, keys, "left_anti").unionByName(new)


def replace_keys(old: DataFrame, keys: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Drop every row of the processed keys, even of keys without new rows, then add the new rows."""
    return old.join(keys.select(key).distinct(), key, "left_anti").unionByName(new)


def update_where_in(df: DataFrame, matches: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Set columns on the rows whose key is in ``matches``."""
    hit = df.join(matches.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    for c, v in values.items():
        hit = hit.withColumn(c, F.when(F.col("_k").isNotNull(), v).otherwise(F.col(c)))
    return hit.drop("_k")


def retain(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the newest date (null dates go)."""
    newest = df.agg(F.max(date).alias("_m"))  # one row
    return df.join(F.broadcast(newest), F.col(date) >= F.date_sub("_m", days)).drop("_m")


def merge_overlap(stored: DataFrame, fetched: DataFrame, keys: list[str], date: str, overlap_days: int = 14) -> DataFrame:
    """Incremental load: the stored rows before the overlap, the fetched ones from it on, latest wins."""
    newest = stored.agg(F.date_sub(F.max(date), overlap_days).alias("_from"))  # one row
    late = fetched.join(F.broadcast(newest), F.col("_from").isNull() | (F.col(date) >= F.col("_from"))).drop("_from")
    return upsert(stored, late, keys)


def drifted(stored: DataFrame, source_count: DataFrame) -> DataFrame:
    """One row: both counts and whether a full rebuild is due."""
    n = stored.agg(F.count("*").alias("stored"))
    return n.crossJoin(source_count).withColumn("rebuild", F.col("stored") != F.col("source"))


def check(name: str, ok: Column, detail: Column, fatal: bool = True) -> Column:
    return F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail"), F.lit(fatal).alias("fatal"))


def score_checks(scores: DataFrame, low: int, high: int) -> DataFrame:
    """Count in range, unique symbols, scores in 0-100, half of the names convinced: one pass, a row a check."""
    a = scores.agg(
        F.count("*").alias("n"),
        F.countDistinct("symbol").alias("u"),
        F.count_if((F.col("score") < 0) | (F.col("score") > 100)).alias("bad"),
        F.avg(F.col("score").isNotNull().cast("double")).alias("cover"),
    )
    rows = F.array(
        check("count", F.col("n").between(low, high), F.col("n")),
        check("unique", F.col("n") == F.col("u"), F.col("n") - F.col("u")),
        check("range", F.col("bad") == 0, F.col("bad")),
        check("coverage", F.col("cover") >= 0.5, F.round("cover", 3), False),
    )
    return a.select(F.explode(rows).alias("c")).select("c.*")


def transitions(df: DataFrame, state: str) -> DataFrame:
    """Rows whose state differs from the symbol's row before (the first row is no transition)."""
    w = Window.partitionBy("symbol").orderBy("date")
    df = df.withColumn("before", F.lag(state).over(w)).withColumn("_seen", F.lag("date").over(w).isNotNull())
    return df.where(F.col("_seen") & ~F.col("before").eqNullSafe(F.col(state))).drop("_seen")


def suppress_seen(events: DataFrame, key: str, date: str, days: int = 10) -> DataFrame:
    """Drop an event whose key was kept in the last ``days`` days; a dropped one does not extend the time.

    The dates of one key are folded in order inside the aggregation.
    """
    dates = F.array_sort(F.collect_set(date))
    keep = F.aggregate(
        dates,
        F.array().cast("array<date>"),
        lambda acc, d: F.when((F.size(acc) == 0) | (F.datediff(d, F.get(acc, F.size(acc) - 1)) > days), F.concat(acc, F.array(d))).otherwise(acc),
    )
    return events.groupBy(key).agg(keep.alias("_k")).select(key, F.explode("_k").alias(date))
