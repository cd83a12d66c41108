"""Breadth, index level and regime of the whole market."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import W

# Fixed values of the regime study.
CLIP, WEAK_BREADTH = 0.5, 0.5


def daily_mean_return(bars: DataFrame) -> DataFrame:
    """Mean over symbols of the day's return, clipped so one bad print cannot move it."""
    r = F.col("close") / F.nullif(F.lag("close").over(W()), F.lit(0.0)) - 1
    r = F.when(r.isNotNull(), F.greatest(F.lit(-CLIP), F.least(r, F.lit(CLIP))))
    return bars.withColumn("r", r).groupBy("date").agg(F.count("r").alias("n"), F.avg("r").alias("mean_return"))


def backdrop(bars: DataFrame) -> DataFrame:
    """Per date: compounded index, drawdown from its 252-session high, distance to its 200-session mean, 63-session return.

    The windows without partition run over one row a date.
    """
    w = Window.orderBy("date")
    df = daily_mean_return(bars).withColumn("index_level", F.exp(F.sum(F.log(F.lit(1.0) + F.coalesce("mean_return", F.lit(0.0)))).over(w)))
    x = F.col("index_level")
    return df.select(
        "date",
        x.alias("index_level"),
        (x / F.max(x).over(w.rowsBetween(-251, 0)) - 1).alias("drawdown"),
        (x / F.avg(x).over(w.rowsBetween(-199, 0)) - 1).alias("vs_200dma"),
        (x / F.lag(x, 63).over(w) - 1).alias("return_3m"),
    )


def breadth(bars: DataFrame, n: int = 200, least: int = 150) -> DataFrame:
    """Share of the symbols that traded which closed above their mean of the last n market sessions."""
    days = bars.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    df = bars.join(F.broadcast(days), "date")
    w = Window.partitionBy("symbol").orderBy("i").rangeBetween(-(n - 1), 0)
    above = F.when(F.count("close").over(w) >= least, (F.col("close") > F.avg("close").over(w)).cast("double"))
    df = df.withColumn("above", above)
    return df.groupBy("date").agg(F.avg("above").alias("breadth"), F.count("above").alias("n")).withColumn(
        "regime", F.when(F.col("breadth") < WEAK_BREADTH, "weak").when(F.col("breadth").isNotNull(), "strong")
    )


# What a study found for each regime (months, six-month return of the top decile and of all, share of months in which ranks helped, episodes).
STUDY = {"weak": (16, 0.156, 0.096, 1.0, 3), "strong": (22, 0.214, 0.120, 1.0, None)}
STUDY_FIELDS = ("hist_months", "hist_top", "hist_avg", "hist_ic_positive", "hist_episodes")


def backdrop_rows(bars: DataFrame) -> DataFrame:
    """The backdrop and the breadth of each date with what the study found for its regime (nothing where that is unknown)."""
    x = backdrop(bars).join(breadth(bars).select("date", "breadth", "regime"), "date")
    types = ("int", "double", "double", "double", "int")
    found = {name: F.when(F.col("regime") == "weak", F.lit(STUDY["weak"][i])).when(F.col("regime") == "strong", F.lit(STUDY["strong"][i])).cast(types[i]) for i, name in enumerate(STUDY_FIELDS)}
    return x.withColumns(found).drop("index_level")
