"""Calendar resampling of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weekly(bars: DataFrame) -> DataFrame:
    """Weeks that end on Friday; the stamp is the last session, so a running week never leads."""
    week = F.next_day(F.date_sub("date", 1), "FRI")
    return (
        bars.groupBy("symbol", week.alias("week"))
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
            F.max("date").alias("date"),
        )
        .where("close is not null")
    )


def month_ends(dates: DataFrame, warm_up: int, ahead: int) -> DataFrame:
    """The last session of each month with ``warm_up`` sessions before and ``ahead`` after it.

    One row a session: the one-task window is over the calendar, not over bars.
    """
    w = Window.orderBy("date")
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    df = dates.withColumn("rn", F.row_number().over(w)).withColumn("n", n)
    df = df.where((F.col("rn") > warm_up) & (F.col("rn") <= F.col("n") - ahead))
    return df.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"))
