"""Streams over the tables, run to their end and held against the same in one batch (section L).

A table is laid down in batches in the order of their times, and a micro-batch takes one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, folder
from ..plans.views import Market
from ..streaming import live, runs
from .registry import query

BATCHES, LEVEL = 4, 50.0


def _events(m: Market, path: str) -> tuple[DataFrame, Iterator[int]]:
    """The events as a stream, and the ``BATCHES`` in which they come."""
    rows = m.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("value").cast("double").alias("value"))
    return runs.feed(m.spark, f"{path}/in", rows.schema), runs.arrivals(rows, f"{path}/in", "ts", BATCHES)


@query("SELECT user_id, max(us) AS us, round(arg_max(value, us), 6) AS value FROM (SELECT user_id, epoch_us(ts) AS us, value FROM events) GROUP BY user_id", views="")
def l01_latest_quotes_stream(m: Market) -> DataFrame:
    """The newest row of each name, kept by a running stream."""
    path = folder(m.spark, "quotes")
    s, batches = _events(m, path)
    out = runs.latest_state(live.latest_quotes(s.select("user_id", "ts", "value"), "user_id", "ts"), path, batches)
    return out.select("user_id", F.unix_micros("ts").alias("us"), "value")


@query(
    f"SELECT user_id, us, round(value, 6) AS value, crossed FROM (SELECT *, lag(crossed) OVER (PARTITION BY user_id ORDER BY us, value) AS before FROM (SELECT user_id, epoch_us(ts) AS us, value, CASE WHEN value >= {LEVEL} THEN 'above' ELSE 'below' END AS crossed FROM events WHERE value IS NOT NULL)) WHERE before <> crossed",
    views="",
)
def l02_transitions_stream(m: Market) -> DataFrame:
    """A row where a name crosses a level, its side kept as state from batch to batch."""
    path = folder(m.spark, "crossings")
    s, batches = _events(m, path)
    out = runs.to_the_end(live.transitions(s, "user_id", "ts", "value", LEVEL), path, batches=batches)
    return out.select("user_id", F.unix_micros("ts").alias("us"), "value", "crossed")


@query("SELECT l_orderkey % 1000 AS id, l_linenumber AS line, round(arg_max(l_extendedprice, ROW(b, l_orderkey, l_partkey, l_extendedprice)), 6) AS price, count(DISTINCT b) AS batches FROM (SELECT *, least(3, floor((epoch_us(l_shipdate) - lo) / greatest(hi - lo, 1)::DOUBLE * 4)) AS b FROM lineitem, (SELECT min(epoch_us(l_shipdate)) AS lo, max(epoch_us(l_shipdate)) AS hi FROM lineitem)) GROUP BY 1, 2", views="")
def l07_late_corrections_stream(m: Market) -> DataFrame:
    """Corrections that come in batches: the newest row of a key stands, and how many batches had the key."""
    path = folder(m.spark, "corrections")
    rows = m.table("lineitem").select((F.col("l_orderkey") % 1000).alias("id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").cast("timestamp").alias("at"), F.struct("l_orderkey", "l_partkey", "l_extendedprice").alias("seq"))
    batches = runs.arrivals(rows, f"{path}/in", "at", BATCHES)
    runs.append_versions(runs.feed(m.spark, f"{path}/in", rows.schema), path, ["id", "line"], "seq", batches)
    had = cut(m.spark.read.parquet(f"{path}/versions").groupBy("id", "line").agg(F.count("*").alias("batches")))
    runs.compact(m.spark, path, ["id", "line"], BATCHES - 2)
    now = runs.current(m.spark, path, ["id", "line"]).select("id", "line", "price")
    return now.join(had, ["id", "line"])
