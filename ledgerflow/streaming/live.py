"""Structured Streaming forms of quotes, transitions, dedupe, late corrections and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_quotes(quotes: DataFrame, key: str = "name", ts: str = "ts") -> DataFrame:
    """The newest row of each name by exchange time (update or complete mode)."""
    rest = [c for c in quotes.columns if c != key]
    best = quotes.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def transitions(rows: DataFrame, key: str, ts: str, value: str, level: float, out: str = "crossed") -> DataFrame:
    """Emit a row when a key's value crosses ``level``; the state is the side it was on.

    Rows of a batch are taken in time order; the first row of a key only sets the state.
    """
    schema = f"{key} {dict(rows.dtypes)[key]}, {ts} timestamp, {value} double, {out} string"

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(b[ts].to_numpy(), b[value].to_numpy("float64")) for b in batches]
        at, v = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((v, at))
        order = order[~np.isnan(v[order])]
        if not len(order):
            return
        at, v = at[order], v[order]
        above = v >= level
        before = state.get[0] == "above" if state.exists else above[0]
        hit = above != np.append(before, above[:-1])
        state.update(("above" if above[-1] else "below",))
        if hit.any():
            yield pd.DataFrame({key: k[0], ts: at[hit], value: v[hit], out: np.where(above[hit], "above", "below")})

    src = rows.select(key, F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value))
    return src.groupBy(key).applyInPandasWithState(step, schema, "side string", "append", GroupStateTimeout.NoTimeout)


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant; local timestamps are read in the session's zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def dedupe(events: DataFrame, key: str, ts: str, delay: str = "10 days") -> DataFrame:
    """Drop an event whose key was seen within the watermark."""
    return _timed(events, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def upsert_batches(stream: DataFrame, path: str, keys: list[str], ts: str, checkpoint: str):
    """Late corrections: each micro-batch replaces the rows of its keys, the newest version wins.

    Versions are written side by side and the pointer is the batch id, so a batch
    that is run again writes the same version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        from ..operators.tables import collapse, upsert

        spark = batch.sparkSession
        new = collapse(batch, keys, ts).select(*batch.columns)
        if epoch > 0:
            new = upsert(spark.read.parquet(f"{path}/v={epoch - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    w = F.window(ts, width)
    return _timed(events, ts).withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, slide: str, *keys: str, late: str = "1 hour") -> DataFrame:
    w = F.window(ts, width, slide)
    return _timed(events, ts).withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str, late: str = "1 hour") -> DataFrame:
    w = F.session_window(ts, gap)
    return _timed(events, ts).withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
