"""Streams run to the end of what is there, and tables of versions that late rows append to."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import collapse

WAIT_S = 1800  # a run that takes longer has failed


def arrivals(df: DataFrame, path: str, order: str, batches: int) -> Iterator[int]:
    """Write ``df`` as batches that come one after the other in time, as a feed leaves them in a folder; yields when a batch is there.

    A batch has as many files as its rows need, written where they were read.
    """
    at = F.col(order)
    at = (F.unix_micros(at.cast("timestamp")) if dict(df.dtypes)[order].startswith("timestamp") else at).cast("double")
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        df.write.parquet(path)
        yield 0
        return
    part = F.least(F.lit(batches - 1), F.floor((at - low) / max(high - low, 1.0) * batches)).cast("int")
    for i in range(batches):
        df.where(F.coalesce(part, F.lit(0)) == i).write.mode("append").parquet(path)
        yield i


def feed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The folder as a stream: a run takes the files that have come since the last one as one micro-batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)  # nothing may have come yet
    return spark.readStream.schema(schema).parquet(path)


def to_the_end(stream: DataFrame, path: str, mode: str = "append", batches: Iterable = (0,)) -> DataFrame:
    """Run until all that is there has been taken, through the file sink (append), and read the rows back.

    It runs once for each of ``batches``, as they come. The sink's log makes a batch count once
    however often it runs; ``path`` keeps the checkpoint too.
    """
    for _ in batches:
        _finish(stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{path}/rows"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def latest_state(stream: DataFrame, path: str, batches: Iterable = (0,)) -> DataFrame:
    """Run an aggregation to the end, once for each of ``batches``, and read its last complete state; each batch replaces its own version."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")

    for _ in batches:
        _finish(stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    rows = spark.read.parquet(f"{path}/state")
    last = rows.agg(F.max("epoch")).first()[0]
    return rows.where(F.col("epoch") == last).drop("epoch")


def append_versions(stream: DataFrame, path: str, keys: list[str], seq: str, batches: Iterable = (0,)) -> None:
    """Late corrections: a micro-batch writes the last row of each of its keys as versions of its own, and no other row.

    A batch that runs again writes the same folder again. ``current`` reads the newest version
    of each key; ``compact`` folds what has gathered.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        collapse(batch, keys, seq).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/versions/epoch={epoch}")

    for _ in batches:
        _finish(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each key: that of the last batch that had it. One aggregation, combined before its shuffle."""
    rows = spark.read.option("basePath", f"{path}/versions").parquet(f"{path}/versions")
    return collapse(rows, keys, "epoch").drop("epoch")


def compact(spark: SparkSession, path: str, keys: list[str], upto: int) -> None:
    """Fold the versions of batches up to ``upto`` into that of batch ``upto``; readers see either the old ones or the new one.

    The folded rows are written aside before the versions they replace go, and ``upto`` is
    written last, so a fold that breaks off can be made again.
    """
    from py4j.java_gateway import JavaObject

    rows = spark.read.option("basePath", f"{path}/versions").parquet(f"{path}/versions").where(F.col("epoch") <= upto)
    folded = collapse(rows, keys, "epoch").drop("epoch")
    folded.write.mode("overwrite").parquet(f"{path}/folded")
    spark.read.parquet(f"{path}/folded").write.mode("overwrite").parquet(f"{path}/versions/epoch={upto}")
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs: JavaObject = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(Path(f"{path}/versions")):
        name = status.getPath().getName()
        if name.startswith("epoch=") and int(name[6:]) < upto:
            fs.delete(status.getPath(), True)
    fs.delete(Path(f"{path}/folded"), True)


def _finish(query) -> None:
    if not query.awaitTermination(WAIT_S):
        query.stop()
        raise TimeoutError(f"the stream did not end in {WAIT_S} s")


def by_batch(stream: DataFrame, path: str, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Run ``step`` on each micro-batch to the end; its rows are kept by batch and read back together."""

    def write(batch: DataFrame, epoch: int) -> None:
        step(batch, epoch).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    _finish(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    return stream.sparkSession.read.parquet(f"{path}/rows")
