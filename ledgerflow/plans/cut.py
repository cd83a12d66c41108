"""Cutting a plan: a table that many branches read is computed once and kept in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as a checkpoint in ``spark.checkpoint.dir``, dealt by ``keys`` if given; its partitioning is known to later plans.

    A lost executor reads it again. A local session without the setting gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerflow-"))
    return (df.repartition(*keys) if keys else df).checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, for files of one run; it goes when the driver ends."""
    from pyspark import SparkContext

    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ledgerflow-')}"
    path = f"{base.rstrip('/')}/ledgerflow-files/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        if SparkContext._active_spark_context is not None and not spark._jsc.sc().isStopped():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(clear)
    return path
