"""Files a run leaves: one document a key, one archive file a session, sorted snapshots.

A run writes to a folder of its own and then points to it, so a reader sees the last whole
run, and a run that is made again writes the same folder again. Documents are put together
by the tasks that write them; nothing passes the driver but the name of the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

from ..functions.num import clean

DOCUMENT_DIGITS = 4


def strict(c: Column, t: DataType, digits: int | None = None) -> Column:
    """The value with every NaN and infinity in it, at any depth, as NULL; doubles rounded if ``digits`` is given."""
    if isinstance(t, (DoubleType, FloatType)):
        c = clean(c)
        return c if digits is None else F.round(c, digits)
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: strict(x, t.elementType, digits))
    if isinstance(t, StructType):
        return F.when(c.isNotNull(), F.struct(*[strict(c[f.name], f.dataType, digits).alias(f.name) for f in t.fields]))
    return c


def strict_frame(df: DataFrame, digits: int | None = None) -> DataFrame:
    return df.select(*[strict(F.col(f.name), f.dataType, digits).alias(f.name) for f in df.schema.fields])


def publish(df: DataFrame, path: str, run: str, kind: str, by: str | None = None, compression: str = "none") -> None:
    """Write ``df`` as ``kind`` (json, csv or text) under ``path``/runs/``run``, one file for each value of ``by``, then point to it."""
    out = df.repartition(F.col(by)) if by else df
    writer = out.write.mode("overwrite").option("compression", compression)
    writer = writer.partitionBy(by) if by else writer
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(f"{path}/runs/{run}")
    df.sparkSession.createDataFrame([(run,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")


def current(spark: SparkSession, path: str) -> str:
    """The folder of the last whole run."""
    return f"{path}/runs/{spark.read.text(f'{path}/current').first()['value']}"


def publish_documents(df: DataFrame, key: str, path: str, run: str, digits: int | None = DOCUMENT_DIGITS) -> None:
    """One strict JSON document a key: all columns but the key, nulls kept, numbers with ``digits`` decimals (None: all)."""
    fields = [f for f in df.schema.fields if f.name != key]
    x = df.select(key, *[strict(F.col(f.name), f.dataType, digits).alias(f.name) for f in fields])
    doc = F.to_json(F.struct(F.col(key).alias("key"), *[f.name for f in fields]), {"ignoreNullFields": "false"})
    publish(x.select(key, doc.alias("value")), path, run, "text", key)


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of the last run, parsed; a file whose text is not one JSON document fails."""
    text = spark.read.text(current(spark, path), wholetext=True).select("value")
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def publish_ranked(df: DataFrame, path: str, run: str, by: str, tiebreak: str) -> None:
    """A snapshot in falling order of ``by``, unknown last: JSON lines in files that follow each other."""
    order = [F.desc_nulls_last(by), F.col(tiebreak)]
    publish(strict_frame(df).repartitionByRange(*order).sortWithinPartitions(*order), path, run, "json")


def ranked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The snapshot's rows with the file they were in and their place in it."""
    where = F.col("_metadata.file_name").alias("file")
    rows = spark.read.text(current(spark, path), wholetext=True).select(where, F.posexplode(F.split(F.rtrim("value"), "\n")).alias("place", "line")).where("line <> ''")
    return rows.select("file", "place", F.from_json("line", schema).alias("d")).select("file", "place", "d.*")
