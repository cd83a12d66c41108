"""Batches of a feed are written and read by as many tasks as their rows need."""

import os

from pyspark.sql import functions as F

from ledgerflow.streaming import runs


def test_a_batch_is_not_one_file_and_stays_one_micro_batch(spark, tmp_path):
    df = spark.range(0, 1000, 1, 8).select("id", (F.col("id") % 10).alias("k"), F.timestamp_seconds("id").alias("at"))
    path = str(tmp_path)
    stream = runs.feed(spark, f"{path}/in", df.schema)
    files = []

    def seen():
        for i in runs.arrivals(df, f"{path}/in", "at", 4):
            files.append(sum(f.endswith(".parquet") for f in os.listdir(f"{path}/in")))
            yield i

    runs.append_versions(stream, path, ["k"], "id", seen())
    assert len(files) == 4 and files[-1] > 4
    got = spark.read.parquet(f"{path}/versions")
    assert sorted(r["epoch"] for r in got.select("epoch").distinct().collect()) == [0, 1, 2, 3]
    assert {r["k"]: r["id"] for r in runs.current(spark, path, ["k"]).collect()} == {k: 990 + k for k in range(10)}
