"""Chart documents lie many to a file."""

import os

from ledgerflow.catalog import QUERIES, files


def test_files_do_not_grow_with_symbols(spark, sf_dir, tmp_path, monkeypatch):
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey").distinct().count()
    monkeypatch.setattr(files, "folder", lambda *_: f"{tmp_path}/chart")
    got = QUERIES["a22_chart_files"](spark, sf_dir)
    found = [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".txt")]
    assert got.select("symbol").distinct().count() == wanted and 0 < len(found) <= 8
