"""Queries that return every row: no cap, no subset of ids."""

from ledgerflow.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_all_alerts_and_all_view_rows(spark):
    alerts = QUERIES["l12_g05_all_alerts"](spark, SF).collect()
    assert len(alerts) == 120 and [r["severity"] for r in alerts] == sorted(r["severity"] for r in alerts)
    assert {r["severity"] for r in alerts} == {0, 1, 2}
    view = QUERIES["c17_filter_sort_all"](spark, SF).collect()
    assert len(view) > 15 and all("00" in r["name"] for r in view)
    scores = [r["a"] for r in view if r["a"] is not None]
    assert scores == sorted(scores, reverse=True)
