"""Snapshot weeks come from all bars."""

import datetime as dt

from ledgerflow.catalog import misc


def test_weeks_without_symbol_1(spark):
    class Fixture:
        def __init__(self):
            self.spark = spark

        def bars(self):
            days = [(2, dt.date(1995, 1, 3)), (2, dt.date(1996, 3, 26)), (2, dt.date(1998, 1, 13))]
            return spark.createDataFrame(days, "symbol long, date date")

    got = {str(r["as_of"]): str(r["week_start"]) for r in misc.d07_membership_snapshot_all(Fixture()).collect()}
    assert got == {"1990-01-01": "1995-01-02", "1996-03-29": "1996-03-25", "1998-01-15": "1998-01-12"}
