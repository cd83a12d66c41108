"""Corporate actions on handmade histories."""

import datetime as dt

from ledgerflow.operators import actions


def bars(spark, closes, opens=None, gap=1):
    day = dt.date(2024, 1, 1)
    rows = [("A", day + dt.timedelta(days=gap * i), float((opens or closes)[i]), c * 1.01, c * 0.99, float(c), 1000.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def adjusted(spark, *a, **k):
    df = actions.adjust(bars(spark, *a, **k), actions.plausible_ratios(spark))
    return [round(r["adj_close"], 6) for r in df.orderBy("date").collect()]


def test_split_halves_history(spark):
    assert adjusted(spark, [100, 102, 51, 52]) == [50, 51, 51, 52]


def test_two_splits_compound(spark):
    assert adjusted(spark, [100, 50, 10, 10]) == [10, 10, 10, 10]


def test_reverse_split(spark):
    assert adjusted(spark, [10, 100, 101]) == [100, 100, 101]


def test_crash_without_gap_is_left(spark):
    assert adjusted(spark, [100, 82, 80], [100, 100, 82]) == [100, 82, 80]


def test_no_action_across_a_long_gap(spark):
    assert adjusted(spark, [100, 50], gap=8) == [100, 50]


def test_snap_to_a_tenth(spark):
    gaps = spark.createDataFrame([("A", dt.date(2024, 1, 1), 0.10225), ("B", dt.date(2024, 1, 1), 0.6)], "symbol string, date date, gap double")
    got = {r["symbol"]: round(r["factor"], 6) for r in actions.snapped(gaps, actions.plausible_ratios(spark)).collect()}
    assert got["A"] == 0.1 and got["B"] == 0.6
