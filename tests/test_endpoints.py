"""Columns at a few rows of a symbol, out of its arrays, against the windows over all rows."""

import datetime as dt
import random

import pytest

from ledgerflow.catalog import QUERIES
from ledgerflow.catalog.cross import featured
from ledgerflow.operators import asof, endpoints, indicators as ind

BAR = "symbol long, date date, open double, high double, low double, close double, volume double"


def bars(spark):
    """Symbols of many lengths; flat ones, ones that only rise, and ones with missing values, zeros and long pauses."""
    draw = random.Random(3)
    rows = []
    for symbol, n in enumerate((1, 2, 13, 14, 15, 28, 62, 63, 126, 127, 200, 221, 252, 253, 700, 700, 700, 1300, 1300)):
        price = 100.0
        for i in range(n):
            price = price if symbol == 14 else price * draw.uniform(1.0, 1.02) if symbol == 15 else price * draw.uniform(0.96, 1.045)
            o, h, lo, c, v = price, price * draw.uniform(1, 1.02), price * draw.uniform(0.97, 1), price, float(draw.randint(1, 90))
            if symbol == 14:
                h = lo = c
            if symbol == 16 and draw.random() < 0.1:
                c = None
            if symbol == 17:
                c, h, lo = (None if i < 40 or 300 < i < 1250 else c), (None if draw.random() < 0.3 else h), (None if draw.random() < 0.3 else lo)
            if symbol == 18 and draw.random() < 0.05:
                c, v = 0.0, None
            rows.append((symbol, dt.date(1990, 1, 1) + dt.timedelta(days=2 * i), o, h, lo, c, v))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, BAR).cache()


def near(a, b):
    if a is None or b is None:
        return a is b
    return a == b if not isinstance(a, float) else abs(a - b) <= 1e-9 * max(1, abs(a), abs(b))


def test_last_technicals_are_the_last_of_all(spark):
    b = bars(spark)
    index = spark.createDataFrame([(dt.date(1990, 1, 1) + dt.timedelta(days=2 * i), None if i % 97 == 5 else 50 + i % 31 + i / 7) for i in range(1290)], "date date, close double")
    want = {r.symbol: r for r in asof.latest(ind.technicals(b, index), "symbol", "date").collect()}
    got = endpoints.last_technicals(b, index).collect()
    assert sorted(r.symbol for r in got) == sorted(want)
    bad = [(r.symbol, c, r[c], want[r.symbol][c]) for r in got for c in ("date", "close", *ind.TECHNICALS) if not near(r[c], want[r.symbol][c])]
    assert not bad
    assert all(any(r[c] is not None for r in got) for c in ind.TECHNICALS)


def test_month_end_features_are_those_of_all_rows(spark):
    b = bars(spark)
    first = dt.date(1990, 1, 1)
    at = spark.createDataFrame([(first + dt.timedelta(days=d),) for d in (0, 3, 502, 503, 504, 505, 777, 1101, 1102, 1398, 1399, 2000, 2598, 2600, 4000)], "as_of date")
    f = featured(b).withColumn("forward_return", asof.forward_return(126))
    key = lambda r: (r.symbol, r.as_of)
    want = {key(r): r for r in asof.asof_latest(f, at, "symbol", "date", 252).collect()}
    got = endpoints.month_end_features(b, at).collect()
    assert sorted(map(key, got)) == sorted(want)
    columns = ("date", "mom", "ret3", "dist", "vr", "forward_return")
    assert not [(key(r), c, r[c], want[key(r)][c]) for r in got for c in columns if not near(r[c], want[key(r)][c])]
    assert all(any(r[c] is not None for r in got) for c in columns) and all(any(r[c] is None for r in got) for c in columns[1:])


@pytest.mark.parametrize("name", ["j15_momentum_pillar", "j20_panel", "e10_feature_ic", "e14_composite"])
def test_no_window_over_a_symbols_rows(spark, sf_dir, name):
    """Only some rows of a symbol are wanted: nothing is worked out at every row."""
    assert "windowspecdefinition(symbol#" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
