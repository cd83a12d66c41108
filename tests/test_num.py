"""The numeric contract and golden indicator values."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.functions import num
from ledgerflow.operators import histories as hs
from ledgerflow.operators import indicators as ind

# The worked example of Wilder's oscillator that charting schools publish.
CLOSES = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00, 46.03, 46.41, 46.22, 45.64]


def series(spark, closes):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), c, None if c is None else c + 0.5, None if c is None else c - 0.5, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_ranks_ties_nulls_and_lone_members(spark):
    df = spark.createDataFrame([(1, "g", 1.0), (2, "g", 2.0), (3, "g", 2.0), (4, "g", None), (5, "h", 7.0)], "symbol int, sector string, x double")
    got = {r["symbol"]: (r["r"], r["p"], r["d"]) for r in df.select("symbol", num.avg_rank("x", "sector").alias("r"), num.percentile_score("x", "sector").alias("p"), num.percentile_score("x", "sector", descending=True).alias("d")).collect()}
    assert got == {1: (1.0, 0.0, 100.0), 2: (2.5, 75.0, 25.0), 3: (2.5, 75.0, 25.0), 4: (None, None, None), 5: (1.0, 50.0, 50.0)}


def test_peers_deciles_and_blend(spark):
    df = spark.createDataFrame([(i, "big" if i < 12 else "small" if i < 15 else None, float(i)) for i in range(16)], "symbol int, sector string, x double")
    assert {r["sector"]: r["peer"] for r in num.peer_groups(df).collect()} == {"big": "big", "small": "__POOLED__", None: "__POOLED__"}
    assert [r["d"] for r in df.select(num.decile("x", "symbol").alias("d")).where("d in (1, 10)").collect()].count(1) == 2
    assert df.limit(9).select(num.decile("x", "symbol").alias("d")).where("d is not null").count() == 0
    one = spark.createDataFrame([(50.0, None, 0.0)], "a double, b double, z double")
    r = one.select(num.blend({"a": 60, "b": 40}).alias("x"), num.blend({"a": 60, "b": 40}, 0.7).alias("y"), num.safe_div("a", "z").alias("q"), num.mean_of("b", "b").alias("m"), num.band("b", 0, 1, 2, 3).alias("n"), num.band("a", 0, 100, 200, 300).alias("h")).first()
    assert tuple(r) == (50.0, None, None, None, None, 50.0)


def test_rsi_golden(spark):
    got = column(ind.rsi(series(spark, CLOSES)), "rsi14")
    assert got[:14] == [None] * 14
    assert all(abs(a - b) < 0.05 for a, b in zip(got[14:17], (70.46, 66.25, 66.48)))
    assert column(ind.rsi(series(spark, [float(i) for i in range(1, 30)])), "rsi14")[-1] == 100
    assert column(ind.rsi(series(spark, [float(i) for i in range(30, 1, -1)])), "rsi14")[-1] == 0
    assert column(ind.rsi(series(spark, [5.0] * 20)), "rsi14")[-1] == 50


def folded_ema(xs, alpha):
    """The plain recursion: a mean loses (1 - alpha) of its weight at every row, a new value has alpha."""
    mean, weight, out = None, 1.0, []
    for x in xs:
        if mean is None:
            mean = x
        else:
            weight *= 1 - alpha
            if x is not None:
                mean, weight = (weight * mean + alpha * x) / (weight + alpha), 1.0
        out.append(mean)
    return out


def folded_wilder(xs, n):
    seen, mean, out = [], None, []
    for x in xs:
        if x is not None:
            seen.append(x)
            mean = mean + (x - mean) / n if mean is not None else sum(seen) / n if len(seen) == n else None
        out.append(mean)
    return out


def close_to(got, want, tolerance=1e-9):
    assert [x is None for x in got] == [x is None for x in want]
    assert all(x is None or abs(x - y) <= tolerance * max(1, abs(y)) for x, y in zip(got, want))


def test_ema_carries_gaps(spark):
    df = series(spark, [1.0, 2.0, 3.0, None, None, 6.0])
    close_to(column(ind.ema(df, "close", 9, "e"), "e"), [1.0, 1.2, 1.56, 1.56, 1.56, 2.8072], 1e-4)
    close_to(column(ind.ema(series(spark, [None, 2.0, 4.0]), "close", 9, "e"), "e"), [None, 2.0, 2.4])


def test_recursions_equal_the_fold(spark):
    import random

    r = random.Random(3)
    for xs in ([None, 3.0, *CLOSES, None, 44.0], [r.choice((None, r.random() * 100)) for _ in range(300)], [5.0] + [None] * 700 + [r.random() for _ in range(2000)]):
        df = series(spark, xs)
        for span in (2, 9, 26):
            close_to(column(ind.ema(df, "close", span, "e"), "e"), folded_ema(xs, 2 / (span + 1)))
        for n in (2, 14):
            close_to(column(ind.wilder(df, "close", n, "w"), "w"), folded_wilder(xs, n))
    assert column(ind.ema(series(spark, [None, None]), "close", 9, "e"), "e") == [None, None]


def test_returns_pad_gaps(spark):
    got = column(ind.returns(series(spark, [10.0, None, 12.0, None]), "close", {"r": 1}), "r")
    close_to(got, [None, 0.0, 0.2, 0.0])


def test_stops(spark):
    from ledgerflow.operators.scoring import suggest_stop

    cases = [(100.0, 2.0, 96.0, None, 95.0), (100.0, 2.0, 50.0, None, 95.0), (100.0, 2.0, 120.0, 97.0, 96.0), (100.0, 2.0, None, 10.0, 95.0), (100.0, 2.0, 99.9, None, 97.0), (100.0, 30.0, None, None, 70.0), (100.0, 2.0, 50.0, 97.0, 95.0), (100.0, 0.0, 96.0, None, None)]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "close double, atr14 double, zone_floor double, swing_low double, want double, i int")
    rows = df.select("i", "want", suggest_stop().alias("stop")).orderBy("i").collect()
    close_to([x["stop"] for x in rows], [x["want"] for x in rows])


def test_newey_west_weights(spark):
    from ledgerflow.operators.research import newey_west

    for xs in ([0.1, 0.3, -0.2, 0.4], [0.1, 0.3, -0.2, 0.4, 0.0], [0.05 * i * (-1) ** i for i in range(12)]):
        df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=30 * i), x) for i, x in enumerate(xs)], "as_of date, ic double")
        n, mean = len(xs), sum(xs) / len(xs)
        e = [x - mean for x in xs]
        var = sum(x * x for x in e) / n + sum(2 * (1 - k / 6) * sum(a * b for a, b in zip(e[k:], e)) / n for k in range(1, min(5, n - 1) + 1))
        assert abs(newey_west(df, "ic").first()["nw_se"] - (max(var, 1e-12) / n) ** 0.5) < 1e-12


def test_atr_of_a_constant_range(spark):
    assert abs(column(ind.atr(series(spark, [10.0] * 30)), "atr14")[-1] - 1.0) < 1e-9


def test_histories(spark):
    df = spark.createDataFrame([([1.0, None, 2.0, 4.0],), ([-1.0, 1.0, 2.0, 3.0],), ([],)], "a array<double>")
    got = [tuple(r) for r in df.select(hs.cagr("a", 2).alias("c"), hs.trend("a").alias("t"), hs.expanding("a").alias("e"), hs.delta("a", 1).alias("d")).collect()]
    assert got == [(1.0, 1.5, False, 2.0), (3.0**0.5 - 1, 1.0, True, 1.0), (None, None, False, None)] or abs(got[1][0] - (3.0**0.5 - 1)) < 1e-12
    end, months = hs.period("l")
    p = spark.createDataFrame([("Mar 2024",), ("Mar 2023 15m",), ("TTM",)], "l string").select(end.alias("e"), months.alias("m")).collect()
    assert [tuple(r) for r in p] == [(dt.date(2024, 3, 31), 12), (dt.date(2023, 3, 31), 15), (None, 12)]
