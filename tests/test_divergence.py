"""Divergence of swings against a bar-by-bar reading of its rule."""

import random

import pytest

from ledgerflow.operators import divergence as dv

SWINGS = "symbol long, kind string, idx int, price double, confirmed int"


def frames(spark, swings, rsi):
    read = spark.createDataFrame([(s, i, v) for s, line in rsi.items() for i, v in enumerate(line)], "symbol long, i int, rsi14 double")
    return spark.createDataFrame(swings, SWINGS), read


def at_bar(swings, rsi, symbol, i, kind, timeframe):
    """The pair a bar sees, asked of that bar alone: (earlier, recent, confirmed) or None."""
    wanted = "low" if kind == "bullish" else "high"
    seen = [p for p in swings if p[0] == symbol and p[1] == wanted and p[4] <= i and p[2] >= i - dv.LOOKBACK[timeframe]]
    if len(seen) < 2:
        return None
    recent = seen[-1]
    for prior in reversed(seen[:-1]):
        if recent[2] - prior[2] < dv.MIN_SEPARATION[timeframe]:
            continue
        a, b = rsi[symbol][prior[2]], rsi[symbol][recent[2]]
        if a is None or b is None or abs(b - a) < 2:
            return None
        ok = recent[3] < prior[3] and b > a if kind == "bullish" else recent[3] > prior[3] and b < a
        return (prior[2], recent[2], recent[4]) if ok else None
    return None


def alive(spark, swings, rsi, timeframe="daily"):
    s, read = frames(spark, swings, rsi)
    return {(r.symbol, r.i): (r.rsi_div_bullish, r.rsi_div_bearish) for r in dv.alive(dv.pairs(s, read, timeframe), read).collect()}


def flat(n, **points):
    line = [50.0] * n
    for k, v in points.items():
        line[int(k[1:])] = v
    return {1: line}


LOWS = [(1, "low", 10, 100.0, 13), (1, "high", 18, 120.0, 20), (1, "low", 25, 95.0, 28)]


@pytest.mark.parametrize("timeframe", ["daily", "weekly"])
def test_every_bar_of_random_swings(spark, timeframe):
    rng = random.Random(7)
    swings, rsi = [], {}
    for symbol in (1, 2, 3):
        i, kind = 0, "low"
        while i < 280:
            i += rng.randint(1, 40 if symbol == 3 else 12)
            swings.append((symbol, kind, i, 100 + rng.gauss(0, 10), i + rng.randint(1, 4)))
            i, kind = swings[-1][4], "high" if kind == "low" else "low"
        rsi[symbol] = [None if k < 14 else rng.uniform(30, 70) for k in range(330)]
    s, read = frames(spark, swings, rsi)
    found = dv.pairs(s, read, timeframe)
    got = {}
    for r in found.collect():
        for i in range(r.confirmed, min(r.until, 329) + 1):
            got[r.symbol, i, r.kind] = (r.prior_idx, r.idx, r.confirmed)
    want = {(s, i, k): p for s in rsi for i in range(330) for k in ("bullish", "bearish") if (p := at_bar(swings, rsi, s, i, k, timeframe))}
    assert got == want and len(want) > 50
    keep = dv.MEMORY_BARS[timeframe]
    flags = alive(spark, swings, rsi, timeframe)
    assert all(v == tuple((s, i, k) in want and i - want[s, i, k][2] <= keep for k in ("bullish", "bearish")) for (s, i), v in flags.items())
    assert len(flags) == 990


def test_lower_low_on_stronger_momentum_is_bullish(spark):
    got = alive(spark, LOWS, flat(80, i10=30.0, i25=40.0))
    assert {k[1] for k, v in got.items() if v[0]} == set(range(28, 49)) and not any(v[1] for v in got.values())


def test_weaker_momentum_higher_lows_and_small_gaps_are_none(spark):
    assert not any(any(v) for v in alive(spark, LOWS, flat(80, i10=40.0, i25=30.0)).values())
    assert not any(any(v) for v in alive(spark, LOWS, flat(80, i10=30.0, i25=31.9)).values())
    higher = [LOWS[0], LOWS[1], (1, "low", 25, 101.0, 28)]
    assert not any(any(v) for v in alive(spark, higher, flat(80, i10=30.0, i25=40.0)).values())


def test_higher_high_on_weaker_momentum_is_bearish(spark):
    highs = [(1, "high", 10, 100.0, 13), (1, "low", 18, 90.0, 20), (1, "high", 25, 105.0, 28)]
    got = alive(spark, highs, flat(80, i10=70.0, i25=60.0))
    assert any(v[1] for v in got.values()) and not any(v[0] for v in got.values())


def test_a_swing_is_unseen_until_confirmed_and_forgotten_after(spark):
    got = alive(spark, LOWS, flat(80, i10=30.0, i25=40.0))
    assert got[1, 27] == (False, False) and got[1, 28] == (True, False) and got[1, 49] == (False, False)


def test_the_next_swing_ends_a_pair_and_unknown_momentum_gives_none(spark):
    more = [*LOWS, (1, "low", 33, 97.0, 35)]
    got = alive(spark, more, flat(80, i10=30.0, i25=40.0, i33=45.0))
    assert got[1, 34][0] and not got[1, 35][0]
    assert not any(any(v) for v in alive(spark, LOWS, {1: [None] * 80}).values())


def test_nothing_without_two_swings(spark):
    assert not any(any(v) for v in alive(spark, LOWS[:1], flat(40)).values())
    assert not any(any(v) for v in alive(spark, [], flat(5)).values())
