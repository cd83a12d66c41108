"""Recursions and frames over blocks: one sort a chain, and the same values as the plain fold."""

import datetime as dt
import random

import pytest

from ledgerflow.catalog import QUERIES
from ledgerflow.operators import indicators as ind

from tests.test_num import close_to, column, folded_ema, folded_wilder, series


@pytest.mark.parametrize("name", ["f17_all_technicals", "f07_adx", "f31_macd_turning_up", "f08_macd_histogram", "f34_rsi_divergence", "f04_rsi", "f29_f30_falling_and_stabilised", "f02_ema", "f03_f05_f06_atr", "f01_sma"])
def test_a_chain_sorts_once(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    sorts = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Sort [")
    assert "Window" in plan and sorts == 1


def test_blocks_carry_pauses_of_any_length(spark):
    r = random.Random(11)
    xs = [None, 7.0, 3.0] + [None] * 1500 + [r.random() for _ in range(40)] + [None] * 30 + [1e6 * r.random() for _ in range(1100)] + [None] * 600
    daily = series(spark, xs)
    counted = daily.withColumn("date", ind.F.date_diff("date", ind.F.lit(dt.date(2024, 1, 1))))  # dates need not be dates
    for df in (daily, counted):
        for span in (1, 2, 12):
            close_to(column(ind.ema(df, "close", span, "e"), "e"), folded_ema(xs, 2 / (span + 1)), 1e-8)
        for n in (2, 14):
            close_to(column(ind.wilder(df, "close", n, "w"), "w"), folded_wilder(xs, n), 1e-8)
    assert "_blk" not in ind.ema(daily, "close", 9, "e").columns


def test_rolled_frames_equal_plain_ones(spark):
    r = random.Random(4)
    xs = [None if r.random() < 0.2 else r.uniform(-5, 50) for _ in range(400)]
    df = series(spark, xs)
    wanted = {"m20": ("mean", "close", 20, 20), "m50": ("mean", "close", 50, 30), "h126": ("high", "close", 126, 63), "h17": ("high", "close", 17, 3)}
    got = {c: column(ind.rolled(df, wanted), c) for c in wanted}
    for c, (kind, _, n, least) in wanted.items():
        want = []
        for i in range(len(xs)):
            there = [x for x in xs[max(0, i - n + 1) : i + 1] if x is not None]
            want.append((max(there) if kind == "high" else sum(there) / len(there)) if len(there) >= least else None)
        close_to(got[c], want)


def test_median_turnover_is_the_middle(spark):
    import statistics

    r = random.Random(9)
    xs = [None if r.random() < 0.3 else r.uniform(1, 9) for _ in range(130)]
    got = column(ind.median_turnover(series(spark, xs), out="t"), "t")
    parts = [[x / 1e7 for x in xs[max(0, i - 59) : i + 1] if x is not None] for i in range(len(xs))]
    close_to([x and x * 1e7 for x in got], [statistics.median(p) * 1e7 if len(p) >= 20 else None for p in parts])
