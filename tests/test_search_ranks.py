"""The search over weights ranks the target once, a date once for all periods, and keeps no group's values in memory."""

import datetime as dt
import random

import numpy as np

from ledgerflow.operators import research as rs


def rank(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def panel(spark, seed=2):
    r = random.Random(seed)
    some = lambda: None if r.random() < 0.3 else round(r.uniform(-1, 1), 1)
    rows = [(dt.date(2020, 1 + d, 1), i, some(), some(), some(), None if r.random() < 0.1 else round(r.uniform(-1, 1), 2)) for d in range(8) for i in range(45)]
    return rows, spark.createDataFrame(rows, "as_of date, symbol int, a double, b double, c double, y double")


def test_targets_are_ranked_among_the_rows_with_a_weighted_part(spark):
    rows, df = panel(spark)
    got = {(r["as_of"], r["symbol"]): r["_b"] for r in rs._ranked_targets(df, ("a", "b", "c"), "as_of", "y").collect()}
    for day in {r[0] for r in rows}:
        for k in range(1, 8):
            there = [r for r in rows if r[0] == day and r[5] is not None and any(r[2 + i] is not None for i in range(3) if k >> i & 1)]
            for r, want in zip(there, rank([r[5] for r in there])):
                assert got[(day, r[1])][k - 1] == 2 * want
    assert all(got[r[0], r[1]] == [None] * 7 for r in rows if r[5] is None)


def test_search_equals_a_loop_over_candidates(spark):
    _, df = panel(spark, 5)
    grid = spark.createDataFrame([(100, 0, 0), (0, 100, 0), (0, 30, 70), (5, 45, 50)], "q int, v int, t int")
    got = {tuple(r)[:3]: r for r in rs.weight_search(df, grid, "a", "b", "c", target="y").collect()}
    for w in ((100, 0, 0), (0, 100, 0), (0, 30, 70), (5, 45, 50)):
        one = rs.information_coefficient(rs.blended(df, grid.where(f"q = {w[0]} and v = {w[1]}"), "a", "b", "c"), "blended", target="y").collect()
        assert bool(one) == (w in got)
        if one:
            assert all(abs(got[w][c] - one[0][c]) < 1e-12 for c in ("n", "mean", "nw_se", "nw_t"))


def test_decile_figures_are_exact_percentiles(spark):
    r = random.Random(7)
    rows = [(k, round(r.uniform(-1, 1), 2), r.choice(("first", "second"))) for k in (1, 2) for _ in range(81)] + [(3, 0.5, "first")]
    got = {(x["k"], x["period"]): x for x in rs._decile_figures(spark.createDataFrame(rows, "k int, y double, _half string"), "y", "k").collect()}
    assert len(got) == 8  # the third has no second half
    for (k, p), x in got.items():
        ys = [y for a, y, h in rows if a == k and p in ("all", h)]
        assert x["m"] == len(ys) and abs(x["hit25"] - np.mean([y >= 0.25 for y in ys])) < 1e-12
        assert abs(x["median"] - np.quantile(ys, 0.5)) < 1e-12 and abs(x["p10"] - np.quantile(ys, 0.1)) < 1e-12
