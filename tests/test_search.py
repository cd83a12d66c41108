"""The weight search over the whole grid and both halves."""

import random

import pytest

from ledgerflow.operators import research as rs


def test_search_halves(spark):
    rng, rows = random.Random(5), []
    for k in range(1, 9):
        for s in range(1, 61):
            a, b, c = (rng.random() for _ in range(3))
            # a is right throughout, b in the second half only, c never
            y = a + (b if k > 4 else -b) + 0.05 * rng.random() - c
            rows.append((f"2001-0{k}-28", s, a, b, c, y))
    panel = spark.createDataFrame(rows, "as_of string, symbol long, a double, b double, c double, forward_return double")
    grid = rs.weight_grid(spark)
    got = {(r["wq"], r["wv"], r["wt"]): r for r in rs.weight_search_halves(panel, grid, "a", "b", "c").collect()}
    assert len(got) == grid.count() == 67 and (5, 45, 50) in got
    a, b, c = got[100, 0, 0], got[0, 100, 0], got[0, 0, 100]
    assert a["stable"] and not b["stable"] and not c["stable"]
    assert b["ic_first_half"] < 0 < b["ic_second_half"] and c["ic_first_half"] < 0 and c["ic_second_half"] < 0
    assert a["verdict"] == "ranks" and c["verdict"] == "inverted" and a["spread"] > 0 and a["rho_first_half"] > 0.6
    # the whole period and each half equal a search over those dates alone
    small = rs.weight_grid(spark, 50)
    for name, part in (("mean", panel), ("ic_first_half", panel.where("as_of < '2001-05-28'")), ("ic_second_half", panel.where("as_of >= '2001-05-28'"))):
        for r in rs.weight_search(part, small, "a", "b", "c").collect():
            assert got[r["wq"], r["wv"], r["wt"]][name] == pytest.approx(r["mean"])
