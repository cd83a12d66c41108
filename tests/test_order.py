"""Figures that must not hang on the order in which rows arrive."""

import datetime as dt
import random

from ledgerflow.plans.views import Market


def test_quarters_of_equal_trades_are_equal(spark, tmp_path):
    draw = random.Random(5)
    trades = [(round(draw.uniform(900, 90000), 2), draw.randint(0, 10) / 100, draw.randint(0, 8) / 100) for _ in range(60)]
    rows = []
    for symbol in range(12):
        draw.shuffle(trades)
        rows += [(symbol, p, d, t, dt.datetime(1995, 2, 3)) for p, d, t in trades]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = Market(spark, str(tmp_path)).quarters().collect()
    assert len(got) == 12 and len({(r.revenue, r.pat) for r in got}) == 1
    net = sum(p * (1 - d) for p, d, _ in trades)
    assert abs(got[0].revenue - net) < 1e-9 * net


def test_a_revenue_at_a_whole_number_is_rounded_down_as_the_plain_sum(spark, tmp_path):
    """Prices of two decimals sum to 10000 exactly; added in their order they stay below it, or do not, as SQL's sum."""
    import pytest

    duckdb = pytest.importorskip("duckdb")
    from ledgerflow.plans.views import QUARTERS

    draw, rows, want = random.Random(7), [], {}
    for symbol in range(40):
        nets = [draw.randint(100, 90000) / 100 for _ in range(20)]
        nets.append(round(10000 - sum(nets), 2))
        plain = 0.0
        for x in nets:
            plain += x
        want[symbol] = int(plain // 1)
        rows.append([(symbol, x, 0.0, 0.0, dt.datetime(1995, 2, 3)) for x in nets])
    rows = [r[i] for i in range(21) for r in rows]  # a symbol's trades lie apart in the table
    schema = "l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.symbol: r.whole for r in Market(spark, str(tmp_path)).quarters(whole=True).collect()}
    assert set(want.values()) == {9999, 10000} and got == want
    sql = duckdb.connect().execute("SET threads = 1").execute(f"WITH lineitem AS (FROM '{tmp_path}/lineitem.parquet/*.parquet'), {QUARTERS} SELECT symbol, CAST(floor(revenue) AS BIGINT) FROM quarters")
    assert dict(sql.fetchall()) == got
