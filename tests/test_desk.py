"""The position book, alert texts, chart quotas and runs that survive bad symbols."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import alerts as al, book as bk, zones as zn
from ledgerflow.plans.isolate import isolated, watched
from ledgerflow.plans.nightly import Audit

COMMANDS = "book long, symbol string, seq long, kind string, day date, price double, qty double, stop double, target double, force boolean"
D = dt.date(2024, 1, 2)


def c(seq, kind, price=None, qty=None, stop=None, force=None, day=D, symbol="A", book=1):
    return (book, symbol, seq, kind, day, price, qty, stop, None, force)


def folded(spark, *commands):
    f = bk.fold(spark.createDataFrame(list(commands), COMMANDS))
    log = {r.seq: r.reason for r in bk.log(f).collect()}
    held = {(r.book, r.symbol, r.id): r for r in bk.positions(f).collect()}
    return log, held


OPEN = c(1, "open", 100.0, 10.0, 90.0)


@pytest.mark.parametrize(
    "now,new,force,moves,why",
    [
        (90.0, 95.0, None, True, None),
        (90.0, 85.0, None, False, "would lower the stop"),
        (90.0, 85.0, True, True, None),
        (90.0, 90.0, True, False, "already there"),
        (90.0, 90.0 + 1e-10, None, False, "already there"),
        (90.0, 90.0 - 1e-8, None, False, "would lower the stop"),
        (90.0, None, True, False, "no stop is given"),
    ],
)
def test_a_stop_moves_up_or_not_at_all(spark, now, new, force, moves, why):
    log, held = folded(spark, c(1, "open", 100.0, 10.0, now), c(2, "move_stop", stop=new, force=force))
    assert log[2] == why and held[1, "A", 1].stop == (new if moves else now)


def test_opening_needs_quantity_price_and_a_stop_below(spark):
    log, held = folded(spark, c(1, "open", 100.0, None, 90.0), c(2, "open", None, 1.0, 90.0), c(3, "open", 100.0, 1.0, None), c(4, "open", 100.0, 1.0, 100.0), c(5, "open", 100.0, 1.0, 99.0))
    assert list(log.values()) == ["quantity and price are required", "quantity and price are required", "a stop is required", "the stop must sit below the entry", None]
    assert list(held) == [(1, "A", 5)]


def test_a_close_ends_the_last_position_and_books_its_profit(spark):
    log, held = folded(spark, OPEN, c(2, "open", 110.0, 5.0, 90.0), c(3, "close"), c(4, "close", 121.0), c(5, "close", 90.0), c(6, "close", 1.0))
    assert log == {1: None, 2: None, 3: "a price is required", 4: None, 5: None, 6: "no open position"}
    assert held[1, "A", 2].profit == 55.0 and held[1, "A", 1].profit == -100.0 and held[1, "A", 1].exit_id == 5


def test_an_edit_corrects_all_but_the_stop(spark):
    day = dt.date(2023, 5, 5)
    log, held = folded(spark, OPEN, c(2, "edit", 101.0, stop=50.0, day=None), c(3, "edit", qty=12.0, day=day), c(4, "edit", day=None), c(5, "edit", 1.0, symbol="B"), c(6, "dance", 1.0))
    p = held[1, "A", 1]
    assert (p.price, p.qty, p.stop, p.day) == (101.0, 12.0, 90.0, day)
    assert (log[4], log[5], log[6]) == ("nothing to change", "no open position", "unknown command")


def test_books_and_symbols_are_apart_and_order_counts_not_arrival(spark):
    log, held = folded(spark, c(9, "close", 120.0), OPEN, c(3, "open", 50.0, 1.0, 40.0, symbol="B"), c(4, "close", 60.0, book=2))
    assert log == {9: None, 1: None, 3: None, 4: "no open position"} and held[1, "A", 1].exit_price == 120.0 and held[1, "B", 3].exit_id is None


def test_capital(spark):
    rows = [(1, 1, 1000.0, None), (1, 2, -5.0, 0.5), (1, 3, 2000.0, 1.0), (1, 4, 3000.0, 0.02), (1, 5, 4000.0, None), (2, 1, 0.0, None), (3, 1, 10.0, None), (4, 1, None, 0.1)]
    got = bk.capital(spark.createDataFrame(rows, "book long, seq long, amount double, risk_pct double")).collect()
    assert {r.book: (r.capital, r.risk_pct) for r in got} == {1: (4000.0, 0.02), 3: (10.0, 0.01)}


def test_only_watched_symbols_and_triggered_setups_are_told(spark):
    rows = [("A", "zone_broken"), ("B", "zone_broken"), ("B", "setup_triggered"), ("C", "entered_top_decile")]
    screen = spark.createDataFrame(rows, "symbol string, rule string")
    got = al.worth_telling(screen, spark.createDataFrame([("A",), ("A",)], "symbol string"))
    assert sorted(map(tuple, got.collect())) == [("A", "zone_broken"), ("B", "setup_triggered")]


def test_texts_leave_out_what_is_not_known(spark):
    alerts = spark.createDataFrame([("A", "setup_triggered", 1, "A:setup_triggered:12.5"), ("B", "setup_triggered", 1, "B:setup_triggered"), ("A", "target_reached", 1, "A:target_reached:3"), ("A", "thesis_broken", 0, "A:thesis_broken:cash_conversion,loss_making"), ("B", "score_decayed", 1, "B:score_decayed:blended score:4")], "symbol string, rule string, severity int, dedupe_key string")
    held = spark.createDataFrame([("A", 3, None, 8.0, 12.0, 12.5), ("A", 4, 1.0, 1.0, 1.0, 1.0)], "symbol string, id int, entry double, stop double, target double, close double")
    today = spark.createDataFrame([("A", None)], "symbol string, blended double")
    setups = spark.createDataFrame([("A", ["rsi_divergence", "volume_pattern"], 3.26)], "symbol string, signs array<string>, reward_risk double")
    got = {(r.symbol, r.rule): r.message for r in al.explained(alerts, held, today, setups).collect()}
    assert got == {
        ("A", "setup_triggered"): "turning at support (rsi divergence, volume pattern), reward to risk 3.3",
        ("B", "setup_triggered"): "turning at support (confirmed)",
        ("A", "target_reached"): "close 12.50 has met the target 12.00",
        ("A", "thesis_broken"): "a holding fails a gate: cash conversion, loss making",
        ("B", "score_decayed"): "blended score is down to decile 4",
    }


def test_prices_in_texts_are_rounded_as_sql_rounds_them(spark):
    """4054.535 lies under the half in binary, 0.125 on it."""
    alerts = spark.createDataFrame([("A", "stop_breached", 0, "A:stop_breached:1"), ("B", "target_reached", 1, "B:target_reached:2")], "symbol string, rule string, severity int, dedupe_key string")
    held = spark.createDataFrame([("A", 1, 1.0, 5000.125, 9e9, 4054.535), ("B", 2, 1.0, 0.5, 1.005, 1.125)], "symbol string, id int, entry double, stop double, target double, close double")
    empty = spark.createDataFrame([], "symbol string, blended double, signs array<string>, reward_risk double")
    got = {r.symbol: r.message for r in al.explained(alerts, held, empty, empty).collect()}
    assert got == {"A": "close 4054.53 is at or under the stop 5000.12", "B": "close 1.12 has met the target 1.00, +12% since entry"}


def test_chart_quotas(spark):
    z = [("live", "low", 90.0 - i, 91.0 - i, True, None) for i in range(5)] + [("over", "high", 101.0 + i, 102.0 + i, True, None) for i in range(4)]
    z += [("late", "low", 95.0, 96.0, False, 300 - i) for i in range(4)] + [("far", "low", 10.0, 11.0, False, 310), ("old", "high", 100.0, 101.0, False, 50), ("above", "low", 120.0, 121.0, True, None)]
    rows = [(1, k, "pivot", n, f, c_, lv, inv, 319, 100.0) for n, (_, k, f, c_, lv, inv) in enumerate(z)]
    df = spark.createDataFrame(rows, "symbol int, kind string, source string, zone int, floor double, ceil double, live boolean, invalidated int, last_i int, price double")
    got = sorted((r.part, r.place, r.floor, r.zone) for r in zn.chart_zones(df, 250).collect())
    assert got == [("broken", 1, 95.0, 9), ("broken", 2, 95.0, 10), ("live", 1, 90.0, 0), ("live", 2, 89.0, 1), ("live", 3, 88.0, 2), ("overhead", 1, 101.0, 5), ("overhead", 2, 102.0, 6)]


def halving():
    def half(rows):
        if rows.x.iloc[0] < 0:
            raise ValueError("below zero")
        return rows.assign(y=rows.x / 2)[["symbol", "y"]]

    return half


def test_one_bad_symbol_leaves_the_others(spark):
    df = spark.createDataFrame([(s, float(v)) for s, v in ((1, 4), (1, 6), (2, -1), (3, 8))], "symbol long, x double")
    sink: list[Audit] = []
    rows = watched(isolated(df, "symbol", halving(), "symbol long, y double"), "symbol", "halves", sink)
    assert sorted((r.symbol, r.y, r.error) for r in rows.where("error is null").collect()) == [(1, 2.0, None), (1, 3.0, None), (3, 4.0, None)]
    assert [(r.symbol, r.y, r.error) for r in rows.where("error is not null").collect()] == [(2, None, "ValueError: below zero")]
    a = sink[0]
    assert (a.status, a.rows_in, a.rows_out, a.errors) == ("partial", 4, 3, ["1 failed, the first: 2: ValueError: below zero"])


def test_a_run_in_which_all_fail_has_failed(spark):
    df = spark.createDataFrame([(1, -1.0), (2, -2.0)], "symbol long, x double")
    sink: list[Audit] = []
    watched(isolated(df, "symbol", halving(), "symbol long, y double"), "symbol", "halves", sink)
    watched(isolated(df.where(F.lit(False)), "symbol", halving(), "symbol long, y double"), "symbol", "none", sink)
    assert [a.status for a in sink] == ["failed", "ok"]
