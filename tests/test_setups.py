"""Zone walks, strength and setups against plain readings of their rules."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerflow.operators import indicators as ind, setups as st


def bars_of(spark, rows):
    day = dt.date(2000, 1, 3)
    return spark.createDataFrame([(s, day + dt.timedelta(i), *map(float, r)) for s, v in rows.items() for i, r in enumerate(v)], "symbol long, date date, open double, high double, low double, close double, volume double")


def walk(zone, bars, atr, up, spacing=5, ahead=20):
    """Touches, rejections, breaks and reclaims of one band, price by price."""
    kind, formed, floor, ceil = zone
    out, last, broken = [], -(10**9), False
    for i in range(formed + 1, len(bars)):
        o, h, low, c, v = bars[i]
        unit = atr[i] or ceil - floor or 1.0
        under, over = (c < floor - 0.25 * unit, c > ceil) if kind == "low" else (c > ceil + 0.25 * unit, c < floor)
        if not broken and under:
            out.append((i, "break", None))
            broken = True
        elif broken:
            if over:
                out.append((i, "reclaim", None))
                broken = False
        elif (low <= ceil if kind == "low" else h >= floor) and i - last >= spacing:
            last = i
            later = bars[i + 1 : i + ahead + 1]
            r = 0.0
            if later:
                r = (max(b[1] for b in later) - ceil if kind == "low" else floor - min(b[2] for b in later)) / unit
            out.append((i, "rejection" if over else "touch", r))
    return out


def test_walks(spark):
    r = random.Random(8)
    rows = {}
    for s in (1, 2):
        x, rows[s] = 100.0, []
        for _ in range(160):
            o, x = x, x * (1 + r.uniform(-0.03, 0.03))
            rows[s].append((o, max(o, x) * (1 + r.random() * 0.01), min(o, x) * (1 - r.random() * 0.01), x, 1000 + r.random()))
    bars = bars_of(spark, rows)
    zones = [(s, kind, n, formed, 100.0 + d, 100.0 + d + w) for n, (s, kind, formed, d, w) in enumerate([(1, "low", 3, -6, 2), (1, "high", 3, 4, 2), (2, "low", 30, -1, 1), (2, "high", 0, 0, 3), (2, "low", 159, -5, 1), (1, "low", 10, 0, 0)])]
    z = spark.createDataFrame(zones, "symbol long, kind string, zone int, formed int, floor double, ceil double")
    got = {x["zone"]: [(e["i"], e["kind"], e["reaction"]) for e in x["ev"]] for x in st.events(z, st.readings(bars, "daily"), "daily").collect()}
    atr = {}
    for x in ind.atr(bars, out="a").orderBy("symbol", "date").collect():
        atr.setdefault(x["symbol"], []).append(x["a"])
    seen = set()
    for s, kind, n, formed, floor, ceil in zones:
        want = walk((kind, formed, floor, ceil), rows[s], atr[s], None)
        assert [e[:2] for e in got[n]] == [e[:2] for e in want]
        assert all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-9) for a, b in zip(got[n], want))
        seen |= {e[1] for e in want}
    assert seen == {"touch", "rejection", "break", "reclaim"}


def test_properties_look_back_only(spark):
    ev = [(10, "rejection", 2.0, 1.0), (20, "rejection", 4.0, None), (50, "break", None, None)]
    df = spark.createDataFrame([(1, ev, at) for at in (15, 30, 60)], f"formed int, ev array<{st._EVENT}>, at int")
    got = {x["at"]: x for x in st.properties(df, "at").withColumn("s", st.strength("daily", "at")).collect()}
    assert [got[a]["touches"] for a in (15, 30, 60)] == [1, 2, 2]
    assert got[30]["respect"] == 1.0 and abs(got[60]["respect"] - 2 / 3) < 1e-12 and got[30]["s"] > got[60]["s"]
    assert got[30]["live"] and not got[60]["live"] and got[60]["reaction"] == 3.0 and got[60]["volume_ratio"] == 1.0
    none = spark.createDataFrame([(1, [], 30)], f"formed int, ev array<{st._EVENT}>, at int")
    x = st.properties(none, "at").withColumn("s", st.strength("daily", "at")).first()
    assert x["respect"] is None and x["s"] == round(0.28 * 45 + 0.2 * 40 + 0.14 * 40 + 0.14 * 50 + 0.12 * 50 + 0.12 * 100, 2)


def test_false_breakout(spark):
    flat = [(10, 11, 9, 10, 1)] * 8
    rows = {1: flat + [(10, 13, 10, 12.5, 1), (12, 12, 9, 10, 1), (10, 10, 9, 9.5, 1)], 2: flat + [(10, 13, 10, 12.5, 1)], 3: flat + [(10, 11, 9, 10, 1)]}
    df = bars_of(spark, rows).withColumn("ceil", F.lit(12.0)).select("symbol", "date", st.false_breakout("daily").alias("held"))
    last = {s: [x["held"] for x in df.where(f"symbol = {s}").orderBy("date").collect()][-1] for s in rows}
    assert last == {1: 2, 2: None, 3: None}


def test_setup_reasons_and_caps(spark):
    base = dict(close=100.0, high=101.0, low=99.0, open=100.5, atr=2.0, sma200=100.5, sma250=150.0, year_high=140.0, year_low=80.0, turning_up_candle=True, rsi_divergence=False, macd_turning_up=False, reclaimed_short_ma=True, volume_pattern=False, falling_knife=False, stabilised=False, lower_highs=False, higher_low=False, quality=70.0, excluded=False)
    cases = [{}, {"excluded": True}, {"quality": None}, {"quality": 59.9}, {"atr": None}, {"falling_knife": True}, {"lower_highs": True}, {"turning_up_candle": False, "reclaimed_short_ma": False}, {"close": 90.0}, {"close": 112.0}]
    names = list(base)
    kinds = {"bool": "boolean", "float": "double"}
    last = spark.createDataFrame([(i, *[{**base, **c}[n] for n in names]) for i, c in enumerate(cases)], "symbol long, " + ", ".join(f"{n} {kinds[type(base[n]).__name__]}" for n in names))
    zones = spark.createDataFrame([(i, "low", f, f + 2, 80.0, True, 5, "pivot", 1) for i in range(len(cases)) for f in (96.0, 97.5)], "symbol long, kind string, floor double, ceil double, strength double, live boolean, formed int, source string, zone int")
    higher = zones.where("floor = 96")
    over = spark.createDataFrame([(i, 130.0) for i in range(len(cases))], "symbol long, target double")
    got = {r["symbol"]: r for r in st.evaluate(last, zones, higher, over).collect()}
    assert [got[i]["reason"] for i in (1, 2, 3, 4, 8, 9)] == ["excluded by a red flag", "quality score not yet available", "quality below the gate", "no ATR", "no live zone below price", "too far above the zone"]
    x = got[0]
    # nearest by middle: 97.5 to 99.5; half an ATR or less above it is full proximity
    assert (x["floor"], x["stop"], x["status"], x["signals"]) == (97.5, 96.5, "triggered", 2)
    assert (x["reward_risk"], x["headroom"]) == (8.57, 0.3)
    assert (x["c_confirmation"], x["c_confluence"], x["c_proximity"], x["c_reward_risk"]) == (90.0, 80.0, 100.0, 100.0)
    assert x["score"] == round((80 * 26 + 90 * 26 + 80 * 16 + 100 * 16 + 100 * 16) / 100, 2)
    assert (got[5]["score"], got[6]["score"], got[7]["score"], got[7]["status"]) == (30.0, 45.0, 55.0, "watching")
