"""The next resistance against a plain reading of its definition."""

import datetime as dt
import random

from ledgerflow.catalog import more
from ledgerflow.operators import indicators as ind, zones as zn


def expected(bars, highs, atr):
    price, out = bars[-1][5], list(highs)
    for i in range(10, len(bars) - 10):
        near = [b[3] for b in bars[i - 10 : i + 11]]
        if bars[i][3] == max(near) and sum(v < bars[i][3] for v in near) >= 10:
            out.append(bars[i][3])
    out = sorted(v for v in out if v > price)
    if not out:
        top = max(b[3] for b in bars[-252:])
        return (top, top, 0) if top > price else None
    bands = []
    for v in out:
        if bands and atr > 0 and v - bands[-1][-1] <= 0.6 * atr:
            bands[-1].append(v)
        else:
            bands.append([v])
    good = next((b for b in bands if len(b) >= 2), None)
    return (good[0], good[-1], len(good)) if good else (out[0], out[0], 1)


def test_next_resistance_of_all_swings(spark):
    rng, rows, day = random.Random(3), {}, dt.date(1995, 1, 2)
    for s in range(1, 7):
        x, rows[s] = 100.0, []
        for i in range(160):
            x = x * (1 + rng.uniform(-0.03, 0.03)) if s < 6 else x * 1.01  # 6 rises: only its last bar's high is above
            rows[s].append((s, day + dt.timedelta(i), x, x * 1.01, x * 0.99, x, 1.0))
    df = spark.createDataFrame([r for v in rows.values() for r in v], "symbol long, date date, open double, high double, low double, close double, volume double")
    highs = {}
    for r in zn.pivots(df).where("kind = 'high'").collect():
        highs.setdefault(r["symbol"], []).append(r["price"])
    atr = {r["symbol"]: r["a"] for r in ind.atr(df, out="a").where(f"date = date'{day + dt.timedelta(159)}'").collect()}
    got = {r["symbol"]: (r["floor"], r["ceil"], r["touches"]) for r in more.resistance(df).collect()}
    want = {s: e for s in rows if (e := expected(rows[s], highs.get(s, []), atr[s]))}
    assert got == want and got[6][2] == 0 and max(t for _, _, t in got.values()) >= 2
