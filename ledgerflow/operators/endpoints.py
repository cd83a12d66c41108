"""Indicators at a few rows of a symbol, out of arrays of its rows.

Where only some rows are wanted, windows would work out every column at every row. Here a
symbol is one row of arrays in date order: recursions are folds over all of it, and frames
are looked at where they are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import safe_div
from .indicators import NOTHING, TECHNICALS


BLOCK = 12  # rows whose highest value is kept


def as_arrays(df: DataFrame, *columns: str) -> DataFrame:
    """A row a symbol: ``_rows`` in date order (one a date), the values of each column as the array ``_<column>``, whether nulls are in it, and the highest of each ``BLOCK`` of its rows."""
    dealt = df.select("symbol", F.struct("date", *columns).alias("_row")).repartition("symbol")
    rows = dealt.groupBy("symbol").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))

    def values(c: str) -> Column:
        return F.transform("_rows", lambda r: r[c])

    def tops(c: str) -> Column:
        n = F.size("_rows")
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.array_max(picked(f"_{c}", b * BLOCK + 1, F.least(b * BLOCK + BLOCK, n))))

    rows = rows.withColumns({f"_{c}": values(c) for c in ("date", *columns)})
    return rows.withColumns({f"_{c}_gaps": F.exists(f"_{c}", lambda v: v.isNull()) for c in columns} | {f"_{c}_tops": tops(c) for c in columns})


def picked(a: str, first: Column, last: Column) -> Column:
    """The values of rows first to last, read by place (``slice`` would unpack the whole array); NULL if there is none."""
    return F.when((first >= 1) & (last >= first), F.transform(F.sequence(first, last), lambda j: F.get(a, j - 1)))


def at(a: str, row) -> Column:
    """The value at a row (from 1), NULL before the first."""
    row = F.lit(row) if isinstance(row, int) else row
    return F.when(row >= 1, F.get(a, row - 1))


def known_at(a: str, row: Column) -> Column:
    """The last value up to a row that is not null."""
    before = lambda: F.filter(F.slice(a, 1, row), lambda v: v.isNotNull())
    return F.when(row >= 1, F.coalesce(at(a, row), F.get(F.reverse(before()), F.lit(0))))


def frame(a: str, row: Column, n: int) -> Column:
    """The values of the n rows that end at a row (the first rows have fewer); NULL before the first."""
    return picked(a, F.greatest(row - (n - 1), F.lit(1)), row)


def mean(a: str, row: Column, n: int) -> Column:
    """Mean of the n rows that end at a row; NULL if one is missing or has no value."""
    return F.when(row >= n, F.aggregate(F.sequence(row - (n - 1), row), F.lit(0.0), lambda s, j: s + F.get(a, j - 1))) / n


def high(a: str, row: Column, n: int, least: int) -> Column:
    """Highest of the n rows that end at a row, NULL until ``least`` of them have a value."""
    first = F.greatest(row - (n - 1), F.lit(1))
    head, tail = F.floor((first + (BLOCK - 2)) / BLOCK).cast("int"), F.floor(row / BLOCK).cast("int")  # whole blocks before which, and up to which
    parts = [picked(a, first, head * BLOCK), picked(f"{a}_tops", head + 1, tail), picked(a, tail * BLOCK + 1, row)]
    top = F.when(tail > head, F.greatest(*[F.array_max(x) for x in parts])).otherwise(F.array_max(frame(a, row, n)))
    there = F.when(F.col(f"{a}_gaps"), F.size(F.array_compact(frame(a, row, n)))).otherwise(F.least(row, F.lit(n)))
    return F.when((row >= least) & (there >= least), top)


def change(a: str, row: Column, n: int) -> Column:
    """Change over n rows; a row without a value has the last known one."""
    return safe_div(known_at(a, row), known_at(a, row - n)) - 1


def momentum_12_1(a: str, row: Column) -> Column:
    return safe_div(at(a, row - 21), at(a, row - 252)) - 1


def _falls(a: str, row: Column, n: int, least: int) -> Column:
    """Falls from the highest of n rows, at each of the n rows that end at a row."""

    def fall(j: Column) -> Column:
        return F.transform(F.array(high(a, j, n, least)), lambda peak: safe_div(peak - at(a, j), peak))[0]

    return F.transform(F.sequence(F.greatest(row - (n - 1), F.lit(1)), row), fall)


# --- folds: a state is a struct, an update gives its new fields. A lambda is evaluated as it is
# written, a shared part as often as it occurs, so parts are kept short. -------------------------
def _wilder(s: Column, k: str, means: dict[str, Column], n: int, there: Column | None = None) -> dict[str, Column]:
    """``k`` values seen; a mean is their sum before the nth, then Wilder's. The values of all means are null together, or never without ``there``."""
    new = {k: s[k] + 1} | {y: F.when(s[k] >= n, s[y] * (1 - 1.0 / n) + x / n).when(s[k] + 1 < n, s[y] + x).otherwise((s[y] + x) / n) for y, x in means.items()}
    return new if there is None else {c: F.when(there, v).otherwise(s[c]) for c, v in new.items()}


def _ema(s: Column, mean: str, x: Column, span: int, pause: Column | None = None) -> Column:
    """The exponential mean after ``x``, with ``pause`` rows without a value before it."""
    alpha = 2.0 / (span + 1)
    new = F.when(x.isNull(), s[mean]).when(s[mean].isNull(), x)
    plain = s[mean] * (1 - alpha) + x * alpha
    if pause is None:
        return new.otherwise(plain)
    weight = F.pow(F.lit(1 - alpha), pause + 1)
    return new.when(pause == 0, plain).when(weight < NOTHING, x).otherwise((weight * s[mean] + alpha * x) / (weight + alpha))


def _oscillators(rows: Column, n: int) -> Column:
    """rsi14, macd_hist, adx14 and atr14 after all rows, in one fold.

    What is smoothed twice is smoothed a row later: a state's ADX and signal lack its own row until ``late``.
    """
    none, zero, no = F.lit(None).cast("double"), F.lit(0.0), F.lit(0)
    start = {c: none for c in ("close", "high", "low", "fast", "slow", "signal")} | {c: zero for c in ("up", "down", "rise", "sink", "range", "dx")}
    start |= {c: no for c in ("n_move", "n_rise", "n_range", "n_dx", "pause")}
    pack = lambda fields: F.struct(*[fields[c].alias(c) for c in start])

    def late(s: Column) -> dict[str, Column]:
        known = (s["n_range"] >= n) & (s["n_rise"] >= n) & (s["range"] != 0) & (s["rise"] + s["sink"] != 0)  # the range drops out of the ratio
        dx = F.abs(s["rise"] - s["sink"]) / (s["rise"] + s["sink"]) * 100
        return _wilder(s, "n_dx", {"dx": dx}, n, known) | {"signal": _ema(s, "signal", s["fast"] - s["slow"], 9)}

    def step(s: Column, r: Column) -> Column:
        d, rise, sink = r["close"] - s["close"], r["high"] - s["high"], s["low"] - r["low"]
        reach = F.greatest(r["high"] - r["low"], F.abs(r["high"] - s["close"]), F.abs(r["low"] - s["close"]))
        new = late(s) | {c: r[c] for c in ("close", "high", "low")}
        new |= _wilder(s, "n_move", {"up": F.greatest(d, zero), "down": F.greatest(-d, zero)}, n, d.isNotNull())
        new |= _wilder(s, "n_rise", {"rise": F.when((rise > sink) & (rise > 0), rise).otherwise(zero), "sink": F.when((sink > rise) & (sink > 0), sink).otherwise(zero)}, n)
        new |= _wilder(s, "n_range", {"range": reach}, n, reach.isNotNull())
        new |= {"fast": _ema(s, "fast", r["close"], 12, s["pause"]), "slow": _ema(s, "slow", r["close"], 26, s["pause"]), "pause": F.when(r["close"].isNull(), s["pause"] + 1).otherwise(no)}
        return pack(new)

    def finish(s: Column) -> Column:
        end = late(s)
        rsi = F.when((s["up"] == 0) & (s["down"] == 0), F.lit(50.0)).when(s["down"] == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + safe_div(s["up"], s["down"])))
        return F.struct(
            F.when(s["n_move"] >= n, rsi).alias("rsi14"),
            (s["fast"] - s["slow"] - end["signal"]).alias("macd_hist"),
            F.when(end["n_dx"] >= n, end["dx"]).alias("adx14"),
            F.when(s["n_range"] >= n, s["range"]).alias("atr14"),
        )

    return F.aggregate(rows, pack(start), step, finish)


def last_technicals(bars: DataFrame, index: DataFrame, n: int = 14) -> DataFrame:
    """The last row of ``indicators.technicals`` of each symbol: symbol, date, close and all twenty columns."""
    df = bars.join(F.broadcast(index.select("date", F.col("close").alias("index"))), "date", "left")
    df = as_arrays(df, "close", "high", "low", "volume", "index").withColumns({"_end": F.size("_rows"), "_folded": _oscillators(F.col("_rows"), n)})
    end = F.col("_end")
    value = F.zip_with(frame("_close", end, 60), frame("_volume", end, 60), lambda c, v: c * v / 1e7)
    df = df.withColumns(
        {
            "date": at("_date", end),
            "close": at("_close", end),
            **{f"sma{k}": mean("_close", end, k) for k in (20, 50, 200)},
            "wma50": mean("_close", end, 250),
            "_before": mean("_close", end - 21, 200),
            **{f"ret_{m}m": change("_close", end, k) for m, k in ((1, 21), (3, 63), (6, 126), (12, 252))},
            "mom_12_1": momentum_12_1("_close", end),
            "rs_vs_index": safe_div(1 + change("_close", end, 126), 1 + change("_index", end, 126)) - 1,
            "_top": high("_high", end, 252, 126),
            "vol_ratio_20_100": safe_div(mean("_volume", end, 20), mean("_volume", end, 100)),
            "_falls": _falls("_close", end, 126, 63),
            "_values": F.sort_array(F.array_compact(value)),
            **{c: F.col("_folded")[c] for c in ("rsi14", "macd_hist", "adx14", "atr14")},
        }
    )
    size = F.size("_values")
    df = df.withColumns(
        {
            "sma200_slope": safe_div(F.col("sma200") - F.col("_before"), F.abs("_before")),
            "atr_pct": safe_div("atr14", "close"),
            "max_dd_6m": F.when(F.size(F.array_compact("_falls")) >= 63, F.array_max("_falls")),
            "dist_52w_high": safe_div(F.col("_top") - F.col("close"), "_top"),
            "turnover_60d_cr": F.when(size >= 20, F.get("_values", F.floor((size - 1) / 2).cast("int")) * 0.5 + F.get("_values", F.floor(size / 2).cast("int")) * 0.5),
        }
    )
    return df.select("symbol", "date", "close", *TECHNICALS)


def month_end_features(bars: DataFrame, at_dates: DataFrame, hold: int = 126, warm_up: int = 252) -> DataFrame:
    """(as_of, symbol, date): mom, ret3, dist, vr at the last bar at or before each ``as_of``, and the return of the ``hold`` bars after it.

    ``at_dates`` is a short list of dates; a symbol appears from its ``warm_up``-th bar on.
    """
    dates = at_dates.agg(F.array_sort(F.collect_set("as_of")).alias("all"))
    df = as_arrays(bars.select("symbol", "date", "open", "high", "close", "volume"), "open", "high", "close", "volume").withColumn("_all", dates.scalar())
    # Bars and wanted dates in one order: the bars up to the jth date lie before it, with j - 1 other dates.
    both = F.sort_array(F.concat(F.transform("_date", lambda d: F.struct(d.alias("date"), F.lit(0).alias("side"))), F.transform("_all", lambda d: F.struct(d.alias("date"), F.lit(1).alias("side")))))
    placed = F.filter(F.transform(both, lambda x, i: F.struct(x["date"].alias("as_of"), x["side"].alias("side"), i.alias("i"))), lambda x: x["side"] == 1)
    df = df.withColumn("_at", F.transform(placed, lambda x, j: F.struct(x["as_of"].alias("as_of"), (x["i"] - j).alias("row"))))

    def features(x: Column) -> Column:
        row = x["row"]
        return F.struct(
            x["as_of"].alias("as_of"),
            at("_date", row).alias("date"),
            at("_close", row).alias("close"),
            momentum_12_1("_close", row).alias("mom"),
            change("_close", row, 63).alias("ret3"),
            high("_high", row, 252, 126).alias("top"),
            safe_div(mean("_volume", row, 20), mean("_volume", row, 100)).alias("vr"),
            (safe_div(at("_close", row + hold), at("_open", row + 1)) - 1).alias("forward_return"),
        )

    df = df.select("symbol", F.explode(F.transform(F.filter("_at", lambda x: x["row"] >= warm_up), features)).alias("_x")).select("symbol", "_x.*")
    return df.withColumn("dist", safe_div(F.col("top") - F.col("close"), "top")).drop("top", "close")
