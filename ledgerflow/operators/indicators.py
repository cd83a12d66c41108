"""Per-symbol indicators over row positions (sessions), as window columns.

All share one partitioning by symbol, so Catalyst plans one shuffle for a chain.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.num import roll, safe_div


def W() -> WindowSpec:
    """A symbol's rows in date order."""
    return Window.partitionBy("symbol").orderBy("date")


BLOCK = 512  # rows of a block at most: a mean loses less than exp(600) of its weight in it


def blocked(df: DataFrame) -> DataFrame:
    """``df`` with ``_blk``, which grows with the date and holds at most ``BLOCK`` rows of a symbol (that has one row a date).

    Windows in the order of ``B()`` need one sort by symbol, block and date, also those
    over a single block, so a whole chain of recursions and frames sorts once.
    """
    if "_blk" in df.columns:
        return df
    days = F.unix_date("date") if dict(df.dtypes)["date"] == "date" else F.row_number().over(W()) - 1
    return df.withColumn("_blk", F.floor(days / BLOCK).cast("int"))


def B() -> WindowSpec:
    """A symbol's rows in date order, for rows that are ``blocked``."""
    return Window.partitionBy("symbol").orderBy("_blk", "date")


def _in_blocks(f):
    """``f`` on blocked rows; rows that were not blocked before are not after."""

    @wraps(f)
    def run(df: DataFrame, *args, **kw) -> DataFrame:
        return f(df, *args, **kw) if "_blk" in df.columns else f(blocked(df), *args, **kw).drop("_blk")

    return run


def rolled(df: DataFrame, wanted: dict[str, tuple], w: WindowSpec | None = None) -> DataFrame:
    """Add means and highs of the last n rows: ``{out: (kind, x, n, least)}``, NULL until ``least`` of them are non-null.

    A frame of n rows is put together of n / d frames of d rows that end d rows apart, so
    a row costs d + n / d steps and not n. Nothing is subtracted but counts.
    """
    w = w or W()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    part = {out: max(d for d in range(1, 15) if n % d == 0) for out, (_, _, n, _) in wanted.items()}
    base, seen = {}, {}
    for out, (kind, x, _, _) in wanted.items():
        agg = {"mean": F.sum, "high": F.max}[kind]
        base[f"_{kind}_{x}_{part[out]}"] = agg(x).over(w.rowsBetween(1 - part[out], 0))
        seen[f"_n_{x}"] = F.count(x).over(upto)
    df = df.withColumns(base | seen)
    found, back = {}, {}  # a lag is read by many means

    def lagged(c: str, k: int) -> Column:
        back[f"{c}_{k}"] = F.lag(c, k).over(w)
        return F.col(f"{c}_{k}")

    for out, (kind, x, n, least) in wanted.items():
        d = part[out]
        c = f"_{kind}_{x}_{d}"
        parts = [F.col(c), *[lagged(c, k) for k in range(d, n, d)]]
        there = F.col(f"_n_{x}") - F.coalesce(lagged(f"_n_{x}", n), F.lit(0))
        if kind == "high":
            value = F.greatest(*parts) if len(parts) > 1 else parts[0]
        else:
            value = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0))) / there
        found[out] = F.when(there >= least, value)
    return df.withColumns(back).withColumns(found).drop(*base, *seen, *back)


def sma(x: str, n: int) -> Column:
    return roll(F.avg(x), x, W(), n)


def returns(df: DataFrame, x: str, spans: dict[str, int], w: WindowSpec | None = None) -> DataFrame:
    """Add the changes of ``x`` over so many rows; a row without a value has the last known one."""
    w = w or W()
    df = df.withColumn("_known", F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumns({name: safe_div("_known", F.lag("_known", n).over(w)) - 1 for name, n in spans.items()}).drop("_known")


def momentum_12_1(x: str, w: WindowSpec | None = None) -> Column:
    w = w or W()
    return safe_div(F.lag(x, 21).over(w), F.lag(x, 252).over(w)) - 1


def distance_from_high(top: str) -> Column:
    """Fraction below the rolling high."""
    return safe_div(F.col(top) - F.col("close"), top)


def slope(x: str, n: int = 21, w: WindowSpec | None = None) -> Column:
    past = F.lag(x, n).over(w or W())
    return safe_div(F.col(x) - past, F.abs(past))


def true_range(w: WindowSpec | None = None) -> Column:
    before = F.lag("close").over(w or W())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def max_drawdown(df: DataFrame, n: int = 126, least: int = 63, out: str = "max_dd_6m", w: WindowSpec | None = None) -> DataFrame:
    """Largest fall from the running peak; a window over a window."""
    df = rolled(df, {"_peak": ("high", "close", n, least)}, w)
    df = df.withColumn("_dd", safe_div(F.col("_peak") - F.col("close"), "_peak"))
    return rolled(df, {out: ("high", "_dd", n, least)}, w).drop("_peak", "_dd")


def median_turnover(df: DataFrame, n: int = 60, least: int = 20, out: str = "turnover_60d_cr", w: WindowSpec | None = None) -> DataFrame:
    """Median traded value in crore, out of the sorted values of the frame."""
    value = F.col("close") * F.col("volume") / 1e7
    df = df.withColumn("_values", F.collect_list(value).over((w or W()).rowsBetween(-(n - 1), 0)))
    size = F.size("_values")
    df = df.withColumn("_values", F.when(size >= least, F.slice(F.sort_array("_values"), F.floor((size + 1) / 2).cast("int"), 2 - size % 2)))
    return df.withColumn(out, F.get("_values", F.lit(0)) * 0.5 + F.element_at("_values", -1) * 0.5).drop("_values")


# --- recursions ---------------------------------------------------------------
NOTHING = 1e-30  # a weight that leaves nothing in a double


def _recursions(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """out[i] = keep[i] * out[i - 1] + add[i] along a symbol's blocked rows, before which it is 0; ``rules`` are ``{out: (keep, add)}``.

    ``keep`` is above 0 and at most 1. Unrolled, a value is a sum of earlier ``add``
    with falling weights: inside a block a running sum of scaled terms. What the blocks
    before leave is the same recursion over their two totals, folded once a block.
    """
    names = list(rules)
    own = Window.partitionBy("symbol", "_blk").orderBy("date")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_keep{i}": keep for i, (keep, _) in enumerate(rules.values())} | {f"_add{i}": add for i, (_, add) in enumerate(rules.values())})
    df = df.withColumns({"_head": F.row_number().over(own) == 1, "_tail": F.lead(F.lit(1)).over(own).isNull()} | {f"_in{i}": F.first(f"_keep{i}").over(run) for i in range(len(names))})
    df = df.withColumns({f"_fall{i}": F.sum(F.when(F.col("_head"), 0.0).otherwise(-F.log(f"_keep{i}"))).over(run) for i in range(len(names))})
    df = df.withColumns({f"_sum{i}": F.sum(F.col(f"_add{i}") * F.exp(f"_fall{i}")).over(run) for i in range(len(names))})
    ends = [F.struct((F.col(f"_in{i}") * F.exp(-F.col(f"_fall{i}"))).alias("keep"), (F.col(f"_sum{i}") * F.exp(-F.col(f"_fall{i}"))).alias("add")).alias(f"t{i}") for i in range(len(names))]
    before = Window.partitionBy("symbol").orderBy("_blk").rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_end", F.when(F.col("_tail"), F.struct(*ends)))
    df = df.withColumn("_ends", F.collect_list("_end").over(before))

    def fold(t: str) -> Column:
        return F.aggregate("_ends", F.lit(0.0), lambda y, e: e[t]["add"] + e[t]["keep"] * y)

    df = df.withColumns({f"_left{i}": F.when(F.col("_head"), fold(f"t{i}")) for i in range(len(names))}).drop("_ends", "_end")
    df = df.withColumns({f"_left{i}": F.first(f"_left{i}").over(run) for i in range(len(names))})
    df = df.withColumns({out: F.exp(-F.col(f"_fall{i}")) * (F.col(f"_sum{i}") + F.col(f"_in{i}") * F.col(f"_left{i}")) for i, out in enumerate(names)})
    return df.drop("_head", "_tail", *[f"_{c}{i}" for c in ("keep", "add", "in", "fall", "sum", "left") for i in range(len(names))])


@_in_blocks
def emas(df: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Exponential means ``{out: (x, span)}`` with alpha 2 / (span + 1), seeded with the first value.

    A row without a value carries the mean on, and the mean weighs less at the next
    value for every row that has passed. Before the first value there is none.
    """
    upto = B().rowsBetween(Window.unboundedPreceding, 0)
    xs = list(dict.fromkeys(x for x, _ in wanted.values()))
    df = df.withColumn("_i", F.row_number().over(B()))
    df = df.withColumns({f"_last_{x}": F.last(F.when(F.col(x).isNotNull(), F.col("_i")), ignorenulls=True).over(B().rowsBetween(Window.unboundedPreceding, -1)) for x in xs})
    rules = {}
    for out, (x, span) in wanted.items():
        if span == 1:
            continue
        alpha = 2.0 / (span + 1)
        weight = F.pow(F.lit(1 - alpha), F.col("_i") - F.col(f"_last_{x}"))
        there = F.col(x).isNotNull()
        # A pause so long that nothing is left of the mean is a new beginning.
        fresh = there & (F.col(f"_last_{x}").isNull() | (weight < NOTHING))
        keep = F.when(~there | F.col(f"_last_{x}").isNull(), F.lit(1.0)).otherwise(F.greatest(weight / (weight + alpha), F.lit(NOTHING)))
        add = F.when(fresh, F.col(x)).when(there, F.col(x) * alpha / (weight + alpha)).otherwise(F.lit(0.0))
        rules[f"_mean_{out}"] = (keep, add)
    df = _recursions(df, rules) if rules else df
    made = {out: F.last(x, ignorenulls=True).over(upto) if span == 1 else F.when(F.col(f"_last_{x}").isNotNull() | F.col(x).isNotNull(), F.col(f"_mean_{out}")) for out, (x, span) in wanted.items()}
    return df.withColumns(made).drop("_i", *[f"_last_{x}" for x in xs], *rules)


@_in_blocks
def wilders(df: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Wilder's means ``{out: (x, n)}``: seeded with the plain mean of the first n valid values.

    Valid values are numbered, and rows without a value carry the last mean forward.
    """
    upto = B().rowsBetween(Window.unboundedPreceding, 0)
    xs = list(dict.fromkeys(x for x, _ in wanted.values()))
    df = df.withColumns({f"_k_{x}": F.count(x).over(upto) for x in xs})
    df = df.withColumns({f"_early_{out}": F.sum(F.when(F.col(f"_k_{x}") <= n, F.col(x))).over(upto) / n for out, (x, n) in wanted.items()})
    rules = {}
    for out, (x, n) in wanted.items():
        if n == 1:
            continue
        there, k = F.col(x).isNotNull(), F.col(f"_k_{x}")
        keep = F.when(there & (k > n), F.lit(1 - 1.0 / n)).otherwise(F.lit(1.0))
        add = F.when(there & (k == n), F.col(f"_early_{out}")).when(there & (k > n), F.col(x) / n).otherwise(F.lit(0.0))
        rules[f"_mean_{out}"] = (keep, add)
    df = _recursions(df, rules) if rules else df
    made = {out: F.last(x, ignorenulls=True).over(upto) if n == 1 else F.when(F.col(f"_k_{x}") >= n, F.col(f"_mean_{out}")) for out, (x, n) in wanted.items()}
    return df.withColumns(made).drop(*[f"_k_{x}" for x in xs], *[f"_early_{out}" for out in wanted], *rules)


def ema(df: DataFrame, x: str, span: int, out: str) -> DataFrame:
    return emas(df, {out: (x, span)})


def wilder(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return wilders(df, {out: (x, n)})


def _moves(df: DataFrame) -> DataFrame:
    """The raw gains and losses of the close."""
    d = F.col("close") - F.lag("close").over(B())
    return df.withColumns({"_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_down": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})


def _oscillator() -> Column:
    """Out of the mean gain and loss."""
    value = F.when((F.col("_u") == 0) & (F.col("_d") == 0), F.lit(50.0)).when(F.col("_d") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + safe_div("_u", "_d")))
    return F.when(F.col("_u").isNotNull(), value)


@_in_blocks
def rsi(df: DataFrame, n: int = 14, out: str = "rsi14") -> DataFrame:
    """No losses give 100, neither gains nor losses 50."""
    df = wilders(_moves(df), {"_u": ("_up", n), "_d": ("_down", n)})
    return df.withColumn(out, _oscillator()).drop("_up", "_down", "_u", "_d")


@_in_blocks
def atr(df: DataFrame, n: int = 14, out: str = "atr14") -> DataFrame:
    return wilder(df.withColumn("_tr", true_range(B())), "_tr", n, out).drop("_tr")


def _directions(df: DataFrame) -> DataFrame:
    """The raw movements up and down; those of the first bar are 0, so their smoothing starts there."""
    df = df.withColumns({"_rise": F.col("high") - F.lag("high").over(B()), "_sink": F.lag("low").over(B()) - F.col("low")})
    rise, sink = F.col("_rise"), F.col("_sink")
    return df.withColumns({"_p": F.when((rise > sink) & (rise > 0), rise).otherwise(F.lit(0.0)), "_m": F.when((sink > rise) & (sink > 0), sink).otherwise(F.lit(0.0))}).drop("_rise", "_sink")


def _directional(df: DataFrame, spread: str) -> DataFrame:
    """``_dx`` out of the smoothed movements ``_sp`` and ``_sm`` and the smoothed range."""
    df = df.withColumns({"_dp": safe_div("_sp", spread) * 100, "_dm": safe_div("_sm", spread) * 100})
    return df.withColumn("_dx", safe_div(F.abs(F.col("_dp") - F.col("_dm")), F.col("_dp") + F.col("_dm")) * 100).drop("_dp", "_dm")


@_in_blocks
def adx(df: DataFrame, n: int = 14, out: str = "adx14") -> DataFrame:
    df = _directions(df).withColumn("_tr", true_range(B()))
    df = _directional(wilders(df, {"_sp": ("_p", n), "_sm": ("_m", n), "_st": ("_tr", n)}), "_st")
    return wilder(df, "_dx", n, out).drop("_p", "_m", "_tr", "_sp", "_sm", "_st", "_dx")


@_in_blocks
def macd_histogram(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, out: str = "macd_hist") -> DataFrame:
    df = emas(df, {"_f": ("close", fast), "_s": ("close", slow)})
    df = df.withColumn("_line", F.col("_f") - F.col("_s"))
    df = ema(df, "_line", signal, "_sig")
    return df.withColumn(out, F.col("_line") - F.col("_sig")).drop("_f", "_s", "_line", "_sig")


def relative_strength(df: DataFrame, index: DataFrame, n: int = 126, out: str = "rs_vs_index") -> DataFrame:
    """Return against the index's over n sessions; the index (a row a date) is aligned to the symbol's dates, then filled."""
    df = df.join(F.broadcast(index.select("date", F.col("close").alias("_raw"))), "date", "left")
    w = B() if "_blk" in df.columns else W()
    df = returns(returns(df, "close", {"_own": n}, w), "_raw", {"_idx": n}, w)
    return df.withColumn(out, safe_div(1 + F.col("_own"), 1 + F.col("_idx")) - 1).drop("_raw", "_own", "_idx")


# The columns of a technicals row.
TECHNICALS = (
    "sma20", "sma50", "sma200", "wma50", "sma200_slope", "rsi14", "macd_hist", "adx14", "atr14", "atr_pct", "ret_1m", "ret_3m", "ret_6m", "ret_12m",
    "mom_12_1", "rs_vs_index", "dist_52w_high", "vol_ratio_20_100", "max_dd_6m", "turnover_60d_cr",
)


@_in_blocks
def technicals(bars: DataFrame, index: DataFrame, n: int = 14) -> DataFrame:
    """All twenty columns after one shuffle by symbol and one sort; means of one kind are taken together."""
    w = B()
    df = relative_strength(bars, index)
    df = returns(df, "close", {"ret_1m": 21, "ret_3m": 63, "ret_6m": 126, "ret_12m": 252}, w)
    means = {"sma20": ("close", 20), "sma50": ("close", 50), "sma200": ("close", 200), "wma50": ("close", 250), "_v20": ("volume", 20), "_v100": ("volume", 100)}
    df = rolled(df, {out: ("mean", x, k, k) for out, (x, k) in means.items()} | {"_top": ("high", "high", 252, 126), "_peak": ("high", "close", 126, 63)}, w)
    df = df.withColumn("_dd", safe_div(F.col("_peak") - F.col("close"), "_peak"))
    df = rolled(df, {"max_dd_6m": ("high", "_dd", 126, 63)}, w)
    df = _directions(_moves(df)).withColumn("_tr", true_range(w))
    df = wilders(df, {"_u": ("_up", n), "_d": ("_down", n), "_sp": ("_p", n), "_sm": ("_m", n), "atr14": ("_tr", n)})
    df = wilder(_directional(df, "atr14"), "_dx", n, "adx14")
    df = macd_histogram(df)
    df = df.withColumns(
        {
            "rsi14": _oscillator(),
            "sma200_slope": slope("sma200", w=w),
            "atr_pct": safe_div("atr14", "close"),
            "mom_12_1": momentum_12_1("close", w),
            "dist_52w_high": distance_from_high("_top"),
            "vol_ratio_20_100": safe_div("_v20", "_v100"),
        }
    )
    return median_turnover(df, w=w).drop("_v20", "_v100", "_top", "_peak", "_dd", "_up", "_down", "_p", "_m", "_tr", "_u", "_d", "_sp", "_sm", "_dx")
