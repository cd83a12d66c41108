"""Swing pivots, anchored clusters, zones and volume shelves.

The order-dependent walks are folds over a symbol's sorted bars inside the JVM
(``aggregate``), one array a symbol, so no Python runs and history stays whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the zone geometry.
QUALIFYING_BARS, RESTART_AFTER = 2, 60
CLUSTER_ATR, MIN_WIDTH_ATR = 0.6, 0.35
SHELF_BINS, SHELF_LOOKBACK, SHELF_TOP = 60, 500, 3

_STATE = (
    "struct<phase: int, ah: double, al: double, ac: double, hits: int, lo: double, lo_at: int, hi: double, hi_at: int, moved: int, "
    "found: array<struct<kind: string, idx: int, price: double, confirmed: int>>>"
)


def pivots(bars: DataFrame, restart_after: int = RESTART_AFTER) -> DataFrame:
    """symbol, kind (low or high), idx, price, confirmed: alternating swings with the bar that confirms each.

    A phase waits for two bars (not necessarily adjacent) beyond the anchor bar in
    extreme and close, then emits the extreme seen since the phase began; a phase
    without progress for ``restart_after`` bars takes the current bar as anchor.
    """
    bar = F.struct("date", "high", "low", "close")
    rows = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(bar)).alias("b"))
    keep = "s.ah, 'al', s.al, 'ac', s.ac"
    here = "x.high, 'al', x.low, 'ac', x.close"
    stalled = f"i - s.moved > {restart_after}"
    lo = "case when s.lo is null or x.low < s.lo then x.low else s.lo end"
    lo_at = "case when s.lo is null or x.low < s.lo then i else s.lo_at end"
    hi = "case when s.hi is null or x.high > s.hi then x.high else s.hi end"
    hi_at = "case when s.hi is null or x.high > s.hi then i else s.hi_at end"
    hit = "case when s.phase = 1 then x.high > s.ah and x.close > s.ac else x.low < s.al and x.close < s.ac end"
    swing = (
        f"named_struct('kind', case when s.phase = 1 then 'low' else 'high' end, 'idx', case when s.phase = 1 then {lo_at} else {hi_at} end, "
        f"'price', case when s.phase = 1 then {lo} else {hi} end, 'confirmed', i)"
    )

    def state(phase, anchor, hits, low, low_at, high, high_at, moved, found):
        return (
            f"cast(named_struct('phase', {phase}, 'ah', {anchor}, 'hits', {hits}, 'lo', {low}, 'lo_at', {low_at}, 'hi', {high}, 'hi_at', {high_at}, "
            f"'moved', {moved}, 'found', {found}) as {_STATE})"
        )

    step = (
        f"case when {stalled} then {state('s.phase', here, '0', 'x.low', 'i', 'x.high', 'i', 'i', 's.found')} "
        f"when ({hit}) and s.hits + 1 >= {QUALIFYING_BARS} then {state('-s.phase', here, '0', 'null', 'null', 'null', 'null', 'i', f'concat(s.found, array({swing}))')} "
        f"else {state('s.phase', keep, f'case when {hit} then s.hits + 1 else s.hits end', lo, lo_at, hi, hi_at, 's.moved', 's.found')} end"
    )
    first = state("1", "b[0].high, 'al', b[0].low, 'ac', b[0].close", "0", "b[0].low", "0", "b[0].high", "0", "0", "array()")
    # Each element carries its place, so the fold sees (i, bar).
    fold = f"aggregate(transform(b, (y, k) -> named_struct('i', k, 'y', y)), {first}, (s, e) -> case when e.i = 0 then s else {step.replace('x.', 'e.y.').replace('i - s', 'e.i - s')} end).found"
    fold = _places(fold)
    out = rows.where(F.size("b") >= 2).select("symbol", "b", F.explode(F.expr(fold)).alias("p"))
    return out.select("symbol", F.col("p.kind").alias("kind"), F.col("p.idx").alias("idx"), F.col("p.price").alias("price"), F.col("p.confirmed").alias("confirmed"), F.expr("b[p.idx].date").alias("date"), F.expr("b[p.confirmed].date").alias("confirmed_date"))


def _places(fold: str) -> str:
    """The bare place ``i`` of a step as the field of the folded element."""
    import re

    return re.sub(r"(?<![\w.'])i(?![\w'])", "e.i", fold)


def visible(p: DataFrame, at: DataFrame) -> DataFrame:
    """Pivots confirmed by each date of ``at`` (as_of), a short list."""
    return p.join(F.broadcast(at), F.col("confirmed_date") <= F.col("as_of"))


def clusters(p: DataFrame, kind: str, tolerance: float = CLUSTER_ATR) -> DataFrame:
    """Add ``cluster``: swings in price order join while within tolerance * their own ATR of the cluster's first member.

    ``p`` has symbol, kind, price, atr (at the swing), idx, confirmed. Lows run
    upwards, highs downwards, so a band never chains away from its anchor.
    """
    sign = 1 if kind == "low" else -1
    rows = p.where((F.col("kind") == kind) & (F.col("atr") > 0))
    item = F.struct((sign * F.col("price")).alias("o"), "idx", "price", "atr", "confirmed")
    rows = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(item)).alias("a"))
    fold = (
        "aggregate(a, cast(named_struct('n', 0, 'first', null, 'o', array()) as struct<n: int, first: double, o: array<int>>), (s, x) -> "
        f"case when s.n > 0 and abs(x.price - s.first) <= {tolerance}D * x.atr then cast(named_struct('n', s.n, 'first', s.first, 'o', concat(s.o, array(s.n))) as struct<n: int, first: double, o: array<int>>) "
        "else cast(named_struct('n', s.n + 1, 'first', x.price, 'o', concat(s.o, array(s.n + 1))) as struct<n: int, first: double, o: array<int>>) end).o"
    )
    out = rows.select("symbol", F.explode(F.arrays_zip("a", F.expr(fold).alias("c"))).alias("z"))
    return out.select("symbol", F.lit(kind).alias("kind"), "z.a.idx", "z.a.price", "z.a.atr", "z.a.confirmed", F.col("z.c").alias("cluster"))


def zones(clustered: DataFrame, atr_at: DataFrame) -> DataFrame:
    """One band a cluster: its price range, widened to a least width in ATR at the bar that completes it."""
    z = clustered.groupBy("symbol", "kind", "cluster").agg(
        F.min("price").alias("floor"), F.max("price").alias("ceil"), F.max("confirmed").alias("formed"), F.count("*").alias("members")
    )
    z = z.join(atr_at.select("symbol", F.col("idx").alias("formed"), F.col("atr").alias("a")), ["symbol", "formed"]).where("a > 0")
    pad = F.greatest(MIN_WIDTH_ATR * F.col("a") - (F.col("ceil") - F.col("floor")), F.lit(0.0)) / 2
    return z.select("symbol", "kind", "cluster", "formed", "members", (F.col("floor") - pad).alias("floor"), (F.col("ceil") + pad).alias("ceil"))


def shelves(bars: DataFrame, bins: int = SHELF_BINS, lookback: int = SHELF_LOOKBACK, top: int = SHELF_TOP) -> DataFrame:
    """The ``top`` price bins by traded volume of the last ``lookback`` bars whose floor lies under the last close.

    A bar's volume is spread evenly over the bins it touches; of equally heavy bins the higher is taken.
    """
    w = Window.partitionBy("symbol")
    recent = bars.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("date")))).where(F.col("_rn") <= lookback)
    df = recent.withColumns({"lo": F.min("low").over(w), "hi": F.max("high").over(w), "n": F.count("*").over(w), "last": F.max_by("close", "date").over(w)})
    df = df.where((F.col("n") >= 30) & (F.col("hi") > F.col("lo")) & (F.col("volume") > 0))
    step = (F.col("hi") - F.col("lo")) / bins

    def edge(k):
        return F.when(k == bins, F.col("hi")).otherwise(F.col("lo") + k * F.col("step"))

    # The quotient gives the bin up to rounding; the edges themselves decide.
    df = df.withColumn("step", step)
    guess = lambda x: F.greatest(F.lit(0), F.least(F.lit(bins), F.floor((F.col(x) - F.col("lo")) / F.col("step")).cast("int")))
    df = df.withColumns({"g0": guess("low"), "g1": guess("high")})
    start = F.when(edge(F.col("g0")) > F.col("low"), F.col("g0") - 1).when((F.col("g0") < bins) & (edge(F.col("g0") + 1) <= F.col("low")), F.col("g0") + 1).otherwise(F.col("g0"))
    stop = F.when(edge(F.col("g1")) >= F.col("high"), F.when((F.col("g1") > 0) & (edge(F.col("g1") - 1) >= F.col("high")), F.col("g1") - 1).otherwise(F.col("g1"))).otherwise(F.col("g1") + 1)
    df = df.withColumns({"a": F.greatest(F.lit(0), F.least(start, F.lit(bins - 1)))})
    df = df.withColumn("b", F.least(F.greatest(stop, F.col("a") + 1), F.lit(bins)))
    df = df.select("symbol", "lo", "hi", "step", "last", (F.col("volume") / (F.col("b") - F.col("a"))).alias("v"), F.explode(F.sequence("a", F.col("b") - 1)).alias("bin"))
    per = df.groupBy("symbol", "bin", "lo", "hi", "step", "last").agg(F.sum("v").alias("weight"))
    per = per.withColumn("share", F.col("weight") / F.sum("weight").over(w)).withColumn("floor", edge(F.col("bin")))
    per = per.where(F.col("floor") < F.col("last"))
    per = per.withColumn("_k", F.row_number().over(w.orderBy(F.desc("weight"), F.desc("bin")))).where(F.col("_k") <= top)
    return per.select("symbol", "bin", "floor", edge(F.col("bin") + 1).alias("ceil"), "share")


# How many zones of a kind a chart shows, and how near to the price a broken one must be.
CHART_QUOTA, CHART_NEAR = {"live": 3, "overhead": 2, "broken": 2}, 0.25


def chart_zones(rated: DataFrame, shown: int) -> DataFrame:
    """symbol, part, place and the zones worth drawing: one ranking with a quota for each part.

    ``rated`` has the zones with live, invalidated, last_i and the symbol's price. Live supports
    below the price come nearest first, as do live resistances not under it; a broken zone counts
    if it broke in the last ``shown`` bars and lies within 25 % of the price, latest break first.
    """
    p, mid = F.col("price"), (F.col("floor") + F.col("ceil")) / 2
    near = (F.col("floor") <= p * (1 + CHART_NEAR)) & (F.col("ceil") >= p * (1 - CHART_NEAR))
    part = (
        F.when(~F.col("live") & (F.col("invalidated") >= F.col("last_i") - (shown - 1)) & near, "broken")
        .when(F.col("live") & (F.col("kind") == "high") & (F.col("ceil") >= p), "overhead")
        .when(F.col("live") & (F.col("kind") == "low") & (F.col("floor") <= p), "live")
    )
    order = F.when(F.col("part") == "broken", -F.col("invalidated")).when(F.col("part") == "overhead", mid).otherwise(-mid)
    z = rated.withColumn("part", part).where("part is not null")
    z = z.withColumn("place", F.row_number().over(Window.partitionBy("symbol", "part").orderBy(order, "kind", "source", "zone")))
    quota = F.create_map(*[x for k, v in CHART_QUOTA.items() for x in (F.lit(k), F.lit(v))])
    return z.where(F.col("place") <= quota[F.col("part")]).select("symbol", "part", "place", "kind", "source", "zone", "floor", "ceil")
