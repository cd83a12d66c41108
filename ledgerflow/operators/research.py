"""Rank-correlation research: information coefficients, holdout, deciles, weight search, simulation.

Everything runs over all (date, symbol) rows at once; features are unpivoted and
candidates exploded into a key, so a search is one job and not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import avg_rank, correlation, decile, pct_rank, safe_div
from ..plans.cut import cut

MIN_NAMES, MIN_DATES, OVERLAP_LAG = 30, 3, 5


def unpivot(panel: DataFrame, features: list[str], *keys: str) -> DataFrame:
    return panel.unpivot(list(keys), features, "feature", "value")


def date_ic(panel: DataFrame, value: str, *groups: str, date: str = "as_of", target: str = "forward_return", least: int = MIN_NAMES) -> DataFrame:
    """Spearman correlation of ``value`` and the target on each date with enough names."""
    df = panel.where(F.col(value).isNotNull() & F.col(target).isNotNull())
    keys = (*groups, date)
    # Twice a rank is whole, so the sums are exact, and no relation is exactly 0.
    df = df.withColumns({"_a": 2 * avg_rank(value, *keys), "_b": 2 * avg_rank(target, *keys)})
    n = F.count("*")
    spread = lambda x, y: n * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)
    ic = spread("_a", "_b") / F.nullif(F.sqrt(spread("_a", "_a") * spread("_b", "_b")), F.lit(0.0))
    out = df.groupBy(*keys).agg(ic.alias("ic"), n.alias("names"))
    return out.where((F.col("names") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def newey_west(series: DataFrame, x: str, *groups: str, order: str = "as_of", lag: int = OVERLAP_LAG) -> DataFrame:
    """mean, naive and Newey-West standard errors (Bartlett weights, variance over n) and t of each group's series."""
    keys = list(groups) or [F.lit(0).alias("_g")]
    names = list(groups) or ["_g"]
    df = series.select("*", *[k for k in keys if not isinstance(k, str)])
    w = Window.partitionBy(*names)
    df = df.withColumn("_e", F.col(x) - F.avg(x).over(w))
    o = w.orderBy(order)
    df = df.withColumns({f"_p{k}": F.col("_e") * F.lag("_e", k).over(o) for k in range(1, lag + 1)})
    out = df.groupBy(*names).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.avg((F.col(x) > 0).cast("double")).alias("share_positive"),
        F.avg(F.col("_e") * F.col("_e")).alias("_g0"),
        *[F.sum(f"_p{k}").alias(f"_g{k}") for k in range(1, lag + 1)],
    )
    var = F.col("_g0")
    for k in range(1, lag + 1):
        var = var + 2 * (1 - k / (lag + 1)) * F.coalesce(F.col(f"_g{k}") / F.col("n"), F.lit(0.0))
    se = F.when(F.col("n") >= 4, F.sqrt(F.greatest(var, F.lit(1e-12)) / F.col("n")))
    out = out.withColumn("nw_se", se)
    out = out.select(*groups, "n", "mean", (F.col("sd") / F.sqrt("n")).alias("naive_se"), "nw_se", safe_div("mean", "nw_se").alias("nw_t"), "share_positive")
    return out


def information_coefficient(panel: DataFrame, value: str, *groups: str, least_dates: int = MIN_DATES, **kw) -> DataFrame:
    return newey_west(date_ic(panel, value, *groups, **kw), "ic", *groups).where(F.col("n") >= least_dates)


def feature_ic(panel: DataFrame, features: list[str], date: str = "as_of", **kw) -> DataFrame:
    """The coefficient of every feature in one job."""
    long = unpivot(panel, features, date, "symbol", "forward_return").where("value is not null")
    return information_coefficient(long, "value", "feature", **kw)


def holdout(panel: DataFrame, features: list[str], cut: str, least_t: float = 2.0, embargo_days: int = 0, **kw) -> DataFrame:
    """Sign and t of each feature before ``cut``, its coefficient after it, and whether the sign held."""
    day = F.lit(cut).cast("date")
    long = unpivot(panel, features, "as_of", "symbol", "forward_return").where("value is not null")
    period = F.when(F.col("as_of") < F.date_sub(day, embargo_days), "train").when(F.col("as_of") >= day, "test")
    least = kw.pop("least_dates", MIN_DATES)
    # A date's coefficient is the same in any period, so the panel is read and ranked once.
    ics = date_ic(long, "value", "feature", **kw).withColumn("period", period).where("period is not null")
    both = newey_west(ics, "ic", "period", "feature").where(F.col("n") >= least)
    sides = both.groupBy("feature").agg(*[F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{p}_{c}") for p in ("train", "test") for c in ("mean", "nw_t")])
    sides = sides.where("train_mean is not null")
    train = sides.select("feature", F.col("train_mean").alias("mean"), F.col("train_nw_t").alias("nw_t"), F.col("test_mean").alias("test_ic"), F.col("test_nw_t").alias("test_t"))
    out = train.select("feature", F.signum("mean").alias("sign"), F.col("mean").alias("train_ic"), F.col("nw_t").alias("train_t"), "test_ic", "test_t")
    return out.withColumns({"selected": F.abs("train_t") >= least_t, "held": F.signum("test_ic") == F.col("sign")})


def composite(panel: DataFrame, signs: dict[str, int], date: str = "as_of") -> DataFrame:
    """Equal mean of the signed within-date percentile ranks."""
    long = unpivot(panel, list(signs), date, "symbol", "forward_return").where("value is not null")
    sign = F.create_map(*[x for k, v in signs.items() for x in (F.lit(k), F.lit(float(v)))])
    long = long.withColumn("value", F.col("value") * sign[F.col("feature")])
    long = long.withColumn("r", pct_rank("value", date, "feature"))
    return long.groupBy(date, "symbol", "forward_return").agg(F.avg("r").alias("composite"))


def decile_study(panel: DataFrame, by: str, x: str = "forward_return", least: int = 20) -> DataFrame:
    stats = [
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.median(x).alias("median"),
        F.avg((F.col(x) > 0).cast("double")).alias("hit_rate"),
        F.avg((F.col(x) >= 0.25).cast("double")).alias("hit_rate_25pct"),
        F.percentile(x, 0.10).alias("p10"),
        F.percentile(x, 0.90).alias("p90"),
    ]
    return panel.where(F.col(by).isNotNull() & F.col(x).isNotNull()).groupBy(by).agg(*stats).where(F.col("n") >= least)


def rank_quality(study: DataFrame, by: str = "decile") -> DataFrame:
    """Spearman of decile with median and hit rate, top-bottom spread and a verdict; one row."""
    df = study.withColumns({"_one": F.lit(1)})
    df = df.withColumns({"_d": avg_rank(by, "_one"), "_m": avg_rank("median", "_one"), "_h": avg_rank("hit_rate", "_one")})
    out = df.agg(
        F.count("*").alias("deciles"),
        correlation("_d", "_m").alias("rho_median"),
        correlation("_d", "_h").alias("rho_hit"),
        (F.max_by("median", by) - F.min_by("median", by)).alias("spread"),
    ).where(F.col("deciles") >= 4)
    r = F.col("rho_median")
    return out.withColumn("verdict", F.when(r >= 0.6, "ranks").when(r >= 0.3, "weak").when(r > -0.3, "none").otherwise("inverted"))


def weight_grid(spark, step: int = 10, incumbents: tuple = ((5, 45, 50),)) -> DataFrame:
    """All (q, v, t) on a grid that sum to 100, and the incumbents once: a driver-side list of fixed size."""
    grid = {(q, v, 100 - q - v) for q in range(0, 101, step) for v in range(0, 101 - q, step)} | set(incumbents)
    return spark.createDataFrame(sorted(grid), "q int, v int, t int")


def blended(panel: DataFrame, grid: DataFrame, q: str, v: str, t: str) -> DataFrame:
    def part(w: str, x: str) -> Column:
        return F.coalesce(F.col(x), F.lit(0.0)) * F.col(w)

    def have(w: str, x: str) -> Column:
        return F.when(F.col(x).isNotNull(), F.col(w)).otherwise(0)

    df = panel.crossJoin(F.broadcast(grid.withColumnsRenamed({"q": "wq", "v": "wv", "t": "wt"})))
    return df.withColumn("blended", safe_div(part("wq", q) + part("wv", v) + part("wt", t), have("wq", q) + have("wv", v) + have("wt", t)))


def _ranked_targets(panel: DataFrame, parts: tuple[str, ...], date: str, target: str) -> DataFrame:
    """Add ``_b``: for each set of parts (bit i: part i has weight) twice the target's average rank among the date's rows with one of them.

    Which rows a candidate scores depends on its parts with a weight only, so the target is sorted once and not for every candidate.
    """
    sets = range(1, 2 ** len(parts))
    there = {}
    for k in sets:
        some = [F.col(x).isNotNull() for i, x in enumerate(parts) if k >> i & 1]
        any_of = some[0]
        for c in some[1:]:
            any_of = any_of | c
        there[k] = (F.col(target).isNotNull() & any_of).cast("int")
    upto = Window.partitionBy(date).orderBy(target).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy(date, target)
    df = panel.withColumns({f"_le{k}": F.sum(there[k]).over(upto) for k in sets}).withColumns({f"_eq{k}": F.sum(there[k]).over(ties) for k in sets})
    ranks = [F.when(there[k] == 1, 2 * F.col(f"_le{k}") - F.col(f"_eq{k}") + 1) for k in sets]
    return df.withColumn("_b", F.array(*ranks)).drop(*[f"_{c}{k}" for c in ("le", "eq") for k in sets])


def _candidates(panel: DataFrame, grid: DataFrame, q: str, v: str, t: str, date: str) -> DataFrame:
    """Scored rows of every candidate, dealt by date and first weight: the other weights are written out after the shuffle."""
    g = grid.groupBy(F.col("q").alias("wq")).agg(F.collect_list(F.struct(F.col("v").alias("wv"), F.col("t").alias("wt"))).alias("_w"))
    df = panel.crossJoin(F.broadcast(g)).repartition(date, "wq").withColumn("_w", F.explode("_w")).select("*", "_w.wv", "_w.wt").drop("_w")

    def part(w: str, x: str) -> Column:
        return F.coalesce(F.col(x), F.lit(0.0)) * F.col(w)

    def have(w: str, x: str) -> Column:
        return F.when(F.col(x).isNotNull(), F.col(w)).otherwise(0)

    df = df.withColumn("blended", safe_div(part("wq", q) + part("wv", v) + part("wt", t), have("wq", q) + have("wv", v) + have("wt", t)))
    bits = sum(((F.col(w) > 0).cast("int") * 2**i for i, w in enumerate(("wv", "wt"), 1)), (F.col("wq") > 0).cast("int"))
    return df.withColumn("_b", F.try_element_at("_b", bits)).where("blended is not null").drop(q, v, t)


def _search_ics(scored: DataFrame, date: str, least: int = MIN_NAMES) -> DataFrame:
    """Spearman correlation of every candidate on each date, from rows that ``_candidates`` made."""
    cand = ("wq", "wv", "wt", date)
    own = Window.partitionBy(*cand)
    upto = own.orderBy("blended").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    there = F.col("_b").isNotNull().cast("int")
    df = scored.withColumn("_le", F.sum(there).over(upto)).withColumn("_eq", F.sum(there).over(Window.partitionBy(*cand, "blended")))
    df = df.where("_b is not null").withColumn("_a", 2 * F.col("_le") - F.col("_eq") + 1)
    n = F.count("*")
    spread = lambda x, y: n * F.sum(F.col(x).cast("double") * F.col(y)) - F.sum(F.col(x).cast("double")) * F.sum(F.col(y).cast("double"))
    ic = spread("_a", "_b") / F.nullif(F.sqrt(spread("_a", "_a") * spread("_b", "_b")), F.lit(0.0))
    out = df.groupBy(*cand).agg(ic.alias("ic"), n.alias("names"))
    return out.where((F.col("names") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def weight_search(panel: DataFrame, grid: DataFrame, q: str, v: str, t: str, date: str = "as_of", target: str = "forward_return", least_dates: int = MIN_DATES) -> DataFrame:
    """The coefficient of every candidate blend: candidates are a key, not a loop. ``grid`` is a fixed list."""
    rows = _ranked_targets(panel.select(date, q, v, t, target).where(F.col(target).isNotNull()), (q, v, t), date, target)
    ics = _search_ics(_candidates(rows, grid, q, v, t, date), date)
    return newey_west(ics, "ic", "wq", "wv", "wt", order=date).where(F.col("n") >= least_dates)


def _decile_figures(found: DataFrame, x: str, *keys: str) -> DataFrame:
    """m, median, hit25 and p10 of ``x`` by period ("all" and each ``_half``) and ``keys``: one sort, no group's values in memory."""
    run = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*keys)
    periods = {"all": F.lit(True), "first": F.col("_half") == "first", "second": F.col("_half") == "second"}
    df = found.select(*keys, x, "_half")
    df = df.withColumns({f"_at_{p}": F.count_if(c).over(run) - 1 for p, c in periods.items()})
    df = df.withColumns({f"_n_{p}": F.count_if(c).over(own) for p, c in periods.items()})
    aggs = []
    for p, c in periods.items():
        for name, share in (("median", 0.5), ("p10", 0.1)):
            place = (F.col(f"_n_{p}") - 1) * F.lit(share)
            low, high = (F.max(F.when(c & (F.col(f"_at_{p}") == f(place)), F.col(x))) for f in (F.floor, F.ceil))
            over = F.max(place - F.floor(place))
            aggs.append((low * (1 - over) + high * over).alias(f"{name}_{p}"))
        aggs += [F.count_if(c).alias(f"m_{p}"), F.avg(F.when(c, (F.col(x) >= 0.25).cast("double"))).alias(f"hit25_{p}")]
    out = df.groupBy(*keys).agg(*aggs)
    each = F.array(*[F.struct(F.lit(p).alias("period"), *[F.col(f"{n}_{p}").alias(n) for n in ("m", "median", "hit25", "p10")]) for p in periods])
    return out.select(*keys, F.inline(each)).where("m > 0")


def weight_search_halves(panel: DataFrame, grid: DataFrame, q: str, v: str, t: str, date: str = "as_of", x: str = "forward_return") -> DataFrame:
    """Coefficient and decile figures of every candidate over all dates, the coefficients and decile order of both halves, and ``stable``.

    The second half begins at the middle date (of fewer than four dates all are the
    first half). A candidate or half with fewer than four deciles of 20 returns has
    no figures; ``stable`` needs a positive coefficient in both halves.
    """
    days = panel.groupBy().agg(F.array_sort(F.collect_set(date)).alias("_d"))  # one row
    middle = F.when(F.size("_d") >= 4, F.element_at("_d", (F.floor(F.size("_d") / 2) + 1).cast("int")))
    half = F.when(middle.isNull() | (F.col(date) < middle), "first").otherwise("second")
    keys = ("period", "wq", "wv", "wt")
    rows = _ranked_targets(panel.select(date, "symbol", q, v, t, x), (q, v, t), date, x).crossJoin(F.broadcast(days)).withColumn("_half", half).drop("_d")
    # Ranks and deciles of a date are the same in any period, so each candidate and date is sorted once.
    scored = _candidates(rows, grid, q, v, t, date).withColumn("decile", decile("blended", "symbol", "wq", "wv", "wt", date))
    days_in = lambda df, c: df.withColumn("period", F.explode(F.array(F.lit("all"), F.col(c))))
    ics = _search_ics(scored, date).crossJoin(F.broadcast(days)).withColumn("_half", half).drop("_d")
    ic = newey_west(days_in(ics, "_half"), "ic", *keys, order=date).where(F.col("n") >= MIN_DATES)
    found = scored.where(F.col("decile").isNotNull() & F.col(x).isNotNull())
    per = _decile_figures(found, x, "wq", "wv", "wt", "decile")
    per = per.where("m >= 20").withColumns({"_d": avg_rank("decile", *keys), "_m": avg_rank("median", *keys), "_h": avg_rank("hit25", *keys)})
    study = per.groupBy(*keys).agg(
        F.count("*").alias("deciles"),
        correlation("_d", "_m").alias("median_rho"),
        correlation("_d", "_h").alias("hit_rho"),
        (F.max_by("median", "decile") - F.min_by("median", "decile")).alias("spread"),
        F.max_by("median", "decile").alias("top_median"),
        F.max_by("hit25", "decile").alias("top_hit25"),
        F.max_by("p10", "decile").alias("top_p10"),
        F.min_by("hit25", "decile").alias("bottom_hit25"),
    ).where("deciles >= 4")
    r = F.round("median_rho", 9)  # a coefficient on a limit is on it in any order of sums
    study = study.withColumn("verdict", F.when(r >= 0.6, "ranks").when(r >= 0.3, "weak").when(r > -0.3, "none").otherwise("inverted"))
    every = cut(study.join(ic, list(keys), "left"))  # read three times
    whole = every.where("period = 'all'").drop("period", "deciles")

    def of(name: str) -> DataFrame:
        return every.where(F.col("period") == name).select("wq", "wv", "wt", F.col("mean").alias(f"ic_{name}_half"), F.col("median_rho").alias(f"rho_{name}_half"))

    out = whole.join(of("first"), ["wq", "wv", "wt"], "left").join(of("second"), ["wq", "wv", "wt"], "left")
    return out.withColumn("stable", F.coalesce((F.col("ic_first_half") > 0) & (F.col("ic_second_half") > 0), F.lit(False)))


def summary(trades: DataFrame, hold: int, x: str = "net_return", date: str = "as_of") -> DataFrame:
    """One row of portfolio statistics; overlapping holds are averaged, not compounded."""
    closed = trades.where(F.col(x).isNotNull())
    r = F.col(x)
    per = closed.groupBy(date).agg(F.avg(x).alias("m"))
    stride = max(1, round(hold / 21))
    order = Window.orderBy(date)  # one row a rebalance
    seq = per.withColumn("_i", F.row_number().over(order) - 1).where(F.col("_i") % stride == 0)
    seq = seq.withColumn("_eq", F.exp(F.sum(F.log(1 + F.col("m"))).over(order)))
    seq = seq.withColumn("_peak", F.max("_eq").over(order))
    dd = seq.agg(F.max((F.col("_peak") - F.col("_eq")) / F.col("_peak")).alias("max_drawdown"), F.count("*").alias("drawdown_periods"))
    mean = per.agg(F.count("*").alias("rebalances"), F.avg("m").alias("mean_per_hold"))
    stats = closed.agg(
        F.count("*").alias("trades"),
        F.median(x).alias("median_return"),
        F.avg(x).alias("mean_return"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.avg((r >= 0.25).cast("double")).alias("hit_rate_25pct"),
        F.median(F.when(r > 0, r)).alias("median_winner"),
        F.median(F.when(r <= 0, r)).alias("median_loser"),
        F.min(x).alias("worst"),
        F.max(x).alias("best"),
        F.percentile(x, 0.1).alias("p10"),
    )
    out = stats.crossJoin(mean).crossJoin(dd)  # three single rows
    return out.withColumn("annualised", F.when(F.col("mean_per_hold") > -1, F.pow(1 + F.col("mean_per_hold"), F.lit(252.0 / hold)) - 1))


def with_deciles(panel: DataFrame, score: str, date: str = "as_of") -> DataFrame:
    return panel.withColumn("decile", decile(score, "symbol", date))
