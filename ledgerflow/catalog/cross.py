"""Queries on the latest cross-section: ranks, blends, gates and selection (sections C, E, F, G, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import band, blend, clamp, decile, mean_of, pct_rank, peer_groups, percentile_score, safe_div
from ..operators import asof, indicators as ind, scoring
from ..plans.views import Market
from .prices import OVER, _roll
from .registry import query

FEATURES = ("mom", "ret3", "dist", "vr")
_FEAT = f"""feat AS (SELECT *, lag(close, 21) {OVER} / nullif(lag(close, 252) {OVER}, 0) - 1 AS mom, close / nullif(lag(close, 63) {OVER}, 0) - 1 AS ret3,
  (top - close) / nullif(top, 0) AS dist, v20 / nullif(v100, 0) AS vr FROM (SELECT *, {_roll('max', 'high', 252, 126)} AS top, {_roll('avg', 'volume', 20)} AS v20, {_roll('avg', 'volume', 100)} AS v100, {_roll('avg', 'close', 50)} AS sma50, {_roll('avg', 'close', 200)} AS sma200 FROM bars))"""
_X = f"""{_FEAT}, x AS (SELECT f.symbol, f.date, f.close, f.sma50, f.sma200, CASE WHEN f.symbol % 13 = 0 THEN NULL ELSE mom END AS mom, ret3, dist, vr, s.name, s.sector, s.industry, s.mcap,
  CASE WHEN s.sector IS NULL OR count(*) OVER (PARTITION BY s.sector) < 10 THEN '__POOLED__' ELSE s.sector END AS peer
  FROM (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) f JOIN stocks s USING (symbol))"""


def featured(bars: DataFrame) -> DataFrame:
    means = {"sma50": ("close", 50), "sma200": ("close", 200), "_v20": ("volume", 20), "_v100": ("volume", 100)}
    df = ind.rolled(ind.returns(bars, "close", {"ret3": 63}), {out: ("mean", x, n, n) for out, (x, n) in means.items()} | {"_top": ("high", "high", 252, 126)})
    return df.withColumns({"mom": ind.momentum_12_1("close"), "dist": ind.distance_from_high("_top"), "vr": safe_div("_v20", "_v100")}).drop("_v20", "_v100", "_top")


def cross_section(m: Market) -> DataFrame:
    """Latest features of every symbol with its sector; every thirteenth momentum is missing."""
    year = asof.tail(m.bars(), "symbol", "date", 253)  # no feature looks further back
    x = asof.latest(featured(year), "symbol", "date").join(m.stocks(), "symbol")
    return peer_groups(x.withColumn("mom", F.when(F.col("symbol") % 13 != 0, F.col("mom"))))


def _avg_rank(x: str, part: str, desc: str = "") -> str:
    p = f"PARTITION BY {part}, {x} IS NULL" if part else f"PARTITION BY {x} IS NULL"
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER ({p} ORDER BY {x} {desc}) + (count(*) OVER ({p}, {x}) - 1) / 2.0 END"


def _pct(x: str, part: str, desc: str = "") -> str:
    n = f"count({x}) OVER (PARTITION BY {part})"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {n} = 1 THEN 50.0 ELSE ({_avg_rank(x, part, desc)} - 1) / nullif({n} - 1, 0) * 100 END"


@query("SELECT symbol, sector, peer FROM x", views="bars stocks", more=_X)
def e04_peer_groups(m: Market) -> DataFrame:
    return cross_section(m).select("symbol", "sector", "peer")


@query(f"SELECT symbol, round({_pct('mom', 'peer')}, 6) AS up, round({_pct('dist', 'peer', 'DESC')}, 6) AS down FROM x", views="bars stocks", more=_X)
def f18_peer_percentile(m: Market) -> DataFrame:
    return cross_section(m).select("symbol", percentile_score("mom", "peer").alias("up"), percentile_score("dist", "peer", descending=True).alias("down"))


@query(f"SELECT symbol, round(({_avg_rank('mom', '')}) / count(mom) OVER (), 6) AS r_mom, round(({_avg_rank('vr', '')}) / count(vr) OVER (), 6) AS r_vr FROM x", views="bars stocks", more=_X)
def f19_pct_ranks(m: Market) -> DataFrame:
    return cross_section(m).select("symbol", pct_rank("mom").alias("r_mom"), pct_rank("vr").alias("r_vr"))


_DECILE = "CASE WHEN {x} IS NOT NULL AND count({x}) OVER ({p}) >= 10 THEN CAST(greatest(1, ceil((row_number() OVER (PARTITION BY {q} {x} IS NULL ORDER BY {x}, symbol) - 1) * 10 / (count({x}) OVER ({p}) - 1))) AS INTEGER) END"


@query(f"SELECT symbol, {_DECILE.format(x='mom', p='', q='')} AS decile FROM x", views="bars stocks", more=_X)
def f20_deciles(m: Market) -> DataFrame:
    return cross_section(m).select("symbol", decile("mom", "symbol").alias("decile"))


@query("SELECT symbol, CASE WHEN mom IS NOT NULL THEN rank() OVER (PARTITION BY peer, mom IS NULL ORDER BY mom DESC) END AS sector_rank FROM x", views="bars stocks", more=_X)
def f22_sector_rank(m: Market) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("peer", F.col("mom").isNull()).orderBy(F.desc("mom"))
    return cross_section(m).select("symbol", F.when(F.col("mom").isNotNull(), F.rank().over(w)).alias("sector_rank"))


@query(
    """SELECT symbol, round(CASE WHEN v IS NULL THEN NULL ELSE greatest(0, least(100, CASE WHEN v < 55 THEN (v - 35) / 20 * 100 WHEN v > 75 THEN (90 - v) / 15 * 100 ELSE 100 END)) END, 6) AS band_score,
    round(CASE WHEN v IS NOT NULL THEN greatest(40, least(v, 60)) END, 6) AS clamped FROM (SELECT symbol, 100 * vr / 2 AS v FROM x)""",
    views="bars stocks",
    more=_X,
)
def c09_c10_clamp_and_band(m: Market) -> DataFrame:
    x = cross_section(m).withColumn("v", 100 * F.col("vr") / 2)
    return x.select("symbol", band("v", 35, 55, 75, 90).alias("band_score"), clamp("v", 40, 60).alias("clamped"))


_PARTS = f"p AS (SELECT symbol, {_pct('mom', 'peer')} AS a, {_pct('ret3', 'peer')} AS b, {_pct('dist', 'peer', 'DESC')} AS c, peer, sector, close, sma200, mcap, name FROM x)"
_BLENDED = "(coalesce(a, 0) * 50 + coalesce(b, 0) * 30 + coalesce(c, 0) * 20) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 50 END + CASE WHEN b IS NULL THEN 0 ELSE 30 END + CASE WHEN c IS NULL THEN 0 ELSE 20 END, 0)"
_HAVE = "(CASE WHEN a IS NULL THEN 0 ELSE 50 END + CASE WHEN b IS NULL THEN 0 ELSE 30 END + CASE WHEN c IS NULL THEN 0 ELSE 20 END)"


def parts(m: Market) -> DataFrame:
    return cross_section(m).withColumns({"a": percentile_score("mom", "peer"), "b": percentile_score("ret3", "peer"), "c": percentile_score("dist", "peer", descending=True)})


@query(f"SELECT symbol, round(CASE WHEN {_HAVE} >= 60 THEN {_BLENDED} END, 6) AS blended FROM p", views="bars stocks", more=f"{_X}, {_PARTS}")
def c11_blend(m: Market) -> DataFrame:
    return parts(m).select("symbol", blend({"a": 50, "b": 30, "c": 20}, 0.6).alias("blended"))


@query(
    "SELECT symbol, round((coalesce(a, 0) + coalesce(b, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END, 0), 6) AS mean_ab, round(greatest(a, c), 6) AS best, CASE WHEN a IS NULL AND c IS NULL THEN NULL WHEN c IS NULL OR a >= c THEN 'a' ELSE 'c' END AS winner FROM p",
    views="bars stocks",
    more=f"{_X}, {_PARTS}",
)
def c12_c14_mean_and_best(m: Market) -> DataFrame:
    a, c = F.col("a"), F.col("c")
    winner = F.when(a.isNull() & c.isNull(), None).when(c.isNull() | (a >= c), "a").otherwise("c")
    return parts(m).select("symbol", mean_of("a", "b").alias("mean_ab"), F.greatest("a", "c").alias("best"), winner.alias("winner"))


@query(
    f"""SELECT symbol, sector, round(blended, 6) AS blended, row_number() OVER (ORDER BY blended DESC, symbol) AS pick FROM (
      SELECT *, row_number() OVER (PARTITION BY sector ORDER BY blended DESC, symbol) AS k FROM (SELECT symbol, sector, {_BLENDED} AS blended FROM p) WHERE blended IS NOT NULL) WHERE k <= 5 QUALIFY pick <= 20""",
    views="bars stocks",
    more=f"{_X}, {_PARTS}",
)
def g01_capped_topn(m: Market) -> DataFrame:
    df = parts(m).withColumn("blended", blend({"a": 50, "b": 30, "c": 20}))
    return scoring.capped_top(df, "blended", 20, 0.25).select("symbol", "sector", "blended", "pick")


@query("SELECT symbol, name, round(mcap, 6) AS mcap, round(a, 6) AS a FROM p WHERE lower(name) LIKE '%00%' AND sector <> 'ASIA' ORDER BY p.a DESC NULLS LAST, symbol", views="bars stocks", more=f"{_X}, {_PARTS}")
def c17_filter_sort_all(m: Market) -> DataFrame:
    df = parts(m).where(F.lower("name").contains("00") & (F.col("sector") != "ASIA"))
    return df.orderBy(F.desc_nulls_last("a"), "symbol").select("symbol", "name", "mcap", "a")


@query(
    "SELECT count(*) AS n_all, count(*) FILTER (a IS NOT NULL) AS scored, count(*) FILTER (close > sma200) AS above_trend, count(*) FILTER (a >= 60) AS strong, count(*) FILTER (a >= 60 AND c >= 50) AS near_high, count(*) FILTER (mcap > 0) AS funded FROM p",
    views="bars stocks",
    more=f"{_X}, {_PARTS}",
)
def c18_funnel(m: Market) -> DataFrame:
    n = F.count_if
    return parts(m).agg(
        F.count("*").alias("n_all"), n(F.col("a").isNotNull()).alias("scored"), n(F.col("close") > F.col("sma200")).alias("above_trend"),
        n(F.col("a") >= 60).alias("strong"), n((F.col("a") >= 60) & (F.col("c") >= 50)).alias("near_high"), n(F.col("mcap") > 0).alias("funded"),
    )


@query(
    "SELECT sector, count(*) AS n, round(sum(mcap), 6) AS exposure, round(sum(mcap) / sum(sum(mcap)) OVER (), 6) AS share, sum(mcap) / sum(sum(mcap)) OVER () > 0.25 AS breach FROM x WHERE mcap > 0 GROUP BY sector",
    views="bars stocks",
    more=_X,
)
def e19_sector_exposure(m: Market) -> DataFrame:
    from pyspark.sql import Window

    df = cross_section(m).where("mcap > 0").groupBy("sector").agg(F.count("*").alias("n"), F.sum("mcap").alias("exposure"))
    share = F.col("exposure") / F.sum("exposure").over(Window.partitionBy(F.lit(0)))  # one row a sector
    return df.withColumn("share", share).withColumn("breach", F.col("share") > 0.25)


_CONV = ", ".join(f"({_avg_rank(f, '')}) / count({f}) OVER () AS r{k}" for k, f in enumerate(("mom", "ret3", "vr"))) + f", ({_avg_rank('nd', '')}) / count(nd) OVER () AS r3"


@query(
    "SELECT symbol, round(CASE WHEN n >= 4 THEN 100 * (coalesce(r0, 0) + coalesce(r1, 0) + coalesce(r2, 0) + coalesce(r3, 0)) / n END, 6) AS conviction FROM (SELECT *, (r0 IS NOT NULL)::INT + (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT AS n FROM (SELECT symbol, "
    + _CONV + " FROM (SELECT *, -dist AS nd FROM x)))",
    views="bars stocks",
    more=_X,
)
def j16_conviction(m: Market) -> DataFrame:
    return scoring.conviction(cross_section(m), features={"mom": 1, "ret3": 1, "vr": 1, "dist": -1}, least=4).select("symbol", "conviction")


_DRIVERS = " UNION ALL ".join(f"SELECT symbol, '{f}' AS feature, {k} AS place, (r{r} - 0.5) * 100 / n AS points FROM ranked" for k, (f, r) in enumerate((("mom", 0), ("ret3", 1), ("vr", 2), ("dist", 3))))


@query(
    f"SELECT symbol, feature, round(points, 6) AS points FROM ({_DRIVERS}) WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY points DESC, place) <= 3",
    views="bars stocks",
    more=f"{_X}, ranked AS (SELECT *, (r0 IS NOT NULL)::INT + (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT AS n FROM (SELECT symbol, {_CONV} FROM (SELECT *, -dist AS nd FROM x)))",
)
def g02_i28_top_drivers(m: Market) -> DataFrame:
    df = scoring.conviction(cross_section(m), features={"mom": 1, "ret3": 1, "vr": 1, "dist": -1}, least=4)
    return df.select("symbol", F.explode(scoring.top_drivers(3)).alias("d")).select("symbol", F.col("d.feature").alias("feature"), F.col("d.points").alias("points"))


@query(
    "SELECT symbol, round(stop, 6) AS stop, CASE WHEN stop < close THEN CAST(floor(least(10000 / (close - stop), 100000 / close)) AS BIGINT) END AS quantity FROM (SELECT symbol, close, CASE WHEN close > 0 AND atr14 > 0 THEN CASE WHEN raw > close - 1.5 * atr14 THEN close - 1.5 * atr14 ELSE greatest(raw, close * 0.7) END END AS stop FROM (SELECT *, CASE WHEN below > close * 0.7 THEN below ELSE close - 2.5 * atr14 END AS raw FROM (SELECT *, CASE WHEN sma200 < close THEN sma200 WHEN sma50 < close THEN sma50 END - 0.5 * atr14 AS below FROM (SELECT *, close * 0.03 AS atr14 FROM x))))",
    views="bars stocks",
    more=_X,
)
def i30_stop_and_size(m: Market) -> DataFrame:
    x = cross_section(m).withColumn("atr14", F.col("close") * 0.03)
    x = x.withColumn("stop", scoring.suggest_stop(zone="sma200", swing="sma50"))
    return x.select("symbol", "stop", scoring.quantity(1_000_000, 0.01).alias("quantity"))


@query(
    "SELECT symbol, rank, entered FROM (SELECT r.symbol, r.rank, NOT coalesce(h AND r.rank <= 25, false) AS entered, row_number() OVER (PARTITION BY NOT coalesce(h AND rank <= 25, false) AND rank <= 10 ORDER BY rank, symbol) AS turn, 10 - sum((coalesce(h AND rank <= 25, false))::INT) OVER () AS free FROM (SELECT symbol, symbol % 3 = 0 AS h, row_number() OVER (ORDER BY close DESC, symbol) AS rank FROM x) r WHERE rank <= 25) WHERE NOT entered OR (rank <= 10 AND turn <= free)",
    views="bars stocks",
    more=_X,
)
def g03_buy_list_band(m: Market) -> DataFrame:
    from pyspark.sql import Window

    x = cross_section(m).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("close"), "symbol")))
    held = x.where("symbol % 3 = 0").select("symbol", F.col("date").alias("since"))
    return scoring.apply_band(x.select("symbol", "rank"), held).select("symbol", "rank", "entered")
