"""Further queries on levels, lists, valuations and formats (sections C-L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..operators import actions, histories as hs, indicators as ind, levels as lv, zones as zn
from ..operators.indicators import W
from ..plans.views import Market
from ..sources import files
from .cross import _BLENDED, _PARTS, _X, parts
from .levels import _PIVOTS
from .prices import OVER, NTR, _ema_sql, _TR, _wilder_sql
from .registry import query
from .tables import _LATEST, latest


@query("SELECT symbol, round(close, 6) AS value FROM latest WHERE symbol % 4 <> 0 UNION ALL SELECT symbol, NULL FROM latest WHERE symbol % 4 = 0", more=_LATEST)
def c08_number_cleaning(m: Market) -> DataFrame:
    text = F.when(F.col("symbol") % 4 == 0, "-").when(F.col("symbol") % 4 == 1, F.concat(F.lit(" "), F.col("close").cast("string"), F.lit("%"))).otherwise(F.col("close").cast("string"))
    return latest(m).select("symbol", text.alias("t")).select("symbol", files.number("t").alias("value"))


@query(f"SELECT symbol, round(CASE WHEN mcap > 0 THEN {_BLENDED} END, 6) AS score, CASE WHEN mcap > 0 THEN 'momentum' ELSE 'none' END AS setup FROM p", views="bars stocks", more=f"{_X}, {_PARTS}")
def c15_c16_masked_reblend(m: Market) -> DataFrame:
    from ..functions.num import blend

    ok = F.col("mcap") > 0
    return parts(m).select("symbol", F.when(ok, blend({"a": 50, "b": 30, "c": 20})).alias("score"), F.when(ok, "momentum").otherwise("none").alias("setup"))


@query(
    "SELECT DISTINCT date, round(lead(close, 127) OVER (ORDER BY date) / nullif(lead(close, 1) OVER (ORDER BY date), 0) - 1, 6) AS benchmark FROM idx",
    views="bars idx",
)
def d13_benchmark_forward(m: Market) -> DataFrame:
    from pyspark.sql import Window

    w = Window.orderBy("date")  # one row a date
    return m.index_prices().select("date", (F.lead("close", 127).over(w) / F.nullif(F.lead("close", 1).over(w), F.lit(0.0)) - 1).alias("benchmark"))


_RECENT = "r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM nbars)"


@query("SELECT a.symbol, a.date, EXISTS (SELECT 1 FROM r b WHERE b.symbol = a.symbol AND b.k BETWEEN 40 AND 60 AND b.low <= a.high AND b.high >= a.low) AS overlaps FROM r a WHERE a.k <= 10", views="nbars", more=_RECENT)
def d14_band_overlap(m: Market) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    r = m.nation_bars().select("symbol", "date", F.col("low").alias("floor"), F.col("high").alias("ceil"), k.alias("k"))
    return lv.overlaps(r.where("k <= 10"), r.where("k between 40 and 60")).select("symbol", "date", "overlaps")


@query(
    "SELECT a.symbol, round(a.close, 6) AS price, round(arg_min(b.low, (abs(a.close - (b.low + b.high) / 2), b.low)), 6) AS floor, round(arg_min(b.high, (abs(a.close - (b.low + b.high) / 2), b.low)), 6) AS ceil FROM r a JOIN r b ON a.symbol = b.symbol AND b.k BETWEEN 2 AND 60 AND b.low < a.close WHERE a.k = 1 GROUP BY a.symbol, a.close",
    views="nbars",
    more=_RECENT,
)
def d15_g08_nearest_band(m: Market) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    r = m.nation_bars().withColumn("k", k)
    bands = r.where("k between 2 and 60").select("symbol", F.col("low").alias("floor"), F.col("high").alias("ceil"))
    return lv.nearest_below(bands, r.where("k = 1").select("symbol", F.col("close").alias("price")))


@query(
    "SELECT symbol, date, coalesce(h > lag(h) OVER w AND lag(h) OVER w > lag(h, 2) OVER w AND lag(h, 2) OVER w < 0, false) AS turning_up FROM (SELECT *, line - sig AS h FROM (" + _ema_sql("line", 9, "l", "sig") + ")) WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    more=f"e1 AS ({_ema_sql('close', 12, 'bars', 'f')}), e2 AS ({_ema_sql('close', 26, 'e1', 's')}), l AS (SELECT *, f - s AS line FROM e2)",
)
def f31_macd_turning_up(m: Market) -> DataFrame:
    from ..operators import candles

    return ind.macd_histogram(ind.blocked(m.bars())).select("symbol", "date", candles.macd_turning_up(ind.B()).alias("turning_up"))


@query(
    "SELECT symbol, date, coalesce(low < min(low) OVER w AND rsi14 > (arg_min({'r': rsi14}, (low, date)) OVER w).r, false) AS divergence FROM (SELECT symbol, date, low, CASE WHEN ag IS NULL THEN NULL WHEN ag = 0 AND al = 0 THEN 50 WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi14 FROM w2) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 8 PRECEDING)",
    more=f"{_TR}, w1 AS ({_wilder_sql('gain', 14, 't', 'ag')}), w2 AS ({_wilder_sql('loss', 14, 'w1', 'al')})",
)
def f34_rsi_divergence(m: Market) -> DataFrame:
    return ind.rsi(ind.blocked(m.bars())).select("symbol", "date", lv.rsi_divergence(w=ind.B()).alias("divergence"))


_RATIOS = """sp AS (SELECT unnest([1, 2, 1, 1, 1, 1, 1, 1, 1]) AS n, unnest([2, 5, 4, 5, 10, 20, 25, 50, 100]) AS d), bo AS (SELECT DISTINCT j AS n, i + j AS d FROM range(1, 11) a(i), range(1, 11) c(j)),
  whole AS (SELECT DISTINCT n // gcd(n, d) AS n, d // gcd(n, d) AS d FROM (SELECT n, d FROM sp UNION SELECT n, d FROM bo UNION SELECT sp.n * bo.n, sp.d * bo.d FROM sp, bo)),
  ratios AS (SELECT n / d AS ratio, n + d AS complexity FROM (SELECT n, d FROM whole UNION SELECT d, n FROM whole) WHERE n <> d AND n / d BETWEEN 0.005 AND 200)"""
_GAPS = f"gaps AS (SELECT symbol, date, r AS gap FROM (SELECT symbol, date, open / nullif(lag(close) {OVER}, 0) AS r, date - lag(date) {OVER} AS days FROM bars) WHERE days <= 5 AND (r < 0.78 OR r > 1.28))"
_FOUND = "found AS (SELECT symbol, date, gap, ratio AS factor FROM (SELECT *, abs(gap / ratio - 1) AS err FROM gaps, ratios) WHERE err <= 0.03 QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY CASE WHEN err <= 0.005 THEN 0 ELSE 1 END, CASE WHEN err <= 0.005 THEN 0 ELSE complexity END, err, ratio) = 1)"


def gaps(m: Market) -> DataFrame:
    return m.bars().withColumn("gap", actions.gap_ratio()).where("gap is not null").select("symbol", "date", "gap")


@query("SELECT round(ratio, 6) AS ratio, complexity, count(factor) AS actions FROM ratios LEFT JOIN found ON factor = ratio GROUP BY ratio, complexity", more=f"{_RATIOS}, {_GAPS}, {_FOUND}")
def h04_ratio_set(m: Market) -> DataFrame:
    """Every plausible ratio with the number of gaps that it explains."""
    ratios = actions.plausible_ratios(m.spark)
    found = actions.snapped(gaps(m), ratios).groupBy(F.col("factor").alias("ratio")).agg(F.count("*").alias("actions"))
    return ratios.join(found, "ratio", "left").fillna(0, ["actions"])


@query("SELECT symbol, date, round(gap, 6) AS gap, round(factor, 6) AS factor FROM found", more=f"{_RATIOS}, {_GAPS}, {_FOUND}")
def i25_actions(m: Market) -> DataFrame:
    """Gaps that a split, a bonus or both explain, with the factor."""
    return actions.snapped(gaps(m), actions.plausible_ratios(m.spark))


@query("SELECT symbol, date, round(gap, 6) AS gap FROM gaps ANTI JOIN found USING (symbol, date)", more=f"{_RATIOS}, {_GAPS}, {_FOUND}")
def i25_unexplained_moves(m: Market) -> DataFrame:
    return actions.unexplained(m.bars(), actions.plausible_ratios(m.spark))


@query("SELECT l.symbol, round(l.close / nullif(CASE WHEN h.eps > 0 THEN h.eps END, 0), 6) AS pe, round(h.eps, 6) AS eps FROM latest l JOIN (SELECT symbol, (pat[-1] + pat[-2] + pat[-3] + pat[-4]) / 1e5 AS eps FROM (SELECT symbol, list(pat ORDER BY period_end) AS pat FROM quarters GROUP BY symbol)) h USING (symbol)", views="bars quarters", more=_LATEST)
def i13_valuation(m: Market) -> DataFrame:
    q = m.quarters()
    h = q.groupBy("symbol").agg(hs.history(q, "pat")).select("symbol", (hs.trailing("pat") / 1e5).alias("eps"))
    return latest(m).join(h, "symbol").select("symbol", F.when(F.col("eps") > 0, F.col("close") / F.col("eps")).alias("pe"), "eps")


@query("SELECT symbol, round(greatest(0, least(100, (2.0 - d) / 1.5 * 100)), 6) AS proximity, round(greatest(0, least(100, (r - 2.5) / 2.5 * 100)), 6) AS reward, CAST(least(100, 45 * ((d < 1)::INT + (r > 3)::INT + (d > 0.2)::INT)) AS INTEGER) AS confirmation FROM (SELECT symbol, (symbol % 23) / 10.0 AS d, (symbol % 17) / 3.0 AS r FROM latest)", more=_LATEST)
def i34_setup_scores(m: Market) -> DataFrame:
    x = latest(m).select("symbol", ((F.col("symbol") % 23) / 10.0).alias("d"), ((F.col("symbol") % 17) / 3.0).alias("r"))
    x = x.withColumns({"p": F.col("d") < 1, "q": F.col("r") > 3, "s": F.col("d") > 0.2})
    return x.select("symbol", lv.proximity("d").alias("proximity"), lv.reward_risk("r").alias("reward"), lv.confirmation(["p", "q", "s"]).alias("confirmation"))


@query("SELECT symbol, (CASE WHEN ret >= 0 THEN '+' ELSE '-' END) || printf('%.1f', abs(ret) * 100) || '%' AS change, strftime(date, '%d %b') AS day FROM (SELECT symbol, date, trunc(close) / 1000 - 1 AS ret FROM latest)", more=_LATEST)
def i33_display(m: Market) -> DataFrame:
    x = latest(m).withColumn("ret", F.floor("close") / 1000 - 1)
    change = F.concat(F.when(F.col("ret") >= 0, "+").otherwise("-"), fixed(F.abs("ret") * 100, 1), F.lit("%"))
    return x.select("symbol", change.alias("change"), F.date_format("date", "dd MMM").alias("day"))


@query("SELECT as_of, piv.symbol, kind, count(*) AS n FROM a, piv JOIN n c ON c.symbol = piv.symbol AND c.i = piv.confirmed WHERE c.date <= as_of GROUP BY as_of, piv.symbol, kind", views="nbars", more=_PIVOTS + ", a AS (SELECT unnest([DATE '1996-03-29', DATE '1998-01-15']) AS as_of)", recursive=True)
def j02_visible_pivots(m: Market) -> DataFrame:
    at = m.spark.sql("SELECT explode(array(DATE'1996-03-29', DATE'1998-01-15')) AS as_of")
    return zn.visible(zn.pivots(m.nation_bars()), at).groupBy("as_of", "symbol", "kind").agg(F.count("*").alias("n"))


_FRACTAL_HIGHS = "fr AS (SELECT symbol, high AS level FROM (SELECT *, max(high) OVER w AS top, count(*) OVER w AS n, len(list_filter(list(high) OVER w, lambda v: v < high)) AS below FROM nbars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) WHERE n = 21 AND high = top AND below >= 10)"
_LAST = f"l AS (SELECT symbol, close AS price, atr14 AS atr, year FROM (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS year FROM ({_wilder_sql('tr', 14, 't', 'atr14')})) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"
_ABOVE = "lv AS (SELECT v.symbol, level, l.price, l.atr FROM (SELECT symbol, price AS level FROM piv WHERE kind = 'high' UNION ALL SELECT symbol, level FROM fr) v JOIN l USING (symbol) WHERE level > l.price)"


@query(
    "SELECT symbol, round(coalesce(min(floor) FILTER (touches >= 2), min(floor)), 6) AS floor, round(coalesce(arg_min(ceil, floor) FILTER (touches >= 2), min(floor)), 6) AS ceil, coalesce(arg_min(touches, floor) FILTER (touches >= 2), 1) AS touches FROM (SELECT symbol, band, min(level) AS floor, max(level) AS ceil, count(*) AS touches FROM (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY level ROWS UNBOUNDED PRECEDING) AS band FROM (SELECT *, CASE WHEN atr > 0 AND level - lag(level) OVER (PARTITION BY symbol ORDER BY level) <= 0.6 * atr THEN 0 ELSE 1 END AS fresh FROM lv)) GROUP BY symbol, band) GROUP BY symbol"
    " UNION ALL SELECT symbol, round(year, 6), round(year, 6), 0 FROM l WHERE year > price AND symbol NOT IN (SELECT symbol FROM lv)",
    views="nbars",
    more=f"{_PIVOTS}, {NTR}, {_FRACTAL_HIGHS}, {_LAST}, {_ABOVE}",
    recursive=True,
)
def j12_next_resistance_swings(m: Market) -> DataFrame:
    """All confirmed swing highs and fractal highs, Wilder's ATR, and the high of the last 252 bars as the last resort."""
    return resistance(m.nation_bars())


def resistance(bars: DataFrame) -> DataFrame:
    df = ind.atr(bars, out="atr").withColumn("year", F.max("high").over(W().rowsBetween(-251, 0)))
    last = df.groupBy("symbol").agg(F.max_by(F.struct("close", "atr", "year"), "date").alias("l"))
    last = last.select("symbol", F.col("l.close").alias("price"), F.col("l.atr").alias("atr"), F.col("l.year").alias("high"))
    swings = zn.pivots(bars).where("kind = 'high'").select("symbol", F.col("price").alias("level"))
    levels = swings.unionByName(lv.fractal_highs(bars))
    return lv.next_resistance(levels.join(last.drop("high"), "symbol"), year=last.select("symbol", "price", "high"))


_RANKED = "rk AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS rank FROM nbars), dy AS (SELECT date, row_number() OVER (ORDER BY date) AS i, list(symbol ORDER BY rank) AS r FROM rk WHERE rank <= 12 GROUP BY date)"


@query(
    "SELECT date, CAST(unnest(m) AS BIGINT) AS symbol FROM hist",
    views="nbars",
    more=_RANKED + """, hist AS (
      SELECT i, date, r[:5] AS m FROM dy WHERE i = 1 UNION ALL
      SELECT d.i, d.date, list_concat(list_filter(h.m, lambda y: list_contains(d.r, y)), list_filter(d.r[:5], lambda z: NOT list_contains(h.m, z))[:greatest(5 - len(list_filter(h.m, lambda y: list_contains(d.r, y))), 0)]) FROM hist h JOIN dy d ON d.i = h.i + 1)""",
    recursive=True,
)
def l04_membership_history(m: Market) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("close"), "symbol"))
    ranked = m.nation_bars().select("date", F.col("symbol").cast("long").alias("symbol"), rank.alias("rank"))
    return lv.membership_history(ranked, 5, 12)


@query("SELECT symbol, 'dropped' AS change FROM stocks WHERE symbol NOT IN (SELECT symbol FROM bars WHERE date >= DATE '2001-10-20') UNION ALL SELECT symbol, 'new' FROM (SELECT symbol FROM bars GROUP BY symbol HAVING min(date) > DATE '1995-01-10')", views="bars stocks")
def l11_l14_membership_changes(m: Market) -> DataFrame:
    b = m.bars()
    gone = m.stocks().join(b.where(F.col("date") >= "2001-10-20").select("symbol"), "symbol", "left_anti").select("symbol", F.lit("dropped").alias("change"))
    new = b.groupBy("symbol").agg(F.min("date").alias("d")).where(F.col("d") > "1995-01-10").select("symbol", F.lit("new").alias("change"))
    return gone.unionByName(new)


@query("SELECT symbol, n < 520 OR first_date > DATE '1995-01-06' AS needs_backfill FROM (SELECT symbol, count(*) AS n, min(date) AS first_date FROM bars GROUP BY symbol)")
def i37_needs_backfill(m: Market) -> DataFrame:
    x = m.bars().groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("d"))
    return x.select("symbol", ((F.col("n") < 520) | (F.col("d") > "1995-01-06")).alias("needs_backfill"))


@query(f"SELECT symbol, date, abs(close - m) <= 0.75 * a AS near_ma, CASE WHEN abs(close - (h - 0.382 * (h - l))) <= 0.6 * a THEN 0.382 WHEN abs(close - (h - 0.5 * (h - l))) <= 0.6 * a THEN 0.5 WHEN abs(close - (h - 0.618 * (h - l))) <= 0.6 * a THEN 0.618 END::DOUBLE AS fib FROM (SELECT *, close * 0.04 AS a, avg(close) OVER w AS m, max(high) OVER w AS h, min(low) OVER w AS l FROM nbars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))", views="nbars")
def i36_long_ma_and_retracement(m: Market) -> DataFrame:
    f = W().rowsBetween(-199, 0)
    x = m.nation_bars().withColumns({"a": F.col("close") * 0.04, "m": F.avg("close").over(f), "h": F.max("high").over(f), "l": F.min("low").over(f)})
    ma, fib = lv.agrees("close", "m", "h", "l", "a")
    return x.select("symbol", "date", ma.alias("near_ma"), fib.alias("fib"))


@query("SELECT symbol, round(CASE WHEN s > 0 THEN CAST(floor(least(10000 / (close * 0.1), 100000 / close)) AS BIGINT) * close END, 6) AS deployed FROM (SELECT symbol, close, symbol % 3 AS s FROM latest) WHERE floor(least(10000 / (close * 0.1), 100000 / close)) >= 1", more=_LATEST)
def e20_g04_shortlist_capacity(m: Market) -> DataFrame:
    x = latest(m).select("symbol", "close", (F.col("close") * 0.9).alias("stop"), (F.col("symbol") % 3).alias("s"))
    x = x.withColumn("q", F.floor(F.least(10000 / (F.col("close") * 0.1), 100000 / F.col("close"))).cast("long")).where("q >= 1")
    return x.select("symbol", F.when(F.col("s") > 0, F.col("q") * F.col("close")).alias("deployed"))
