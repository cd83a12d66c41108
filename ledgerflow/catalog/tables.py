"""Queries on joins, set operations, table mutation, checks and transitions (sections B, D, H, K, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import asof, tables as tb
from ..plans.views import Market
from .prices import OVER
from .registry import query

_LATEST = "latest AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"


def latest(m: Market) -> DataFrame:
    return asof.latest(m.bars(), "symbol", "date")


@query("SELECT symbol, date, round(close, 6) AS close, sector, industry FROM latest LEFT JOIN stocks USING (symbol)", views="bars stocks", more=_LATEST)
def d01_d02_lookup(m: Market) -> DataFrame:
    return latest(m).join(m.stocks().select("symbol", "sector", "industry"), "symbol", "left").select("symbol", "date", "close", "sector", "industry")


@query("SELECT symbol, name FROM stocks WHERE symbol IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= DATE '1998-06-01' AND l_returnflag = 'R')", views="stocks")
def d04_semi_members(m: Market) -> DataFrame:
    seen = m.table("lineitem").where((F.col("l_shipdate") >= "1998-06-01") & (F.col("l_returnflag") == "R")).select(F.col("l_suppkey").alias("symbol"))
    return m.stocks().join(seen, "symbol", "left_semi").select("symbol", "name")


@query("SELECT symbol, name FROM stocks WHERE symbol NOT IN (SELECT symbol FROM bars WHERE date >= DATE '2001-10-25')", views="bars stocks")
def d05_anti_dropped(m: Market) -> DataFrame:
    seen = m.bars().where(F.col("date") >= "2001-10-25").select("symbol")
    return m.stocks().join(seen, "symbol", "left_anti").select("symbol", "name")


@query(
    """SELECT n.symbol, n.date, q.revenue IS NOT NULL AS known, round(q.revenue, 6) AS revenue FROM latest n ASOF LEFT JOIN quarters q ON n.symbol = q.symbol AND n.date >= q.filed_on""",
    views="bars quarters",
    more=_LATEST,
)
def d08_asof_statement(m: Market) -> DataFrame:
    q = m.quarters().select("symbol", F.col("filed_on").alias("date"), "revenue")
    got = asof.asof_join(latest(m).select("symbol", "date"), q, "symbol", "date", "revenue", "revenue_known")
    return got.select("symbol", "date", F.col("revenue_known").isNotNull().alias("known"), F.col("revenue_known").alias("revenue"))


@query("SELECT symbol, date, round(CASE WHEN symbol % 2 = 0 THEN close * 2 ELSE close END, 6) AS close FROM latest UNION ALL SELECT symbol + 1000000, date, round(close, 6) FROM latest WHERE symbol % 10 = 0", more=_LATEST)
def b01_upsert(m: Market) -> DataFrame:
    old = latest(m).select("symbol", "date", "close")
    new = old.where("symbol % 2 = 0").withColumn("close", F.col("close") * 2)
    new = new.unionByName(old.where("symbol % 10 = 0").withColumn("symbol", F.col("symbol") + 1_000_000))
    return tb.upsert(old, new, ["symbol"])


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1", views="")
def b02_collapse_duplicates(m: Market) -> DataFrame:
    rows = m.table("lineitem").withColumn("seq", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    return tb.collapse(rows.select("l_orderkey", "l_linenumber", "l_extendedprice", "seq"), ["l_orderkey", "l_linenumber"], "seq").drop("seq")


@query("SELECT symbol, date, round(close, 6) AS close FROM bars WHERE symbol % 4 <> 0 UNION ALL SELECT symbol, date, round(close, 6) FROM latest WHERE symbol % 8 = 0", more=_LATEST)
def b03_replace_keys(m: Market) -> DataFrame:
    bars = m.bars().select("symbol", "date", "close")
    done = bars.where("symbol % 4 = 0")
    return tb.replace_keys(bars, done, latest(m).where("symbol % 8 = 0").select("symbol", "date", "close"), "symbol")


@query("SELECT symbol, name, CASE WHEN sector = 'ASIA' THEN 'moved' ELSE industry END AS industry FROM stocks", views="stocks")
def b04_update_where_in(m: Market) -> DataFrame:
    s = m.stocks()
    return tb.update_where_in(s, s.where("sector = 'ASIA'"), "symbol", {"industry": F.lit("moved")}).select("symbol", "name", "industry")


@query("SELECT symbol, date, round(close, 6) AS close FROM bars WHERE date >= (SELECT max(date) FROM bars) - 120")
def b06_retention(m: Market) -> DataFrame:
    return tb.retain(m.bars().select("symbol", "date", "close"), "date", 120)


@query("SELECT symbol, date, round(CASE WHEN date >= (SELECT max(date) FROM bars WHERE date < DATE '2001-06-01') - 14 THEN close + 1 ELSE close END, 6) AS close FROM bars")
def a08_overlap_merge(m: Market) -> DataFrame:
    bars = m.bars().select("symbol", "date", "close")
    stored = bars.where(F.col("date") < "2001-06-01")
    return tb.merge_overlap(stored, bars.withColumn("close", F.col("close") + 1), ["symbol", "date"], "date")


@query("SELECT symbol FROM (SELECT symbol FROM bars WHERE date >= DATE '2001-10-01' INTERSECT SELECT symbol FROM bars WHERE date < DATE '1995-02-01')")
def h01_intersection(m: Market) -> DataFrame:
    b = m.bars()
    return b.where(F.col("date") >= "2001-10-01").select("symbol").intersect(b.where(F.col("date") < "1995-02-01").select("symbol"))


@query("SELECT symbol FROM (SELECT symbol FROM bars WHERE date >= DATE '2001-10-01' EXCEPT SELECT symbol FROM bars WHERE date < DATE '1995-02-01')")
def h02_difference(m: Market) -> DataFrame:
    b = m.bars()
    return b.where(F.col("date") >= "2001-10-01").select("symbol").subtract(b.where(F.col("date") < "1995-02-01").select("symbol"))


@query("SELECT symbol, date, round(close, 6) AS close, 'daily' AS frame FROM bars WHERE volume > 100 UNION ALL SELECT symbol, date, round(close, 6), 'weekly' FROM nbars WHERE volume > 400", views="bars nbars")
def h03_h05_union(m: Market) -> DataFrame:
    d = m.bars().where("volume > 100").select("symbol", "date", "close", F.lit("daily").alias("frame"))
    w = m.nation_bars().where("volume > 400").select(F.col("symbol").cast("long").alias("symbol"), "date", "close", F.lit("weekly").alias("frame"))
    return d.unionByName(w)


@query(
    """SELECT name, ok, detail, fatal FROM (SELECT count(*) AS n, count(DISTINCT symbol) AS u, count(*) FILTER (score < 0 OR score > 100) AS bad, avg((score IS NOT NULL)::DOUBLE) AS cover FROM sc),
    LATERAL (VALUES ('count', n BETWEEN 5 AND 520, n::VARCHAR, true), ('unique', n = u, (n - u)::VARCHAR, true), ('range', bad = 0, bad::VARCHAR, true), ('coverage', cover >= 0.5, CAST(round(cover, 3) AS VARCHAR), false)) t(name, ok, detail, fatal)""",
    more=f"{_LATEST}, sc AS (SELECT symbol, CASE WHEN symbol % 3 = 0 THEN NULL ELSE close / 20 END AS score FROM latest)",
)
def k01_score_checks(m: Market) -> DataFrame:
    scores = latest(m).select("symbol", F.when(F.col("symbol") % 3 != 0, F.col("close") / 20).alias("score"))
    return tb.score_checks(scores, 5, 520)


@query(f"SELECT symbol, date, round(close, 6) AS close, CASE WHEN cheap THEN 'below' ELSE 'above' END AS state FROM (SELECT *, close < 1000 AS cheap, lag(close < 1000) {OVER} AS was FROM bars) WHERE was IS NOT NULL AND was <> cheap")
def l02_transitions(m: Market) -> DataFrame:
    b = m.bars().withColumn("state", F.when(F.col("close") < 1000, "below").otherwise("above"))
    return tb.transitions(b, "state").select("symbol", "date", "close", "state")


@query(
    """SELECT symbol, date FROM (
      WITH RECURSIVE e AS (SELECT DISTINCT symbol, date FROM bars WHERE volume > 60), k AS (SELECT symbol, min(date) AS date FROM e GROUP BY symbol UNION ALL
        SELECT * FROM (SELECT k.symbol, min(e.date) AS date FROM k JOIN e ON e.symbol = k.symbol AND e.date > k.date + 10 GROUP BY k.symbol, k.date)) SELECT * FROM k)"""
)
def l03_suppress_seen(m: Market) -> DataFrame:
    return tb.suppress_seen(m.bars().where("volume > 60").select("symbol", "date"), "symbol", "date", 10)


@query("SELECT symbol, date, max((volume > 80)::INT) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) = 1 AS fired FROM bars")
def e17_l05_event_memory(m: Market) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-62, 0)
    return m.bars().select("symbol", "date", F.max(F.col("volume") > 80).over(w).alias("fired"))


@query("SELECT event_type AS name, max(ts) AS ts, round(arg_max(value, (ts, event_id)), 6) AS last FROM events GROUP BY 1", views="")
def l01_live_latest(m: Market) -> DataFrame:
    e = m.table("events").withColumn("k", F.struct("ts", "event_id"))
    return e.groupBy(F.col("event_type").alias("name")).agg(F.max("ts").alias("ts"), F.max_by("value", "k").alias("last"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 6) AS invested, count(*) FILTER (event_type = 'error') AS broken, round(avg(value) FILTER (event_type = 'purchase'), 6) AS mean_purchase FROM events GROUP BY user_id", views="")
def e18_book_totals(m: Market) -> DataFrame:
    is_ = lambda t: F.col("event_type") == t
    return m.table("events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("value").alias("invested"), F.count_if(is_("error")).alias("broken"), F.avg(F.when(is_("purchase"), F.col("value"))).alias("mean_purchase")
    )
