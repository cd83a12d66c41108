"""Statements, holdings and membership of the nations, measured in the star schema.

Sales are lines by ship date. Operating profit is what is left of the net price over nine
tenths of the list price, profit what tax leaves of it; returned lines brought no cash and
are owed back. Holders are the customers' market segments by their share of the quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import Market

SHARES = 500  # of a supplier; a nation has those of its suppliers


def _home(m: Market) -> DataFrame:
    return m.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("symbol"))


def statements(m: Market) -> tuple[DataFrame, DataFrame]:
    """Years and quarters: symbol, period_end, filed_on (60 days after a December, else 45) and the figures of ``pointintime``."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    gross, cost = F.col("l_extendedprice"), 0.9 * F.col("l_extendedprice")
    back = F.col("l_returnflag") == "R"
    end = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2))
    sums = {
        "revenue": net,
        "pat": net * (1 - F.col("l_tax")) - cost,
        "ebitda": net - cost,
        "cfo": F.when(back, 0.0).otherwise(net * (1 - F.col("l_tax")) - cost),
        "debt": F.when(back, net).otherwise(0.0),
        "gross": gross,
    }
    q = m.table("lineitem").join(_home(m), "l_suppkey").groupBy("symbol", end.alias("period_end")).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    shares = m.table("supplier").groupBy(F.col("s_nationkey").alias("symbol")).agg((F.count("*") * SHARES).alias("shares"))
    lag = F.when(F.month("period_end") == 12, 60).otherwise(45)

    def filed(df: DataFrame) -> DataFrame:
        return df.join(shares, "symbol").withColumns({"filed_on": F.date_add("period_end", lag), "eps": F.col("pat") / F.col("shares"), "opm": F.col("ebitda") / F.col("revenue") * 100})

    year = q.groupBy("symbol", F.last_day(F.add_months(F.date_trunc("year", "period_end"), 11)).alias("period_end")).agg(*[F.sum(k).alias(k) for k in sums], F.count("*").alias("_q")).where("_q = 4").drop("_q")
    year = filed(year).withColumns({"equity": 0.25 * F.col("gross"), "debtor_days": 365 * F.col("debt") / F.col("revenue"), "fcf": F.col("cfo") - 0.01 * F.col("revenue")})
    year = year.withColumns(
        {
            "roe": F.col("pat") / F.col("equity"),
            "roce": F.col("ebitda") / (F.col("equity") + F.col("debt")),
            "debt_equity": F.col("debt") / F.col("equity"),
            "interest_cover": F.col("ebitda") / F.nullif(0.1 * F.col("debt"), F.lit(0.0)),
        }
    )
    return year, filed(q)


def holdings(m: Market) -> DataFrame:
    """symbol, quarter_end, promoter_pct, fii_pct, dii_pct, has_promoter: shares of the quantity by segment."""
    orders = m.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    who = orders.join(m.table("customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    end = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2))
    lines = m.table("lineitem").join(_home(m), "l_suppkey").join(who, "l_orderkey")
    share = lambda s: (F.sum(F.when(F.col("c_mktsegment") == s, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity") * 100)
    h = lines.groupBy("symbol", end.alias("quarter_end")).agg(share("BUILDING").alias("promoter_pct"), share("AUTOMOBILE").alias("fii_pct"), share("MACHINERY").alias("dii_pct"))
    return h.withColumn("has_promoter", F.col("promoter_pct") >= 15)


def nations(m: Market) -> DataFrame:
    """symbol, sector, is_financial, shares."""
    shares = m.table("supplier").groupBy(F.col("s_nationkey").alias("symbol")).agg((F.count("*") * SHARES).alias("shares"))
    n = m.table("nation").join(m.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.col("n_nationkey").alias("symbol"), F.col("r_name").alias("sector"), (F.col("r_name") == "ASIA").alias("is_financial"))
    return n.join(shares, "symbol")


def snapshots(bars: DataFrame) -> DataFrame:
    """week_start, symbol: the members are who traded in the first week of a quarter."""
    first = F.date_trunc("quarter", F.date_add("date", 6)).cast("date")
    return bars.where((first > F.date_sub("date", 1)) & (first <= F.date_add("date", 6))).select(F.col("date").alias("week_start"), "symbol")


STATEMENTS = """shr AS (SELECT s_nationkey AS symbol, count(*) * 500 AS shares FROM supplier GROUP BY 1),
qs AS (SELECT q.*, shares, pat / shares AS eps, ebitda / revenue * 100 AS opm, period_end + CASE WHEN month(period_end) = 12 THEN 60 ELSE 45 END AS filed_on FROM (
  SELECT s_nationkey AS symbol, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * (1 - l_discount) * (1 - l_tax) - 0.9 * l_extendedprice) AS pat,
    sum(l_extendedprice * (1 - l_discount) - 0.9 * l_extendedprice) AS ebitda, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice * (1 - l_discount) * (1 - l_tax) - 0.9 * l_extendedprice END) AS cfo,
    sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS debt, sum(l_extendedprice) AS gross
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) q JOIN shr USING (symbol)),
ys AS (SELECT *, pat / equity AS roe, ebitda / (equity + debt) AS roce, debt / equity AS debt_equity, ebitda / nullif(0.1 * debt, 0) AS interest_cover FROM (
  SELECT y.*, pat / shares AS eps, period_end + 60 AS filed_on, 0.25 * gross AS equity, 365 * debt / revenue AS debtor_days, cfo - 0.01 * revenue AS fcf FROM (
    SELECT symbol, make_date(year(period_end), 12, 31) AS period_end, any_value(shares) AS shares, sum(revenue) AS revenue, sum(pat) AS pat, sum(ebitda) AS ebitda, sum(cfo) AS cfo, sum(debt) AS debt, sum(gross) AS gross FROM qs GROUP BY 1, 2 HAVING count(*) = 4) y)),
hs AS (SELECT *, promoter_pct >= 15 AS has_promoter FROM (SELECT s_nationkey AS symbol, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS quarter_end,
    sum(CASE WHEN c_mktsegment = 'BUILDING' THEN l_quantity ELSE 0 END) / sum(l_quantity) * 100 AS promoter_pct, sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN l_quantity ELSE 0 END) / sum(l_quantity) * 100 AS fii_pct, sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN l_quantity ELSE 0 END) / sum(l_quantity) * 100 AS dii_pct
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)),
nat AS (SELECT n_nationkey AS symbol, r_name AS sector, r_name = 'ASIA' AS is_financial, shares FROM nation JOIN region ON n_regionkey = r_regionkey JOIN shr ON shr.symbol = n_nationkey),
snap AS (SELECT date AS week_start, symbol FROM nbars WHERE date_trunc('quarter', date + 6) > date - 1 AND date_trunc('quarter', date + 6) <= date + 6)"""
