"""Market tables derived from the star schema.

Each view is a DataFrame here and, for the checks, SQL text with the same columns.
Symbols are suppliers, sectors regions; a bar is a supplier's day of trades in the
order of (order, line, part).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import steady_sum


def trade(part_bits: int):
    """A trade's place by (order, line, part) as one number, so that first and last of a group fit a hash aggregation.

    Orders have at most seven lines. 43 bits hold orders up to 10 ** 12; where two trades
    share order and line, the low bits of the part decide.
    """
    return (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")) * F.lit(1 << part_bits) + F.pmod(F.col("l_partkey").cast("long"), F.lit(1 << part_bits))


class Market:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def bars(self) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return (
            self.table("lineitem")
            .select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), price.alias("p"), F.col("l_quantity").alias("q"), trade(20).alias("k"))
            .groupBy("symbol", "date")
            .agg(
                F.min_by("p", "k").alias("open"),
                F.max("p").alias("high"),
                F.min("p").alias("low"),
                F.max_by("p", "k").alias("close"),
                F.sum("q").alias("volume"),
            )
        )

    def nation_bars(self) -> DataFrame:
        """Weekly bars of a nation's suppliers: they have real ranges."""
        when = F.weekday("l_shipdate").cast("long") * F.lit(1 << 60) + trade(17)  # days of a week from Monday on
        price = F.col("l_extendedprice") / F.col("l_quantity")
        home = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("symbol"))
        return (
            self.table("lineitem")
            .join(home, "l_suppkey")
            .select("symbol", F.date_trunc("week", "l_shipdate").cast("date").alias("date"), price.alias("p"), F.col("l_quantity").alias("q"), when.alias("k"))
            .groupBy("symbol", "date")
            .agg(
                F.min_by("p", "k").alias("open"),
                F.max("p").alias("high"),
                F.min("p").alias("low"),
                F.max_by("p", "k").alias("close"),
                F.sum("q").alias("volume"),
            )
        )

    def stocks(self) -> DataFrame:
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("symbol"),
                F.col("s_name").alias("name"),
                F.col("r_name").alias("sector"),
                F.col("n_name").alias("industry"),
                F.col("s_acctbal").alias("mcap"),
            )
        )

    def index_prices(self) -> DataFrame:
        """The mean close of a day over all symbols."""
        return self.bars().groupBy("date").agg(F.avg("close").alias("close"))

    def quarters(self, whole: bool = False) -> DataFrame:
        """A symbol's quarterly figures, filed 45 days after the quarter ends (60 for the last).

        With ``whole``, also the revenue rounded down as SQL's plain sum in the order of the table has it: that
        sum may fall to either side of a whole number that lies within its rounding error. Such quarters
        are few; only theirs are added again, trade by trade in the table's order.
        """
        net, keys, t = self._net(), ["symbol", "period_end"], self.table("lineitem")
        error = [(F.count(net) * F.sum(F.abs(net)) * F.lit(2.0**-52)).alias("_error")] if whole else []
        q = t.groupBy(*self._quarter()).agg(
            steady_sum(net).alias("revenue"),
            steady_sum(net * (1 - F.col("l_tax")) - 0.9 * F.col("l_extendedprice")).alias("pat"),
            *error,
        )
        lag = F.when(F.month("period_end") == 12, 60).otherwise(45)
        if whole:
            near = q.where(F.abs(F.col("revenue") - F.rint("revenue")) <= F.col("_error")).select(*keys)
            trade = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), net.alias("net"))
            trades = t.where(net.isNotNull()).select(*self._quarter(), trade.alias("trade")).join(F.broadcast(near), keys)
            plain = F.aggregate(F.array_sort(F.collect_list("trade")), F.lit(0.0), lambda s, x: s + x["net"])
            q = q.join(trades.groupBy(*keys).agg(plain.alias("_plain")), keys, "left")
            q = q.withColumn("whole", F.floor(F.coalesce("_plain", "revenue")).cast("long")).drop("_plain", "_error")
        return q.withColumn("filed_on", F.date_add("period_end", lag))

    @staticmethod
    def _net():
        return F.col("l_extendedprice") * (1 - F.col("l_discount"))

    @staticmethod
    def _quarter():
        return F.col("l_suppkey").alias("symbol"), F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2)).alias("period_end")


# The same views for the checks.
BARS = """bars AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
    first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
    sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""
NBARS = """nbars AS (
  SELECT s_nationkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
    sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
STOCKS = """stocks AS (
  SELECT s_suppkey AS symbol, s_name AS name, r_name AS sector, n_name AS industry, s_acctbal AS mcap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
INDEX = "idx AS (SELECT date, avg(close) AS close FROM bars GROUP BY date)"
QUARTERS = """quarters AS (
  SELECT *, period_end + CASE WHEN month(period_end) = 12 THEN 60 ELSE 45 END AS filed_on FROM (
    SELECT l_suppkey AS symbol, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS period_end,
      sum(l_extendedprice * (1 - l_discount)) AS revenue,
      sum(l_extendedprice * (1 - l_discount) * (1 - l_tax) - 0.9 * l_extendedprice) AS pat
    FROM lineitem GROUP BY 1, 2))"""
