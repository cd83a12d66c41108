"""Positions marked to market, what a book holds and may still take, and what to buy next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.num import safe_div

# Limits of a position, a sector and the whole book as shares of capital.
POSITION_CAP, SECTOR_CAP, BOOK_RISK, LISTED = 0.10, 0.25, 0.06, 12
CROWDED_RISK, NEAR_STOP = 0.02, 0.03


def marked(held: DataFrame, prices: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Open positions (symbol, price, qty, stop) at the newest ``close``: value, profit, return, R, and what the stop still risks.

    Without a close nothing can be marked; a stop at or above the entry gives no R. ``failed``
    (symbol, names) has the gates a symbol fails; ``intact`` is unknown for a symbol it lacks.
    """
    x = held.join(prices.select("symbol", "close"), "symbol", "left")
    p, q, s, c = (F.col(n) for n in ("price", "qty", "stop", "close"))
    x = x.withColumns(
        {
            "invested": p * q,
            "value": c * q,
            "pnl": (c - p) * q,
            "ret": safe_div("close", "price") - 1,
            "r_multiple": (c - p) / F.when(p > s, p - s),
            "stop_distance": safe_div("close", "stop") - 1,
            "risk_left": (c - s) * q,
        }
    )
    if failed is None:
        return x.withColumn("intact", F.lit(None).cast("boolean"))
    return x.join(failed.select("symbol", "names"), "symbol", "left").withColumn("intact", F.size("names") == 0).drop("names")


def totals(m: DataFrame, *keys: str) -> DataFrame:
    """Count, invested, value, profit, return, risk left and broken cases of each book."""
    out = m.groupBy(*keys).agg(
        F.count("*").alias("positions"), F.sum("invested").alias("invested"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"),
        F.coalesce(F.sum("risk_left"), F.lit(0.0)).alias("risk_left"), F.coalesce(F.count_if(~F.col("intact")), F.lit(0)).alias("broken"),
    )
    return out.withColumns({"pnl": F.col("value") - F.col("invested"), "ret": safe_div("value", "invested") - 1})


def capacity(total: DataFrame, capital: DataFrame, *keys: str) -> DataFrame:
    """What a book has deployed and risked of its capital, and how many units of risk it may still take.

    ``capital`` has the keys, capital and risk_pct. The whole book risks 6 % at most, a unit
    risk_pct; risk already past its stop counts as none.
    """
    x = total.join(capital, list(keys))
    c, risk = F.col("capital"), F.greatest(F.col("risk_left"), F.lit(0.0))
    free = F.floor((c * BOOK_RISK - risk) / (c * F.col("risk_pct")))
    return x.select(*keys, "capital", (c * F.col("risk_pct")).alias("unit"), F.col("value").alias("deployed"), (c - F.col("value")).alias("free"), (F.col("value") / c).alias("deployed_pct"), risk.alias("risked"), (risk / c).alias("risked_pct"), F.greatest(free, F.lit(0)).cast("long").alias("units_free"))


def shortlist(candidates: DataFrame, held: DataFrame, capital: DataFrame, book: str = "book", listed: int = LISTED) -> DataFrame:
    """The first ``listed`` candidates of each book in rank order that can be acted on, sized.

    ``candidates`` is the buy list, a few names (symbol, rank, conviction, close, stop, failed): it is sent
    to every task. Out go names the book holds, without conviction or with a failed gate,
    and those whose stop is not below the price or of which one share is too much.
    """
    few = candidates.where("conviction is not null and not coalesce(failed, false) and stop > 0 and close > stop")
    x = capital.crossJoin(F.broadcast(few)).join(held.select(book, "symbol").distinct(), [book, "symbol"], "left_anti")
    by_risk = F.floor(F.col("capital") * F.col("risk_pct") / (F.col("close") - F.col("stop")))
    by_cap = F.floor(F.col("capital") * POSITION_CAP / F.col("close"))
    x = x.withColumns({"shares": F.least(by_risk, by_cap), "capped": by_cap < by_risk}).where("shares >= 1")
    x = x.withColumns({"cost": F.col("shares") * F.col("close"), "risk": F.col("shares") * (F.col("close") - F.col("stop"))})
    place = F.row_number().over(Window.partitionBy(book).orderBy("rank", "symbol"))
    return x.withColumn("place", place).where(F.col("place") <= listed).select(book, "place", "symbol", "rank", "shares", "cost", "risk", "capped")


def insights(m: DataFrame, capital: DataFrame, book: str = "book") -> DataFrame:
    """book, symbol, id and a text for each thing worth saying about a marked position."""
    x = m.join(capital.select(book, "capital"), book)
    pct = text.share
    share = F.col("value") / F.col("capital")
    found: dict[str, tuple[Column, Column]] = {
        "no price": (F.col("close").isNull(), F.lit("no price to mark it at")),
        "stopped": (F.col("close") <= F.col("stop"), F.lit("the close is at or under the stop")),
        "near": ((F.col("close") > F.col("stop")) & (F.col("stop_distance") < NEAR_STOP), F.concat(F.lit("the stop is "), pct(F.col("stop_distance")), F.lit(" away"))),
        "large": (share > POSITION_CAP, F.concat(F.lit("it is "), pct(share), F.lit(" of the capital"))),
        "risk": (F.col("risk_left") / F.col("capital") > CROWDED_RISK, F.concat(F.lit("it still risks "), pct(F.col("risk_left") / F.col("capital")), F.lit(" of the capital"))),
        "broken": (~F.col("intact"), F.lit("it fails a gate")),
    }
    texts = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in found.values()]))
    return x.select(book, "symbol", "id", F.explode(texts).alias("insight"))
