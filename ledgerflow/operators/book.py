"""A book of positions as the fold of its commands, refused ones kept with their reason.

The positions of a book in one symbol depend only on the commands on them, in their order,
so each (book, symbol) is folded by itself inside the JVM; capital is folded by book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RISK, SAME = 0.01, 1e-9  # of capital a position; stops closer than this are one
_POSITION = "struct<id: bigint, day: date, price: double, qty: double, stop: double, target: double, exit_id: bigint, exit_day: date, exit_price: double>"
_LOG = "array<struct<seq: bigint, kind: string, accepted: boolean, reason: string>>"
_STATE = f"struct<open: array<{_POSITION}>, closed: array<{_POSITION}>, log: {_LOG}>"
_COMMAND = ("seq", "kind", "day", "price", "qty", "stop", "target", "force")


def stop_moves(now: Column, new: Column, force: Column) -> Column:
    """Whether a stop may change: one that is given and another one, and upwards unless forced; any if there was none."""
    up = (F.abs(new - now) >= SAME) & ((new >= now) | F.coalesce(force, F.lit(False)))
    return F.coalesce(F.when(now.isNull(), new.isNotNull()).otherwise(up), F.lit(False))


def refusal(c: Column, open_: Column) -> Column:
    """Why a command is refused, NULL if it is not."""
    kind, none = c["kind"], F.size(open_) == 0
    moves = F.exists(open_, lambda p: stop_moves(p["stop"], c["stop"], c["force"]))
    same = F.forall(open_, lambda p: F.abs(p["stop"] - c["stop"]) < SAME)
    opening = F.when(c["qty"].isNull() | c["price"].isNull(), "quantity and price are required").when(c["stop"].isNull(), "a stop is required").when(c["stop"] >= c["price"], "the stop must sit below the entry")
    there = F.when(none, "no open position")
    return (
        F.when(kind == "open", opening)
        .when(kind == "close", there.when(c["price"].isNull(), "a price is required"))
        .when(kind == "move_stop", there.when(c["stop"].isNull(), "no stop is given").when(~moves, F.when(F.coalesce(same, F.lit(False)), "already there").otherwise("would lower the stop")))
        .when(kind == "edit", there.when(F.coalesce(c["price"], c["qty"]).isNull() & c["day"].isNull(), "nothing to change"))
        .otherwise("unknown command")
    )


def _with(p: Column, **new: Column) -> Column:
    names = ("id", "day", "price", "qty", "stop", "target", "exit_id", "exit_day", "exit_price")
    return F.struct(*[new.get(n, p[n]).alias(n) for n in names]).cast(_POSITION)


def _step(s: Column, c: Column) -> Column:
    why = refusal(c, s["open"])
    ok = why.isNull()
    is_ = lambda k: ok & (c["kind"] == k)
    null = F.lit(None)
    fresh = F.struct(c["seq"].alias("id"), c["day"].alias("day"), c["price"].alias("price"), c["qty"].alias("qty"), c["stop"].alias("stop"), c["target"].alias("target"), null.alias("exit_id"), null.alias("exit_day"), null.alias("exit_price")).cast(_POSITION)
    last = F.try_element_at(s["open"], F.lit(-1))
    gone = _with(last, exit_id=c["seq"], exit_day=c["day"], exit_price=c["price"])
    moved = F.transform(s["open"], lambda p: _with(p, stop=F.when(stop_moves(p["stop"], c["stop"], c["force"]), c["stop"]).otherwise(p["stop"])))
    edited = F.transform(s["open"], lambda p: _with(p, price=F.coalesce(c["price"], p["price"]), qty=F.coalesce(c["qty"], p["qty"]), day=F.coalesce(c["day"], p["day"])))
    open_ = (
        F.when(is_("open"), F.concat(s["open"], F.array(fresh)))
        .when(is_("close"), F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0))))
        .when(is_("move_stop"), moved)
        .when(is_("edit"), edited)
        .otherwise(s["open"])
    )
    closed = F.when(is_("close"), F.concat(s["closed"], F.array(gone))).otherwise(s["closed"])
    log = F.struct(c["seq"].alias("seq"), c["kind"].alias("kind"), ok.alias("accepted"), why.alias("reason"))
    return F.struct(open_.alias("open"), closed.alias("closed"), F.concat(s["log"], F.array(log)).alias("log")).cast(_STATE)


def fold(commands: DataFrame) -> DataFrame:
    """book, symbol, open, closed, log after all commands.

    ``commands`` has book, symbol, seq (their order), kind (open, close, move_stop, edit), day, price, qty,
    stop, target and force. An open needs a quantity, a price and a stop below it. A close ends the
    position opened last. A stop moves up or not at all, unless forced; an edit corrects day, price and
    quantity of what is open, and never its stop.
    """
    c = F.struct(*_COMMAND)
    listed = commands.groupBy("book", "symbol").agg(F.array_sort(F.collect_list(c)).alias("c"))
    start = F.struct(F.array().alias("open"), F.array().alias("closed"), F.array().alias("log")).cast(_STATE)
    return listed.select("book", "symbol", F.aggregate("c", start, _step).alias("s")).select("book", "symbol", "s.*")


def positions(folded: DataFrame) -> DataFrame:
    """A row a position, open and closed, with profit of the closed ones."""
    p = folded.select("book", "symbol", F.explode(F.concat("closed", "open")).alias("p")).select("book", "symbol", "p.*")
    return p.withColumn("profit", (F.col("exit_price") - F.col("price")) * F.col("qty"))


def log(folded: DataFrame) -> DataFrame:
    return folded.select("book", "symbol", F.explode("log").alias("l")).select("book", "symbol", "l.*")


def capital(commands: DataFrame) -> DataFrame:
    """book, capital, risk_pct: the last amount above 0 whose risk is a fraction; a risk that is not given stays (1 % at first).

    ``commands`` has book, seq, amount, risk_pct. A book whose every command is refused has no row.
    """
    listed = commands.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("seq", "amount", "risk_pct"))).alias("c"))
    kind = "struct<capital: double, risk_pct: double>"

    def step(s: Column, c: Column) -> Column:
        risk = F.coalesce(c["risk_pct"], s["risk_pct"], F.lit(DEFAULT_RISK))
        ok = F.coalesce((c["amount"] > 0) & (risk > 0) & (risk < 1), F.lit(False))
        return F.when(ok, F.struct(c["amount"].alias("capital"), risk.alias("risk_pct")).cast(kind)).otherwise(s)

    start = F.struct(F.lit(None).alias("capital"), F.lit(None).alias("risk_pct")).cast(kind)
    return listed.select("book", F.aggregate("c", start, step).alias("s")).select("book", "s.*").where("capital is not null")


def at_a_glance(held: DataFrame, scores: DataFrame, prices: DataFrame, setups: DataFrame) -> DataFrame:
    """Open positions with their symbol's newest score, price and setup, each left null where there is none.

    The other three have symbol and date; only their newest row of a symbol counts.
    """
    out = held
    for df in (scores, prices, setups):
        rest = [c for c in df.columns if c not in ("symbol", "date")]
        newest = df.groupBy("symbol").agg(*[F.max_by(c, "date").alias(c) for c in rest])
        out = out.join(newest, "symbol", "left")
    return out
