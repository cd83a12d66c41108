"""Queries that write files out of the tables and read them back (sections A, B).

What a load must survive is written too: rows that break the rules, other series, stale pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import histories as hs, indicators as ind, setups as st
from ..plans.cut import cut, folder
from ..plans.statements import STATEMENTS, statements
from ..plans.views import Market
from ..sources import files as sf, layouts as ly, sinks
from .prices import OVER, _roll
from .registry import query
from .research import _PANEL, _TRADES, trades
from .setups import _MORE, _RATED

_TEXT = "string"


def _csv(df: DataFrame, path: str, by: str) -> None:
    """Files of their own for each value of ``by``, which is in their path only; a value of many rows has several."""
    df.hint("rebalance", by).write.partitionBy(by).option("header", True).option("emptyValue", "").csv(path)


_SPLIT = "1998-07-01"  # the layout changes


@query(
    f"""SELECT 'S' || symbol AS symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(CASE WHEN bad THEN high * 2 ELSE close END, 6) AS close, CAST(volume AS BIGINT) AS volume, CASE WHEN date < DATE '{_SPLIT}' THEN 'old' ELSE 'new' END AS layout, CASE WHEN bad THEN 'bad price row' END AS problem
    FROM (SELECT *, symbol % 10 = 6 AND day(date) = 15 AS bad FROM bars) WHERE symbol % 10 <> 3 AND NOT (date >= DATE '{_SPLIT}' AND symbol % 10 = 5)"""
)
def a13_a14_daily_files(m: Market) -> DataFrame:
    """Bars through daily files of both layouts: other series and instruments stay out, bad rows are told."""
    path = folder(m.spark, "daily")
    s = F.col("symbol")
    b = m.bars().withColumns({"file": F.concat(F.year("date"), F.lit("-"), F.quarter("date")), "close": F.when((s % 10 == 6) & (F.day("date") == 15), F.col("high") * 2).otherwise(F.col("close"))})
    series = F.when(s % 10 == 3, "GB").when(s % 10 == 4, "BE").otherwise("EQ")
    isin = F.concat(F.lit("INE"), F.lpad(s.cast(_TEXT), 9, "0"))
    values = {"symbol": F.concat(F.lit("s"), s, F.lit(" ")), "series": series, "isin": isin, "kind": F.when(s % 10 == 5, "OPT").otherwise("STK"), "open": F.col("open"), "high": F.col("high"), "low": F.col("low"), "close": F.col("close"), "prev_close": F.col("open"), "volume": F.col("volume")}
    new = b.where(F.col("date") >= _SPLIT).select("file", *[c.alias(sf.DAILY[k]) for k, c in (values | {"date": F.col("date")}).items()])
    old = b.where(F.col("date") < _SPLIT).select("file", *[c.alias(sf.DAILY_OLD[k]) for k, c in (values | {"date": F.date_format("date", "dd-MMM-yyyy")}).items() if k in sf.DAILY_OLD])
    _csv(new, f"{path}/new", "file")
    _csv(old, f"{path}/old", "file")
    got = ly.daily(m.spark, f"{path}/*/*")
    return got.select("symbol", "date", "open", "high", "low", "close", "volume", "layout", "problem")


@query("SELECT 'Benchmark' AS index_name, date, round(CAST(printf('%.2f', close) AS DOUBLE), 6) AS close, CASE WHEN day(date) % 2 = 0 THEN 0.34 END AS pe FROM idx", views="bars idx")
def a16_index_files(m: Market) -> DataFrame:
    """Index levels through archive files: thousands commas, '-' for missing, '.34', one name of two."""
    path = folder(m.spark, "index")
    level = F.format_number("close", 2)
    x = m.index_prices().select(
        F.year("date").alias("file"), F.explode(F.array(F.lit(" BENCHmark "), F.lit("Other"))).alias("Index Name"), F.date_format("date", "dd-MM-yyyy").alias("Index Date"),
        *[level.alias(sf.INDEX[c]) for c in ("open", "high", "low", "close")], F.when(F.day("date") % 2 == 0, ".34").otherwise("-").alias("P/E"),
    )
    _csv(x, path, "file")
    got = ly.index(m.spark, f"{path}/*", ("benchmark",))
    return got.select(F.initcap("index_name").alias("index_name"), "date", "close", "pe")


_STAMPS = ("19950701", "19960701", "19970701", "19980701", "19990701", "20000701", "20010101", "20010701")
_MEMBER = f"""st AS (SELECT unnest([{', '.join(repr(s) for s in _STAMPS)}]) AS stamp), mb AS (SELECT DISTINCT strptime(stamp, '%Y%m%d')::DATE AS week_start, symbol FROM st JOIN bars ON date > strptime(stamp, '%Y%m%d')::DATE - 30 AND date <= strptime(stamp, '%Y%m%d')::DATE)"""


def _member_files(m: Market) -> str:
    path = folder(m.spark, "members")
    stamps = F.array(*[F.lit(s) for s in _STAMPS])
    day = lambda s: F.to_date(s, "yyyyMMdd")
    near = F.filter(stamps, lambda s: (F.col("date") > F.date_sub(day(s), 30)) & (F.col("date") <= day(s)))
    x = m.bars().select("symbol", F.explode(near).alias("stamp")).distinct().join(m.stocks(), "symbol")
    s = F.col("symbol")
    x = x.select(
        F.concat("stamp", F.lit("093000")).alias("stamp"), F.when(s % 29 == 7, "").otherwise(F.concat(F.col("name"), F.lit(', "the" company'))).alias("Company Name"), F.col("sector").alias("Industry"), F.concat(F.lit("s"), s).alias("Symbol"),
        F.when(s % 10 == 1, "RR").otherwise("EQ").alias("Series"), F.when(s % 31 == 5, "US0000000000").otherwise(F.concat(F.lit("INE"), F.lpad(s.cast(_TEXT), 9, "0"))).alias("ISIN Code"),
    )
    x.repartition("stamp").write.partitionBy("stamp").option("header", True).option("escape", '"').csv(path)
    return path


@query("SELECT week_start, 'S' || symbol AS symbol, CASE WHEN symbol % 10 = 1 THEN 'reit' ELSE 'equity' END AS instrument_type, CASE WHEN symbol % 29 = 7 THEN 'no company name' WHEN symbol % 31 = 5 THEN 'bad ISIN' END AS problem FROM mb", more=_MEMBER)
def a17_a18_constituent_files(m: Market) -> DataFrame:
    """Members of eight archived lists, the date out of the file's stamp, with what is wrong in a row."""
    return ly.constituents(m.spark, f"{_member_files(m)}/*").select("week_start", "symbol", "instrument_type", "problem")


@query("SELECT week_start, count(*) FILTER (NOT odd) AS usable, count(*) FILTER (odd) AS skipped, 0 AS duplicates, count(*) FILTER (NOT odd) BETWEEN 50 AND 520 AND count(*) FILTER (odd) <= 5 AS ok FROM (SELECT *, symbol % 29 = 7 OR symbol % 31 = 5 AS odd FROM mb) GROUP BY week_start", more=_MEMBER)
def a17_constituent_checks(m: Market) -> DataFrame:
    found = ly.constituents(m.spark, f"{_member_files(m)}/*")
    return ly.constituent_checks(found, 50, 520).drop("file")


_PAGES = """pg AS (SELECT symbol, basis, period_end, revenue, pat FROM qs, (VALUES ('consolidated'), ('standalone')) b(basis) WHERE (basis = 'standalone' OR symbol % 3 <> 0) AND (basis = 'standalone' OR symbol % 5 <> 2 OR year(period_end) <= 1998)),
yr AS (SELECT symbol, basis, year(period_end) AS y, sum(revenue) AS revenue FROM pg GROUP BY ALL),
ch AS (SELECT symbol, min(basis) AS basis FROM (SELECT symbol, basis, max(y) AS newest FROM yr GROUP BY 1, 2) WHERE basis = 'standalone' OR date_diff('day', make_date(newest, 12, 31), DATE '2002-01-31') <= 550 GROUP BY symbol)"""


def statement_pages(m: Market) -> DataFrame:
    """symbol, basis, html: pages with yearly, quarterly and holders' tables; some consolidated ones are missing or end early."""
    _, q = statements(m)
    q = q.select("symbol", "period_end", "revenue", "pat").withColumn("basis", F.explode(F.array(F.lit("consolidated"), F.lit("standalone"))))
    alone = F.col("basis") == "standalone"
    q = q.where((alone | (F.col("symbol") % 3 != 0)) & (alone | (F.col("symbol") % 5 != 2) | (F.year("period_end") <= 1998)))

    def table(df: DataFrame, name: str, period, shown: dict) -> DataFrame:
        g = df.groupBy("symbol", "basis", period.alias("p")).agg(*[c.alias(k) for k, c in shown.items()])
        g = g.groupBy("symbol", "basis").agg(F.array_sort(F.collect_list(F.struct("p", *shown))).alias("a"))
        line = lambda label, cell: F.concat(F.lit(f"<tr><td>{label}&nbsp;+</td>"), F.array_join(F.transform("a", cell), ""), F.lit("</tr>\n"))
        head = F.concat(F.lit("<tr><th></th>"), F.array_join(F.transform("a", lambda x: F.concat(F.lit("<th>"), F.date_format(x["p"], "MMM yyyy"), F.lit("</th>"))), ""), F.lit("</tr>\n"))
        cell = lambda k: lambda x: F.concat(F.lit("<td class='n'>"), F.format_number(x[k], 2), F.lit("</td>"))
        body = [line(k, cell(k)) for k in shown]
        return g.select("symbol", "basis", F.concat(F.lit(f'<section id="{name}"><h2>x</h2><table class="t">\n'), head, *body, F.lit("</table></section>\n")).alias(name.replace("-", "_")))

    year = F.last_day(F.add_months(F.date_trunc("year", "period_end"), 11))
    sums = {"Sales": F.sum("revenue"), "Profit": F.sum("pat"), "OPM": F.sum("pat") / F.sum("revenue") * 100}
    end = F.col("period_end")
    pages = table(q, "profit-loss", year, sums).join(table(q, "quarters", end, sums), ["symbol", "basis"]).join(table(q, "shareholding", end, {"Promoters": F.lit(60.0), "Public": F.max(F.when(F.col("symbol") % 7 == 4, 75.0).otherwise(40.0))}), ["symbol", "basis"])
    return pages.select("symbol", "basis", F.concat(F.lit("<html><body>"), "profit_loss", "quarters", "shareholding", F.lit("</body></html>")).alias("html"))


@query(
    "SELECT p.symbol, c.basis, period_end, round(CAST(printf('%.2f', revenue) AS DOUBLE), 6) AS revenue, round(CAST(printf('%.2f', pat) AS DOUBLE), 6) AS pat, CASE WHEN symbol % 7 = 4 THEN 'holders do not sum to a whole' END AS problem FROM pg p JOIN ch c USING (symbol, basis)",
    views="",
    more=f"{STATEMENTS.replace('nbars', 'lineitem').split('snap AS')[0].strip().rstrip(',')}, {_PAGES}",
)
def a19_a20_a21_statement_pages(m: Market) -> DataFrame:
    """Quarters out of statement pages: tables to records, the live basis of a company, and what is wrong with its page."""
    pages = cut(statement_pages(m))
    keyed = pages.select(F.concat_ws("|", F.col("symbol").cast(_TEXT), "basis").alias("symbol"), "html")
    cells = cut(sf.statement_tables(keyed))
    rec = sf.statement_records(cells, {"Sales": "revenue", "Profit": "pat", "OPM": "opm", "Promoters": "promoter_pct", "Public": "public_pct"})
    rec = rec.withColumns({"basis": F.split_part("symbol", F.lit("|"), F.lit(2)), "symbol": F.split_part("symbol", F.lit("|"), F.lit(1)).cast("int"), "period_end": hs.period("period")[0]})
    of = lambda s: rec.where(F.col("section") == s)
    keys = ["symbol", "basis"]
    sizes = rec.groupBy(*keys).agg(F.count_if(F.col("section") == "profit-loss").alias("years"), F.count_if(F.col("section") == "quarters").alias("quarters"), F.max(F.when(F.col("section") == "profit-loss", F.col("period_end"))).alias("newest"))
    live = ly.live_basis(sizes, F.lit("2002-01-31").cast("date"))
    problems = ly.sane(of("profit-loss"), of("quarters"), of("shareholding").select(*keys, (F.col("promoter_pct") + F.col("public_pct")).alias("total")), keys)
    return of("quarters").join(live, keys).join(problems, keys).select("symbol", "basis", "period_end", "revenue", "pat", "problem")


@query("SELECT 'S' || symbol AS symbol, date, round(open, 6) AS open, round(close, 6) AS close, CAST(volume AS BIGINT) AS volume, round(CASE WHEN symbol % 4 = 0 THEN close ELSE close / 2 END, 6) AS adj_close FROM bars WHERE NOT (symbol % 3 = 0 AND day(date) = 9)")
def a22_chart_files(m: Market) -> DataFrame:
    """Bars through chart documents of parallel arrays; sessions without a close drop out."""
    path = folder(m.spark, "chart")
    s = F.col("symbol")
    b = m.bars().withColumns({"t": F.unix_timestamp(F.col("date").cast("timestamp")), "close": F.when(~((s % 3 == 0) & (F.day("date") == 9)), F.col("close"))})
    a = b.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("t", "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"), (F.col("close") / 2).alias("adj")))).alias("a"))
    of = lambda c: F.transform("a", lambda x: x[c]).alias(c)
    quote = F.array(F.struct(*[of(c) for c in ("open", "high", "low", "close", "volume")])).alias("quote")
    adj = F.when(s % 4 != 0, F.array(F.struct(F.transform("a", lambda x: x["adj"]).alias("adjclose")))).alias("adjclose")
    result = F.struct(F.struct(F.concat(F.lit("S"), s).alias("symbol")).alias("meta"), F.transform("a", lambda x: x["t"]).alias("timestamp"), F.struct(quote, adj).alias("indicators"))
    doc = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    a.select(doc.alias("value")).write.text(path)  # a document a line: a file a symbol would be as many files as symbols
    return sf.chart_bars(m.spark.read.text(path)).select("symbol", "date", "open", "close", "volume", "adj_close")


@query("SELECT 'N' || (symbol - symbol % 10) AS name, CAST(date AS VARCHAR) AS as_of, round(CAST(printf('%.2f', close) AS DOUBLE), 6) AS last, CASE WHEN symbol % 20 = 0 THEN NULL ELSE 0.5 END::DOUBLE AS pct_change FROM nbars WHERE symbol % 10 = 0", views="nbars")
def a23_live_index_files(m: Market) -> DataFrame:
    """Live index documents, one a session: names kept whatever their case, text to numbers."""
    path = folder(m.spark, "live")
    b = m.nation_bars()
    row = F.struct(F.concat(F.lit("n"), F.col("symbol")).alias("index"), F.format_number("close", 2).alias("last"), F.when(F.col("symbol") % 20 == 0, "-").otherwise("0.5").alias("percentChange"))
    d = b.groupBy("date").agg(F.collect_list(row).alias("data")).select("date", F.to_json(F.struct(F.col("date").cast(_TEXT).alias("timestamp"), "data")).alias("value"))
    d.withColumn("y", F.year("date")).repartition("y").select("date", "value").write.partitionBy("date").text(path)
    got = ly.live_index(m.spark, path, tuple(f"N{i}" for i in range(0, 30, 10)))
    return got.select(F.upper("name").alias("name"), "as_of", "last", "pct_change")


@query("SELECT symbol, date, round(close, 6) AS close, CAST(volume AS BIGINT) AS volume FROM bars WHERE symbol IN (SELECT symbol FROM stocks)", views="bars stocks")
def a25_backup_files(m: Market) -> DataFrame:
    """A gzipped backup restored: rows of unknown symbols stay out, real volumes become whole."""
    path = folder(m.spark, "backup")
    b = m.bars().select("symbol", "date", "close", "volume")
    stray = b.withColumn("symbol", F.col("symbol") + 10_000_000)
    b.unionByName(stray).write.option("compression", "gzip").json(path)
    got = sf.backup(m.spark, path, "symbol long, date date, close double, volume double", m.stocks(), lines=True)
    return got.select("symbol", "date", "close", F.col("volume").cast("long").alias("volume"))


# --- sinks ---------------------------------------------------------------------
@query("SELECT symbol, date, round(close, 6) AS close, CAST(rank() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS INTEGER) AS place FROM nbars", views="nbars")
def b08_score_archive(m: Market) -> DataFrame:
    """A gzipped file a session with that session's ranking, read back whole."""
    path = folder(m.spark, "archive")
    place = F.row_number().over(ind.Window.partitionBy("date").orderBy(F.desc("close"), "symbol"))
    sinks.publish(m.nation_bars().select("symbol", "date", "close", place.alias("place")), path, "night", "json", "date", "gzip")
    return m.spark.read.schema("symbol int, date date, close double, place int").json(sinks.current(m.spark, path)).select("symbol", "date", "close", "place")


@query(f"SELECT CAST(row_number() OVER (ORDER BY mom DESC NULLS LAST, symbol) AS INTEGER) AS place, symbol, round(mom, 6) AS blended FROM (SELECT symbol, CASE WHEN symbol % 13 <> 0 THEN lag(close, 21) {OVER} / nullif(lag(close, 252) {OVER}, 0) - 1 END AS mom, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k = 1")
def b09_screener_snapshot(m: Market) -> DataFrame:
    """The screener's rows in falling order, unknown last, out of files that follow each other."""
    path = folder(m.spark, "screener")
    from .cross import cross_section

    sinks.publish_ranked(cross_section(m).select("symbol", F.col("mom").alias("blended")), path, "night", "blended", "symbol")
    got = sinks.ranked(m.spark, path, "symbol long, blended double")
    # Places go on from file to file: a row a file is enough to know how many lie before.
    before = got.groupBy("file").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ind.Window.orderBy("file").rowsBetween(ind.Window.unboundedPreceding, -1)), F.lit(0)))
    return got.join(F.broadcast(before), "file").select((F.col("before") + F.col("place") + 1).cast("int").alias("place"), "symbol", "blended")


DETAIL_BARS = 250
_DOCUMENT = "key int, t array<string>, c array<double>, v array<double>, sma50 array<double>, sma200 array<double>, zones array<struct<kind: string, source: string, zone: int, floor: double, ceil: double, strength: double>>, annual array<struct<period: string, revenue: double, eps: double>>"
_W = "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, " + f"{_roll('avg', 'close', 50)} AS sma50, {_roll('avg', 'close', 200)} AS sma200 FROM nbars)"
_ITEMS = f"""it AS (SELECT symbol, part, CAST(i - min(i) OVER (PARTITION BY symbol) AS INTEGER) AS place, label, value FROM (SELECT symbol, i, strftime(date, '%Y-%m-%d') AS label, unnest([{{'part': 'c', 'value': close}}, {{'part': 'v', 'value': volume}}, {{'part': 'sma50', 'value': sma50}}, {{'part': 'sma200', 'value': sma200}}], recursive := true) FROM {_W} WHERE back <= {DETAIL_BARS})
  UNION ALL SELECT symbol, part, CAST(row_number() OVER (PARTITION BY symbol, part ORDER BY kind, source, zone) - 1 AS INTEGER), kind || ':' || source || ':' || zone, value FROM (SELECT symbol, kind, source, CAST(zone AS INTEGER) AS zone, unnest([{{'part': 'floor', 'value': floor}}, {{'part': 'strength', 'value': strength}}], recursive := true) FROM rated WHERE live)
  UNION ALL SELECT symbol, part, CAST(row_number() OVER (PARTITION BY symbol, part ORDER BY label) - 1 AS INTEGER), label, value FROM (SELECT symbol, strftime(period_end, '%Y-%m-%d') AS label, unnest([{{'part': 'revenue', 'value': revenue}}, {{'part': 'eps', 'value': eps}}], recursive := true) FROM ys))"""


def _field(array: str, name: str):
    return F.transform(array, lambda r: r[name])


def detail_documents(m: Market) -> DataFrame:
    """symbol and its document: the last bars with averages of the whole history, live zones, yearly figures."""
    bars = cut(m.nation_bars(), "symbol")
    b = bars.withColumns({"sma50": ind.sma("close", 50), "sma200": ind.sma("close", 200), "_back": F.row_number().over(ind.Window.partitionBy("symbol").orderBy(F.desc("date")))})
    rows = b.where(F.col("_back") <= DETAIL_BARS).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.date_format("date", "yyyy-MM-dd").alias("t"), F.col("close").alias("c"), F.col("volume").alias("v"), "sma50", "sma200"))).alias("b"))
    x = rows.select("symbol", *[_field("b", c).alias(c) for c in ("t", "c", "v", "sma50", "sma200")])
    z = st.build(bars, "daily").where("live").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("kind", "source", "zone", "floor", "ceil", "strength"))).alias("zones"))
    year, _ = statements(m)
    a = year.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.date_format("period_end", "yyyy-MM-dd").alias("period"), "revenue", "eps"))).alias("annual"))
    return x.join(z, "symbol", "left").join(a, "symbol", "left")


@query("SELECT symbol, part, place, label, round(value, 6) AS value FROM it", views="nbars", more=f"{_MORE}, {_RATED}, {STATEMENTS}, {_ITEMS}", recursive=True)
def b10_detail_documents(m: Market) -> DataFrame:
    """One nested document a symbol, each in a file of its own, read back item by item."""
    path = folder(m.spark, "detail")
    sinks.publish_documents(detail_documents(m), "symbol", path, "night", digits=None)
    d = sinks.documents(m.spark, path, _DOCUMENT)
    def item(part: str, i, label, value):
        return F.struct(F.lit(part).alias("part"), i.alias("place"), label.alias("label"), value.alias("value"))

    line = lambda c: F.transform(c, lambda v, i: item(c, i, F.get("t", i), v))
    zone = lambda c: F.transform("zones", lambda z, i: item(c, i, F.concat_ws(":", z["kind"], z["source"], z["zone"].cast(_TEXT)), z[c]))
    year = lambda c: F.transform("annual", lambda a, i: item(c, i, a["period"], a[c]))
    items = [*map(line, ("c", "v", "sma50", "sma200")), *map(zone, ("floor", "strength")), *map(year, ("revenue", "eps"))]
    x = d.select(F.col("key").alias("symbol"), F.explode(F.flatten(F.array_compact(F.array(*items)))).alias("x"))
    return x.select("symbol", "x.part", "x.place", "x.label", "x.value")


@query("SELECT as_of, symbol, sector, round(net_return, 6) AS net_return FROM trades", views="bars stocks", more=f"{_PANEL}, {_TRADES}")
def b12_backtest_files(m: Market) -> DataFrame:
    """The trades of a backtest as CSV, read back."""
    path = folder(m.spark, "backtest")
    sinks.publish(trades(m).select("as_of", "symbol", "sector", "net_return"), path, "test", "csv")
    return m.spark.read.option("header", True).schema("as_of date, symbol long, sector string, net_return double").csv(sinks.current(m.spark, path))
