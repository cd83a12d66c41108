"""Folders of text files whose layout is in each file's own header.

Lines come from Spark's text source, so any store that Spark reads will do and a folder
may mix layouts. They are read by the names in their file's header; what is wrong
with a row, or with a whole file, is a column and not an exception, and ``files.demand``
turns it into one where a load must stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import CONSTITUENTS, DAILY, DAILY_OLD, INDEX, INDEX_EXTRA, ISIN, SERIES, number

STALE_DAYS = 550  # a page of older years is no live basis
IMPLAUSIBLE_MARGIN, HOLDERS = 1000.0, (90.0, 110.0)
# Fields of the live index feed (target: source).
LIVE = {"last": "last", "change": "variation", "pct_change": "percentChange", "open": "open", "high": "high", "low": "low", "prev_close": "previousClose", "year_high": "yearHigh", "year_low": "yearLow"}


_CUT = "\ufdd0"  # stands between the fields of a quoted line; no character of any text


def _fields(line: Column) -> Column:
    """The fields of one line of CSV, cut at commas outside quotes, quotes undone; blanks around them may remain."""
    x = F.regexp_replace(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', _CUT)
    x = F.trim(F.regexp_replace(x, f" *{_CUT} *", _CUT))
    x = F.replace(F.regexp_replace(x, f'(?<![^{_CUT}])"|"(?![^{_CUT}])', ""), F.lit('""'), F.lit('"'))
    return F.when(F.contains(line, F.lit('"')), F.split(x, _CUT, -1)).otherwise(F.split(line, ",", -1))


def _cells(line: Column) -> Column:
    """The fields without blanks around them, empty ones missing."""
    return F.transform(_fields(line), lambda x: F.nullif(F.trim(x), F.lit("")))


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns in a step of its own: what reads them does not work them out again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _lines(spark: SparkSession, path: str, **about: Column) -> DataFrame:
    """file, header, row (its number, from 1), line (both null for a file without rows), and ``about`` out of header.

    Lines are read a part of a file at a time, so a file may be of any size. A part's first line
    and count give each file's header and how many lines lie before a part: a row a part. What
    ``about`` says of a header is worked out there, once a part.
    """
    value = F.col("value")
    value = F.when(F.startswith(value, F.lit("\ufeff")), F.substring(value, 2, 2**31 - 1)).otherwise(value)
    value = F.when(F.endswith(value, F.lit("\r")), F.rtrim(value, F.lit("\r"))).otherwise(value)
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), value.alias("line"))
    lines = text.where(F.trim("line") != "").withColumn("n", F.monotonically_increasing_id())
    parts = lines.groupBy("file", "part").agg(F.count("*").alias("size"), F.min("n").alias("first")).where("first is not null")
    w = Window.partitionBy("file").orderBy("part")
    parts = parts.select("file", "part", "size", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "first")
    tops = lines.select("n", "line").join(F.broadcast(parts.where("before = 0").select("file", F.col("first").alias("n"))), "n").select("file", _cells(F.col("line")).alias("header"))
    parts = parts.join(F.broadcast(tops), "file").select("file", "part", "size", (F.col("before") - F.col("first")).alias("shift"), "header").withColumns(about)
    body = lines.join(F.broadcast(parts.drop("size")), ["file", "part"]).select("file", "header", (F.col("n") + F.col("shift")).cast("int").alias("row"), "line", *about).where("row >= 1")
    sizes = parts.groupBy("file").agg(F.first("header").alias("header"), F.sum("size").alias("size"))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    none = F.array().cast("array<string>")
    bare = files.join(sizes, "file", "left").where(F.coalesce("size", F.lit(0)) <= 1).select("file", F.coalesce("header", none).alias("header"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("string").alias("line"))
    return body.unionByName(bare.withColumns(about))


def rows(spark: SparkSession, path: str) -> DataFrame:
    """file, header, row (its number, from 1; null for a file without rows), cells."""
    return _step(_lines(spark, path), cells=_cells(F.col("line"))).drop("line")


def cell(name: str) -> Column:
    """The field under a header name; null if the file has no such column."""
    at = F.array_position("header", name)
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def _lacks(names) -> Column:
    return F.array_except(F.array(*[F.lit(n) for n in sorted(set(names))]), "header")


def daily(spark: SparkSession, path: str, series: tuple[str, ...] = SERIES) -> DataFrame:
    """file, layout (new, old or unknown), problem and the bar, from a folder of daily price files of either layout.

    Other series and instruments are left out. A file that is of neither layout is one row
    with its problem; so is a row without a date, an open or a close within its range.
    """
    old = (F.size(_lacks(DAILY_OLD.values())) == 0) & ~F.array_contains("header", DAILY["symbol"])
    new = F.size(_lacks(DAILY.values())) == 0
    layout = F.when(old, "old").when(new, "new").otherwise("unknown")
    at = lambda name: F.array_position("header", name).cast("int") - 1
    places = {f"_{c}": F.when(old, at(DAILY_OLD[c]) if c in DAILY_OLD else F.lit(-1)).otherwise(at(DAILY[c])) for c in DAILY}
    raw = _step(_lines(spark, path, layout=layout, _lack=F.array_join(_lacks(DAILY.values()), ", "), **places), _fields=_fields(F.col("line")))
    of = lambda c: F.trim(F.get("_fields", F.col(f"_{c}")))
    known = F.col("layout") != "unknown"
    priced = of("series").isin(*series) & ((F.col("layout") == "old") | (of("kind") == "STK"))
    raw = raw.where(F.when(known, F.coalesce(priced, F.lit(False))).otherwise(F.coalesce("row", F.lit(1)) == 1))
    date = F.when(F.col("layout") == "old", any_date_of(of("date"), "dd-MMM-yyyy")).otherwise(of("date").try_cast("date"))
    prices = ("open", "high", "low", "close", "prev_close")
    out = raw.select(
        "file", "layout", "_lack", F.nullif(F.upper(of("symbol")), F.lit("")).alias("symbol"), date.alias("date"), *[number(of(c)).alias(c) for c in prices],
        F.coalesce(number(of("volume")), F.lit(0.0)).cast("long").alias("volume"), F.nullif(of("isin"), F.lit("")).alias("isin"),
    )
    whole = F.col("date").isNotNull() & F.col("open").isNotNull() & F.col("close").between(F.col("low"), F.col("high"))
    problem = F.when(~known, F.concat(F.lit("columns are missing: "), "_lack")).when(~F.coalesce(whole, F.lit(False)), "bad price row")
    return out.withColumn("problem", problem).drop("_lack")


def daily_checks(bars: DataFrame, least: int) -> DataFrame:
    """A row a file: bars, problems, whether there are enough and whether all have one date."""
    good = F.col("problem").isNull()
    a = bars.groupBy("file", "layout").agg(F.count_if(good).alias("bars"), F.count_if(~good).alias("problems"), (F.min("date") == F.max("date")).alias("one_day"))
    return a.withColumn("ok", (F.col("bars") >= least) & (F.col("problems") == 0) & F.coalesce("one_day", F.lit(False)))


def index(spark: SparkSession, path: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """file, problem and the index levels of a folder of archive files; names are kept whatever their case."""
    raw = rows(spark, path)
    lack = _lacks(INDEX.values())
    columns = INDEX | INDEX_EXTRA
    out = raw.select(
        "file", F.when(F.size(lack) > 0, F.concat(F.lit("columns are missing: "), F.array_join(lack, ", "))).alias("problem"), cell(INDEX["index_name"]).alias("index_name"),
        any_date_of(cell(INDEX["date"]), "dd-MM-yyyy", "dd MMM yyyy", "yyyy-MM-dd").alias("date"), *[number(cell(v)).alias(k) for k, v in columns.items() if k not in ("index_name", "date")],
    )
    named = F.col("close").isNotNull() & (F.coalesce("index_name", F.lit("")) != "")
    if keep:
        named = named & F.upper("index_name").isin(*[k.upper() for k in keep])
    return out.where(F.col("problem").isNotNull() | named)


def any_date_of(text: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def constituents(spark: SparkSession, path: str) -> DataFrame:
    """file, week_start (the 14-digit stamp in the file's path), the member and what is wrong with its row or file."""
    raw = rows(spark, path)
    same = F.concat_ws("|", "header") == "|".join(CONSTITUENTS)
    t = lambda c: F.coalesce(cell(c), F.lit(""))
    out = raw.select(
        "file", F.to_date(F.substring(F.regexp_extract("file", r"^.*(?<!\d)(\d{14})", 1), 1, 8), "yyyyMMdd").alias("week_start"), same.alias("_same"), F.upper(t("Symbol")).alias("symbol"),
        t("Company Name").alias("company_name"), t("Industry").alias("sector"), F.upper(t("ISIN Code")).alias("isin"), F.when(F.upper(t("Series")) == "RR", "reit").otherwise("equity").alias("instrument_type"),
    )
    problem = F.when(~F.col("_same"), "header changed").when(F.col("symbol") == "", "missing symbol").when(F.col("company_name") == "", "no company name").when(F.col("sector") == "", "no industry").when(~F.col("isin").rlike(ISIN), "bad ISIN")
    return out.withColumn("problem", problem).drop("_same")


def constituent_checks(found: DataFrame, low: int = 450, high: int = 520, skipped: int = 5) -> DataFrame:
    """A row a file: usable and skipped rows, repeated symbols, and whether it may be loaded."""
    good = F.col("problem").isNull()
    a = found.groupBy("file", "week_start").agg(
        F.count_if(good).alias("usable"), F.count_if(~good).alias("skipped"), (F.count(F.when(good, F.col("symbol"))) - F.count_distinct(F.when(good, F.col("symbol")))).alias("duplicates"), F.bool_or(F.coalesce(F.col("problem") == "header changed", F.lit(False))).alias("_other")
    )
    return a.withColumn("ok", F.col("usable").between(low, high) & (F.col("skipped") <= skipped) & (F.col("duplicates") == 0) & ~F.col("_other")).drop("_other")


def live_index(spark: SparkSession, path: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """name, as_of and numbers of the live index feed, a JSON document a file; names are kept whatever their case.

    '-', blanks and what is no number are missing. A document without data is one row with its problem.
    """
    fields = ", ".join(f"{v}: string" for v in ("index", *LIVE.values()))
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<timestamp: string, data: array<struct<{fields}>>>").alias("j"))
    j = j.select(F.col("j.timestamp").alias("as_of"), F.explode_outer("j.data").alias("r"))
    out = j.select(F.trim("r.index").alias("name"), "as_of", *[number(F.col(f"r.{v}")).alias(k) for k, v in LIVE.items()], F.when(F.col("r").isNull(), "no data").alias("problem"))
    return out.where(F.col("problem").isNotNull() | F.upper("name").isin(*[k.upper() for k in keep])) if keep else out


def sane(annual: DataFrame, quarterly: DataFrame, holders: DataFrame, keys: list[str]) -> DataFrame:
    """A row a page with its first problem, null if its tables are what they should be.

    ``annual`` has revenue and opm, ``quarterly`` rows, ``holders`` total (the holders' shares of a
    period). Unusual companies pass: one revenue above 0 and one margin within reason are enough.
    """
    a = annual.groupBy(*keys).agg(F.count("*").alias("years"), F.count("revenue").alias("known"), F.coalesce(F.bool_or(F.col("revenue") > 0), F.lit(False)).alias("sells"), F.coalesce(F.bool_and(F.abs("opm") > IMPLAUSIBLE_MARGIN), F.lit(False)).alias("wild"))
    q = quarterly.groupBy(*keys).agg(F.count("*").alias("quarters"))
    h = holders.groupBy(*keys).agg(F.coalesce(F.bool_or((F.col("total") != 0) & ~F.col("total").between(*HOLDERS)), F.lit(False)).alias("odd"))
    x = a.join(q, keys, "full").join(h, keys, "full")
    problem = (
        F.when(F.coalesce("years", F.lit(0)) == 0, "no annual table")
        .when(F.coalesce("quarters", F.lit(0)) == 0, "no quarterly table")
        .when(F.col("known") == 0, "no revenue in any year")
        .when(~F.col("sells"), "no revenue above zero")
        .when(F.col("wild"), "margins are no percentages")
        .when(F.coalesce("odd", F.lit(False)), "holders do not sum to a whole")
    )
    return x.select(*keys, problem.alias("problem"))


def live_basis(pages: DataFrame, today: Column, key: str = "symbol") -> DataFrame:
    """key, basis: consolidated where that page has years and quarters and its newest year is at most 550 days old, else standalone.

    ``pages`` has a row a page: key, basis, years, quarters, newest. Nothing to choose from: no row.
    """
    usable = (F.col("years") > 0) & (F.col("quarters") > 0) & (F.datediff(today, F.col("newest")) <= STALE_DAYS)
    wanted = pages.where((F.col("basis") == "standalone") | F.coalesce(usable, F.lit(False)))
    return wanted.groupBy(key).agg(F.min("basis").alias("basis"))  # consolidated is first by name
