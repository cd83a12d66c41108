"""Readers for exchange, index, constituent, chart and statement files.

Each reader is a projection of what Spark's own sources deliver; bad rows are a
DataFrame of violations, and ``strict`` turns them into a failing expression, so a
layout change stops the load instead of thinning it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File layouts (target column: source column).
DAILY = {"date": "TradDt", "symbol": "TckrSymb", "series": "SctySrs", "kind": "FinInstrmTp", "isin": "ISIN", "open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "prev_close": "PrvsClsgPric", "volume": "TtlTradgVol"}
DAILY_OLD = {"date": "TIMESTAMP", "symbol": "SYMBOL", "series": "SERIES", "isin": "ISIN", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "prev_close": "PREVCLOSE", "volume": "TOTTRDQTY"}
INDEX = {"index_name": "Index Name", "date": "Index Date", "open": "Open Index Value", "high": "High Index Value", "low": "Low Index Value", "close": "Closing Index Value"}
INDEX_EXTRA = {"volume": "Volume", "turnover_cr": "Turnover (Rs. Cr.)", "pe": "P/E", "pb": "P/B", "div_yield": "Div Yield"}
CONSTITUENTS = ["Company Name", "Industry", "Symbol", "Series", "ISIN Code"]
SERIES = ("EQ", "BE", "BZ", "RR")
ISIN = r"^IN[A-Z0-9]{10}$"


def raw_csv(spark: SparkSession, path) -> DataFrame:
    """All columns as text, header names trimmed; quoted fields may span lines."""
    df = spark.read.option("header", True).option("multiLine", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def number(c: str | Column) -> Column:
    """Numbers with thousands commas or a percent sign; '-' and blanks are missing."""
    text = F.col(c) if isinstance(c, str) else c
    for mark in ",%₹ ":
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text.try_cast("double")  # '-' and '--' are no numbers either


def any_date(c: str, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in formats])


def _require(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")


def demand(df: DataFrame, ok: Column, message: Column) -> DataFrame:
    """Fail the query at the first row that is not ok."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(ok, F.lit(False)), F.col(first)).otherwise(F.raise_error(message).cast(df.schema[first].dataType)))


def daily_prices(raw: DataFrame, series=SERIES, strict: bool = True) -> DataFrame:
    """Bars of either daily layout, told apart by the header; the close must lie within the range."""
    old = "TckrSymb" not in raw.columns and set(DAILY_OLD.values()) <= set(raw.columns)
    names = DAILY_OLD if old else DAILY
    _require(raw, names.values())
    q = {k: f"`{v}`" for k, v in names.items()}
    df = raw.where(F.trim(q["series"]).isin(*series))
    if not old:
        df = df.where(F.col(q["kind"]) == "STK")
    date = any_date(q["date"], "dd-MMM-yyyy") if old else F.trim(q["date"]).try_cast("date")
    out = df.select(
        F.upper(F.trim(q["symbol"])).alias("symbol"), date.alias("date"), *[number(q[c]).alias(c) for c in ("open", "high", "low", "close", "prev_close")],
        F.coalesce(number(q["volume"]), F.lit(0.0)).cast("long").alias("volume"), F.trim(q["isin"]).alias("isin"),
    )
    ok = F.col("date").isNotNull() & F.col("open").isNotNull() & F.col("close").between(F.col("low"), F.col("high"))
    return demand(out, ok, F.concat(F.lit("bad price row: "), "symbol")) if strict else out.withColumn("ok", F.coalesce(ok, F.lit(False)))


def daily_unified(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enough(df: DataFrame, least: int, stamp=None) -> DataFrame:
    """One row: rows, whether there are enough, and whether all carry the asked date."""
    same = F.lit(True) if stamp is None else F.coalesce(F.bool_and(F.col("date") == F.lit(stamp).cast("date")), F.lit(False))
    return df.agg(F.count("*").alias("n"), same.alias("stamped")).withColumn("enough", F.col("n") >= least)


def index_prices(raw: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Index levels; three date formats, '-' for missing, rows without a close dropped."""
    _require(raw, INDEX.values())
    extra = [number(f"`{v}`").alias(k) if v in raw.columns else F.lit(None).cast("double").alias(k) for k, v in INDEX_EXTRA.items()]
    out = raw.select(
        F.trim(f"`{INDEX['index_name']}`").alias("index_name"), any_date(f"`{INDEX['date']}`", "dd-MM-yyyy", "dd MMM yyyy", "yyyy-MM-dd").alias("date"),
        *[number(f"`{INDEX[c]}`").alias(c) for c in ("open", "high", "low", "close")], *extra,
    )
    out = out.where("index_name <> '' and close is not null")
    return out.where(F.col("index_name").isin(*keep)) if keep else out


def constituents(raw: DataFrame) -> DataFrame:
    """Rows with their problem (NULL for usable ones)."""
    if raw.columns != CONSTITUENTS:
        raise ValueError(f"header is {raw.columns}, expected {CONSTITUENTS}")
    t = lambda c: F.coalesce(F.trim(f"`{c}`"), F.lit(""))
    df = raw.select(F.upper(t("Symbol")).alias("symbol"), t("Company Name").alias("company_name"), t("Industry").alias("sector"), F.upper(t("ISIN Code")).alias("isin"), F.upper(t("Series")).alias("series"))
    problem = F.when(F.col("symbol") == "", "missing symbol").when(F.col("company_name") == "", "no company name").when(F.col("sector") == "", "no industry").when(~F.col("isin").rlike(ISIN), "bad ISIN")
    return df.withColumns({"problem": problem, "instrument_type": F.when(F.col("series") == "RR", "reit").otherwise("equity")})


def constituent_checks(df: DataFrame, low: int = 450, high: int = 520, skipped: int = 5) -> DataFrame:
    """One row: usable, skipped, duplicate symbols, and whether the file may be loaded."""
    good = F.col("problem").isNull()
    a = df.agg(F.count_if(good).alias("usable"), F.count_if(~good).alias("skipped"), (F.count(F.when(good, F.col("symbol"))) - F.countDistinct(F.when(good, F.col("symbol")))).alias("duplicates"))
    return a.withColumn("ok", F.col("usable").between(low, high) & (F.col("skipped") <= skipped) & (F.col("duplicates") == 0))


def snapshot_date(path: str | Column = "_metadata.file_path") -> Column:
    """The date in a 14-digit stamp of a file name."""
    return F.to_date(F.substring(F.regexp_extract(path, r"^.*(?<!\d)(\d{14})", 1), 1, 8), "yyyyMMdd")


_CHART = "struct<chart: struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>, adjclose: array<struct<adjclose: array<double>>>>>>>>"


def chart_bars(raw: DataFrame, column: str = "value") -> DataFrame:
    """Bars from chart JSON with parallel arrays; null closes dropped, arrays of unequal length fail."""
    r = raw.select(F.from_json(column, _CHART).alias("j")).select(F.explode("j.chart.result").alias("r"))
    q = "r.indicators.quote[0]"
    r = r.select(F.col("r.meta.symbol").alias("symbol"), F.col("r.timestamp").alias("t"), *[F.expr(f"{q}.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")], F.expr("r.indicators.adjclose[0].adjclose").alias("adj_close"))
    r = demand(r, F.size("t") == F.size("close"), F.concat(F.lit("ragged arrays: "), "symbol"))
    r = r.withColumn("adj_close", F.coalesce("adj_close", "close"))
    z = r.select("symbol", F.explode(F.arrays_zip("t", "open", "high", "low", "close", "volume", "adj_close")).alias("z"))
    out = z.select("symbol", F.timestamp_seconds("z.t").cast("date").alias("date"), *[f"z.{c}" for c in ("open", "high", "low", "close", "volume", "adj_close")])
    return out.where("close is not null").withColumn("adj_close", F.coalesce("adj_close", "close"))


def statement_tables(pages: DataFrame, html: str = "html", key: str = "symbol") -> DataFrame:
    """Long cells of period-as-column tables: key, section, period, label, value.

    Tables, rows and cells are cut by regular expressions inside the JVM; the first
    row of a table names the periods, the first cell of a row its label.
    """
    sections = F.expr(f"regexp_extract_all(coalesce({html}, ''), '(?is)<section[^>]*id=\"([^\"]+)\"', 1)")
    parts = F.expr(f"split(coalesce({html}, ''), '(?i)<section ')")
    df = pages.select(key, sections.alias("names"), parts.alias("parts")).select(key, F.posexplode("parts").alias("k", "part"), "names").where("k > 0")
    df = df.select(key, F.expr("get(names, k - 1)").alias("section"), F.expr("regexp_extract(part, '(?is)<table.*?>(.*?)</table>', 1)").alias("t")).where("t <> ''")
    rows = F.expr("transform(regexp_extract_all(t, '(?is)<tr[^>]*>(.*?)</tr>', 1), r -> transform(regexp_extract_all(r, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1), c -> trim(regexp_replace(regexp_replace(c, '<[^>]+>', ''), '&nbsp;|[+]', ' '))))")
    df = df.select(key, "section", rows.alias("rows")).where(F.size("rows") > 1)
    df = df.select(key, "section", F.expr("rows[0]").alias("head"), F.explode(F.expr("slice(rows, 2, size(rows))")).alias("r")).where(F.size("r") > 1)
    df = df.select(key, "section", F.expr("r[0]").alias("label"), F.posexplode(F.expr("arrays_zip(slice(head, 2, size(head)), slice(r, 2, size(r)))")).alias("i", "z"))
    return df.select(key, "section", F.col("z.0").alias("period"), "label", number(F.col("z.1")).alias("value")).where("period is not null and period <> ''")


def statement_records(cells: DataFrame, labels: dict[str, str], key: str = "symbol") -> DataFrame:
    """One record a period from the long cells; ``labels`` maps row labels to columns."""
    named = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    return cells.withColumn("field", named[F.col("label")]).where("field is not null").groupBy(key, "section", "period").pivot("field", sorted(set(labels.values()))).agg(F.first("value", ignorenulls=True))


def backup(spark: SparkSession, path: str, schema: str, stocks: DataFrame | None = None, lines: bool = False) -> DataFrame:
    """Rows of a gzipped JSON backup whose symbol is known; ``lines``: one row a line, not one array a file."""
    df = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return df.join(stocks.select("symbol").distinct(), "symbol", "left_semi") if stocks is not None else df
