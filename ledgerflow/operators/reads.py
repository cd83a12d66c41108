"""Reads by name: a total order for every table, filters by equality, membership and lower bound, latest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns by which a table's rows are in a stable, total order.
ORDER = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "events": ("event_id",), "bars": ("symbol", "date"), "nation_bars": ("symbol", "date"), "stocks": ("symbol",), "quarters": ("symbol", "period_end"),
}


def order_of(table: str) -> tuple[str, ...]:
    if table not in ORDER:
        raise KeyError(f"no order is known for table {table!r}; add it to ORDER")
    return ORDER[table]


def select(df: DataFrame, table: str, columns: tuple[str, ...] = (), where: dict | None = None, since: tuple[str, object] | None = None, within: dict[str, list] | None = None) -> DataFrame:
    """Columns of a table's rows that meet all conditions; an equality with None asks for a missing value.

    The conditions are plain comparisons, so they reach the scan; the table's order must be known.
    """
    order_of(table)
    for c, v in (where or {}).items():
        df = df.where(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    for c, vs in (within or {}).items():
        df = df.where(F.col(c).isin(*vs))
    if since:
        df = df.where(F.col(since[0]) >= F.lit(since[1]))
    return df.select(*columns) if columns else df


def page(df: DataFrame, table: str, size: int, number: int) -> DataFrame:
    """The rows of one page in the table's order, numbered from 0."""
    return df.orderBy(*order_of(table)).offset(size * number).limit(size)


def newest(df: DataFrame, by: str, n: int, tiebreak: str) -> DataFrame:
    """The first n rows in falling order, missing values last."""
    return df.orderBy(F.desc_nulls_last(by), tiebreak).limit(n)


def update(df: DataFrame, values: dict, where: dict) -> DataFrame:
    """The table with columns set on the rows that meet all equalities; no equality is refused."""
    if not where:
        raise ValueError("an update without a condition would change every row")
    hit = F.lit(True)
    for c, v in where.items():
        hit = hit & (F.col(c).isNull() if v is None else F.coalesce(F.col(c) == F.lit(v), F.lit(False)))
    types = dict(df.dtypes)
    return df.withColumns({c: F.when(hit, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in values.items()})


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The table and the new rows; columns the rows lack are missing in them, others are refused."""
    if extra := set(rows.columns) - set(df.columns):
        raise ValueError(f"the table has no columns {sorted(extra)}")
    return df.unionByName(rows, allowMissingColumns=True)
