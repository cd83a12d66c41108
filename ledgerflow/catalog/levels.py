"""Queries on swings, zones and shelves (section J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indicators as ind, zones as zn
from ..operators.indicators import W
from ..plans.views import Market
from .prices import NTR, OVER, _wilder_sql
from .registry import query

_PIVOTS = f"""n AS (SELECT symbol, date, high, low, close, row_number() {OVER} - 1 AS i FROM nbars),
walk AS (
  SELECT symbol, i, 1 AS phase, high AS ah, low AS al, close AS ac, 0 AS hits, low AS lo, i AS lo_at, high AS hi, i AS hi_at, i AS moved, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS price FROM n WHERE i = 0
  UNION ALL
  SELECT symbol, i, CASE WHEN stalled OR NOT fires THEN phase ELSE -phase END, CASE WHEN stalled OR fires THEN high ELSE ah END, CASE WHEN stalled OR fires THEN low ELSE al END, CASE WHEN stalled OR fires THEN close ELSE ac END,
    CASE WHEN stalled OR fires THEN 0 WHEN hit THEN hits + 1 ELSE hits END,
    CASE WHEN stalled THEN low WHEN fires THEN NULL ELSE lo2 END, CASE WHEN stalled THEN i WHEN fires THEN NULL ELSE lo_at2 END, CASE WHEN stalled THEN high WHEN fires THEN NULL ELSE hi2 END, CASE WHEN stalled THEN i WHEN fires THEN NULL ELSE hi_at2 END,
    CASE WHEN stalled OR fires THEN i ELSE moved END,
    CASE WHEN fires AND NOT stalled THEN CASE WHEN phase = 1 THEN 'low' ELSE 'high' END END, CASE WHEN fires AND NOT stalled THEN CASE WHEN phase = 1 THEN lo_at2 ELSE hi_at2 END END, CASE WHEN fires AND NOT stalled THEN CASE WHEN phase = 1 THEN lo2 ELSE hi2 END END
  FROM (SELECT *, hit AND hits + 1 >= 2 AS fires FROM (SELECT w.symbol, n.i, n.high, n.low, n.close, phase, ah, al, ac, hits, moved, n.i - moved > 60 AS stalled,
      CASE WHEN lo IS NULL OR n.low < lo THEN n.low ELSE lo END AS lo2, CASE WHEN lo IS NULL OR n.low < lo THEN n.i ELSE lo_at END AS lo_at2, CASE WHEN hi IS NULL OR n.high > hi THEN n.high ELSE hi END AS hi2, CASE WHEN hi IS NULL OR n.high > hi THEN n.i ELSE hi_at END AS hi_at2,
      CASE WHEN phase = 1 THEN n.high > ah AND n.close > ac ELSE n.low < al AND n.close < ac END AS hit
    FROM walk w JOIN n ON n.symbol = w.symbol AND n.i = w.i + 1))),
piv AS (SELECT symbol, kind, idx, price, i AS confirmed FROM walk WHERE kind IS NOT NULL)"""


@query("SELECT symbol, kind, CAST(idx AS INTEGER) AS idx, round(price, 6) AS price, CAST(confirmed AS INTEGER) AS confirmed FROM piv", views="nbars", more=_PIVOTS, recursive=True)
def j01_pivots(m: Market) -> DataFrame:
    return zn.pivots(m.nation_bars()).select("symbol", "kind", "idx", "price", "confirmed")


def _atr(m: Market) -> DataFrame:
    df = ind.atr(m.nation_bars(), out="atr")
    return df.select("symbol", (F.row_number().over(W()) - 1).alias("idx"), "atr")


_NATR = f"nw AS (SELECT *, row_number() {OVER} - 1 AS i FROM ({_wilder_sql('tr', 14, 't', 'atr14')}))"


def _bands(points: str) -> str:
    """Clusters and their bands from ``points`` (symbol, kind, idx, price, confirmed)."""
    return f"""pts AS (SELECT p.*, w.atr14 AS atr, row_number() OVER (PARTITION BY p.symbol, kind ORDER BY CASE WHEN kind = 'low' THEN price ELSE -price END, idx, price, w.atr14, confirmed) AS r FROM ({points}) p JOIN nw w ON w.symbol = p.symbol AND w.i = p.idx WHERE w.atr14 > 0),
clus AS (
  SELECT symbol, kind, idx, price, atr, confirmed, r, price AS anchor, 1 AS cluster FROM pts WHERE r = 1
  UNION ALL
  SELECT p.symbol, p.kind, p.idx, p.price, p.atr, p.confirmed, p.r, CASE WHEN abs(p.price - c.anchor) <= 0.6 * p.atr THEN c.anchor ELSE p.price END, CASE WHEN abs(p.price - c.anchor) <= 0.6 * p.atr THEN c.cluster ELSE c.cluster + 1 END
  FROM clus c JOIN pts p ON p.symbol = c.symbol AND p.kind = c.kind AND p.r = c.r + 1),
bands AS (SELECT b.symbol, kind, cluster, formed, members, floor - pad AS floor, ceil + pad AS ceil FROM (
  SELECT b.*, greatest(0.35 * w.atr14 - (ceil - floor), 0) / 2 AS pad FROM (SELECT symbol, kind, cluster, max(confirmed) AS formed, count(*) AS members, min(price) AS floor, max(price) AS ceil FROM clus GROUP BY 1, 2, 3) b
  JOIN nw w ON w.symbol = b.symbol AND w.i = b.formed WHERE w.atr14 > 0) b)"""


SWINGS = "SELECT symbol, kind, idx, price, confirmed FROM piv"


@query(
    "SELECT symbol, kind, CAST(idx AS INTEGER) AS idx, round(price, 6) AS price, round(atr, 6) AS atr, CAST(confirmed AS INTEGER) AS confirmed, cluster FROM clus",
    views="nbars",
    more=f"{_PIVOTS}, {NTR}, {_NATR}, {_bands(SWINGS)}",
    recursive=True,
)
def j03_clusters(m: Market) -> DataFrame:
    p = zn.pivots(m.nation_bars()).join(_atr(m), ["symbol", "idx"])
    return zn.clusters(p, "low").unionByName(zn.clusters(p, "high"))


@query(
    "SELECT symbol, kind, cluster, CAST(formed AS INTEGER) AS formed, members, round(floor, 6) AS floor, round(ceil, 6) AS ceil FROM bands",
    views="nbars",
    more=f"{_PIVOTS}, {NTR}, {_NATR}, {_bands(SWINGS)}",
    recursive=True,
)
def j04_zones(m: Market) -> DataFrame:
    atr = _atr(m)
    p = zn.pivots(m.nation_bars()).join(atr, ["symbol", "idx"])
    return zn.zones(zn.clusters(p, "low").unionByName(zn.clusters(p, "high")), atr)


_EDGE = "CASE WHEN {k} = 60 THEN hi ELSE lo + {k} * step END"


_SHELVES = f"""SELECT symbol, bin, floor, {_EDGE.format(k='(bin + 1)')} AS ceil, share FROM (
      SELECT *, {_EDGE.format(k='bin')} AS floor, weight / sum(weight) OVER (PARTITION BY symbol) AS share FROM (
        SELECT symbol, bin, lo, hi, step, last, sum(v) AS weight FROM (
          SELECT symbol, lo, hi, step, last, volume / (b - a) AS v, CAST(unnest(range(a, b)) AS INTEGER) AS bin FROM (
            SELECT *, least(greatest(stop, a + 1), 60) AS b FROM (
              SELECT *, greatest(0, least(start, 59)) AS a FROM (
                SELECT *, len(list_filter(edges, lambda e: e <= low)) - 1 AS start, len(list_filter(edges, lambda e: e < high)) AS stop FROM (
                  SELECT *, [{_EDGE.format(k='k')} FOR k IN range(0, 61)] AS edges FROM (
                    SELECT *, (hi - lo) / 60 AS step FROM (
                      SELECT *, min(low) OVER (PARTITION BY symbol) AS lo, max(high) OVER (PARTITION BY symbol) AS hi, count(*) OVER (PARTITION BY symbol) AS n, first_value(close) OVER (PARTITION BY symbol ORDER BY date DESC) AS last
                      FROM (SELECT * FROM nbars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 500)) WHERE n >= 30 AND hi > lo AND volume > 0)))))) GROUP BY ALL))
    WHERE floor < last QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, bin DESC) <= 3"""


@query(f"SELECT symbol, bin, round(floor, 6) AS floor, round(ceil, 6) AS ceil, round(share, 6) AS share FROM ({_SHELVES})", views="nbars")
def j05_g07_volume_shelves(m: Market) -> DataFrame:
    return zn.shelves(m.nation_bars())
