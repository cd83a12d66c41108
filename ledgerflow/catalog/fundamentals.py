"""Queries on statement histories and scalar functions (sections C, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import histories as hs
from ..plans.views import Market
from .registry import query

_H = "h AS (SELECT symbol, list(revenue ORDER BY period_end) AS rev, list(pat ORDER BY period_end) AS pat, list(pat / revenue ORDER BY period_end) AS opm FROM quarters GROUP BY symbol)"


def arrays(m: Market) -> DataFrame:
    q = m.quarters().withColumn("opm", F.col("pat") / F.col("revenue"))
    return q.groupBy("symbol").agg(hs.history(q, "revenue", out="rev"), hs.history(q, "pat"), hs.history(q, "opm"))


@query(
    "SELECT symbol, round(CASE WHEN len(rev) >= 13 AND rev[-13] > 0 AND rev[-1] > 0 THEN pow(rev[-1] / rev[-13], 1.0 / 12) - 1 END, 6) AS cagr, round(CASE WHEN rev[-5] > 0 THEN rev[-1] / rev[-5] - 1 END, 6) AS yoy, round((rev[-1] - rev[-3]) / 2, 6) AS trend FROM h",
    views="quarters",
    more=_H,
)
def i01_i02_i03_growth(m: Market) -> DataFrame:
    return arrays(m).select("symbol", hs.cagr("rev", 12).alias("cagr"), hs.yoy("rev").alias("yoy"), hs.trend("rev").alias("trend"))


@query(
    """SELECT symbol, round(CASE WHEN sd > 0 THEN greatest(-8, least(8, (d[-1] - mu) / sd)) END, 6) AS sue FROM (SELECT *, list_avg(d[-5:-2]) AS mu, list_stddev_samp(d[-5:-2]) AS sd
    FROM (SELECT symbol, CASE WHEN len(pat) >= 8 THEN [pat[i] - pat[i - 4] FOR i IN range(5, len(pat) + 1)] END AS d FROM h))""",
    views="quarters",
    more=_H,
)
def i05_i06_sue(m: Market) -> DataFrame:
    return hs.with_sue(arrays(m), "pat", "sue").select("symbol", "sue")


@query(
    """SELECT symbol, round(CASE WHEN len(rev) >= 6 AND rev[-5] > 0 AND rev[-6] > 0 THEN rev[-1] / rev[-5] - rev[-2] / rev[-6] END, 6) AS acceleration, round(opm[-1] - (opm[-2] + opm[-3] + opm[-4] + opm[-5]) / 4, 6) AS margin_revision,
    round(CASE WHEN len(pat) >= 8 THEN (CASE WHEN pat[-1] > pat[-5] THEN 1 ELSE 0 END + CASE WHEN pat[-2] > pat[-6] THEN 1 ELSE 0 END + CASE WHEN pat[-3] > pat[-7] THEN 1 ELSE 0 END + CASE WHEN pat[-4] > pat[-8] THEN 1 ELSE 0 END) / 4.0 END, 6) AS consistency,
    opm[-3] < opm[-2] AND opm[-2] < opm[-1] AS expanding FROM h""",
    views="quarters",
    more=_H,
)
def i07_i08_i09_i10_revision(m: Market) -> DataFrame:
    return arrays(m).select(
        "symbol", hs.acceleration("rev").alias("acceleration"), hs.margin_revision("opm").alias("margin_revision"), hs.consistency("pat").alias("consistency"), hs.expanding("opm").alias("expanding")
    )


@query("SELECT symbol, round(opm[-1] - opm[-5], 6) AS d4, round(opm[-1] - opm[-2], 6) AS d1, round(pat[-1] + pat[-2] + pat[-3] + pat[-4], 6) AS trailing, round(rev[-1], 6) AS last_rev FROM h", views="quarters", more=_H)
def i11_i12_i14_deltas(m: Market) -> DataFrame:
    return arrays(m).select("symbol", hs.delta("opm", 4).alias("d4"), hs.delta("opm", 1).alias("d1"), hs.trailing("pat").alias("trailing"), hs.at("rev", 1).alias("last_rev"))


@query("SELECT symbol, period_end, round(revenue * 12 / 3, 6) AS revenue, round(pat * 12 / 3, 6) AS pat, filed_on FROM quarters", views="quarters")
def c02_i16_annualised(m: Market) -> DataFrame:
    q = m.quarters().withColumn("months", F.lit(3))
    return q.withColumns(hs.annualised(["revenue", "pat"], "months")).drop("months")


@query(
    "SELECT DISTINCT strftime(period_end, '%b %Y') || CASE WHEN month(period_end) = 3 THEN ' 15m' ELSE '' END AS label, period_end, CASE WHEN month(period_end) = 3 THEN 15 ELSE 12 END AS months FROM quarters",
    views="quarters",
)
def i15_period_labels(m: Market) -> DataFrame:
    text = F.concat(F.date_format("period_end", "MMM yyyy"), F.when(F.month("period_end") == 3, " 15m").otherwise(""))
    rows = m.quarters().select(text.alias("label")).distinct()
    end, months = hs.period("label")
    return rows.select("label", end.alias("period_end"), months.alias("months"))


_FLAGS = "g AS (SELECT symbol, CASE WHEN symbol % 7 = 0 THEN NULL ELSE symbol % 40 END AS pledge, opm[-1] * 10 - opm[-6] * 10 AS promoter_change, CASE WHEN symbol % 5 = 0 THEN NULL ELSE pat[-1] / nullif(abs(pat[-2]), 0) END AS cash_ratio, rev[-1] / rev[-5] AS receivable_ratio, (pat[-1] < 0)::INT + (pat[-5] < 0)::INT + (pat[-9] < 0)::INT AS loss_years, rev[-1] / 1e6 AS turnover, symbol % 11 = 0 AS is_lender, symbol % 13 <> 0 AS has_promoter FROM h)"


@query(
    """SELECT symbol, coalesce(pledge > 20, false) OR (has_promoter AND coalesce(promoter_change < -3, false)) OR (NOT is_lender AND (coalesce(cash_ratio < 0.5, false) OR coalesce(receivable_ratio > 1.4, false))) OR coalesce(loss_years >= 2, false) OR coalesce(turnover < 2, false) AS excluded,
      (pledge IS NULL OR pledge > 20)::INT + (has_promoter AND (promoter_change IS NULL OR promoter_change < -3))::INT + (NOT is_lender AND (cash_ratio IS NULL OR cash_ratio < 0.5))::INT + (NOT is_lender AND (receivable_ratio IS NULL OR receivable_ratio > 1.4))::INT + (loss_years IS NULL OR loss_years >= 2)::INT + (turnover IS NULL OR turnover < 2)::INT AS noted FROM g""",
    views="quarters",
    more=f"{_H}, {_FLAGS}",
)
def i26_i27_red_flags(m: Market) -> DataFrame:
    a = arrays(m)
    x = a.select(
        "symbol",
        F.when(F.col("symbol") % 7 != 0, F.col("symbol") % 40).alias("pledge"),
        (hs.at("opm", 1) * 10 - hs.at("opm", 6) * 10).alias("promoter_change"),
        F.when(F.col("symbol") % 5 != 0, hs.at("pat", 1) / F.nullif(F.abs(hs.at("pat", 2)), F.lit(0.0))).alias("cash_ratio"),
        (hs.at("rev", 1) / hs.at("rev", 5)).alias("receivable_ratio"),
        sum(((hs.at("pat", k) < 0).cast("int") for k in (5, 9)), (hs.at("pat", 1) < 0).cast("int")).alias("loss_years"),
        (hs.at("rev", 1) / 1e6).alias("turnover"),
        (F.col("symbol") % 11 == 0).alias("is_lender"),
        (F.col("symbol") % 13 != 0).alias("has_promoter"),
    ).withColumn("flags", hs.red_flags())
    return x.select("symbol", hs.excluded("flags").alias("excluded"), F.size(hs.noted("flags")).alias("noted"))


@query("SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS monday, isodow(ts + INTERVAL 330 MINUTE) <= 5 AND hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE) BETWEEN 555 AND 930 AS is_open FROM events", views="")
def i17_i18_market_hours(m: Market) -> DataFrame:
    t = F.col("ts") + F.expr("INTERVAL 330 MINUTES")
    minutes = F.hour(t) * 60 + F.minute(t)
    open_ = F.weekday(t).between(0, 4) & minutes.between(555, 930)
    return m.table("events").select("event_id", F.date_trunc("week", "ts").cast("date").alias("monday"), open_.alias("is_open"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", views="")
def i40_json_props(m: Market) -> DataFrame:
    return m.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT symbol, CAST(unnest(generate_series(first_date, first_date + INTERVAL 9 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT symbol, min(date) AS first_date FROM bars GROUP BY symbol)")
def i41_candidate_days(m: Market) -> DataFrame:
    first = m.bars().groupBy("symbol").agg(F.min("date").alias("first_date"))
    return first.select("symbol", F.explode(F.sequence("first_date", F.date_add("first_date", 9))).alias("day"))
