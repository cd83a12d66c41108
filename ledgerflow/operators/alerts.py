"""Alert rules on held positions and on the screen, their order, and what has been told before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import change, fixed

# Severities by urgency, and the decile under which an entry case has weakened.
SEVERITY = {"critical": 0, "action": 1, "info": 2}
DECAY_FLOOR, TOP_DECILE = 7, 10


def _failed(flags: str) -> Column:
    return F.array_sort(F.transform(F.filter(F.coalesce(flags, F.array().cast("array<struct<name: string, verdict: string>>")), lambda f: f["verdict"] == "fail"), lambda f: f["name"]))


def _alert(rule: str, severity: str, when: Column, extra: Column | None = None) -> Column:
    """The alert as a struct where its condition holds. ``extra`` tells one event of a rule from another."""
    extra = F.lit(None).cast("string") if extra is None else extra.cast("string")
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(SEVERITY[severity]).alias("severity"), extra.alias("extra")))


def _named(df: DataFrame, rules: list[Column]) -> DataFrame:
    """One row an alert: symbol, rule, severity, dedupe_key. A tie in severity is ordered by symbol, then rule."""
    out = df.select("symbol", F.explode(F.array_compact(F.array(*rules))).alias("a")).select("symbol", "a.rule", "a.severity", "a.extra")
    return out.withColumn("dedupe_key", F.concat_ws(":", F.col("symbol").cast("string"), "rule", "extra")).drop("extra")


def for_positions(positions: DataFrame, today: DataFrame) -> DataFrame:
    """Alerts on positions (symbol, id, stop, target, close) that today's scores (symbol, decile, conviction_decile, flags) know.

    A missing price or level raises nothing; the conviction decile counts before the blended one.
    """
    x = positions.join(today.select("symbol", "decile", "conviction_decile", "flags"), "symbol").withColumn("_f", _failed("flags"))
    decile = F.coalesce("conviction_decile", "decile")
    score = F.when(F.col("conviction_decile").isNotNull(), "conviction").otherwise("blended score")
    return _named(
        x,
        [
            _alert("stop_breached", "critical", F.col("close") <= F.col("stop"), F.col("id")),
            _alert("target_reached", "action", F.col("close") >= F.col("target"), F.col("id")),
            _alert("thesis_broken", "critical", F.size("_f") > 0, F.array_join("_f", ",")),
            _alert("score_decayed", "action", decile < DECAY_FLOOR, F.concat_ws(":", score, decile.cast("string"))),
        ],
    )


def for_screen(today: DataFrame, yesterday: DataFrame) -> DataFrame:
    """Alerts on what changed since yesterday; both have symbol, decile, setup_status, reason, zone_floor and flags.

    A symbol without a row yesterday can only have its setup triggered.
    """
    before = yesterday.select("symbol", F.lit(True).alias("_was"), *[F.col(c).alias(f"_{c}") for c in ("decile", "setup_status", "flags")])
    x = today.join(before, "symbol", "left").withColumn("_fresh", F.array_except(_failed("flags"), _failed("_flags")))
    known = F.col("_was").isNotNull()
    return _named(
        x,
        [
            _alert("setup_triggered", "action", (F.col("setup_status") == "triggered") & ~F.coalesce(F.col("_setup_status") == "triggered", F.lit(False)), F.col("zone_floor")),
            _alert("entered_top_decile", "info", known & (F.col("decile") >= TOP_DECILE) & (F.col("_decile") < TOP_DECILE)),
            _alert("zone_broken", "info", known & (F.col("_setup_status") != "none") & (F.col("setup_status") == "none") & (F.col("reason") == "no live zone below price")),
            _alert("new_red_flag", "info", known & (F.size("_fresh") > 0), F.array_join("_fresh", ",")),
        ],
    )


def dispatch(alerts: DataFrame, seen: DataFrame) -> DataFrame:
    """Alerts whose event has not been told (``seen`` has dedupe_key), most urgent first."""
    return alerts.dropDuplicates(["dedupe_key"]).join(seen.select("dedupe_key"), "dedupe_key", "left_anti").orderBy("severity", "symbol", "rule")


def worth_telling(screen: DataFrame, watched: DataFrame) -> DataFrame:
    """Screen alerts of watched symbols, and of all symbols those on a triggered setup."""
    on = watched.select("symbol").distinct().withColumn("_on", F.lit(True))
    return screen.join(on, "symbol", "left").where(F.col("_on") | (F.col("rule") == "setup_triggered")).drop("_on")


def _plain(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.replace(n, F.lit("_"), F.lit(" "))), ", ")


def explained(alerts: DataFrame, positions: DataFrame, today: DataFrame, setups: DataFrame) -> DataFrame:
    """Add ``message``: what happened and, for a setup, why it counts.

    ``positions`` has symbol, id, entry, stop, target, close; ``today`` symbol, blended, decile,
    conviction_decile, flags; ``setups`` symbol, signs (an array of names) and reward_risk.
    What is not known is left out of the text.
    """
    x = alerts.withColumn("_what", F.regexp_extract("dedupe_key", r"^[^:]*:[^:]*:(.*)$", 1))
    held = positions.select(F.col("symbol"), F.col("id").cast("string").alias("_what"), "entry", "stop", "target", "close")
    x = x.join(held, ["symbol", "_what"], "left").join(today.select("symbol", "blended"), "symbol", "left").join(setups.select("symbol", "signs", "reward_risk"), "symbol", "left")
    two = lambda c: fixed(c, 2)
    gain = F.when(F.col("entry") > 0, F.concat(F.lit(", "), change(F.col("close") / F.col("entry") - 1, 0), F.lit(" since entry"))).otherwise("")
    odds = F.when(F.col("reward_risk").isNotNull(), F.concat(F.lit(", reward to risk "), fixed("reward_risk", 1))).otherwise("")
    signs = F.when(F.size("signs") > 0, _plain(F.col("signs"))).otherwise("confirmed")
    listed = _plain(F.split("_what", ","))
    text = {
        "stop_breached": F.concat(F.lit("close "), two("close"), F.lit(" is at or under the stop "), two("stop")),
        "target_reached": F.concat(F.lit("close "), two("close"), F.lit(" has met the target "), two("target"), gain),
        "thesis_broken": F.concat(F.lit("a holding fails a gate: "), listed),
        "score_decayed": F.concat(F.split_part("_what", F.lit(":"), F.lit(1)), F.lit(" is down to decile "), F.split_part("_what", F.lit(":"), F.lit(2))),
        "entered_top_decile": F.concat(F.lit("new in the top decile"), F.when(F.col("blended").isNotNull(), F.concat(F.lit(", blend "), fixed("blended", 1))).otherwise("")),
        "setup_triggered": F.concat(F.lit("turning at support ("), signs, F.lit(")"), odds),
        "zone_broken": F.lit("the support under it has gone"),
        "new_red_flag": F.concat(F.lit("fails a gate it passed before: "), listed),
    }
    message = None
    for rule, c in text.items():
        message = F.when(F.col("rule") == rule, c) if message is None else message.when(F.col("rule") == rule, c)
    return x.withColumn("message", message).select(*alerts.columns, "message")
