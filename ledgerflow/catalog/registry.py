"""``@query(sql)`` registers a function of a Market under its own name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.num import SHIFT, round_doubles
from ..plans.views import BARS, INDEX, NBARS, QUARTERS, STOCKS, Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_VIEWS = {"bars": BARS, "nbars": NBARS, "stocks": STOCKS, "idx": INDEX, "quarters": QUARTERS}


def query(sql: str | None = None, views: str = "bars", more: str = "", recursive: bool = False):
    """``views``: derived tables the SQL reads; ``more``: further common tables."""

    def register(f: Callable[[Market], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: round_doubles(f(Market(spark, sf_dir)))
        if sql:
            parts = [_VIEWS[v] for v in views.split()] + ([more.strip().rstrip(",")] if more.strip() else [])
            word = "WITH RECURSIVE" if recursive else "WITH"
            ORACLES[f.__name__] = _guarded((f"{word} {', '.join(parts)} " if parts else "") + sql)
        return f

    return register


def _guarded(sql: str) -> str:
    """``round(x, 6)`` as the sink rounds: a small shift keeps exact ties on one side in both engines."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 1, i + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = sql[i + 6 : j - 1]
        out.append(sql[at:i])
        if inner.endswith(", 6"):
            out.append(f"(round({_guarded(inner[:-3])} + {SHIFT}, 6) + 0)")
        else:
            out.append(f"round({_guarded(inner)})")
        at = j
    return "".join(out) + sql[at:]


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
