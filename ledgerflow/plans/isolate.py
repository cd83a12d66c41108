"""A step over many symbols of which some fail: those become rows that say why, the others finish.

What a run did is observed while it runs, in the same pass over the rows, and goes into its
audit row; nothing is counted twice and no second job is started.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .cut import cut
from .nightly import Audit, audited


def isolated(df: DataFrame, key: str, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The rows of ``step`` on each symbol's rows, with ``error``; a symbol on which it raises is one row with its key and the reason.

    ``schema`` is that of the step's rows and has the key.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return step(rows)[names].assign(error=None)
        except Exception as e:  # one symbol's trouble is a row, not the run's end
            return pd.DataFrame([{key: k[0], "error": f"{type(e).__name__}: {e}"}]).reindex(columns=[*names, "error"])

    return df.groupBy(key).applyInPandas(run, f"{schema}, error string")


def watched(rows: DataFrame, key: str, job: str, sink: list[Audit]) -> DataFrame:
    """The rows of an isolated step, computed once and kept, with the run's audit appended to ``sink``.

    The run is partial if a symbol failed, failed if all did, and ok otherwise; rows_in are
    the symbols seen, rows_out the rows kept.
    """
    with audited(job, sink) as audit:
        seen = Observation(f"{job}-counts")
        failed = F.col("error").isNotNull()
        counts = [F.count_if(~failed).alias("good"), F.count_if(failed).alias("bad"), F.count_if(failed | F.col(key).isNotNull()).alias("rows"), F.min(F.when(failed, F.concat_ws(": ", F.col(key).cast("string"), "error"))).alias("first")]
        kept = cut(rows.observe(seen, *counts))
        n = seen.get
        audit.rows_in, audit.rows_out = n["rows"], n["good"]
        if n["bad"]:
            audit.errors.append(f"{n['bad']} failed, the first: {n['first']}")
        audit.failed = bool(n["bad"]) and not n["good"]
    return kept
