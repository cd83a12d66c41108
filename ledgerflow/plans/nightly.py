"""A run of dependent steps with skip propagation, failure isolation and an audit table."""

from __future__ import annotations

import contextlib
import datetime as dt
import traceback
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

AUDIT = "job string, started_at timestamp, finished_at timestamp, status string, rows_in long, rows_out long, errors array<string>, bytes_read long"


@dataclass
class Step:
    name: str
    run: Callable[[], object]
    needs: tuple[str, ...] = ()
    tolerate_failure: bool = False


@dataclass
class Audit:
    """Counters of one run; ``status`` is ok, partial (errors noted) or failed."""

    job: str
    started_at: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc))
    finished_at: dt.datetime | None = None
    rows_in: int = 0
    rows_out: int = 0
    bytes_read: int = 0
    errors: list[str] = field(default_factory=list)
    failed: bool = False

    @property
    def status(self) -> str:
        return "failed" if self.failed else "partial" if self.errors else "ok"

    def row(self) -> tuple:
        return (self.job, self.started_at, self.finished_at, self.status, self.rows_in, self.rows_out, self.errors, self.bytes_read)


@contextlib.contextmanager
def audited(job: str, sink: list[Audit]) -> Iterator[Audit]:
    """Record a run whatever happens in it; the exception goes on."""
    a = Audit(job)
    try:
        yield a
    except Exception as e:
        a.failed = True
        a.errors.append(f"{type(e).__name__}: {e}")
        raise
    finally:
        a.finished_at = dt.datetime.now(dt.timezone.utc)
        sink.append(a)


def audit_frame(spark: SparkSession, runs: list[Audit]) -> DataFrame:
    return spark.createDataFrame([a.row() for a in runs], AUDIT)


def ordered(steps: list[Step]) -> list[Step]:
    """Steps in given order; a need must name an earlier step."""
    seen: set[str] = set()
    for s in steps:
        if missing := set(s.needs) - seen:
            raise ValueError(f"{s.name} needs {sorted(missing)}, which no earlier step gives")
        if s.name in seen:
            raise ValueError(f"two steps are named {s.name}")
        seen.add(s.name)
    return steps


def run(steps: list[Step], idle: Callable[[], bool] = lambda: False, always: tuple[str, ...] = ()) -> dict[str, str]:
    """The status of each step: ok, failed, tolerated, or skipped.

    A step whose need failed or was skipped is skipped; a tolerated failure lets its
    dependants run. On an idle night only the ``always`` steps run.
    """
    out: dict[str, str] = {}
    quiet = idle()
    for s in ordered(steps):
        if quiet and s.name not in always or any(out[n] in ("failed", "skipped") for n in s.needs):
            out[s.name] = "skipped"
            continue
        try:
            s.run()
            out[s.name] = "ok"
        except Exception:
            traceback.print_exc()
            out[s.name] = "tolerated" if s.tolerate_failure else "failed"
    return out


def exit_code(status: dict[str, str]) -> int:
    return int(any(s == "failed" for s in status.values()))


def weights(defaults: dict[str, float], conf: Callable[[str], str | None]) -> dict[str, float]:
    """Blend weights, each overridden by a setting of its name if there is one; all must be finite and not negative."""
    out = {k: float(conf(k) or v) for k, v in defaults.items()}
    if any(not 0 <= v < float("inf") for v in out.values()) or not sum(out.values()):
        raise ValueError(f"weights must be non-negative and not all zero: {out}")
    return out
