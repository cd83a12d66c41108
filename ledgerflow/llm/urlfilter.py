"""Operator 9: URL rules by a bit-parallel wildcard automaton.

All globs are packed side by side into words of 64 bits. One Shift-And step over a
character advances every pattern on every URL of a batch at once; a position
before a wildcard keeps its bit while the wildcard's class holds. ``*`` stands for
characters other than '/', ``**`` for any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

# The rules (host, path prefix, verdict), longest first wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# The method's own globs over '.' + host + path, for URLs that no rule fits.
BLOCK_GLOBS = ("*casino*/**", "*free-bets*/**", "*casino*", "*free-bets*", "*/**.exe")


@dataclass
class Automaton:
    """``accept[p]`` is the state bit of pattern ``p``; masks are indexed by byte class."""

    patterns: tuple[str, ...]

    def __post_init__(self) -> None:
        steps: list[tuple[int, str | None, str]] = []  # (pattern, literal, loop kind at this state)
        starts, accepts = [], []
        for p, glob in enumerate(self.patterns):
            starts.append(len(steps))
            states: list[list] = [[None, ""]]
            i = 0
            while i < len(glob):
                if glob.startswith("**", i):
                    states[-1][1] = "any"
                    i += 2
                elif glob[i] == "*":
                    states[-1][1] = states[-1][1] or "part"
                    i += 1
                else:
                    states.append([glob[i], ""])
                    i += 1
            steps += [(p, lit, loop) for lit, loop in states]
            accepts.append(len(steps) - 1)
        self.words = (len(steps) + 63) // 64
        self.start = self._bits(starts)
        self.accept = accepts
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for k, (_, lit, loop) in enumerate(steps):
            w, bit = k >> 6, np.uint64(1 << (k & 63))
            if lit is not None:
                for byte in lit.encode()[:1]:
                    self.enter[byte, w] |= bit
            if loop:
                self.stay[:, w] |= bit
                if loop == "part":
                    self.stay[ord("/"), w] &= ~bit

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for k in places:
            out[k >> 6] |= np.uint64(1 << (k & 63))
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """matched[text, pattern], all patterns on all texts a character at a time."""
        n = len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")  # the longest first: live texts stay a prefix
        data = np.frombuffer(b"".join(texts), np.uint8)
        offs = (np.cumsum(sizes) - sizes)[order]
        live_sizes = sizes[order]
        state = np.tile(self.start, (n, 1))
        carry_in = np.uint64(63)
        for i in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-live_sizes, -i, "left"))  # sizes > i
            b = data[offs[:live] + i]
            s = state[:live]
            moved = s << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> carry_in
            state[:live] = (moved & self.enter[b]) | (s & self.stay[b])
        out = np.zeros((n, len(self.patterns)), bool)
        for p, k in enumerate(self.accept):
            out[order, p] = (state[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1) != 0
        return out


def rule_globs(rules) -> tuple[str, ...]:
    """A rule as a glob over '.' + host + path: its host or any below it, its path as a prefix."""
    return tuple(f"*.{host}{path}**" for host, path, _ in rules)


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    Host: after the first ``://`` up to '/', '?', '#' or the end, A-Z lower-cased;
    path: from there up to '?', '#' or the end. A null url, or one without ``://``,
    has both empty, no rule and the method's verdict on '.' (allow). Of several
    fitting rules the longest wins, of equally long ones the first. Bytes outside
    ASCII match only wildcards. Repeated rows are judged each; other columns are ignored.
    """
    tune(pages.sparkSession)
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][0] + rules[k][1]), k))
    globs = rule_globs(rules) + tuple(block_globs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(globs)
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            hit = machine.match([f".{h}{p}".encode() for h, p in zip(hosts, paths)])
            rule: list[str | None] = [None] * len(hosts)
            verdict = ["block" if x else "allow" for x in hit[:, len(rules) :].any(axis=1)]
            for k in reversed(ranked):
                for i in np.flatnonzero(hit[:, k]).tolist():
                    rule[i] = rules[k][0] + rules[k][1]
                    verdict[i] = rules[k][2]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), rest.alias("rest"))
    src = src.select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"(?s)^[^/?#]*", 0), upper, lower).alias("host"),
        F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    return src.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN contains(host, 'casino') OR contains(host, 'free-bets') OR path LIKE '%.exe' THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
