"""Operator 6: best-fit packing by a configuration linear program.

Only the histogram of piece lengths (at most ``size`` rows, whatever the input)
reaches the driver. The covering program over all configurations (multisets of
lengths that fit in one sequence) is solved by multiplicative weights: each step
prices lengths by the weight of their unmet demand, a knapsack dynamic program
finds the dearest configurations, covered lengths lose weight, and the prices give
the bound at whose stated gap it stops. The fractional solution is rounded to whole
configurations, the same program takes what rounding leaves, and a knapsack over the
stock completes the last few pieces. Pieces then find their place by rank within
their length, without a shuffle of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, tune
from .fasttok import default_path, encoder
from .text_core import buffers, pieces


def piece_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: only the first may be shorter than ``size``."""
    if n <= size:
        return [n]
    first = n % size or size
    return [first] + [size] * ((n - first) // size)


def token_pieces(docs: DataFrame, doc_id: str, text: str, size: int, end_id: int, path: str | None) -> DataFrame:
    """One row per piece; (block, idx) counts pieces of one length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or default_path())
        block = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for b in batches:
            for part in pieces(b, "text"):
                data, offs = buffers(part.column(1))
                ids, per = enc.encode(data, offs)
                ends = np.cumsum(per)
                out: list[tuple] = []
                for d, e, m in zip(part.column(0).to_pylist(), ends.tolist(), per.tolist()):
                    own = np.empty(m + 1, "<u4")
                    own[:m], own[m] = ids[e - m : e], end_id
                    at = 0
                    for k, length in enumerate(piece_lengths(m + 1, size)):
                        out.append((d, k, at, length, zlib.crc32(own[at : at + length]), block, int(seen[length])))
                        seen[length] += 1
                        at += length
                cols = list(zip(*out)) if out else [()] * 7
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "block", "idx"],
                )

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, block long, idx long")


def knapsack(lengths: np.ndarray, stock: np.ndarray, price: np.ndarray, size: int) -> dict[int, int]:
    """The dearest configuration: copies of each length, no more than in stock, that fit in ``size``."""
    rows = []
    for i, (length, m) in enumerate(zip(lengths.tolist(), stock.tolist())):
        m, k = min(m, size // length), 1
        while m > 0:  # 1, 2, 4, ... copies make up every number of them
            k = min(k, m)
            rows.append((i, k, k * length, k * float(price[i])))
            m, k = m - k, 2 * k
    best = np.zeros(size + 1)
    taken = np.zeros((len(rows), size + 1), bool)
    new = np.empty(size + 1)
    for row, (_, _, weight, value) in zip(taken, rows):
        n = size + 1 - weight
        np.add(best[:n], value, out=new[:n])
        np.greater(new[:n], best[weight:], out=row[weight:])
        np.copyto(best[weight:], new[:n], where=row[weight:])
    out: dict[int, int] = {}
    room = size
    for (i, k, weight, _), row in zip(reversed(rows), taken[::-1]):
        if row[room]:
            out[int(lengths[i])] = out.get(int(lengths[i]), 0) + k
            room -= weight
    return out


def dearest(price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of the dearest configuration within each room, any number of copies allowed, and its next piece (0: leave one free)."""
    back = np.zeros(size + 1)  # by room, the largest first
    pick = np.zeros(size + 1, np.int64)
    buf = np.empty(size)
    for room in range(1, size + 1):
        values = buf[:room]
        np.add(back[size - room + 1 :], price[1 : room + 1], out=values)
        k = int(values.argmax())
        if values[k] > back[size - room + 1]:
            back[size - room], pick[room] = values[k], k + 1
        else:
            back[size - room] = back[size - room + 1]
    return back[::-1], pick


def completions(lengths: np.ndarray, pick: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, piece): for each length the dearest configuration that contains it, piece by piece."""
    jump = np.maximum.accumulate(np.where(pick > 0, np.arange(size + 1), 0))
    i, room = np.arange(len(lengths)), jump[size - lengths]
    which, piece = [i], [lengths]
    while (more := room > 0).any():
        i, room = i[more], room[more]
        which.append(i)
        piece.append(pick[room])
        room = jump[room - pick[room]]
    which, piece = np.concatenate(which), np.concatenate(piece)
    order = np.lexsort((piece, which))
    return which[order], piece[order]


def program(demand: np.ndarray, size: int, eta: float, step: float, gap: float, near: float = 0.05, steps: int = 200) -> tuple[dict[tuple[int, ...], float], float, float]:
    """A fractional solution of the covering program, its sequences, and a lower bound on those of any solution.

    A length's price is its size times a weight that falls by the factor exp(-eta) while
    its demand is covered. One knapsack a step gives the dearest configuration and, for
    each open length, the dearest one that contains it; those whose value is ``near`` the
    dearest are used, no length for more than the share ``step`` of its demand. Any prices
    give a dual bound: the demand's price over that of the dearest configuration. It ends
    when the use, with what is open counted as filled by copies of one length, is within
    ``gap`` of the bound (or after ``steps``: the gap is then what it is).
    """
    have = np.flatnonzero(demand)
    cover = np.zeros(size + 1)
    out: dict[tuple[int, ...], float] = {}
    used = bound = 0.0
    for _ in range(steps + 1):
        lacks = np.maximum(demand[have] - cover[have], 0)
        live = have[lacks > 1e-9 * demand[have]]
        total = used + float((lacks / (size // have)).sum())
        if not len(live) or total <= (1 + gap) * bound:
            break
        worth = live / size * np.exp(-eta * cover[live] / demand[live])
        price = np.full(size + 1, -1.0)
        price[live] = worth - 1e-6 * worth.max()  # of equal values the one of fewer pieces
        best, pick = dearest(price, size)
        bound = max(bound, float((demand[live] * np.maximum(price[live], 0)).sum() / best[size]))
        lead = live[price[live] + best[size - live] >= (1 - near) * best[size]]
        which, piece = completions(lead, pick, size)
        room = np.minimum(np.maximum(demand - cover, 0), step * demand)
        use = room[lead]
        load = np.bincount(piece, use[which], size + 1)
        share = np.ones(len(lead))
        np.minimum.at(share, which, np.minimum(1, room[piece] / load[piece]))
        use = use * share
        cover += np.bincount(piece, use[which], size + 1)
        used += float(use.sum())
        cuts = np.searchsorted(which, np.arange(len(lead) + 1))
        for lo, hi, times in zip(cuts[:-1], cuts[1:], use.tolist()):
            key = tuple(piece[lo:hi].tolist())
            out[key] = out.get(key, 0.0) + times
    return out, total, bound


def fractional(demand: np.ndarray, size: int, eta: float, gap: float) -> tuple[dict[tuple[int, ...], float], float, float]:
    """The best of a few solutions, with smaller steps while the gap to the bound stays open."""
    found, total, bound = program(demand, size, eta, 1.0, gap)
    for step in (0.5, 0.25, 0.125):
        if total <= (1 + gap) * bound:
            break
        other, t, b = program(demand, size, eta, step, gap)
        bound = max(bound, b)
        if t < total:
            found, total = other, t
    return found, total, bound


def solve(demand: np.ndarray, size: int, eta: float = 3.0, gap: float = 0.03, report: list | None = None, few: int = 2000) -> list[tuple[dict[int, int], int]]:
    """Configurations with whole multiplicities that meet ``demand`` (index: length) exactly.

    The program is solved and rounded: configurations in order of use, each taken as
    often as its rounded number (full ones once at least) and the demand still open
    allow. What rounding leaves is a smaller program of the same kind, until at most
    ``few`` pieces are left or most could not be placed: then the largest piece left and
    the knapsack over the stock complete the last rounding. ``report`` gets the pieces
    that each rounding has placed.
    """
    left = demand.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []

    def use(conf: dict[int, int], times: int) -> None:
        for k, a in conf.items():
            left[k] -= a * times
        plan.append((conf, times))

    if left[size]:
        use({size: 1}, int(left[size]))
    while left.any():
        before = int(left.sum())
        found = fractional(left, size, eta, gap)[0]
        for key, times in sorted(found.items(), key=lambda kv: (-kv[1], -kv[0][-1], kv[0])):
            lengths, copies = np.unique(key, return_counts=True)
            whole = min(max(int(sum(key) == size), int(times + 1e-9)), int((left[lengths] // copies).min()))
            if whole > 0:
                use(dict(zip(lengths.tolist(), copies.tolist())), whole)
        open_ = int(left.sum())
        if open_ <= few or open_ > 0.7 * before:
            _complete(left, size, use)
        if report is not None:
            report.append(before - int(left.sum()))
    return plan


def _complete(left: np.ndarray, size: int, use) -> None:
    """Each time the largest length left with the fullest choice beside it, of equal ones that of fewest pieces."""
    while left.any():
        big = int(np.flatnonzero(left)[-1])
        stock = left[: size - big + 1].copy()
        if big < len(stock):
            stock[big] -= 1
        lengths = np.flatnonzero(stock)
        conf = knapsack(lengths, stock[lengths], lengths / size - 1e-6, size - big) if len(lengths) else {}
        conf[big] = conf.get(big, 0) + 1
        use(conf, min(int(left[k] // a) for k, a in conf.items()))


def _segments(plan: list[tuple[dict[int, int], int]], size: int) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which configuration."""
    rows, base, given = [], 0, np.zeros(size + 1, np.int64)
    for conf, times in plan:
        at = 0
        for k, a in sorted(conf.items(), reverse=True):
            rows.append((k, given[k], a, at, base))
            given[k] += a * times
            at += k * a
        base += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "offset", "sequence"), cols.T))


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 2048,
    end_id: int = 0,
    tokenizer: str | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document is its ids and ``end_id``; only longer ones are cut. A null or empty
    text is the one id ``end_id``. Repeated rows are packed once each; a null id
    stays null; other columns are ignored; an empty table gives no rows. Ties of
    length are broken by the place of a piece in its input block.
    """
    spark = docs.sparkSession
    tune(spark)
    ws = Workspace(spark, "packing")
    rows = ws.save(token_pieces(docs, doc_id, text, size, end_id, tokenizer), "pieces")
    counts = rows.groupBy("block", "length").agg(F.count("*").alias("m"))
    hist = counts.groupBy("length").agg(F.sum("m").alias("m")).collect()
    demand = np.zeros(size + 1, np.int64)
    for r in hist:
        demand[r["length"]] = r["m"]
    seg = _segments(solve(demand, size), size)
    before = F.sum("m").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("block", "length", F.coalesce(before, F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = seg["length"] << 44 | seg["rank"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            if not len(length):
                continue
            s = np.searchsorted(key, length << 44 | rank, "right") - 1
            r = rank - seg["rank"][s]
            yield pa.record_batch(
                [*b.columns[:5], pa.array(seg["sequence"][s] + r // seg["each"][s]), pa.array(seg["offset"][s] + r % seg["each"][s] * length)],
                [*b.schema.names[:5], "sequence_id", "offset"],
            )

    ranked = rows.join(base, ["block", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("idx")).alias("rank")
    )
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
