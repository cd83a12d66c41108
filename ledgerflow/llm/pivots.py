"""Operator 10: embedding near-duplicates by a pivot-permutation index.

A bounded sample of vectors are the pivots. A vector is described by its nearest
pivots in order; the inverted list of each pair among its first ``top`` holds it,
so two vectors meet in a list exactly when they share two pivots. Every meeting
is verified by its cosine, and counted in the list of its two lowest shared
pivots only. Equal vectors are one class with a weight. A long list is cut into
blocks that meet pairwise; a task sends link counts and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, tune
from .graph import components

BLOCK = 1024
MAX_PIVOTS = 2048


def _first(n_pivots: int) -> int:
    """How many nearest pivots a vector is listed by: 4 up to 32 pivots, one more for each fourfold.

    Among more pivots two near vectors share fewer of a fixed number of first ones.
    """
    return 4 + max(0, math.ceil(math.log(max(n_pivots, 1) / 32, 4)))


def _units(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, dim, name (of the exact vector), unit (float64 bytes); dim 0 for those that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, names, units = np.zeros(b.num_rows, np.int32), [b""] * b.num_rows, [b""] * b.num_rows
            column = b.column(1)
            flat, sizes = column.flatten(), column.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            whole = flat.is_valid().to_numpy(zero_copy_only=False)
            every = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            every = np.where(whole, every, np.nan)
            # Rows of one length are one matrix.
            for d in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == d)
                m = every[(ends[rows] - d)[:, None] + np.arange(d)]
                ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                rows, m = rows[ok], m[ok]
                m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow in the norm
                m = m / np.sqrt((m * m).sum(axis=1, keepdims=True)) + 0.0
                dims[rows] = d
                for i, u in zip(rows.tolist(), m):
                    units[i] = u.tobytes()
                    names[i] = hashlib.md5(units[i]).digest()
            yield pa.record_batch([b.column(0), pa.array(dims, pa.int32()), pa.array(names, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "dim", "name", "unit"])

    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return src.mapInArrow(run, "vec_id long, dim int, name binary, unit binary")


def _apart(pool: np.ndarray, n: int, limit: float = 0.7) -> np.ndarray:
    """The first n vectors of the pool that are not close to one taken before.

    Pivots out of one hot family would stand in random order for its members.
    """
    taken: list[int] = []
    for i in range(len(pool)):
        if len(taken) < n and (not taken or (pool[taken] @ pool[i]).max() < limit):
            taken.append(i)
    return pool[taken]


def _lists(classes: DataFrame, pivots: dict[int, np.ndarray], top: int | None) -> DataFrame:
    """One row per class and pair of its first pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            vec, weight = b.column(0).to_numpy(), b.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                p = pivots[d]
                first = min(len(p), _first(len(p)) if top is None else top)
                units = b.column(3).take(pa.array(rows))
                m = np.frombuffer(b"".join(units.to_pylist())).reshape(-1, d)
                near = np.sort(np.argsort(-(m @ p.T), axis=1, kind="stable")[:, :first], axis=1)
                # fewer than two pivots: one list for all
                pairs = list(combinations(range(first), 2))
                xs = [near[:, i] for i, _ in pairs] or [np.zeros(len(rows), np.int64)]
                ys = [near[:, j] for _, j in pairs] or [np.zeros(len(rows), np.int64)]
                each = np.tile(np.arange(len(rows)), len(xs))
                listed = pa.array(near.tolist(), pa.list_(pa.int32()))
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(each), d), pa.int32()), pa.array(np.concatenate(xs), pa.int32()), pa.array(np.concatenate(ys), pa.int32()),
                        pa.array(vec[rows][each]), pa.array(weight[rows][each]), units.take(pa.array(each)), listed.take(pa.array(each)),
                    ],
                    ["dim", "x", "y", "vec", "w", "unit", "near"],
                )

    return classes.select("vec", "dim", "w", "unit").mapInArrow(run, "dim int, x int, y int, vec long, w long, unit binary, near array<int>")


def _verify(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """kind 0: (a, links of a); kind 1: (a, b) of a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        dim, x, y, i, j = (table[c][0].as_py() for c in ("dim", "x", "y", "i", "j"))
        vec, w, blk = (table[c].to_numpy() for c in ("vec", "w", "blk"))
        m = np.frombuffer(b"".join(table["unit"].to_pylist())).reshape(-1, dim)
        near = np.full((len(vec), max(len(n) for n in table["near"])), -1)
        for k, n in enumerate(table["near"].to_pylist()):
            near[k, : len(n)] = n
        early = np.where((near < y) & (near != x), near, -1)
        left = np.flatnonzero(blk == i)
        right = left if i == j else np.flatnonzero(blk == j)
        links = np.zeros(len(vec), np.int64)
        parent = {}

        def root(v):
            while parent.get(v, v) != v:
                parent[v] = parent.get(parent[v], parent[v])
                v = parent[v]
            return v

        edges = []
        for lo in range(0, len(left), 256):
            a = left[lo : lo + 256]
            s, t = np.nonzero(m[a] @ m[right].T >= threshold)
            s, t = a[s], right[t]
            keep = (vec[s] < vec[t]) if i == j else np.ones(len(s), bool)
            s, t = s[keep], t[keep]
            # another shared pivot below y: a lower list counts this pair
            both = (early[s][:, :, None] == early[t][:, None, :]) & (early[s] >= 0)[:, :, None]
            own = ~both.any(axis=(1, 2))
            s, t = s[own], t[own]
            np.add.at(links, s, w[t])
            np.add.at(links, t, w[s])
            for p, q in zip(vec[s].tolist(), vec[t].tolist()):
                rp, rq = root(p), root(q)
                if rp != rq:
                    parent[max(rp, rq)] = min(rp, rq)
                    edges.append((p, q))
        some = np.flatnonzero(links)
        kind = [0] * len(some) + [1] * len(edges)
        a = vec[some].tolist() + [e[0] for e in edges]
        b = links[some].tolist() + [e[1] for e in edges]
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    size = rows.groupBy("dim", "x", "y").agg(F.count("*").alias("m")).where("m > 1")
    size = size.withColumn("nb", F.ceil(F.col("m") / F.lit(block)).cast("long"))
    met = (
        rows.join(size, ["dim", "x", "y"])
        .withColumn("blk", F.pmod(F.xxhash64("vec"), F.col("nb")))
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        .select("dim", "x", "y", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "vec", "w", "unit", "near")
    )
    return met.groupBy("dim", "x", "y", "i", "j").applyInArrow(run, "kind int, a long, b long")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, top: int | None = None, n_pivots: int | None = None
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero or hold a null or non-finite component link
    with nothing, as do vectors of different lengths. Rows with one vec_id count as
    vectors each; a null vec_id is outside every link (n_links 0, component null,
    kept null). Pivots are at most ``n_pivots`` vectors of a length, the first of a
    sample of four times as many (smallest crc32 of the id) that are not close to one
    before (default: half the square root of the vectors, 32 to 2048). Vectors meet
    when they share two of their ``top`` nearest pivots (default: 4 to 7, by the
    number of pivots).
    """
    spark = vectors.sparkSession
    tune(spark)
    ws = Workspace(spark, "pivots")
    unit = ws.save(_units(vectors, vec_id, embedding), "units")
    ok = unit.where("dim > 0 and vec_id is not null")
    classes = ws.save(ok.groupBy("dim", "name").agg(F.min("vec_id").alias("vec"), F.count("*").alias("w"), F.min("unit").alias("unit")), "classes")
    if n_pivots is None:
        n_pivots = int(min(MAX_PIVOTS, max(32, classes.count() ** 0.5 / 2)))
    first = Window.partitionBy("dim").orderBy(F.crc32(F.col("vec").cast("string").cast("binary")), "vec")
    sample = classes.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 4 * n_pivots).select("dim", "r", "unit").collect()
    pivots = {}
    for d in {r["dim"] for r in sample}:
        pool = np.array([np.frombuffer(bytes(r["unit"])) for r in sorted((r for r in sample if r["dim"] == d), key=lambda r: r["r"])])
        pivots[d] = _apart(pool, n_pivots)
    found = ws.save(_verify(_lists(classes, pivots, top), threshold, BLOCK), "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("vec")).agg(F.sum("b").alias("others"))
    comp = components(found.where("kind = 1").select("a", "b"), ws).withColumnsRenamed({"node": "vec", "comp": "low"})
    known = classes.join(links, "vec", "left").join(comp, "vec", "left").select("dim", "name", "vec", "w", "others", "low")
    out = unit.join(known.withColumnsRenamed({"dim": "kd", "name": "kn"}), (F.col("dim") == F.col("kd")) & (F.col("name") == F.col("kn")) & (F.col("dim") > 0), "left")
    linked = F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
    n_links = F.when(linked, F.col("w") - 1 + F.coalesce("others", F.lit(0))).otherwise(F.lit(0)).cast("long")
    component = F.when(linked, F.coalesce("low", "vec")).otherwise(F.col("vec_id"))
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
