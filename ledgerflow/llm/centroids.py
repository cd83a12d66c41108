"""Operator 11: k-means over integer vectors, its comparisons filtered by n-simplex projection.

A few vectors are the pivots; their simplex is laid out once in as few dimensions. The
distances of a vector to the pivots fix it as an apex over that simplex, and the apexes
are kept in a table. Between two apexes the Euclidean distance is a lower bound of the
true one, and the distance with one altitude turned over an upper bound. A centroid whose
lower bound is above the least upper bound of a vector cannot be its nearest; the others
are compared exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

LIMIT = 1 << 62  # components beyond it are set to it
SAFE = 1 << 27  # below it 64 squares of differences fit 64 bits
LONGEST = (1 << 63) - 1
POOL = 1024  # vectors among which the pivots are sought
SUMS = pa.list_(pa.decimal128(38, 0))


class Simplex:
    """Pivots and the frame in which a vector's distances to them become its apex."""

    def __init__(self, pool: np.ndarray, n: int):
        # The next pivot is the vector highest over the simplex so far; flat ones would blur the bounds.
        x = pool.astype(np.float64)
        rest = x - x[0]
        taken, base = [0], []
        first = None
        while len(taken) < n:
            height = (rest * rest).sum(axis=1)
            far = int(height.argmax())
            first = height[far] if first is None else first
            if height[far] <= 1e-6 * max(first, 1.0):
                break
            axis = rest[far] / np.sqrt(height[far])
            base.append(axis)
            rest = rest - np.outer(rest @ axis, axis)
            taken.append(far)
        self.pivots = pool[taken]
        edges = x[taken[1:]] - x[0]
        self.side = (edges * edges).sum(axis=1)
        # Row i: pivot i + 1 in the frame, a lower triangle.
        self.inverse = np.linalg.inv(np.tril(edges @ np.array(base).T)) if base else np.zeros((0, 0))

    def apexes(self, v: np.ndarray) -> np.ndarray:
        """Coordinates over the pivots' simplex and, last, the altitude."""
        d = np.stack([np.square(v.astype(np.float64) - p.astype(np.float64)).sum(axis=1) for p in self.pivots], axis=1)
        y = (d[:, :1] + self.side - d[:, 1:]) / 2 @ self.inverse.T
        return np.concatenate([y, np.sqrt(np.maximum(d[:, 0] - (y * y).sum(axis=1), 0.0))[:, None]], axis=1)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v and c, as 64-bit integers or, where these could overflow, as Python's."""
    most = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0))
    if most >= SAFE or v.shape[-1] > 64:
        v, c = v.astype(object), c.astype(object)
    d = v - c
    return (d * d).sum(axis=1)


def nearest(v: np.ndarray, apex: np.ndarray, centers: np.ndarray, center_apex: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), the squared distance, and how many were computed."""
    flat = np.square(apex[:, None, :-1] - center_apex[None, :, :-1]).sum(axis=2)
    low = flat + np.square(apex[:, None, -1] - center_apex[None, :, -1])
    high = flat + np.square(apex[:, None, -1] + center_apex[None, :, -1])
    # Rounding of the apexes is relative to their size; the exact comparison decides what is left.
    blur = 1e-6 * (np.square(apex).sum(axis=1)[:, None] + np.square(center_apex).sum(axis=1)[None, :] + 1)
    at, which = np.nonzero(low - blur <= (high + blur).min(axis=1)[:, None])
    d = squared(v[at], centers[which])
    order = np.lexsort((which, d, at)) if d.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], d[i], which[i])), np.int64)
    first = order[np.searchsorted(at[order], np.arange(len(v)))]
    return which[first], d[first], len(at)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _whole(vectors: DataFrame, vec_id: str, embedding: str, dim: int, scale: int) -> DataFrame:
    """vec_id, v: the vectors of ``dim`` finite components as integers."""
    x = F.col(embedding).cast("array<double>")
    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    src = src.where((F.size("x") == dim) & F.forall("x", fine))
    part = lambda c: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), c * F.lit(float(scale))))).cast("long")
    return src.select("vec_id", F.transform("x", part).alias("v"))


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", n_pivots: int = 12
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept are vectors of ``dim`` components that are all finite numbers; a component x becomes
    floor(scale * x), at most 2 ** 62 in size. Centroids start as the k vectors whose sha256 of
    ``seed:vec_id`` is smallest (fewer if fewer are kept; rows of one id by their components; a
    null id comes last) and are moved ``rounds`` times to the floor of their vectors' mean; one
    without vectors stays. Once no centroid moves, further rounds would change nothing and are
    left out. Equal distances go to the smaller number; a distance beyond 64 bits is the
    largest that fits. No kept vector: no rows. ``n_pivots`` pivots are sought among the
    first 1024 vectors in the order of the start. Each round is one job that sends
    a count and ``dim`` sums a cluster.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "centroids")
    whole = ws.save(_whole(vectors, vec_id, embedding, dim, scale), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    pool = [r["v"] for r in whole.orderBy(rank.asc_nulls_last(), "v").select("v").limit(max(POOL, k)).collect()]
    if not pool:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64)
    pool = np.array(pool, np.int64)
    simplex, centers = Simplex(pool, n_pivots), pool[:k]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apex = simplex.apexes(_matrix(b.column(1), dim))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(list(apex), pa.list_(pa.float64()))], ["vec_id", "v", "apex"])

    kept = ws.save(whole.mapInArrow(project, "vec_id long, v array<long>, apex array<double>"), "apexes")
    width = len(simplex.pivots)

    def sums(centers: np.ndarray) -> DataFrame:
        over = simplex.apexes(centers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(centers), dim), object), np.zeros(len(centers), np.int64)
            for b in batches:
                v = _matrix(b.column(0), dim)
                which, _, _ = nearest(v, _matrix(b.column(1), width), centers, over)
                wide = np.abs(v).max(initial=0) >= 1 << 40
                for c in np.unique(which).tolist():
                    rows = v[which == c]
                    total[c] += (rows.astype(object) if wide else rows).sum(axis=0).astype(object)
                    count[c] += len(rows)
            has = np.flatnonzero(count)
            parts = [[Decimal(int(x)) for x in total[c]] for c in has]
            yield pa.record_batch([pa.array(has, pa.int32()), pa.array(count[has], pa.int64()), pa.array(parts, SUMS)], ["cluster", "n", "s"])

        per = kept.select("v", "apex").mapInArrow(run, "cluster int, n long, s array<decimal(38,0)>")
        return per.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dim)]).alias("s"))

    for _ in range(rounds):
        moved = centers.copy()
        for r in sums(centers).collect():  # k rows
            moved[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
        if (moved == centers).all():
            break
        centers = moved

    over = simplex.apexes(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, d, _ = nearest(_matrix(b.column(1), dim), _matrix(b.column(2), width), centers, over)
            yield pa.record_batch([b.column(0), pa.array(which, pa.int32()), pa.array([min(int(x), LONGEST) for x in d], pa.int64())], ["vec_id", "cluster", "distance"])

    return ws.save(kept.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned"), centers


def report(vectors: DataFrame) -> DataFrame:
    """The vectors with their cluster, the distances summed over it and over all, and the digest of its centroid."""
    found, centers = cluster(vectors)
    spark = vectors.sparkSession
    names = spark.createDataFrame([(i, sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centers)], "cluster int, centroid_sha256 string")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    fits = lambda c: F.least(c, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    every = per.agg(F.sum("own").alias("every"))
    # A row a cluster, k in all.
    per = per.join(names, "cluster").crossJoin(every).select("cluster", fits(F.col("own")).alias("cluster_inertia"), fits(F.col("every")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024) -> str:
    """The same without projection: every vector against every centroid, a table a round."""

    def assign(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT vec_id, rn, v, unnest(arg_min({{'c': c, 'd': d, 'm': m}}, {{'d': d, 'c': c}}, 1)) AS w FROM (
    SELECT vec_id, rn, v, c, m, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept CROSS JOIN c{r}) GROUP BY vec_id, rn, v)"""

    def move(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(x.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list(f ORDER BY i) AS m FROM (
    SELECT w.c AS c, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f FROM a{r}, range(1, {dim + 1}) AS t(i) GROUP BY 1, 2) GROUP BY c) x USING (c))"""

    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) AS rn, vec_id, v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}))""",
        f"c0 AS MATERIALIZED (SELECT CAST(rn - 1 AS INTEGER) AS c, v AS m FROM kept WHERE rn <= {k})",
    ]
    for r in range(rounds):
        steps += [assign(r), move(r)]
    steps.append(assign(rounds))
    return f"""WITH {', '.join(steps)}
SELECT vec_id, w.c AS cluster, w.d AS distance, CAST(sum(w.d) OVER (PARTITION BY w.c) AS BIGINT) AS cluster_inertia, CAST(sum(w.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w.m, ',')) AS centroid_sha256 FROM a{rounds}"""


SQL = _sql()
