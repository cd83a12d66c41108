"""K-means behind n-simplex bounds against plain integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from ledgerflow.llm import centroids as ce
from ledgerflow.llm.queries import QUERIES, SQL


def brute(rows, k=8, rounds=10, dim=64, scale=1024):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-ce.LIMIT, min(ce.LIMIT, math.floor(scale * float(x)))) for x in v]))
    name = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        where = assign()
        for j in range(len(centers)):
            own = [v for (_, v), (_, w) in zip(kept, where) if w == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, w, min(d, ce.LONGEST)) for (i, _), (d, w) in zip(kept, assign())]
    per = {j: sum(d for _, w, d in out if w == j) for j in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    fit = lambda x: min(x, ce.LONGEST)
    return [(i, w, d, fit(per[w]), fit(sum(per.values())), sha[w]) for i, w, d in out]


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance string")
    return [tuple(r) for r in ce.report(df).collect()]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


def with_extras(rows):
    return [(i, v, "c", "d") for i, v in rows]


def test_query_against_brute_force_and_sql(spark, sf_dir):
    got = [tuple(r) for r in QUERIES["op11_centroids_simplex"](spark, sf_dir).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    rows = duckdb.sql(f"select vec_id, embedding from '{sf_dir}/embeddings.parquet'").fetchall()
    assert same(got, brute(rows))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = con.sql(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({SQL['op11_centroids_simplex']})").fetchall()
    assert same(got, want)


def test_clustered_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    homes = rng.normal(size=(6, 64))
    rows = [(i, (homes[i % 6] + 0.05 * rng.normal(size=64)).tolist()) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [float("nan")] + [0.0] * 63), (204, [float("inf")] + [0.0] * 63), (205, [None] + [0.0] * 63)]
    rows += [(3, rows[3][1]), (None, [0.0] * 64), (206, [0.0] * 64), (207, [-0.00001] * 64)]
    assert same(found(spark, with_extras(rows)), brute(rows))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert same(found(spark, with_extras(rows)), brute(rows))


def test_equal_vectors_tie_to_the_first_centroid(spark):
    rows = [(i, [0.25] * 64) for i in range(20)]
    got = found(spark, with_extras(rows))
    assert same(got, brute(rows)) and {g[1] for g in got} == {0}


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 8 * 5)).tolist()) for i in range(40)] + [(90, [1e300] * 64), (91, [-1e300] * 64)]
    assert same(found(spark, with_extras(rows)), brute(rows))


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(3)
    homes = rng.normal(size=(8, 64)) * 300
    v = np.floor(homes[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 64)) * 15).astype(np.int64)
    centers = np.floor(homes).astype(np.int64)
    s = ce.Simplex(v[:500], 12)
    a, b = s.apexes(v), s.apexes(centers)
    true = np.stack([ce.squared(v, np.broadcast_to(c, v.shape)) for c in centers], axis=1)
    flat = np.square(a[:, None, :-1] - b[None, :, :-1]).sum(axis=2)
    low, high = flat + np.square(a[:, None, -1] - b[None, :, -1]), flat + np.square(a[:, None, -1] + b[None, :, -1])
    assert (low <= true * (1 + 1e-6) + 1).all() and (high >= true * (1 - 1e-6) - 1).all()
    which, d, computed = ce.nearest(v, a, centers, b)
    assert (which == true.argmin(axis=1)).all() and (d == true.min(axis=1)).all()
    assert computed < 0.3 * true.size  # most comparisons are filtered


def test_flat_pools_give_fewer_pivots():
    pool = np.outer(np.arange(50), np.ones(64, np.int64)).astype(np.int64)
    s = ce.Simplex(pool, 12)
    assert len(s.pivots) == 2
    assert len(ce.Simplex(pool[:1], 12).pivots) == 1
