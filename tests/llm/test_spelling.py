"""Spelling variants against deletion neighbourhoods in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ledgerflow.llm import spelling as sp
from ledgerflow.llm.common import Workspace
from ledgerflow.llm.queries import QUERIES

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def counted(docs):
    n = Counter()
    for d, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    return {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}


def neighbours(n):
    gaps = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i] + "*" + w[i + 1 :]].add(w)
            gaps[w[:i] + w[i + 1 :]].add(w)
    near = {}
    for w in n:
        s = set(gaps.get(w, ()))
        for i in range(len(w)):
            s |= gaps[w[:i] + "*" + w[i + 1 :]]
            s |= {w[:i] + w[i + 1 :]} & n.keys()
        near[w] = s - {w}
    return near


def brute(docs):
    n = counted(docs)
    near, form = neighbours(n), {}
    for w, s in near.items():
        best = min(s, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        r = w
        while r in form:
            r = form[r]
        out.append((w, form.get(w), r, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def found(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], "doc_id long, text string, word string, n int, form string")
    return [tuple(r) for r in sp.variants(df).collect()]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("cell", [sp.CELL, 300])
def test_query_against_brute_force(spark, sf_dir, cell, monkeypatch):
    """In one cell a length, and cut into cells."""
    monkeypatch.setattr(sp, "CELL", cell)
    got = [tuple(r) for r in QUERIES["op13_spelling_variants"](spark, sf_dir).collect()]
    want = brute(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    assert same(got, want) and sum(g[4] for g in got) > 1000


def test_chains_of_forms_and_ties(spark):
    texts = ["working " * 2000, "worling " * 200, "worlings " * 20, "worlingsx " * 2, "abcdefgh " * 30, "abcdefgi " * 30, "abcdefgj " * 2]
    docs = [(i * 2 + 1001, t) for i, t in enumerate(texts)]
    got = {g[0]: g[1:] for g in found(spark, docs)}
    assert same(found(spark, docs), brute(docs))
    assert got["worlingsx"][:2] == ("worlings", "working") and got["abcdefgj"][0] == "abcdefgh"


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "short words only"), (None, "nowhere nowhere nowhere"), (4, "ÀÉÎÕÜàé " * 3 + "àÉÎÕÜàé " * 40), (5, "x" * 40_000), (6, "x" * 40_000 + " " + "x" * 40_001), (7, "x" * 40_001)]
    docs += [(8, "letters letters"), (8, "letters letters"), (8, "letters letters")]
    assert same(found(spark, docs), brute(docs))
    assert found(spark, []) == [] and found(spark, [(1, "none here")]) == []


def test_anagrams_and_repeated_letters(spark):
    rng = random.Random(4)
    base = list("abcdefg")
    words = {"".join(rng.sample(base, 7)) for _ in range(300)} | {w + c for w in ("aaaaaaa", "aaaaaab", "aabbaabb") for c in "abc"} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa"}
    words |= {w[:i] + "z" + w[i:] for w in list(words)[:50] for i in (0, 3, 7)}
    docs = [(i, " ".join([w] * rng.choice([2, 3, 40]))) for i, w in enumerate(sorted(words))]
    assert same(found(spark, docs), brute(docs))


@pytest.mark.parametrize("leaf", [1, 6, 50])
def test_range_search_finds_all_and_little_else(leaf):
    """Each point that is one up and one down away is in a leaf that the search returns."""
    rng = np.random.default_rng(leaf)
    points = rng.poisson(0.4, size=(2000, sp.LETTERS)).astype(np.int32)
    points[::2] = points[1::2]  # half of them moved by one letter
    points[np.arange(0, 2000, 2), rng.integers(0, sp.LETTERS, 1000)] += 1
    tree = sp.KdTree(points, leaf)
    leaf_of = np.empty(len(points), np.int64)
    for k, m in enumerate(tree.members):
        leaf_of[m] = k
    for up, down in ((1, 1), (1, 0)):
        who, leaves = tree.search(points, up, down)
        pairs = set(zip(who.tolist(), leaves.tolist()))
        assert len(pairs) == len(who)
        for q in range(0, 2000, 7):
            d = points - points[q]
            near = np.flatnonzero((np.maximum(d, 0).sum(axis=1) <= up) & (np.maximum(-d, 0).sum(axis=1) <= down))
            assert all((q, leaf_of[p]) in pairs for p in near)
        assert len(pairs) < 0.3 * len(points) * tree.leaves
    who, leaves = tree.search(points, 1, 1, leaf_of)
    assert (leaves >= leaf_of[who]).all()


def test_pairs_come_from_the_search(spark, monkeypatch):
    """A tree that finds nothing leaves no near words: there is no other path."""
    v = spark.createDataFrame([("letters", 5), ("lettres", 3), ("lettern", 2)], "word string, n long")
    assert {r.n_near for r in sp.near_words(v, Workspace(spark, "t")).collect()} == {1, 0}
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(sp.KdTree, "search", lambda *a, **k: (none, none))
    cell = sp.pa.table({"length": [7, 7], "cell": [0, 0], "role": [0, 0], "word": ["letters", "lettern"], "n": [5, 2]})
    assert sp._search(cell)["n_near"].to_pylist() == [0, 0]
