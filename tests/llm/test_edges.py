"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import chat, decontam, jaccard, langid, packing, pii, pivots, toxicity, urlfilter, wavelet

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
TEXTS = [(1, None), (2, ""), (3, "  \t\n "), (4, LONG), (5, "a b c d e f"), (5, "a b c d e f"), (6, "A B c d e f"), (None, "x y z"), (7, "?!"), (8, "one"), (9, "ONE"), (10, "it's\n\n  <|endoftext|> 日本語 é")]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns take names that the operators use inside."""
    rows = [(i, t, "en", "src0", len(t or ""), i, "h", 1.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, tokens string, score double").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (4, None), (None, 1), (5, 0), (5, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "x y z"), (4, "x")], "item_id long, text string")


def test_pii(docs):
    out = pii.report(docs).collect()
    assert len(out) == len(TEXTS) and all(r["spans"] == "" and r["n_email"] == 0 for r in out)
    assert pii.redact(docs).schema == docs.schema
    assert pii.report(docs.limit(0)).count() == 0


def test_langid(docs):
    out = langid.identify(docs).collect()
    assert len(out) == len(TEXTS)
    said = {r["doc_id"]: r for r in out}
    assert said[1]["lang_pred"] == said[2]["lang_pred"] == said[7]["lang_pred"] == "und"
    assert said[None]["held_out"] is None and said[4]["lang_pred"] == "en"
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} <= {"und"}


def test_toxicity(docs, labels):
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(TEXTS)
    assert toxicity.reject(docs, labels).schema == docs.schema


def test_decontam(docs, items):
    out = sorted((r["doc_id"] or 0, r["item_id"], r["score"]) for r in decontam.contaminated(docs, items).collect())
    assert out == [(5, 1, 1.0), (5, 1, 1.0), (6, 1, 1.0)]
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    kept = decontam.reject(docs, items)
    assert kept.schema == docs.schema and kept.count() == len(TEXTS) - 3


def test_jaccard(docs):
    out = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard(docs).collect())
    assert out == sorted([(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 6, 4), (5, 3, 5), (5, 3, 5), (6, 3, 5), (7, 1, 7), (8, 1, 8), (9, 1, 8), (10, 1, 10)])
    assert jaccard.ngram_jaccard(docs.limit(0)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 7, 8, 10]


def test_jaccard_families(spark):
    """A hot family, a shared passage and tiny limits, so that every path runs, against all pairs."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(60)]
    line = [word() for _ in range(12)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3, 6))):
            w[r.randrange(60)] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(line + [word() for _ in range(r.choice((1, 2, 8, 30)))])) for i in range(60)]
    rows += [(200 + i, " ".join(base)) for i in range(20)]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                root[b] = a
    got = {d["doc_id"]: d["component_id"] for d in jaccard.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), bucket=5, block=16).collect()}
    assert got == {i: top(i) for i in sets}


def test_packing(docs):
    out = packing.pack(docs).collect()
    per = {}
    for r in out:
        per.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
    assert per[1] == per[2] == [(0, 1)] and len(per[5]) == 2 and len(per[None]) == 1
    assert sorted(per[4])[1:] == [(k, 2048) for k in range(1, len(per[4]))]
    assert packing.pack(docs.limit(0)).count() == 0


def test_chat_and_urls(spark):
    conv = spark.createDataFrame([(1, None, None, None, 5), (1, 1, "assistant", "x" * 200_000, 5), (1, 1, "assistant", "x" * 200_000, 5), (None, 2, "user", "", 5)], "conv_id long, turn long, role string, text string, formatted long")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.format_and_read_back(conv).collect()}
    assert got == {1: (3, 400_000), None: (1, 0)}
    pages = spark.createDataFrame([(1, "x://a.org/" + "y" * 50_000, "h"), (1, None, "h"), (None, "x://a.org/", "h")], "page_id long, url string, host string")
    assert sorted((r["page_id"] or 0, r["rule"] or "") for r in urlfilter.filter_urls(pages).collect()) == [(0, "org/"), (1, ""), (1, "org/")]
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_wavelet(docs):
    out = wavelet.wavelet_documents(docs).collect()
    assert len(out) == len(TEXTS)
    order = sorted(out, key=lambda r: r["start"])
    assert order[0]["doc_id"] is None and order[0]["start"] == 0
    for a, b in zip(order, order[1:]):
        assert a["start"] + a["n_tokens"] == b["start"]
    assert wavelet.wavelet_documents(docs.limit(0)).count() == 0


def test_pivots_blocks(spark):
    """A hot class and a hot family over several blocks count every link once."""
    import numpy as np

    r = np.random.default_rng(0)
    base = r.normal(size=16)
    rows = [(i, (base + r.normal(size=16) * 0.02).tolist()) for i in range(120)] + [(500 + i, base.tolist()) for i in range(40)] + [(900 + i, r.normal(size=16).tolist()) for i in range(60)]
    old, pivots.BLOCK = pivots.BLOCK, 25
    try:
        got = {x["vec_id"]: x["n_links"] for x in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    finally:
        pivots.BLOCK = old
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = ((m @ m.T) >= 0.95).sum(1) - 1
    have = np.array([got[i] for i, _ in rows])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
