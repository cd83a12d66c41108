"""Toxicity and decontamination against plain versions of their definitions."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from ledgerflow.llm import decontam
from ledgerflow.llm.text_core import buffers
from ledgerflow.llm.toxicity import Model, _train, _words


def plain_score(model, text):
    """1 - (1 - leak) * prod(1 - p) over the sentences that hold a feature."""
    quiet = 1 - model.leak
    for sentence in re.split(r"[.!?\n]", text):
        found = {w for w in _words(sentence) if w in model.words}
        if found:
            z = model.bias + sum(model.weights[model.words.index(w)] for w in found)
            quiet *= 1 - 1 / (1 + math.exp(-z))
    return 1 - quiet


def test_noisy_or():
    model = Model(["fool", "awful*"[:4] + "*", "größe", "dummköp*"[:6] + "*"], np.array([2.5, -1.0, 0.7, 1.9]), -1.2, 0.03)
    r = random.Random(1)
    parts = ["fool", "FOOL", "fools", "awfully", "awfu", "Größe", "dummköpfe", "a", "ok", ".", "!\n", "?", " ", " ", "\n\n", "日本"]
    texts = ["", ".", "fool", "a.fool.fool fool", "dummköpfe"] + [" ".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(200)] + ["x " * 30_000 + "fool"]
    data, offs = buffers(pa.array(texts))
    got = model.score(data, offs, model.lexicon())
    for t, s, lo, hi in zip(texts, got["score"], got["lo"], got["hi"]):
        assert abs(s - plain_score(model, t)) < 1e-9, t
        if lo >= 0:
            assert any(w in model.words for w in _words(t[lo:hi]))


def test_training_finds_the_maximum():
    """No small step of any parameter makes the labels likelier."""
    r = random.Random(2)
    bags, y = [], []
    for i in range(300):
        bags.append([sorted({r.randrange(4) for _ in range(r.randint(1, 2))}) for _ in range(r.randint(0, 4))])
        y.append(float(any(0 in s for s in bags[-1]) or r.random() < 0.1))
    m = _train(bags, np.array(y), {0: 1.0, 1: 1.0}, ["a", "b", "c", "d"], 3000)

    def loss(w, bias, leak):
        total = 0.0
        for s, t in zip(bags, y):
            quiet = (1 - leak) * math.prod(1 - 1 / (1 + math.exp(-(bias + sum(w[k] for k in x)))) for x in s)
            total -= math.log(min(1 - 1e-12, max(1e-12, 1 - quiet if t else quiet))) / len(y)
        return total + 0.5e-5 * sum((x - 2.0) ** 2 for x in w)

    least = loss(m.weights, m.bias, m.leak)
    for k in range(4):
        for d in (-0.05, 0.05):
            w = m.weights.copy()
            w[k] += d
            assert loss(w, m.bias, m.leak) >= least - 1e-4
    assert loss(m.weights, m.bias + 0.05, m.leak) >= least - 1e-4 and loss(m.weights, m.bias - 0.05, m.leak) >= least - 1e-4


def smith_waterman(item, doc):
    best, row = 0, [0] * (len(doc) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(doc, 1):
            new.append(max(0, row[j - 1] + (2 if a == b else -1), row[j] - 1, new[j - 1] - 1))
            best = max(best, new[j])
        row = new
    return best / (2 * len(item))


def test_alignment_of_edited_copies(spark):
    """All pairs by full alignment: none is named that scores less, and edited copies are found."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    items = [[word() for _ in range(r.randint(12, 40))] for _ in range(10)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(r.randint(0, 60))]
        if i % 3:
            copy = [w if r.random() > (0, 0.1, 0.2, 0.3, 0.5)[i % 5] else word() for w in items[i % 10]]
            if i % 4 == 0:
                del copy[len(copy) // 2]
            at = r.randint(0, len(body))
            body = body[:at] + copy + body[at:]
        docs.append(body)
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    t = spark.createDataFrame([(i, ", ".join(x).upper()) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontam.contaminated(d, t).collect()}
    want = {(i, k): s for i, x in enumerate(docs) for k, y in enumerate(items) if (s := smith_waterman(y, x)) >= 0.5}
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and len(want) > 25
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
