"""Operator 3: toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from its words
and their beginnings, and the document's is their noisy-or:
1 - (1 - leak) * prod(1 - p). Weights and leak are trained from document labels
alone; afterwards the sentences with a high probability are the offending ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, fit_cut, fit_hash, tune
from .text_core import buffers, pieces, span_hashes, spans_of, trim

THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)  # code points; longer words also count by how they begin, as "begin*"
_WORD = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


def _words(text: str) -> set[str]:
    """The features of a text: its words, and the beginnings of its longer ones."""
    found = set(_WORD.findall(text.translate(_LOWER)))
    return found | {w[:k] + "*" for w in found for k in PREFIXES if len(w) > k}


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    bias: float
    leak: float

    def lexicon(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By kind (0: whole words, else code points of a beginning): sorted hashes and their features."""
        out = {}
        for kind in (0, *PREFIXES):
            own = [i for i, w in enumerate(self.words) if (len(w) - 1 if w.endswith("*") else 0) == kind]
            raw = [self.words[i].rstrip("*").encode() for i in own]
            size = np.array([len(r) for r in raw], np.int64)
            ends = np.cumsum(size)
            h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - size, ends, True)
            order = np.argsort(h)
            out[kind] = h[order], np.array(own, np.int64)[order]
        return out

    @staticmethod
    def hits(data: np.ndarray, s: np.ndarray, e: np.ndarray, lexicon) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions of words with a feature, and the feature."""
        places, features = [], []
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(heads, s) if any(len(k) for n, (k, _) in lexicon.items() if n) else None
        for kind, (keys, feature) in lexicon.items():
            if not len(keys):
                continue
            at, end = s, e
            if kind:
                stop = np.append(heads, np.full(kind + 1, len(data)))[first + kind]
                longer = stop < e
                at, end = s[longer], stop[longer]
            h = span_hashes(data, at, end, True)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            ok = keys[k] == h
            places.append(at[ok])
            features.append(feature[k[ok]])
        return (np.concatenate(places), np.concatenate(features)) if places else (s[:0], s[:0])

    def score(self, data: np.ndarray, offs: np.ndarray, lexicon) -> dict[str, np.ndarray]:
        n = len(offs) - 1
        quiet = np.full(n, np.log1p(-self.leak))
        out = {"offending": np.zeros(n, np.int32), "lo": np.full(n, -1, np.int64), "hi": np.full(n, -1, np.int64)}
        s, e, _ = spans_of(data, offs, _WORD_BYTE)
        if len(self.words) and len(s):
            pos, word = self.hits(data, s, e, lexicon)
            if len(pos):
                doc = np.searchsorted(offs, pos, "right") - 1
                stops = np.flatnonzero(_STOP[data])
                sent = np.searchsorted(stops, pos)
                # a word counts once in a sentence
                _, first = np.unique(np.stack([doc, sent, word]), axis=1, return_index=True)
                doc, sent, word = doc[first], sent[first], word[first]
                bag, inv = np.unique(np.stack([doc, sent]), axis=1, return_inverse=True)
                z = self.bias + np.bincount(inv.ravel(), self.weights[word], bag.shape[1])
                p = 1 / (1 + np.exp(-z))
                quiet += np.bincount(bag[0], np.log1p(-np.minimum(p, 1 - 1e-12)), n)
                bad = p >= 0.5
                out["offending"] = np.bincount(bag[0][bad], minlength=n).astype(np.int32)
                worst = np.lexsort((bag[1], -p, bag[0]))
                for k in worst[np.unique(bag[0][worst], return_index=True)[1]]:
                    if not bad[k]:
                        continue
                    d, j = int(bag[0][k]), int(bag[1][k])
                    lo = max(offs[d], stops[j - 1] + 1 if j else 0)
                    hi = min(offs[d + 1], stops[j] + 1 if j < len(stops) else len(data))
                    lead = (data[offs[d] : hi] & 0xC0) != 0x80  # code points begin here
                    out["lo"][d] = int(lead[: lo - offs[d]].sum())
                    out["hi"][d] = int(lead.sum())
        out["score"] = np.clip(-np.expm1(quiet), 0, 1)
        return out


def _sample(labels: DataFrame, doc_id: str, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .where(crc_mod(doc_id, 3) != 1)
        .groupBy(F.col(doc_id).cast("long").alias("id"))
        .agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    )
    totals = {r["y"]: r["m"] for r in known.groupBy("y").agg(F.count("*").alias("m")).collect()}
    first = Window.partitionBy("y").orderBy("h", "id")
    cut = F.when(F.col("y") == 1, fit_cut(F.lit(float(totals.get(1, 1))), per_class)).otherwise(fit_cut(F.lit(float(totals.get(0, 1))), per_class))
    few = known.withColumn("h", fit_hash("id")).where(F.col("h") < cut)
    return few.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= per_class).select("id", "y"), totals


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_class: int, max_words: int, steps: int = 800) -> Model:
    """Train on at most ``per_class`` labelled documents of each class.

    They are those whose crc32 of the id comes first; a cut of that hash comes before
    the ranking. Of the texts of one id the first in order counts, equal texts count once.
    """
    chosen, totals = _sample(labels, doc_id, label, per_class)
    own = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    bag = own.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    bag = bag.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"]).select("id", "text", "y")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        size = [0, 0]
        for b in batches:
            for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                seen[y].update(_words(t))
                size[y] += 1
        rows = [(w, seen[1][w], seen[0][w]) for w in seen[0].keys() | seen[1].keys()] + [("", size[1], size[0])]
        yield pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["w", "p", "n"])

    stats = bag.mapInArrow(words, "w string, p long, n long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    size = stats.where("w = ''").first()
    if size is None or not size["p"] or not size["n"]:
        share = float(totals.get(1, 0)) / max(1, sum(totals.values()))
        return Model([], np.zeros(0), 0.0, min(share, 0.69))
    pos, neg = float(size["p"]), float(size["n"])
    # Log-odds of the classes over its standard error: words that mark label 1.
    p, n = F.col("p") + 0.5, F.col("n") + 0.5
    odds = F.log(p / (F.lit(pos + 1) - p)) - F.log(n / (F.lit(neg + 1) - n))
    top = (
        stats.where("w <> '' and p >= 3")
        .withColumn("z", odds / F.sqrt(1 / p + 1 / n))
        .where("z >= 3")
        .orderBy(F.desc("z"), "w")
        .limit(max_words)
        .collect()
    )
    vocab = {r["w"]: k for k, r in enumerate(top)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                sents = ({vocab[w] for w in _words(x) if w in vocab} for x in re.split(r"[.!?\n]", t))
                out.append([sorted(x) for x in sents if x])
            yield pa.record_batch([b.column(2).cast(pa.int32()), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["y", "s"])

    rows = bag.mapInArrow(bags, "y int, s array<array<int>>").collect()
    weight = {k: totals.get(k, 0) / max(1.0, pos if k else neg) for k in (0, 1)}
    return _train([r["s"] for r in rows], np.array([r["y"] for r in rows], float), weight, [r["w"] for r in top], steps)


def _train(bags: list, y: np.ndarray, weight: dict[int, float], words: list[str], steps: int) -> Model:
    """Weighted log-likelihood of the noisy-or, by Adam on all bags at once."""
    m = len(words)
    doc = np.array([i for i, s in enumerate(bags) for _ in s], np.int64)
    sent = np.array([k for k, x in enumerate(x for s in bags for x in s) for _ in x], np.int64)
    word = np.array([w for s in bags for x in s for w in x], np.int64)
    c = np.where(y > 0, weight[1], weight[0])
    c = c / c.sum()
    theta = np.concatenate([np.full(m, 2.0), [-1.0, -3.0]])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[m] + np.bincount(sent, theta[word], len(doc))
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        leak = np.clip(1 / (1 + np.exp(-theta[m + 1])), 1e-9, 0.5)
        quiet = np.log1p(-leak) + np.bincount(doc, np.log1p(-p), len(y))
        loud = np.clip(-np.expm1(quiet), 1e-9, 1 - 1e-9)
        # d loss / d quiet, with quiet = log of the chance that no sentence is toxic
        g = c * np.where(y > 0, np.exp(quiet) / loud, -1.0)
        gz = g[doc] * -p
        grad = np.concatenate([np.bincount(word, gz[sent], m), [gz.sum(), (g * -leak).sum()]])
        grad[:m] += 1e-5 * (theta[:m] - 2.0)
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        theta = theta - 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    leak = float(np.clip(1 / (1 + np.exp(-theta[m + 1])), 0, 0.5))
    return Model(words, theta[:m], float(theta[m]), leak)


def score(docs: DataFrame, model: Model, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for b in batches:
            for p in pieces(b, "text"):
                data, offs = buffers(p.column(1))
                r = model.score(data, offs, lexicon)
                yield pa.record_batch(
                    [p.column(0), pa.array(r["score"]), pa.array((r["score"] >= THRESHOLD).astype(np.int32)), pa.array(r["offending"]), pa.array(r["lo"]), pa.array(r["hi"])],
                    ["doc_id", "score", "predicted", "n_offending", "worst_start", "worst_end"],
                )

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "doc_id long, score double, predicted int, n_offending int, worst_start long, worst_end long")


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 5000, max_words: int = 600
) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, worst_start, worst_end for every row.

    worst_start and worst_end are the code points of the likeliest offending sentence
    (-1 if none). An empty or null text has the leak as score. Without labels of both
    classes the score is the share of label 1, at most 0.69. Repeated labels of one
    id count as the highest. Rows with one id are scored each; a null id has held_out
    null. Other columns are ignored.
    """
    tune(docs.sparkSession)
    model = fit(docs, labels, doc_id, text, label, per_class, max_words)
    out = score(docs, model, doc_id, text)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_offending", "worst_start", "worst_end")


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 5000, max_words: int = 600) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; columns and order of columns stay."""
    tune(docs.sparkSession)
    model = fit(docs, labels, doc_id, text, label, per_class, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for b in batches:
            for p in pieces(b, text):
                data, offs = buffers(p.column(p.schema.get_field_index(text)))
                yield p.filter(pa.array(model.score(data, offs, lexicon)["score"] < THRESHOLD))
        trim()

    return docs.mapInArrow(run, docs.schema)
