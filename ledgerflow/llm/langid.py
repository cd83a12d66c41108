"""Operator 2: language by rank-order n-gram profiles.

A language's profile is its most frequent letter n-grams (1 to 3 letters, word
edges marked) in order. All n-grams of a document are put in the same order and the
most frequent of them, as many as a profile has, are compared: its distance to a
language is the sum of how far each of them is out of place, an absent one counting
the whole profile length. Texts are scored whole, as arrays of a batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, fit_cut, fit_hash, tune
from .text_core import pieces

EDGE = "_"


def _letters() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            t[cp] = True
    return t


_cache: dict[str, object] = {}


def letters() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = _letters()
    return _cache["letters"]


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with 0 around each, and the text each belongs to."""
    low = [(t or "").lower() for t in texts]
    cps = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in low], np.int64)
    return cps, np.concatenate([[0], np.repeat(np.arange(len(low)), sizes)])


def count_grams(texts: list[str]) -> Counter:
    cps, _ = code_points(texts)
    c = np.where(letters()[cps], cps, 0).astype(np.int64)
    out: Counter = Counter()
    for gram, n in _grams(c):
        keys, counts = np.unique(gram, return_counts=True)
        for k, m in zip(keys.tolist(), counts.tolist()):
            parts = [(k >> 21 * j) & 0x1FFFFF for j in range(n)]
            out["".join(chr(p) if p else EDGE for p in reversed(parts))] += m
    return out


def _grams(c: np.ndarray):
    yield c[c > 0], 1
    two = (c[:-1] > 0) | (c[1:] > 0)
    yield (c[:-1] << 21 | c[1:])[two], 2
    mid = c[1:-1] > 0
    yield (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[mid], 3


@dataclass
class Profiles:
    """Languages in alphabetical order, the n-grams of any of them, and rank[language, n-gram] (``depth``: absent)."""

    languages: list[str]
    grams: list[str]
    ranks: np.ndarray
    depth: int

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams as three code points (0: nothing, 1: an edge), and the ranks with a last column for absent ones."""
        digits = [[1 if ch == EDGE else ord(ch) for ch in g] + [0] * (3 - len(g)) for g in self.grams]
        absent = np.full((len(self.languages), 1), self.depth, self.ranks.dtype)
        return np.array(digits, np.int64).reshape(-1, 3), np.hstack([self.ranks, absent])

    def score(self, texts: list[str | None], tables) -> tuple[list[str], np.ndarray]:
        points, ranks = tables
        n_docs = len(texts)
        cps, doc = code_points(texts)
        own = np.zeros(0x110000, bool)
        own[cps] = True
        own &= letters()
        code = np.ones(0x110000, np.int64)  # all but letters are edges
        base = int(own.sum()) + 2
        code[own] = np.arange(2, base)
        if n_docs > 1 and n_docs * base**3 >= 1 << 63:
            half = n_docs // 2
            (x, p), (y, q) = self.score(texts[:half], tables), self.score(texts[half:], tables)
            return x + y, np.concatenate([p, q])
        c = code[cps]
        word = c > 1
        two = np.flatnonzero(word[:-1] | word[1:])
        mid = np.flatnonzero(word[1:-1])
        # One number for an n-gram of a text, in the order of text and n-gram.
        keys = np.concatenate([
            doc[word] * base**3 + c[word] * base**2,
            doc[two + ~word[two]] * base**3 + c[two] * base**2 + c[two + 1] * base,
            doc[mid + 1] * base**3 + (c[mid] * base + c[mid + 1]) * base + c[mid + 2],
        ])
        keys.sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(keys)))
        keys = keys[at]
        who, gram = keys // base**3, keys % base**3
        # The first ``depth`` of each text by count, then n-gram, which is their order here.
        order = _by_text_and_count(who, count)
        per = np.bincount(who, minlength=n_docs)
        place = np.arange(len(order)) - np.repeat(np.cumsum(per) - per, per)
        order, place = order[place < self.depth], place[place < self.depth]
        who, gram = who[order], gram[order]
        # The n-grams of the profiles that these letters can make.
        known = np.flatnonzero(((points < 2) | own[points]).all(axis=1))
        digit = np.where(points[known] < 2, points[known], code[points[known]])
        mine = (digit[:, 0] * base + digit[:, 1]) * base + digit[:, 2]
        sort = np.argsort(mine)
        column = np.full(len(gram), len(self.grams))
        if len(mine):
            k = np.minimum(np.searchsorted(mine[sort], gram), len(mine) - 1)
            hit = mine[sort][k] == gram
            column[hit] = known[sort][k[hit]]
        listed = np.bincount(who, minlength=n_docs)
        far = np.empty((n_docs, len(self.languages)))
        for i in range(len(self.languages)):
            r = ranks[i][column]
            far[:, i] = np.bincount(who, np.where(r >= self.depth, self.depth, np.abs(r - place)), n_docs)
        far /= np.maximum(listed * self.depth, 1)[:, None]
        best = far.argmin(1)
        score = np.where(listed > 0, 1.0 - far[np.arange(n_docs), best], 0.0)
        return [self.languages[b] if m else "und" for b, m in zip(best, listed)], np.clip(score, 0, 1)


def _by_text_and_count(who: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The order by text, then falling count, then place: one sort of packed numbers where they fit in 63 bits."""
    low, mid = len(who).bit_length(), int(count.max(initial=0)).bit_length()
    if low + mid + int(who.max(initial=0)).bit_length() > 63:
        return np.lexsort((-count, who))
    packed = (who << (low + mid)) | (((1 << mid) - 1 - count) << low) | np.arange(len(who))
    packed.sort()
    return packed & ((1 << low) - 1)


def fit(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int, depth: int) -> Profiles:
    """Profiles from at most ``per_language`` labelled texts of each language.

    They are the ones whose crc32 of the id comes first, so the choice does not
    depend on partitions. A cut of the hash leaves little more than ``per_language``
    ids of a language before any are ranked.
    """
    src = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).where(crc_mod(doc_id, 5) != 0)
    ids = src.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang")).withColumn("h", fit_hash("id"))
    room = ids.groupBy("lang").agg(fit_cut(F.count("*"), per_language).alias("cut"))  # a row for each language
    first = Window.partitionBy("lang").orderBy("h", "id")
    chosen = (
        ids.join(F.broadcast(room), "lang")
        .where(F.col("h") < F.col("cut"))
        .withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") <= per_language)
        .select("id", "lang")
        .distinct()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for b in batches:
            for p in pieces(b, "text"):
                for t, name in zip(p.column(0).to_pylist(), p.column(1).to_pylist()):
                    total.setdefault(name, Counter()).update(count_grams([t]))
        rows = [(name, g, m) for name, c in total.items() for g, m in c.items()]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], ["lang", "gram", "m"])

    own = src.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    grams = own.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("text", "lang").mapInArrow(run, "lang string, gram string, m long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("m").alias("m"))
    top = Window.partitionBy("lang").orderBy(F.desc("m"), "gram")
    rows = grams.withColumn("r", F.row_number().over(top) - 1).where(F.col("r") < depth).collect()
    languages = sorted({r["lang"] for r in rows})
    names = sorted({r["gram"] for r in rows})
    at = {g: i for i, g in enumerate(names)}
    ranks = np.full((len(languages), len(names)), depth, np.int64)
    for r in rows:
        ranks[languages.index(r["lang"]), at[r["gram"]]] = r["r"]
    return Profiles(languages, names, ranks, depth)


def predict(docs: DataFrame, profiles: Profiles, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = profiles.tables() if profiles.languages else None
        for b in batches:
            for p in pieces(b, "text", 1 << 20):
                texts = p.column(1).to_pylist()
                if profiles.languages:
                    names, score = profiles.score(texts, tables)
                else:
                    names, score = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.record_batch([p.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1000, depth: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    A null text, or one without a letter, is ``und`` with score 0; so is every text
    when nothing is labelled. N-grams that a profile lacks count as out of place by its
    whole length; if all are, the first language by name is named with score 0. Equal distances
    go to the first language by name. Rows with one id are predicted each; a null
    id has held_out null. Other columns are ignored.
    """
    tune(docs.sparkSession)
    profiles = fit(docs, doc_id, text, lang, per_language, depth)
    out = predict(docs, profiles, doc_id, text)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
