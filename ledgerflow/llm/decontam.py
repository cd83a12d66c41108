"""Operator 4: benchmark decontamination by rare seeds and local alignment.

Word n-grams of the test items that are rare in the corpus are the seeds. A seed
found in a document proposes a window around it, and the Smith-Waterman score of
the item's words against that window, relative to a perfect copy, decides. Edited
and paraphrased copies keep some rare n-grams and most of their words in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .text_core import buffers, pieces, shingles, span_hashes, spans_of, trim

MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 16 << 20  # test-item text handled (and broadcast) at once
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals (bytes C3 80-9E but 97) in lower case."""
    out = _FOLD[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    x = data[at]
    out[at[(x >= 0x80) & (x <= 0x9E) & (x != 0x97)]] += 32
    return out


def words_of(data: np.ndarray, offs: np.ndarray):
    low = folded(data) if len(data) else data
    s, e, per = spans_of(low, offs, _WORD)
    return span_hashes(low, s, e, False), per, s, e


@dataclass
class Items:
    """One block of test items: words, and which seed stands where."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted distinct n-gram hashes
    first: np.ndarray  # rows of each seed in the two arrays below
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str], n: int) -> "Items":
        data, offs = buffers(pa.array(texts, pa.string()))
        h, per, _, _ = words_of(data, offs)
        run, m = shingles(h, per, n, short=False)
        item = np.repeat(np.arange(len(ids)), m)
        place = np.arange(len(run)) - np.repeat(np.cumsum(m) - m, m)
        ends = np.cumsum(per)
        return cls(ids, [h[e - k : e] for e, k in zip(ends, per)], *cls._index(run, item, place))

    @staticmethod
    def _index(run, item, place):
        order = np.lexsort((place, item, run))
        run, item, place = run[order], item[order], place[order]
        seeds, first = np.unique(run, return_index=True)
        return seeds, np.append(first, len(run)), item, place

    def rarest(self, df: np.ndarray, share: float, least: int) -> "Items":
        """Keep each item's rarest n-grams: ``share`` of them, at least ``least``.

        The choice is by rank within the item, so an item copied into very many
        documents still has seeds.
        """
        run = np.repeat(self.seeds, np.diff(self.first))
        freq = np.repeat(df, np.diff(self.first))
        order = np.lexsort((self.place, freq, self.item))
        item = self.item[order]
        size = np.bincount(item, minlength=len(self.ids))
        rank = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
        keep = order[rank < np.maximum(np.ceil(size * share), least)[item]]
        return Items(self.ids, self.words, *self._index(run[keep], self.item[keep], self.place[keep]))

    def filter(self) -> np.ndarray:
        flags = np.zeros(1 << 20, bool)
        flags[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return flags

    def find(self, run: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``run`` that hold a seed, and which."""
        at = np.flatnonzero(flags[(run & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.seeds) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.seeds, run[at]), len(self.seeds) - 1)
        ok = self.seeds[k] == run[at]
        return at[ok], k[ok]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local score of ``item`` within ``window`` and the word where it ends.

    One row a word of the item; the gap along a row is a running maximum.
    """
    j = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        t = np.zeros_like(row)
        t[1:] = row[:-1] + np.where(window == w, MATCH, MISMATCH)
        t = np.maximum(t, row + GAP)
        row = np.maximum(np.maximum.accumulate(t - GAP * j) + GAP * j, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _doc_hits(items: Items, flags: np.ndarray, part: pa.RecordBatch, n: int):
    data, offs = buffers(part.column(1))
    h, per, s, e = words_of(data, offs)
    run, m = shingles(h, per, n, short=False)
    at, seed = items.find(run, flags)
    run_ends = np.cumsum(m)
    doc = np.searchsorted(run_ends, at, "right")
    return data, offs, h, per, s, e, doc, at - (run_ends - m)[doc], seed


def _matches(items: Items, part: pa.RecordBatch, flags: np.ndarray, n: int, threshold: float) -> list[tuple]:
    data, offs, h, per, s, e, doc, pos, seed = _doc_hits(items, flags, part, n)
    if not len(doc):
        return []
    size = np.diff(items.first)[seed]
    row = np.repeat(items.first[seed], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    doc, pos, item = np.repeat(doc, size), np.repeat(pos, size), items.item[row]
    start = pos - items.place[row]
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    length = np.array([len(w) for w in items.words], np.int64)[item]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > length[1:])
    firsts = np.flatnonzero(cut)
    lasts = np.append(firsts[1:], len(doc)) - 1
    ends = np.cumsum(per)
    found: dict[tuple[int, int], tuple] = {}
    for f, l in zip(firsts.tolist(), lasts.tolist()):
        d, i = int(doc[f]), int(item[f])
        words = items.words[i]
        slack = max(5, len(words) // 2)
        base = int(ends[d] - per[d])
        lo = max(0, int(start[f]) - slack)
        hi = min(int(per[d]), int(start[l]) + len(words) + slack)
        score, end = align(words, h[base + lo : base + hi])
        rel = score / (MATCH * len(words))
        if rel >= threshold and (found.get((d, i)) or (-1.0,))[0] < rel:
            found[d, i] = (rel, base + lo, base + lo + end - 1)
    out = []
    ids = part.column(0)
    for (d, i), (rel, lo, last) in found.items():
        lead = (data[offs[d] : e[last]] & 0xC0) != 0x80
        out.append((ids[d].as_py(), items.ids[i], rel, int(lead[: s[lo] - offs[d]].sum()), int(lead.sum())))
    return out


def _blocks(items: DataFrame, item_id: str, text: str, unnamed: bool) -> Iterator[list]:
    """Blocks of test items of at most BLOCK_BYTES of text each, streamed to the driver."""
    rows = items.where(F.col(text).isNotNull() & (F.col(item_id).isNotNull() | F.lit(unnamed)))
    rows = rows.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).distinct().orderBy("id", "text").coalesce(4)
    block, size = [], 0
    for r in rows.toLocalIterator():
        own = len(r["text"].encode())
        if block and size + own > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(r)
        size += own
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 3,
    share: float = 0.6,
    least: int = 8,
    threshold: float = 0.5,
    unnamed: bool = False,
) -> DataFrame:
    """doc_id, item_id, score, start, end: the documents that hold a copy of an item.

    score is the alignment score over that of a perfect copy (threshold to 1); start
    and end (code points) span the window up to the last aligned word. One row for
    each document row and item, with the best window. Null and empty texts match
    nothing, neither do items of fewer than ``n`` words; repeated items count once;
    rows with one doc_id are judged each; a null doc_id stays null. Items without an
    id count with ``unnamed`` (item_id null), else not. Other columns are ignored. The items go to the tasks in blocks of bounded size, one pass each.
    """
    spark = docs.sparkSession
    tune(spark)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, score double, start long, end long"
    out = None
    for block in _blocks(items, item_id, item_text, unnamed):
        every = Items.of([r["id"] for r in block], [r["text"] for r in block], n)
        out_block = _search(src, every, n, share, least, threshold, schema)
        out = out_block if out is None else out.unionByName(out_block)
    return out if out is not None else spark.createDataFrame([], schema)


def reject(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 3, share: float = 0.6, least: int = 8, threshold: float = 0.5,
    unnamed: bool = False,
) -> DataFrame:
    """``docs`` without the rows that hold a copy of an item; the columns stay. ``unnamed``: items without an id count too."""
    tune(docs.sparkSession)
    out = docs
    for block in _blocks(items, item_id, item_text, unnamed):
        every = Items.of([r["id"] for r in block], [r["text"] for r in block], n)
        rare = _rare(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), every, n, share, least)

        def run(batches: Iterator[pa.RecordBatch], rare=rare) -> Iterator[pa.RecordBatch]:
            flags = rare.filter()
            for b in batches:
                for p in pieces(b, text):
                    rows = pa.record_batch([pa.array(np.arange(p.num_rows)), p.column(p.schema.get_field_index(text))], ["doc_id", "text"])
                    keep = np.ones(p.num_rows, bool)
                    keep[[m[0] for m in _matches(rare, rows, flags, n, threshold)]] = False
                    yield p.filter(pa.array(keep))
            trim()

        out = out.mapInArrow(run, docs.schema)
    return out


def _search(src: DataFrame, every: Items, n: int, share: float, least: int, threshold: float, schema: str) -> DataFrame:
    items = _rare(src, every, n, share, least)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = items.filter()
        for b in batches:
            for p in pieces(b, "text"):
                got = _matches(items, p, flags, n, threshold)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "score", "start", "end"])

    return src.mapInArrow(match, schema)


def _rare(src: DataFrame, every: Items, n: int, share: float, least: int) -> Items:
    """The items with their rarest seeds, by document frequency over all of ``src``."""

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = every.filter()
        df = np.zeros(len(every.seeds), np.int64)
        for b in batches:
            for p in pieces(b, "text"):
                *_, doc, _, seed = _doc_hits(every, flags, p, n)
                once = np.unique(doc * len(df) + seed) if len(doc) else doc
                df += np.bincount(once % max(1, len(df)), minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], ["seed", "m"])

    rows = src.mapInArrow(frequency, "seed long, m long").groupBy("seed").agg(F.sum("m").alias("m")).collect()
    df = np.zeros(len(every.seeds), np.int64)
    for r in rows:  # at most one row a seed of this block
        df[r["seed"]] = r["m"]
    return every.rarest(df, share, least)
