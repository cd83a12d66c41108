"""Operator 13: spelling variants of the words of a corpus.

A word's letter counts are a point. One replaced letter moves it by one up and one down, one
inserted letter by one up, so near words lie within an L1 distance of two, and a range
search in a k-d tree over the points of one length finds all words of that length or of
the length before that may be near; the order of the letters then decides.

The tree of a length is in two parts. Its top is grown on a bounded sample and cuts the
space into cells of some thousand words; a word goes to its own cell and, as a query, to
the cells that its range reaches. Inside a cell, one task grows the tree to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .lines import LOWER, UPPER

LETTERS = 26 + 64  # a to z and the code points from C0 to FF
CELL = 16384  # words of a cell, about
SAMPLE = 200_000  # words of all samples together, at most about
PER_CELL = 24  # sampled words of a cell
LEAF = 6
CHUNK = 4096  # queries searched at a time
PAIRS = 1 << 18  # pairs verified at a time
OWN, SAME, SHORTER = 0, 1, 2  # roles of a word in a cell


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 7, min_n: int = 2, typo_mod: int = 31) -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased; where ``typo_mod`` divides the crc32 of ``doc_id:run`` one letter is left out.

    A null text has no words; a null doc_id is written as nothing.
    """
    # Shorter runs stay too short: letters only go.
    runs = F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{min_chars},}}"), 0)
    src = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    src = src.select("d", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    src = src.select("run", h.alias("h"), F.char_length("run").alias("l"))
    k = (F.col("h") % F.col("l")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), k), F.substring("run", k + 2, F.col("l")))
    word = F.when(F.col("h") % typo_mod == 0, cut).otherwise(F.col("run"))
    return src.select(word.alias("word")).where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


class Words:
    """Words as code points end to end, with the places where each begins."""

    def __init__(self, listed: list[str]):
        self.size = np.fromiter(map(len, listed), np.int64, len(listed))
        self.start = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32).astype(np.int32)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Letter counts of some words, a row each."""
        size = self.size[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        c = self.codes[at]
        letter = np.where(c >= 0xC0, c - 0xC0 + 26, c - ord("a"))
        flat = np.repeat(np.arange(len(rows)), size) * LETTERS + letter
        return np.bincount(flat, minlength=len(rows) * LETTERS).reshape(-1, LETTERS).astype(np.int32)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b, as long or b longer by one, differ by one replaced or inserted letter; all a are of one length."""
        if not len(a):
            return np.zeros(0, bool)
        n = int(self.size[a[0]])
        longer = int(self.size[b[0]]) - n
        place = np.arange(n)
        x = self.codes[self.start[a][:, None] + place]
        differ = x != self.codes[self.start[b][:, None] + place]
        if not longer:
            return differ.sum(axis=1) == 1
        # Equal before some place, and after it when b is read one letter on.
        later = x != self.codes[self.start[b][:, None] + place + 1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
        last = np.where(later.any(axis=1), n - 1 - later[:, ::-1].argmax(axis=1), -1)
        return last < first


class KdTree:
    """Axis-aligned halves of points with whole coordinates; a node keeps the bounds of the cut axis in its box."""

    def __init__(self, points: np.ndarray, leaf: int):
        cut, at, left, low, high, members = [], [], [], [], [], []
        far = np.iinfo(np.int32).max // 2

        def new() -> int:
            for column, start in ((cut, -1), (at, 0), (left, -1), (low, -far), (high, far), (members, None)):
                column.append(start)
            return len(cut) - 1

        work = [(new(), np.arange(len(points)), {})]
        leaves = 0
        while work:
            node, rows, box = work.pop()
            axis, t = self._cut(points, rows, leaf)
            if axis < 0:
                members[node], at[node] = rows, leaves
                leaves += 1
                continue
            cut[node], at[node] = axis, t
            low[node], high[node] = box.get(axis, (-far, far))
            below = points[rows, axis] <= t
            left[node] = new()
            new()
            # The right half waits, so leaves are numbered from left to right.
            work.append((left[node] + 1, rows[~below], box | {axis: (t + 1, high[node])}))
            work.append((left[node], rows[below], box | {axis: (low[node], t)}))
        self.axis, self.at, self.left, self.low, self.high = (np.array(x, np.int32) for x in (cut, at, left, low, high))
        self.leaves = leaves
        self.members = [m for _, m in sorted((at[i], m) for i, m in enumerate(members) if m is not None)] if leaf else []
        # The last leaf under each node; children come after their parent.
        self.last = np.where(self.axis < 0, self.at, 0)
        for i in range(len(cut) - 1, -1, -1):
            if cut[i] >= 0:
                self.last[i] = self.last[left[i] + 1]

    @staticmethod
    def _cut(points: np.ndarray, rows: np.ndarray, leaf: int) -> tuple[int, int]:
        """The axis and place that come nearest to halving the rows; -1 for a leaf."""
        if len(rows) <= leaf:
            return -1, 0
        p = points[rows]
        none, one = np.count_nonzero(p > 0, axis=0), np.count_nonzero(p > 1, axis=0)
        half = len(rows) / 2
        best = np.abs(np.stack([none, one]) - half)
        t, axis = np.unravel_index(best.argmin(), best.shape)
        if best[t, axis] < half:
            return int(axis), int(t)
        lo, hi = p.min(axis=0), p.max(axis=0)
        axis = int((hi - lo).argmax())
        return (axis, int(lo[axis] + (hi[axis] - lo[axis] - 1) // 2)) if hi[axis] > lo[axis] else (-1, 0)

    def search(self, q: np.ndarray, up: int, down: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs whose box holds a point that is at most ``up`` above and ``down`` below the query.

        ``least``: leaves of a smaller number do not count for a query.
        """
        who = np.arange(len(q))
        node = np.zeros(len(q), np.int64)
        ups, downs = np.full(len(q), up, np.int32), np.full(len(q), down, np.int32)
        found_q, found_leaf = [], []
        while len(who):
            axis = self.axis[node]
            end = axis < 0
            if end.any():
                found_q.append(who[end])
                found_leaf.append(self.at[node[end]])
                go = ~end
                who, node, ups, downs, axis = who[go], node[go], ups[go], downs[go], axis[go]
                if not len(who):
                    break
            x, t = q[who, axis], self.at[node]
            u = ups - np.maximum(t + 1 - x, 0) + np.maximum(self.low[node] - x, 0)
            d = downs - np.maximum(x - t, 0) + np.maximum(x - self.high[node], 0)
            child = self.left[node]
            right, left = u >= 0, d >= 0
            if least is not None:
                mine = least[who]
                right &= self.last[child + 1] >= mine
                left &= self.last[child] >= mine
            who, node, ups, downs = np.concatenate([who[left], who[right]]), np.concatenate([child[left], child[right] + 1]), np.concatenate([ups[left], u[right]]), np.concatenate([d[left], downs[right]])
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_leaf).astype(np.int64)


def _tops(vocabulary: DataFrame) -> dict[int, KdTree]:
    """The top of the tree of each length with more words than a cell holds, grown on a sample."""
    sizes = vocabulary.groupBy(F.char_length("word").alias("l")).count().where(F.col("count") > CELL).collect()  # lengths, not words
    if not sizes:
        return {}
    wanted = {r["l"]: r["count"] / CELL * PER_CELL for r in sizes}
    share = min(1.0, SAMPLE / sum(wanted.values()))
    cut = F.lit(0.0)
    for r in sizes:
        cut = F.when(F.char_length("word") == r["l"], min(1.0, wanted[r["l"]] * share / r["count"])).otherwise(cut)
    picked = vocabulary.where(F.crc32(F.col("word").cast("binary")) < cut * float(1 << 32)).select("word").collect()  # SAMPLE words, about
    tops = {}
    for length in wanted:
        own = sorted(r["word"] for r in picked if len(r["word"]) == length)
        w = Words(own)
        if own:
            tops[length] = KdTree(w.counts(np.arange(len(own))), PER_CELL)
    return tops


_ROUTED = "length int, cell int, role int, word string, n long"


def _route(vocabulary: DataFrame, tops: dict[int, KdTree]) -> DataFrame:
    """A row for each word and cell: its own, those its range reaches from there on, and those of the next length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column(0).to_pylist()
            w = Words(listed)
            out = []
            for length in np.unique(w.size).tolist():
                rows = np.flatnonzero(w.size == length)
                q = w.counts(rows) if length in tops or length + 1 in tops else None
                one = np.arange(len(rows))
                if length in tops:
                    who, home = tops[length].search(q, 0, 0)
                    own = np.zeros(len(rows), np.int64)
                    own[who] = home
                    who, cell = tops[length].search(q, 1, 1, own)
                    out.append((length, cell, np.where(cell == own[who], OWN, SAME), rows[who]))
                else:
                    out.append((length, one * 0, one * 0 + OWN, rows))
                who, cell = tops[length + 1].search(q, 1, 0) if length + 1 in tops else (one, one * 0)
                out.append((length + 1, cell, cell * 0 + SHORTER, rows[who]))
            take = np.concatenate([o[3] for o in out]) if out else np.zeros(0, np.int64)
            lengths = np.concatenate([np.full(len(o[1]), o[0]) for o in out]) if out else take
            cells, roles = (np.concatenate([o[i] for o in out]) if out else take for i in (1, 2))
            at = pa.array(take)
            yield pa.record_batch([pa.array(lengths, pa.int32()), pa.array(cells, pa.int32()), pa.array(roles, pa.int32()), b.column(0).take(at), b.column(1).take(at)], ["length", "cell", "role", "word", "n"])

    return vocabulary.mapInArrow(run, _ROUTED)


def _pairs(w: Words, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All near pairs of a cell of which one word is the cell's own, each once."""
    own = np.flatnonzero(role == OWN)
    tree = KdTree(w.counts(own), LEAF)
    sizes = np.array([len(m) for m in tree.members])
    starts = np.cumsum(sizes) - sizes
    members = own[np.concatenate(tree.members)]
    home = np.empty(len(own), np.int64)
    home[np.concatenate(tree.members)] = np.repeat(np.arange(len(sizes)), sizes)
    leaf_of = np.full(len(role), -1, np.int64)
    leaf_of[own] = home
    for kind in (OWN, SAME, SHORTER):
        queries = np.flatnonzero(role == kind)
        for lo in range(0, len(queries), CHUNK):
            q = queries[lo : lo + CHUNK]
            who, leaf = tree.search(w.counts(q), 1, 0 if kind == SHORTER else 1, leaf_of[q] if kind == OWN else None)
            done = 0
            total = np.cumsum(sizes[leaf])
            while done < len(who):
                base = total[done - 1] if done else 0
                end = max(done + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
                s, f = sizes[leaf[done:end]], starts[leaf[done:end]]
                a = np.repeat(q[who[done:end]], s)
                b = members[np.repeat(f - (np.cumsum(s) - s), s) + np.arange(s.sum())]
                if kind == OWN:  # a leaf meets itself once
                    once = (leaf_of[a] < leaf_of[b]) | (a < b)
                    a, b = a[once], b[once]
                ok = w.near(a, b)
                yield a[ok], b[ok]
                done = end


_FOUND = "word string, n long, n_near long, form struct<m: long, word: string>"


def _search(cell: pa.Table) -> pa.Table:
    """For each word of a cell its near words there: their number and the one of largest n (first in order of those)."""
    listed, role, n = cell["word"].to_pylist(), cell["role"].to_numpy(), cell["n"].to_numpy()
    order = np.empty(len(listed), np.int64)
    order[sorted(range(len(listed)), key=listed.__getitem__)] = np.arange(len(listed))
    count = np.zeros(len(listed), np.int64)
    best = np.full(len(listed), -1, np.int64)
    # Words ranked by n, largest first, then by code points: the best near word has the least rank.
    rank = np.empty(len(listed), np.int64)
    by = np.lexsort((order, -n))
    rank[by] = np.arange(len(listed))
    none = len(listed)
    best = np.full(len(listed), none, np.int64)
    if (role == OWN).any():
        for a, b in _pairs(Words(listed), role):
            for x, y in ((a, b), (b, a)):
                count += np.bincount(x, minlength=none)
                np.minimum.at(best, x, rank[y])
    keep = np.flatnonzero((role == OWN) | (count > 0))
    found = [None if best[i] == none else {"m": -int(n[by[best[i]]]), "word": listed[by[best[i]]]} for i in keep]
    own = pa.array([int(n[i]) if role[i] == OWN else None for i in keep], pa.int64())
    return pa.table({"word": pa.array([listed[i] for i in keep], pa.string()), "n": own, "n_near": pa.array(count[keep]), "form": pa.array(found, pa.struct([("m", pa.int64()), ("word", pa.string())]))})


def near_words(vocabulary: DataFrame, ws: Workspace) -> DataFrame:
    """word, n, n_near, form (m: the near word's n below zero, word) of every word of a table of distinct words."""
    cells = _route(vocabulary, _tops(vocabulary)).groupBy("length", "cell").applyInArrow(_search, _FOUND)
    return cells.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("form").alias("form"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words that ``words`` finds.

    A word's form is its near word of largest n (ties: first in code-point order) if that is
    at least ``ratio`` times the word's; the root is where its forms end. Null and empty texts
    have no words, rows of one doc_id are counted each, a null doc_id is written as nothing, no
    words give no rows, and further columns of ``docs`` are not read.
    """
    ws = Workspace(docs.sparkSession, "spelling")
    vocabulary = ws.save(words(docs, doc_id, text), "words")
    found = near_words(vocabulary, ws)
    close = -F.col("form.m") >= F.col("n") * ratio
    found = ws.save(found.select("word", "n", "n_near", F.when(close, F.col("form.word")).alias("form"), F.when(close, -F.col("form.m")).alias("form_n")), "forms")
    # n grows by the ratio at each step, so chains are short; each round doubles the steps taken.
    roots = ws.save(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = ws.save(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        more = longer.where("moved").limit(1).count()
        roots = longer.select("word", "root")
        if not more:
            break
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
