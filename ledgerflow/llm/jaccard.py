"""Operator 5: n-gram Jaccard join over a token-group matrix.

Two documents link when ``num * |A u B| <= 100 * |A n B|`` for their sets of
word shingles. The join is exact (up to 64-bit hash collisions):

1. Texts with equal sets form one class; the smallest id represents it.
2. Classes are sorted by their smallest shingle under a hash; a run with one such
   shingle is a group of similar sets, cut at ``block`` classes. Classes alone in
   their run are sorted again by a second and a third hash. A class that stays
   alone is a group of one.
3. The texts of the representatives travel to their group. Each group gets its
   token union; inside it the union's postings give all overlaps, and the
   members that link form stars around their best connected one.
4. The matrix of tokens and groups is kept sparse and by columns: a chunk of groups
   sends each of its tokens once, with the number of groups that hold it. A token
   of one group only can link nothing to another group.
5. A set lists the rarest p = n - ceil(t n) + 1 of its tokens, rare in groups first;
   linked sets share one. Most lists are empty, because their tokens are of one group.
6. Groups that meet in a list first compare the centres of their stars; a set then
   probes the groups whose part of a list belongs to another component. Its overlap
   with the group's union bounds every overlap there, and only groups whose bound
   reaches the threshold are opened.

No pair of one class or one component is made after step 3, a hot token travels once
a chunk, and the members that ask a hot group are dealt over copies of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Workspace, tune
from .graph import components
from .text_core import buffers, pieces, shingles, splitmix, trim, word_hashes

BUCKET = 64  # entries of a list that are paired by array passes
BLOCK = 512  # classes of a token group
GROUP_TOKENS = 1 << 20  # tokens of a token group
CHUNK_TOKENS = 1 << 21  # tokens of a chunk of groups
HELD_CHARS = 1 << 20  # characters of the texts of one compressed value
ASKERS = 2048  # probing sets that one copy of a group serves
HOT = 1000  # copies of one text that make its class a hot key
SENT = 2_000_000  # representatives (32 bytes each) that are broadcast to their texts; more are joined by a shuffle
SPARE_BITS = 13  # bits of a counted key beyond those of the number of tokens: few of them share a key by chance


def prefix_len(n, num: int):
    """p: a set of n may lack p - 1 of its shingles in a linked one."""
    return n - (n * num + 99) // 100 + 1


def _sets(batch: pa.RecordBatch, text: str, k: int) -> list[np.ndarray]:
    data, offs = buffers(batch.column(batch.schema.get_field_index(text)))
    h, per, _, _ = word_hashes(data, offs)
    run, n = shingles(h, per, k)
    ends = np.cumsum(n)
    return [np.unique(run[e - m : e]) for e, m in zip(ends, n)]


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """Rows c1, c2 (a 128-bit name of the set), k1, k2, k3 (smallest hashes); 0 for an empty set."""
    n = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((5, len(n)), np.int64)
    full = n > 0
    if full.any():
        t, at = np.concatenate(sets), (np.cumsum(n) - n)[full]
        out[0, full] = np.add.reduceat(splitmix(t ^ np.uint64(0xA5A5)), at).view(np.int64)
        out[1, full] = np.add.reduceat(splitmix(t * np.uint64(3) + np.uint64(7)), at).view(np.int64)
        for j in range(3):
            out[2 + j, full] = np.minimum.reduceat(splitmix(t + np.uint64(0x51ED2701 * (j + 1))), at).view(np.int64)
    return out


def _table(kinds: dict[str, pa.DataType], columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))


def signatures(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id, n (size of the set), c1, c2, k1, k2, k3 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, "text"):
                sets = _sets(part, "text", k)
                cols = [pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, _names(sets))]
                yield pa.record_batch([part.column(0), *cols], ["doc_id", "n", "c1", "c2", "k1", "k2", "k3"])
        trim()

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "doc_id long, n long, c1 long, c2 long, k1 long, k2 long, k3 long")


_CLASS = "c long, c2 long, n long, rep long, k1 long, k2 long, k3 long"


def groups(classes: DataFrame, ws: Workspace, parts: int, block: int) -> DataFrame:
    """c, c2, n, rep, gid: every class with its group of similar sets."""

    def cut(which: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(list(batches))
            if not held.num_rows:
                return
            k, n, rep = (held[x].to_numpy() for x in (f"k{which}", "n", "rep"))
            rows = np.arange(len(k))
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            first = np.maximum.accumulate(np.where(new, rows, 0))
            upto = np.cumsum(n) - n
            pos, tokens = (rows - first) // block, (upto - upto[first]) // GROUP_TOKENS
            new[1:] |= (pos[1:] != pos[:-1]) | (tokens[1:] != tokens[:-1])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(k)))
            held = held.append_column("gid", pa.array(np.repeat(rep[at], size))).append_column("m", pa.array(np.repeat(size, size)))
            yield from held.to_batches(max_chunksize=10_000)

        return run

    left, done = classes, []
    for j in range(3):
        order = [*(f"k{(j + i) % 3 + 1}" for i in range(3)), "n", "c", "rep"]
        left = left.select("c", "c2", "n", "rep", "k1", "k2", "k3").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        got = ws.save(left.mapInArrow(cut(j + 1), f"{_CLASS}, gid long, m long"), f"runs{j}")
        done.append(got.where("m > 1"))
        left = got.where("m = 1")
    out = left
    for d in done:
        out = out.unionByName(d)
    return out.select("c", "c2", "n", "rep", "gid")


class TokenGroup:
    """Similar sets with the union of their tokens and, for each token, the members that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        flat = flat[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        self.at = np.append(np.flatnonzero(new), len(flat))
        self.union = flat[new]

    def linked(self, q: np.ndarray, num: int) -> np.ndarray:
        """Which members link with the set ``q``."""
        if not len(self.union):
            return np.zeros(len(self.sizes), bool)
        x = np.minimum(np.searchsorted(self.union, q), len(self.union) - 1)
        x = x[self.union[x] == q]
        # |q n d| <= |q n union| for every member d, and a link needs t * max(|q|, |d|).
        if 100 * len(x) < num * max(len(q), int(self.sizes.min())):
            return np.zeros(len(self.sizes), bool)
        lo, many = self.at[x], self.at[x + 1] - self.at[x]
        rows = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(self.owner[rows], minlength=len(self.sizes))
        return 100 * both >= num * (len(q) + self.sizes - both)


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _stars(reps: np.ndarray, sets: list[np.ndarray], num: int) -> list[tuple[int, int, int]]:
    """(member, centre, members of its star) for the components inside one group."""
    group, forest = TokenGroup(sets), _Forest()
    degree = np.zeros(len(sets), np.int64)
    for i, s in enumerate(sets):
        hits = np.flatnonzero(group.linked(s, num))
        degree[i] = len(hits)
        for j in hits[hits > i].tolist():
            forest.join(i, j)
    parts: dict[int, list[int]] = {}
    for i in range(len(sets)):
        parts.setdefault(forest.root(i), []).append(i)
    out = []
    for own in parts.values():
        if len(own) > 1:
            centre = min(own, key=lambda i: (-degree[i], reps[i]))
            out += [(int(reps[i]), int(reps[centre]), len(own)) for i in own]
    return out


_PLACED = ["chunk", "gid", "c", "c2", "rep", "text"]


def _texts(docs: DataFrame, doc_id: str, text: str, members: DataFrame, chunks: int) -> DataFrame:
    """The texts of the representatives with their group and its chunk."""
    src = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    return src.join(members, "rep").withColumn("chunk", F.pmod(F.xxhash64("gid"), F.lit(chunks))).select(*_PLACED)


def _held(texts: pa.Table, compressor) -> bytes:
    """Rows gid, c, rep, text as one compressed value: the texts travel to their lists as a few rows a chunk."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema) as out:
        out.write_table(texts)
    return compressor.compress(sink.getvalue())


def _pack(keys: np.ndarray, counts: np.ndarray, compressor) -> bytes:
    """Sorted keys as gaps and 32-bit counts, in byte planes."""
    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    planes = np.minimum(counts, 2**32 - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return compressor.compress(np.ascontiguousarray(gaps).tobytes() + np.ascontiguousarray(planes).tobytes())


def _unpack(blob: bytes, decompressor) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(decompressor.decompress(blob), np.uint8)
    n = len(raw) // 12
    gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").reshape(-1)
    counts = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").reshape(-1)
    return np.cumsum(gaps, dtype=np.uint64), counts.astype(np.int64)


_COUNTED = {"kind": pa.int32(), "chunk": pa.int64(), "span": pa.int32(), "keys": pa.binary(), "a": pa.int64(), "b": pa.int64(), "m": pa.int64()}


def _matrix(placed: DataFrame, k: int, num: int, spans: int, width: int) -> DataFrame:
    """kind 0: the tokens of a chunk in one span of the key space, with their groups; kind 1: stars (a, b, m); kind 2: texts.

    A token's key is its ``width`` highest bits.
    """
    low = np.uint64(64 - width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        # chunk, gid, c, rep, set, text of the classes read so far
        held: list[tuple[int, int, int, int, np.ndarray, str]] = []
        size = 0

        def emit(rows):
            out, keys = [], []
            for _, of_group in groupby(rows, key=lambda r: r[1]):
                own = {r[2]: r for r in of_group}  # a repeated row of one class counts once
                sets = [r[4] for r in own.values()]
                if len(sets) > 1:
                    out += [(1, rows[0][0], None, None, *s) for s in _stars(np.array([r[3] for r in own.values()]), sets, num)]
                    keys.append(np.unique(np.concatenate(sets) >> low))
                else:
                    keys.append(sets[0] >> low)
            key, many = np.unique(np.concatenate(keys), return_counts=True)
            cut = np.searchsorted(key, np.arange(spans, dtype=np.uint64) * np.uint64((1 << width) // spans))
            cut = np.append(cut, len(key))
            for i in range(spans):
                if cut[i] < cut[i + 1]:
                    out.append((0, rows[0][0], i, _pack(key[cut[i] : cut[i + 1]], many[cut[i] : cut[i + 1]], z), None, None, None))
            yield _table(_COUNTED, zip(*out))
            lo = size = 0
            for i, r in enumerate(rows):
                size += len(r[5] or "")
                if size > HELD_CHARS or i + 1 == len(rows):
                    own = rows[lo : i + 1]
                    texts = pa.table({"gid": [x[1] for x in own], "c": [x[2] for x in own], "rep": [x[3] for x in own], "text": pa.array([x[5] for x in own], pa.large_string())})
                    yield _table(_COUNTED, ([2], [r[0]], [None], [_held(texts, z)], [None], [None], [None]))
                    lo, size = i + 1, 0

        def whole(last: bool):
            """Cut the held rows by chunk; the last group may go on."""
            nonlocal held, size
            end = len(held)
            if not last:
                while end and held[end - 1][1] == held[-1][1]:
                    end -= 1
            for _, rows in groupby(held[:end], key=lambda r: r[0]):
                yield from emit(list(rows))
            held = held[end:]
            size = sum(len(r[4]) for r in held)

        for b in batches:
            for part in pieces(b, "text"):
                sets = _sets(part, "text", k)
                chunk, gid, c, c2, rep = (part.column(i).to_numpy() for i in range(5))
                names = _names(sets)
                texts = part.column(5).to_pylist()
                # rows with the id of a representative and another text go
                for i in np.flatnonzero((names[0] == c) & (names[1] == c2)).tolist():
                    held.append((int(chunk[i]), int(gid[i]), int(c[i]), int(rep[i]), sets[i], texts[i]))
                    size += len(sets[i])
                if size > CHUNK_TOKENS:
                    yield from whole(False)
        yield from whole(True)
        trim()

    placed = placed.repartition("chunk").sortWithinPartitions("chunk", "gid", "c")
    return placed.mapInArrow(run, "kind int, chunk long, span int, keys binary, a long, b long, m long")


def _shared(counted: DataFrame) -> DataFrame:
    """chunk, span, keys: the tokens of each chunk that two or more groups hold, with their number."""

    def merge(table: pa.Table) -> pa.Table:
        z, c = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        keys, counts = zip(*(_unpack(x.as_py(), z) for x in table["keys"]))
        size = [len(x) for x in keys]
        flat, total = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(flat, kind="stable")
        flat, total = flat[order], total[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        each = np.add.reduceat(total, np.flatnonzero(new))[np.cumsum(new) - 1]
        back = np.empty(len(flat), np.int64)
        back[order] = each
        blobs, chunk, lo = [], [], 0
        for x, m, own in zip(keys, size, table["chunk"].to_pylist()):
            many = back[lo : lo + m]
            lo += m
            if (many > 1).any():
                chunk.append(own)
                blobs.append(_pack(x[many > 1], many[many > 1], c))
        del keys, counts, flat, total, order, new, each, back
        trim()
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "span": pa.array([table["span"][0].as_py()] * len(chunk), pa.int32()), "keys": pa.array(blobs, pa.binary())})

    return counted.where("kind = 0").select("chunk", "span", "keys").groupBy("span").applyInArrow(merge, "chunk long, span int, keys binary")


_LISTED = {"c": pa.int64(), "rep": pa.int64(), "gid": pa.int64(), "heads": pa.list_(pa.int64()), "tokens": pa.binary()}


def _listed(counted: DataFrame, shared: DataFrame, k: int, num: int, width: int) -> DataFrame:
    """c, rep, gid, heads (the listed tokens that other groups hold), tokens of the sets with such heads."""

    def run(table: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        kinds = table["kind"].to_pylist()
        got = [_unpack(x.as_py(), z) for x, kind in zip(table["keys"], kinds) if kind == 3]
        out, seen = [_table(_LISTED, [[]] * 5)], set()
        if not got:
            return pa.Table.from_batches(out)
        key, many = (np.concatenate(x) for x in zip(*got))
        # a chunk written in two goes has some tokens twice
        key, first = np.unique(key, return_index=True)
        many = many[first]
        for x in (x for x, kind in zip(table["keys"], kinds) if kind == 2):
            for b in pa.ipc.open_stream(z.decompress(x.as_py())):
                for part in pieces(b, "text"):
                    out.append(listed(part, key, many, seen))
        trim()
        return pa.Table.from_batches(out)

    def listed(part: pa.RecordBatch, key: np.ndarray, many: np.ndarray, seen: set[int]) -> pa.RecordBatch:
        gid, c, rep = (part.column(i).to_numpy() for i in range(3))
        sets = _sets(part, "text", k)
        n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        own = flat >> np.uint64(64 - width)
        at = np.minimum(np.searchsorted(key, own), len(key) - 1)
        df = np.where(key[at] == own, many[at], 1)
        doc = np.repeat(np.arange(len(n)), n)
        room = prefix_len(n, num) - np.bincount(doc[df == 1], minlength=len(n))
        pick = np.flatnonzero((df > 1) & (room[doc] > 0))
        pick = pick[np.lexsort((flat[pick], df[pick], doc[pick]))]
        per = np.bincount(doc[pick], minlength=len(n))
        pos = np.arange(len(pick)) - np.repeat(np.cumsum(per) - per, per)
        pick = pick[pos < room[doc[pick]]]
        per = np.bincount(doc[pick], minlength=len(n))
        ends = np.cumsum(per)
        rows = []
        for i in np.flatnonzero(per).tolist():
            if int(c[i]) not in seen:
                seen.add(int(c[i]))
                rows.append(i)
        heads = [flat[pick[ends[i] - per[i] : ends[i]]].view(np.int64) for i in rows]
        return _table(_LISTED, (c[rows], rep[rows], gid[rows], heads, [sets[i].tobytes() for i in rows]))

    both = counted.where("kind = 2").select("kind", "chunk", "keys").unionByName(shared.select(F.lit(3).alias("kind"), "chunk", "keys"))
    return both.groupBy("chunk").applyInArrow(run, "c long, rep long, gid long, heads array<long>, tokens binary")


def _by_list(rows: DataFrame, columns: list[str], emit: Callable, schema: str) -> DataFrame:
    """Hand whole lists (rows of one ``h``, in order) to ``emit(h, *columns)``, many lists at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            own = [b.column(i).to_numpy() for i in range(b.num_columns)]
            rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own)]
            if len(rest[0]) > 200_000:
                whole = int(np.searchsorted(rest[0], rest[0][-1], "left"))  # the last list may go on
                if whole:
                    yield emit(*(x[:whole] for x in rest))
                    rest = [x[whole:] for x in rest]
        if rest is not None and len(rest[0]):
            yield emit(*rest)

    ordered = rows.select("h", *columns).repartition("h").sortWithinPartitions("h", *columns)
    return ordered.mapInArrow(run, schema)


def _lists(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each list, and its number of rows."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(h)))


def _unique_pairs(a: np.ndarray, b: np.ndarray, names: list[str]) -> pa.RecordBatch:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.record_batch([pa.array(a[new]), pa.array(b[new])], names)


def _centre_pairs(lists: DataFrame) -> DataFrame:
    """a, b: in each list, the centre of the largest star against the other centres."""

    def emit(h, comp, m):
        at, size = _lists(h)
        order = np.lexsort((comp, m, h))  # the largest star of a list comes last
        lead = np.repeat(comp[order[at + size - 1]], size)
        ok = lead != comp
        return _unique_pairs(lead[ok], comp[ok], ["a", "b"])

    return _by_list(lists, ["comp", "m"], emit, "a long, b long").distinct()


def _probes(lists: DataFrame, bucket: int) -> DataFrame:
    """q, gid: sets that probe a group of a list whose members there are of a larger component."""

    def emit(h, w, comp, rep, gid):
        at, size = _lists(h)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (comp[1:] != comp[:-1])
        rank = np.cumsum(new)
        q, g = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.repeat(size <= bucket, size)
        end = np.repeat(at + size, size)
        for d in range(1, int(size[size <= bucket].max(initial=1))):
            i = np.flatnonzero(small & (np.arange(len(h)) + d < end))
            j = i + d
            ok = (rank[i] != rank[j]) & (gid[i] != gid[j])  # rows are in order of rank
            q.append(rep[i[ok]])
            g.append(gid[j[ok]])
        for x in np.flatnonzero(size > bucket).tolist():
            lo, hi = at[x], at[x] + size[x]
            # for each group of the list, its largest rank there
            o = lo + np.lexsort((rank[lo:hi], gid[lo:hi]))
            own = gid[o]
            last = np.flatnonzero(np.append(own[1:] != own[:-1], True))
            names, top = own[last], rank[o[last]]
            for s in range(lo, hi, 1024):
                e = min(s + 1024, hi)
                i, j = np.nonzero((rank[s:e, None] < top[None, :]) & (gid[s:e, None] != names[None, :]))
                q.append(rep[s:e][i])
                g.append(names[j])
        return _unique_pairs(np.concatenate(q), np.concatenate(g), ["q", "gid"])

    return _by_list(lists, ["w", "comp", "rep", "gid"], emit, "q long, gid long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) of representatives that link: groups of one set, opened directly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= num * max(len(x), len(y)) else 0
                keep.append(both > 0 and 100 * both >= num * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _opened(probes: DataFrame, sets: DataFrame, num: int, buckets: int) -> DataFrame:
    """a, b: a spanning forest of the links between probing sets and the members of the groups they open."""
    share = probes.groupBy("gid").agg(F.ceil(F.count("*") / F.lit(ASKERS)).cast("long").alias("copies"))
    copies = share.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    key = F.pmod(F.xxhash64("gid", "copy"), F.lit(buckets)).alias("bucket")
    members = copies.join(sets, "gid").select(key, F.lit(False).alias("asks"), "gid", "copy", "rep", "tokens")
    asks = probes.join(share, "gid").withColumn("copy", F.pmod(F.xxhash64("q"), F.col("copies")))
    asks = asks.join(sets.select(F.col("rep").alias("q"), "tokens"), "q").select(key, F.lit(True).alias("asks"), "gid", "copy", F.col("q").alias("rep"), "tokens")

    def run(table: pa.Table) -> pa.Table:
        places: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        for i, (asking, gid, copy) in enumerate(zip(*(table[x].to_pylist() for x in ("asks", "gid", "copy")))):
            places.setdefault((gid, copy), ([], []))[asking].append(i)
        reps = table["rep"].to_numpy()
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["tokens"]]
        a, b = [], []
        for own, who in places.values():
            if not own or not who:
                continue
            group, forest = TokenGroup([tokens[i] for i in own]), _Forest()
            for i in who:
                for j in np.flatnonzero(group.linked(tokens[i], num)).tolist():
                    x, y = int(reps[i]), int(reps[own[j]])
                    if forest.join(x, y):
                        a.append(x)
                        b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.unionByName(asks).groupBy("bucket").applyInArrow(run, "a long, b long")


def ngram_jaccard(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    k: int = 4,
    num: int = 85,
    bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased.
    A null or empty text has 0 shingles and is its own component; equal texts share
    a component; rows with one doc_id repeated count as rows of that id; a null id
    is its own component (null). Other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    ws = Workspace(spark, "jaccard")
    sig = ws.save(signatures(docs, doc_id, text, k), "signatures")
    classes = sig.where("n > 0 and doc_id is not null").groupBy("c1", "c2", "n").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.min(x).alias(x) for x in ("k1", "k2", "k3"))
    )
    classes = ws.save(classes.select(F.col("c1").alias("c"), "c2", "n", "rep", "copies", "k1", "k2", "k3"), "classes")
    total, count = classes.agg(F.sum("n"), F.count("*")).first()
    if not count:
        return sig.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))

    members = groups(classes, ws, 8 + count // 500_000, block).select("c", "c2", "rep", "gid")
    if count <= SENT:
        members = F.broadcast(members)
    placed = _texts(docs, doc_id, text, members, 48 + 2 * total // CHUNK_TOKENS)
    width = min(64, int(total).bit_length() + SPARE_BITS)
    counted = ws.save(_matrix(placed, k, num, 16 + total // CHUNK_TOKENS, width), "matrix")
    stars = ws.save(counted.where("kind = 1").select("a", "b", "m"), "stars")
    listed = ws.save(_listed(counted, _shared(counted), k, num, width), "listed")
    ws.drop(counted)
    heads = listed.select("rep", "gid", F.explode("heads").alias("h"))
    sets = listed.select("rep", "gid", "tokens")

    near = heads.join(stars.withColumnRenamed("a", "rep"), "rep", "left")
    near = near.select("h", "rep", "gid", F.coalesce("b", "rep").alias("comp"), F.coalesce("m", F.lit(1)).alias("m"))
    centres = ws.save(_verified(_centre_pairs(near.select("h", "comp", "m").distinct()), sets, num), "centres")
    joined = ws.save(components(centres, ws), "joined").select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    far = ws.save(near.join(joined, "comp", "left").select("h", "rep", "gid", F.coalesce("whole", "comp").alias("comp")), "lists")
    # Components are ranked by the lists they are in, then by name; the smaller one asks.
    weight = far.groupBy("comp").agg(F.count("*").alias("w"))
    mixed = far.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("h")
    probes = ws.save(_probes(far.join(mixed, "h", "left_semi").join(weight, "comp"), bucket), "probes")
    links = _opened(probes, sets, num, 48 + total // (4 * CHUNK_TOKENS))

    comp = components(stars.select("a", "b").unionByName(centres).unionByName(links), ws)
    return _spread(sig, classes, comp)


def _spread(sig: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """The component of every row. Classes of many copies are hot keys: they are sent to the rows
    while they are few, and dealt over 16 salts beyond that."""
    comp = comp.select(F.col("node").alias("rep"), F.col("comp").alias("linked"))
    known = classes.join(comp, "rep", "left").select(
        F.col("c").alias("c1"), "c2", "n", "copies", F.coalesce("linked", "rep").alias("component_id")
    )
    key = ["c1", "c2", "n"]
    hot = known.where(F.col("copies") > HOT).select(*key, F.col("component_id").alias("hot_id"))
    rows = sig.select("doc_id", *key)
    if hot.count() <= 100_000:
        rows = rows.join(F.broadcast(hot), key, "left")
    else:
        salts = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(salts, [*key, "salt"], "left").drop("salt")
    done = rows.where("hot_id is not null").select("doc_id", "n", F.col("hot_id").alias("component_id"))
    rest = rows.where("hot_id is null").join(known.where(F.col("copies") <= HOT).select(*key, "component_id"), key, "left")
    out = done.unionByName(rest.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` with the smallest doc_id of each component only; the columns stay.

    Rows that share the kept id all stay, as do rows with a null id. Texts are not
    shuffled: a fixed-size bitmap passes the rows that surely stay, and only the
    others are joined with the list of ids that go. Any column names are allowed.
    """
    ws = Workspace(docs.sparkSession, "keep")
    comp = ngram_jaccard(docs, doc_id, text, **params)
    name = "gone_id"
    while name in docs.columns:
        name += "_"
    gone = ws.save(comp.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    listed = Bitmap.of(gone, name)

    def side(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(b.schema.get_field_index(doc_id))
                hit = listed.has(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ~ids.is_null().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit if inside else ~hit))

        return docs.mapInArrow(run, docs.schema)

    return side(False).unionByName(side(True).join(gone, F.col(doc_id) == F.col(name), "left_anti"))
