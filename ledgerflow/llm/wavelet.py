"""Operator 8: token ids as one succinct wavelet matrix per shard.

A shard holds whole documents in ascending doc_id order. Its one compressed file
has the document table and, for each bit of the ids from the top, a bit-plane in
the order of the planes above with its rank directory. The file answers
``access``, ``rank`` (counting) and ``select`` (occurrence lookup) without the
ids being unpacked, and ``ids`` unpacks them all. Tasks write the files to the
shared folder under a hidden name and rename them, so a task that runs twice leaves
one file; Spark's binary file source reads them back.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, tune
from .fasttok import default_path, encoder
from .text_core import buffers, pieces

MAGIC = b"LFWM0002"
SUFFIX = ".lfwm"
SHARD_TOKENS = 1 << 20
RANK_BITS = 512  # bits between entries of a rank directory


def _block_counts(plane: np.ndarray) -> np.ndarray:
    """The rank directory of a plane: the ones in each of its blocks."""
    return np.bitwise_count(plane.reshape(-1, RANK_BITS // 64, 8).view("<u8")).sum(axis=(1, 2), dtype="<u2")


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one shard: magic, header, then zstd frames: the document table, and for each plane its bits and its ranks."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    z = zstandard.ZstdCompressor(level=1)
    table = [
        z.compress(np.array([d is None for d in doc_ids], np.uint8).tobytes()),
        z.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        z.compress(np.array(lengths, "<i8").tobytes()),
    ]
    zeros, planes = [], []
    for bit in range(bits - 1, -1, -1):
        one = (a & a.dtype.type(1 << bit)) != 0
        bits_of = np.packbits(one, bitorder="little")
        bits_of = np.concatenate([bits_of, np.zeros(-len(bits_of) % (RANK_BITS // 8), np.uint8)])
        planes += [z.compress(bits_of.tobytes()), z.compress(_block_counts(bits_of).tobytes())]
        zero_part = a[~one]
        zeros.append(len(zero_part))
        a = np.concatenate([zero_part, a[one]])
    frames = table + planes
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "frames": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *frames])


class Shard:
    """A reader of one file's bytes; a plane is unpacked when first asked for."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (k,) = struct.unpack_from("<I", blob, 8)
        head = json.loads(blob[12 : 12 + k])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        at, frames = 12 + k, []
        for size in head["frames"]:
            frames.append(blob[at : at + size])
            at += size
        self._z = zstandard.ZstdDecompressor()
        null, ids, sizes = (self._z.decompress(f) for f in frames[:3])
        self.doc_ids = [None if x else int(d) for x, d in zip(null, np.frombuffer(ids, "<i8"))]
        self.lengths = np.frombuffer(sizes, "<i8")
        self._frames = frames[3:]
        self._planes: dict[int, np.ndarray] = {}
        self._ranks: dict[int, np.ndarray] = {}

    def _plane(self, level: int) -> np.ndarray:
        if level not in self._planes:
            self._planes[level] = np.frombuffer(self._z.decompress(self._frames[2 * level]), np.uint8)
            per = np.frombuffer(self._z.decompress(self._frames[2 * level + 1]), "<u2")
            self._ranks[level] = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])
        return self._planes[level]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits."""
        plane = self._plane(level)
        block = i // RANK_BITS
        lo = block * RANK_BITS // 8
        ones = int(self._ranks[level][block]) + int(np.bitwise_count(plane[lo : i >> 3]).sum())
        if i & 7:
            ones += int(plane[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return ones

    def _select(self, level: int, k: int, one: bool) -> int:
        """Place of the k-th (from 0) bit of a kind: its block by the directory, then inside the block."""
        plane, ranks = self._plane(level), self._ranks[level]
        before = ranks if one else np.arange(len(ranks)) * RANK_BITS - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(plane[block * RANK_BITS // 8 : (block + 1) * RANK_BITS // 8], bitorder="little")
        return block * RANK_BITS + int(np.flatnonzero(bits == one)[k - before[block]])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._plane(level)[i >> 3] >> (i & 7) & 1
            ones = self._rank1(level, i)
            value = value << 1 | int(bit)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def rank(self, value: int, end: int, start: int = 0) -> int:
        """Occurrences of ``value`` among ids[start:end]."""
        if value < 0 or value.bit_length() > self.bits:
            return 0
        lo, hi = max(0, start), min(end, self.n)
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if value >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return max(0, hi - lo)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``value``, or -1."""
        if k < 0 or k >= self.rank(value, self.n):
            return -1
        at = 0
        for level in range(self.bits):
            ones = self._rank1(level, at)
            at = self.zeros[level] + ones if value >> (self.bits - 1 - level) & 1 else at - ones
        i = at + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            i = self._select(level, i - self.zeros[level] if one else i, bool(one))
        return i

    def ids(self) -> np.ndarray:
        """All ids, from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            raw = np.frombuffer(self._z.decompress(self._frames[2 * level]), np.uint8)
            one = np.unpackbits(raw, count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            up = np.empty(self.n, kind)
            up[~one] = v[:z]
            up[one] = v[z:] | kind(1 << (self.bits - 1 - level))
            v = up
        return v


def _store(folder: str, name: str, blob: bytes) -> None:
    """Write one file of the shared folder (a qualified path) from a task."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    hidden = f"{at}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as f:
        f.write(blob)
    fs.move(hidden, f"{at}/{name}")


def write_shards(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """part, seq, n_tokens of each file that the tasks write to ``folder``, in ascending doc_id order.

    The files are there once the result has been computed.

    A null or empty text is the one id ``end_id``. Null ids come first; rows with
    one id are ordered by their text. A document over ``shard_tokens`` has a shard
    of its own. Other columns are ignored; an empty table gives no shard.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    src = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")), F.length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer or default_path())
        part_no, seq = TaskContext.get().partitionId(), 0
        names, sizes, held, n = [], [], [], 0

        def flush():
            nonlocal names, sizes, held, n, seq
            _store(folder, f"part-{part_no:06d}-{seq:06d}{SUFFIX}", write_shard(names, sizes, np.concatenate(held)))
            out = pa.record_batch([pa.array([x], pa.int64()) for x in (part_no, seq, n)], ["part", "seq", "n_tokens"])
            names, sizes, held, n, seq = [], [], [], 0, seq + 1
            return out

        for b in batches:
            for p in pieces(b, "text"):
                data, offs = buffers(p.column(1))
                ids, per = enc.encode(data, offs)
                ends = np.cumsum(per)
                # the end id after each document
                full = np.insert(ids, ends, end_id)
                per = per + 1
                lo = done = 0
                for i, d in enumerate(p.column(0).to_pylist()):
                    m = int(per[i])
                    if names and n + m > shard_tokens:
                        held.append(full[lo:done])
                        lo = done
                        yield flush()
                    names.append(d)
                    sizes.append(m)
                    n += m
                    done += m
                held.append(full[lo:done])
        if names:
            yield flush()

    return src.mapInArrow(run, "part long, seq long, n_tokens long")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, doc_id, at (ids before it in its shard), n_tokens, ids_crc32, from the files of ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = Shard(blob.as_py())
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(starts.tolist(), ends.tolist())]
                k = len(s.lengths)
                yield pa.record_batch(
                    [pa.array(np.full(k, part, np.int64)), pa.array(np.full(k, seq, np.int64)), pa.array(s.doc_ids, pa.int64()), pa.array(starts), pa.array(s.lengths), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    name = [F.regexp_extract("path", rf"part-(\d+)-(\d+)\{SUFFIX}$", i).cast("long") for i in (1, 2)]
    return files.select(name[0].alias("part"), name[1].alias("seq"), "content").mapInArrow(
        run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long"
    )


def wavelet_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Write the shards to the shared folder, read them back, one row per document."""
    spark = docs.sparkSession
    tune(spark)
    ws = Workspace(spark, "wavelet")
    folder = ws.folder("shards")
    meta = ws.save(write_shards(docs, folder, doc_id, text, end_id, tokenizer), "meta")
    # Totals of partitions first: the one-task window has a row per partition, not per shard.
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("m"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("p0"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        meta.withColumn("s0", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "seq", (F.col("p0") + F.col("s0")).alias("base"))
    )
    return read_shards(spark, folder).join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
