"""Shared plumbing: table reading, shared-folder snapshots, bounded bitmaps.

Sizes that matter at 100 TB are fixed here: a ``Bitmap`` is the only thing the
operators broadcast that is derived from all rows, and its size is a constant
(``words`` 64-bit words) whatever the input; when it fills up it only filters
less, it never changes a result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 250  # rows of an Arrow batch
BITMAP_WORDS = 1 << 19  # 4 MB, 33.5 million bits
CHUNKS = "kind int, chunk int, bits binary"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: very long documents are copied whole into the buffers of both sides.

    The setting stays with the session, because plans run after the call that made them.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session without the setting gets a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if getattr(shared_dir, "own", None) is None:
        shared_dir.own = tempfile.mkdtemp(prefix="ledgerflow-")
    return f"file://{shared_dir.own}"


class Workspace:
    """Tables written to the shared folder to cut lineage.

    A lost executor re-reads them; nothing is held in executor-local storage.
    The folder is removed when the driver ends; ``drop`` removes one table early.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/ledgerflow/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.saved: dict[int, str] = {}
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        # Small row groups: a writer holds one in memory, and rows may be large.
        df.write.option("parquet.block.size", 16 << 20).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.saved[id(out)] = path
        return out

    def folder(self, name: str) -> str:
        """A new empty folder of the workspace, as a path with its scheme."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        return fs.makeQualified(p).toString()

    def drop(self, df: DataFrame) -> None:
        path = self.saved.pop(id(df), None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the session may have ended before the interpreter
            return

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class Bitmap:
    """A fixed-size set of 64-bit keys with false positives and no false negatives."""

    CHUNK = 4096  # words of a chunk, the unit that tasks send

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __getstate__(self) -> bytes:
        # Sent to every task: a sparse set must be a small closure.
        return zlib.compress(self.bits.tobytes(), 1)

    def __setstate__(self, state: bytes) -> None:
        self.bits = np.frombuffer(zlib.decompress(state), np.uint64)

    @classmethod
    def empty(cls, words: int = BITMAP_WORDS) -> "Bitmap":
        return cls(np.zeros(words, np.uint64))

    def add(self, keys: np.ndarray) -> None:
        k = mixed(keys)
        w = (k >> np.int64(6)) & np.int64(len(self.bits) - 1)
        np.bitwise_or.at(self.bits, w, np.uint64(1) << (k & np.int64(63)).astype(np.uint64))

    def chunks(self) -> tuple[list[int], list[bytes]]:
        parts = self.bits.reshape(-1, self.CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        return used.tolist(), [zlib.compress(parts[i].tobytes(), 1) for i in used]

    @classmethod
    def of(cls, keys: DataFrame, column: str, words: int = BITMAP_WORDS) -> "Bitmap":
        """Each task sends its chunks; the driver gets ``words`` words whatever the number of keys."""

        def part(batches):
            own = cls.empty(words)
            for b in batches:
                own.add(b.column(0).drop_null().to_numpy(zero_copy_only=False))
            at, blobs = own.chunks()
            yield pa.record_batch([pa.array([0] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "chunk", "bits"])

        return cls.gather(keys.select(F.col(column).cast("long")).mapInArrow(part, CHUNKS), 1, words)[0]

    @classmethod
    def gather(cls, chunks: DataFrame, kinds: int, words: int = BITMAP_WORDS) -> "list[Bitmap]":
        """The unions of chunks (kind, chunk, bits), one bitmap for each kind."""

        def merge(table: pa.Table) -> pa.Table:
            bits = np.zeros(cls.CHUNK, np.uint64)
            for x in table["bits"]:
                bits |= np.frombuffer(zlib.decompress(x.as_py()), np.uint64)
            return pa.table({"kind": table["kind"].slice(0, 1), "chunk": table["chunk"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

        out = [cls.empty(words) for _ in range(kinds)]
        for r in chunks.groupBy("kind", "chunk").applyInArrow(merge, CHUNKS).collect():  # at most kinds * words / CHUNK rows
            out[r["kind"]].bits[r["chunk"] * cls.CHUNK :][: cls.CHUNK] = np.frombuffer(bytes(r["bits"]), np.uint64)
        return out

    def union(self, other: "Bitmap") -> "Bitmap":
        return Bitmap(self.bits | other.bits)

    def any(self) -> bool:
        return bool(self.bits.any())

    def has(self, keys: np.ndarray) -> np.ndarray:
        k = mixed(keys)
        w = (k >> np.int64(6)) & np.int64(len(self.bits) - 1)
        return (self.bits[w] >> (k & np.int64(63)).astype(np.uint64)) & np.uint64(1) != 0


def mixed(k: np.ndarray) -> np.ndarray:
    """Spread keys: sequential ids would fill neighbouring bits only."""
    k = k.astype(np.int64).view(np.uint64)
    k = k ^ (k >> np.uint64(33))
    k = k ^ (k << np.uint64(21))
    return (k ^ (k >> np.uint64(17))).view(np.int64)


def crc_mod(column: str, m: int):
    """crc32 of an integer id written as text, modulo ``m``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m).cast("long"))


def fit_hash(column: str):
    """The order in which ids are taken for a fit."""
    return F.crc32(F.concat(F.lit("fit"), F.col(column)).cast("binary"))


def fit_cut(total, wanted: int):
    """A bound of ``fit_hash`` under which ``wanted`` ids of ``total`` lie, and six standard deviations more."""
    return F.least(F.lit(1.0), F.lit(float(wanted + 6 * wanted**0.5 + 1)) / total) * F.lit(float(1 << 32))
