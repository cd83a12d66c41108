"""Operator 12: drop lines that many documents share.

Lines are exploded with their place, the normalised line (blanks stripped at both ends,
A-Z lower-cased) is hashed to 128 bits, and a hash that enough documents hold is dropped
everywhere but in the document of the largest id. What is left is put together by place.
Only hashes and places are shuffled by line; a text is shuffled once, to meet its places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased; ASCII lines take the quicker function."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """key, n_docs, keep: the hashes that ``min_docs`` documents hold and the largest document that does.

    ``lines`` has key and doc_id. A document counts once however often it repeats the
    line; a key of very many documents is dealt out by document before its counts meet.
    """
    each = lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return each.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text (what is left), n_lines (before), n_dropped; one row for each row.

    A null or empty text is one empty line and stays as it is (null stays null). Rows of one
    doc_id are one document: they are counted once, and all or none of them keep a line. A
    null doc_id is no document: its lines are neither counted nor dropped. Keys shorter than
    ``min_chars`` code points are never dropped. An empty table gives no rows; further
    columns of ``docs`` are not read.
    """
    ws = Workspace(docs.sparkSession, "lines")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Rows of one id may differ: a place belongs to an id and a text.
    version = F.xxhash64("text").alias("version")
    lines = src.where("doc_id is not null and char_length(text) >= %d" % min_chars).select("doc_id", version, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    lines = lines.select("doc_id", "version", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"))
    lines = ws.save(lines, "lines")
    shared = ws.save(shared_lines(lines.select("key", "doc_id"), min_docs).select("key", "keep"), "shared")
    gone = lines.join(shared, "key").where(F.col("doc_id") < F.col("keep")).groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone"))
    gone = gone.withColumnsRenamed({"doc_id": "d", "version": "v"})
    out = src.withColumn("version", F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col("d")) & (F.col("version") == F.col("v")), "left")
    out = out.withColumn("every", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("every") - 1), "gone")
    left = F.array_join(F.transform(stay, lambda i: F.get("every", i)), "\n")
    return out.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.size("every").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is left."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, row, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, row, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, keep IS NOT NULL AND doc_id < keep AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, row
"""
