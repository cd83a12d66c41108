"""Operator 7: chat formatting with prefix-target expansion.

A conversation is rendered once, in turn order, with a template that marks every
turn. Every assistant turn is exploded into its own example: its context is all that
stands before its reply, and only the reply is trainable. A context is held as its
length in the one rendered text, so n turns cost n rows and not n prefixes;
``expand`` cuts the full contexts where a trainer wants them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, tune

# The control strings of the template.
OPEN = {"user": "[INST] ", "assistant": "<s> ", "system": "<<SYS>> "}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "[ROLE ", "] ", " [/ROLE]"
_CONTROL = re.compile(r"[\\\[\]]|</?s>|<</?SYS>>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_MARK = re.compile(r"\\.|\[INST\] |<s> |<<SYS>> |\[ROLE ((?:\\.|[^\\\]])*)\] ", re.S)


def escape(text: str) -> str:
    """A backslash before whatever could begin or end a control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def open_mark(role: str) -> str:
    return OPEN.get(role) or OTHER_OPEN + escape(role) + OTHER_MID


def close_mark(role: str) -> str:
    return CLOSE.get(role, OTHER_CLOSE)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The rendered text and (turn, start, end) of every assistant reply in it."""
    out, at, spans = [], 0, []
    for k, (role, text) in enumerate(turns):
        a, b, c = open_mark(role), escape(text), close_mark(role)
        if role == "assistant":
            spans.append((k, at + len(a), at + len(a) + len(b)))
        out += [a, b, c]
        at += len(a) + len(b) + len(c)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text; the inverse of ``render``."""
    turns, at = [], 0
    while at < len(text):
        m = _MARK.match(text, at)
        if not m or m[0][0] == "\\":
            raise ValueError(f"no turn begins at {at}")
        role = unescape(m[1]) if m[1] is not None else {v: k for k, v in OPEN.items()}[m[0]]
        close = close_mark(role)
        # The first close mark that no backslash precedes: escapes are read in pairs.
        i = m.end()
        stop = re.compile(r"\\.|" + re.escape(close), re.S)
        while True:
            n = stop.search(text, i)
            if not n:
                raise ValueError(f"turn at {at} does not end")
            if n[0] == close:
                break
            i = n.end()
        turns.append((role, unescape(text[m.end() : n.start()])))
        at = n.end()
    return turns


def format_conversations(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, examples (array of struct turn, start, end, target) per conversation.

    Turns are ordered by number (null first), then role and text. A null role or text
    is empty; rows with a null conv_id are one conversation; repeated rows are turns
    each. Rows arrive sorted, so a task holds one conversation at a time.
    """
    tune(conv.sparkSession)
    src = conv.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("target", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, done = object(), [], []

        def batch():
            out = [(k, *render(t)) for k, t in done]
            done.clear()
            return pa.record_batch(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([[{"turn": t, "start": a, "end": b, "target": o[1][a:b]} for t, a, b in o[2]] for o in out], kind)],
                ["conv_id", "formatted", "examples"],
            )

        for b in batches:
            for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if c != key or type(key) is object:
                    if turns:
                        done.append((key, turns))
                    key, turns = c, []
                turns.append((r, t))
            if done:
                yield batch()
        if turns:
            done.append((key, turns))
        yield batch()

    return src.mapInArrow(run, "conv_id long, formatted string, examples array<struct<turn: long, start: long, end: long, target: string>>")


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, turn, context_chars (all that stands before the reply), target (the reply)."""
    rows = formatted.select("conv_id", F.posexplode("examples").alias("example", "e"))
    return rows.select("conv_id", "example", F.col("e.turn").alias("turn"), F.col("e.start").alias("context_chars"), F.col("e.target").alias("target"))


def expand(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, turn, context (all before the target), target (the reply)."""
    rows = formatted.select("conv_id", "formatted", F.explode("examples").alias("e"))
    return rows.select(
        "conv_id", F.col("e.turn").alias("turn"), F.expr("substring(formatted, 1, cast(e.start as int))").alias("context"), F.col("e.target").alias("target")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The turns are read from the rendered text, the loss from the exploded examples:
    the targets of a conversation in order. One without an assistant turn has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                turns = parse(text)
                digest = hashlib.sha256()
                for r, t in turns:
                    digest.update(f"{r}\n{t}\n".encode())
                out.append((c, len(turns), digest.hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "formatted_chars"])

    turns = formatted.select("conv_id", "formatted").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, formatted_chars long")
    reply = F.regexp_replace("target", r"(?s)\\(.)", "$1")
    rows = examples(formatted).select(F.col("conv_id").alias("of"), F.struct("example", reply.alias("reply")).alias("x"))
    said = F.concat_ws("", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["reply"]))
    loss = rows.groupBy("of").agg(said.alias("said")).select("of", F.length("said").cast("long").alias("chars"), F.sha2(F.col("said").cast("binary"), 256).alias("digest"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return turns.join(loss, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", "n_turns", "turns_sha256", F.coalesce("chars", F.lit(0).cast("long")).alias("loss_chars"), F.coalesce("digest", none).alias("loss_sha256"), "formatted_chars"
    )


def format_and_read_back(conv: DataFrame) -> DataFrame:
    ws = Workspace(conv.sparkSession, "chat")
    return read_back(ws.save(format_conversations(conv), "formatted"))
