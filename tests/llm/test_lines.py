"""Line dedup against a plain reading of its rule, and at its edges."""

import hashlib
from collections import defaultdict

import duckdb

from ledgerflow.llm import lines
from ledgerflow.llm.queries import QUERIES, SQL

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, min_chars=20, min_docs=3):
    """(doc_id, what is left, lines, dropped) of each row."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= min_chars:
                held[key(x)].add(d)
    shared = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        left = [x for x in every if d is None or key(x) not in shared or shared[key(x)] == d]
        out.append((d, "\n".join(left) if t is not None or len(left) != len(every) else None, len(every), len(every) - len(left)))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in lines.dedup_lines(df, **kw).select("doc_id", "text", "n_lines", "n_dropped").collect()]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


LONG = "This line is shared by a lot of documents"


def test_query_against_brute_force_and_sql(spark, sf_dir):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op12_line_dedup"](spark, sf_dir).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    want = {d: (n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, n, k in brute(rows)}
    assert got == want and sum(k for _, k, _ in got.values()) > 0
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({SQL['op12_line_dedup']})").fetchall()} == got


def test_largest_document_keeps_the_line(spark):
    rows = [(1, f"a\n{LONG}\nb"), (2, f"  {LONG.upper()}\t"), (7, f"{LONG}\n{LONG}\nend"), (3, "own")]
    assert same(found(spark, rows), [(1, "a\nb", 3, 1), (2, "", 1, 1), (7, rows[2][1], 3, 0), (3, "own", 1, 0)])


def test_two_documents_or_short_lines_are_left_alone(spark):
    rows = [(1, LONG), (2, LONG), (3, "short"), (4, "short"), (5, "short")]
    assert same(found(spark, rows), [(d, t, 1, 0) for d, t in rows])
    # Twenty code points are enough, nineteen are not.
    rows = [(i, "é" * n) for n in (19, 20) for i in range(n * 10, n * 10 + 3)]
    assert {d for d, _, _, k in found(spark, rows) if k} == {200, 201}


def test_only_ascii_is_lower_cased(spark):
    rows = [(1, "ÀLA " + LONG), (2, "àla " + LONG), (3, "Àla " + LONG), (4, "ÀlA " + LONG)]
    assert same(found(spark, rows), brute(rows))
    assert {d for d, _, _, k in found(spark, rows) if k} == {1, 3}


def test_nulls_empty_texts_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n"), (None, LONG), (4, LONG), (4, f"x\n{LONG}"), (4, LONG), (5, LONG), (6, f"{LONG}\n\n"), (8, None)]
    assert same(found(spark, rows), brute(rows))
    assert found(spark, []) == []


def test_no_lone_document_counts_twice(spark):
    rows = [(1, "\n".join([LONG] * 5)), (1, LONG), (2, LONG)]
    assert same(found(spark, rows), [(d, t, t.count("\n") + 1, 0) for d, t in rows])


def test_very_long_text_and_clashing_columns(spark):
    big = "\n".join(f"{LONG} {i % 50}" for i in range(20_000))
    rows = [(i, big, "v", 1, "g") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, version string, pos int, gone string")
    got = {r.doc_id: (len(r.text), r.n_lines, r.n_dropped) for r in lines.dedup_lines(df).collect()}
    assert got == {0: (0, 20_000, 20_000), 1: (0, 20_000, 20_000), 2: (0, 20_000, 20_000), 3: (len(big), 20_000, 0)}


def test_lower_thresholds_and_names(spark):
    df = spark.createDataFrame([(1, "ab\nc"), (2, "AB")], "id int, body string")
    got = lines.dedup_lines(df, "id", "body", min_chars=2, min_docs=2).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "c"), (2, "AB")]
