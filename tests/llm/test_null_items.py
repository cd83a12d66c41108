"""A test item without an id still counts."""

import corpus_pipeline
from ledgerflow.llm.queries import QUERIES

PASSAGE = "one quick brown fox jumps over the lazy dog while seven green birds sing"


def test_null_item_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"before it {PASSAGE} after it"), (2, "nothing of the kind is in this text at all")], "doc_id long, text string")
    items = spark.createDataFrame([(None, PASSAGE), (None, None), (3, "another passage of the test set which no document copies")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r["doc_id"], r["item_id"], r["score"]) for r in QUERIES["op4_decontaminate_aligned"](spark, str(tmp_path)).collect()]
    assert got == [(1, None, 1.0)]
    assert [r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [2]
