"""Each stage of the pipeline against a brute-force version on the smallest tables."""

import re

import corpus_pipeline as cp
from ledgerflow.llm.common import load

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def test_stages(spark, sf_dir, tmp_path):
    docs = load(spark, sf_dir, "documents")
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"file://{tmp_path}/{k}")
        nxt = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < len(cp.STAGES) - 1:
            assert nxt.dtypes == docs.dtypes
        seen[name] = (docs.collect(), nxt.collect())
        docs = nxt
    before, after = seen["near_copies"]
    sets = {}
    for r in before:
        w = re.findall(r"[^\x20\x09-\x0d]+", (r["text"] or "").translate(LOW))
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                root[b] = a
    assert {r["doc_id"] for r in after} == {i for i in sets if top(i) == i}
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == texts[r["doc_id"]] for r in after)

    insult = re.compile(r"\b(idiot|moron|stupid|scum|trash|clown|pathetic|worthless|disgusting|loser)\b")
    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after}
    clean = [r["doc_id"] for r in before if not insult.search((r["text"] or "").lower())]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    before, after = seen["decontamination"]
    assert 0 < len(before) - len(after) < 0.2 * len(before)
    before, after = seen["personal_data"]
    assert len(before) == len(after)
    for r in after:
        assert r["n_chars"] == len(r["text"] or "")
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"] or "")
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
