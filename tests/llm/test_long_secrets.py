"""Secrets are redacted to their end, however long."""

from ledgerflow.llm import pii


def test_long_secrets_leave_no_tail(spark):
    token = "aB3dE5gH7j" * 400
    texts = [f"api_key={token} end", f"the key AKIA{token} end", f"password: {token}", "api_key=" + "aB3dE5gH7jKm2nPq4r end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert all("aB3dE5gH7j" not in t and "[SECRET]" in t for t in got.values())
    assert got[0].endswith(" end") and got[1].endswith(" end")


def test_clashing_columns_and_overlaps(spark):
    """Columns with the operator's own names come back as they were; overlapping added spans are one."""
    long = "k" * 10_000
    texts = [f"token={long}9 end", "mail ab" + "c" * 300 + " [at] host [dot] com now", "my iban secret=DE44500105175407324931 x", None, ""]
    df = spark.createDataFrame([(i, t, "mine", [1], 5, "t", "v") for i, t in enumerate(texts)], "doc_id long, text string, pii_base string, m_email array<int>, pii_spans int, piix_t string, v string")
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert pii.redact(df).schema == df.schema
    assert all((r["pii_base"], r["m_email"], r["pii_spans"], r["piix_t"], r["v"]) == ("mine", [1], 5, "t", "v") for r in out.values())
    assert out[0]["text"] == "[SECRET] end" and out[1]["text"] == "mail [SPELLED_EMAIL] now"
    assert out[3]["text"] is None and out[4]["text"] == ""
    spans = pii.report(df).where("doc_id = 2").first()["spans"].split(",")
    places = sorted(tuple(map(int, x.split(":")[1:])) for x in spans if x.split(":")[0] not in pii.BASE)
    assert places and all(a[1] <= b[0] for a, b in zip(places, places[1:]))
    assert "DE44" not in out[2]["text"]
    assert set(pii.model()[3]) == set(pii.ADDED)
