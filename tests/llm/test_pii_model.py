"""The trees over added kinds: look-alikes, features in SQL against plain ones, and measured precision."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import pii


def score(x):
    trees, a, b, _ = pii.model()
    return 1 / (1 + math.exp(-(a * sum(pii._walk(t, x) for t in trees) + b)))


def brute(text):
    """Added spans by the plain features: candidates over their threshold, those that overlap as one of the best one's kind."""
    base = []
    for k in pii.BASE:
        for m in re.finditer(pii.PATTERNS[k].replace(r"|\G", ""), text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if k == "ip" else False, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[k]:
                base.append((m.start(), m.end(), k))
    found = []
    for k in pii.ADDED:
        for m in re.finditer(pii.PATTERNS[k], text):
            s = score(pii.features(k, text[: m.start()], m[0], text[m.end() :]))
            if s >= pii.model()[3][k]:
                found.append((m.start(), pii.KINDS.index(k), m.end(), s, k))
    runs = []
    for f in sorted(found):
        if runs and f[0] < max(x[2] for x in runs[-1]):
            runs[-1].append(f)
        else:
            runs.append([f])
    more = [(r[0][0], max(x[2] for x in r), max(r, key=lambda x: (x[3], -x[0], -x[1]))[4]) for r in runs]
    more = [x for x in more if not any(b[0] <= x[0] and b[1] >= x[1] for b in base)]
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(base + more, key=lambda x: (x[0], pii.KINDS.index(x[2]))))


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.spans for r in pii.report(df).orderBy("doc_id").collect()]


FALSE = ["model XY99 ABCD EFGH IJKL MNOP in stock", "part AB12CDEF3456GHIJ7890KLMN", "error code US40 1234 ABCD 9876 WXYZ", "the final score 123-45-6789", "see version 415-555-2671 of it", "the secret: something", "meet me (at) noon. sharp"]
REAL = {"pay to DE89 3704 0044 0532 0130 00 now": "iban:7:34", "iban GB82WEST12345698765432": "iban:5:27", "my ssn 123-45-6789": "national_id:7:18", "call me at 415-555-2671": "local_phone:11:23", "password=hunter2xyz99": "secret:0:21", "mail john [at] example [dot] com": "spelled_email:5:32"}


def test_look_alikes_are_left_and_real_ones_found(spark):
    assert spans(spark, FALSE) == [""] * len(FALSE)
    assert dict(zip(REAL, spans(spark, list(REAL)))) == REAL


def written(n, seed):
    """Texts of several written candidates with words between, each kind real and not."""
    r, out = random.Random(seed), []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 4)):
            seen = []
            keep = pii.features
            pii.features = lambda k, before, v, after: seen.append(before + v + after) or keep(k, before, v, after)
            try:
                pii._draw(r)
            finally:
                pii.features = keep
            parts += seen
        parts += r.choice([[], ["a.b@c.de 10.0.0.1"], ["+1 415 555 2671 x"], ["4111 1111 1111 1111"]])
        r.shuffle(parts)
        out.append(" ".join(parts))
    return out


def test_added_spans_against_brute_force(spark):
    texts = written(400, 3) + FALSE + list(REAL) + ["", "é" * 30 + " iban GB82WEST12345698765432", "password=secret=token=abcd1234efgh5678"]
    got = spans(spark, texts)
    assert got == [brute(t) for t in texts]
    kinds = Counter(x.split(":")[0] for g in got for x in g.split(",") if x)
    assert all(kinds[k] > 20 for k in pii.ADDED)


def test_thresholds_have_a_floor_and_precision_holds_out():
    assert all(t >= pii.FLOOR for t in pii.model()[3].values())
    r, hit, wrong, missed = random.Random(99), Counter(), Counter(), Counter()
    for _ in range(6000):
        x, real = pii._draw(r)
        k = pii.KINDS[int(x[-1])]
        taken = score(x) >= pii.model()[3][k]
        hit[k] += taken and real
        wrong[k] += taken and not real
        missed[k] += real and not taken
    for k in pii.ADDED:
        assert hit[k] / (hit[k] + wrong[k]) >= 0.9, k
        assert hit[k] / (hit[k] + missed[k]) >= 0.75, k


@pytest.mark.parametrize("v,right", [("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 33", False), ("DE89370400440532013000", True), ("US40 1234 ABCD 9876 WXYZ", False)])
def test_remainder_in_sql_and_plainly(spark, v, right):
    assert (pii.remainder(v) == 1) == right
    got = spark.range(1).select(F.expr(f"element_at(transform(array(named_struct('v', '{v}')), m -> {pii._check_sql('iban')}), 1)")).first()[0]
    assert got == float(right)
