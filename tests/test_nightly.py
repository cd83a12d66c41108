import pytest

from ledgerflow.plans import nightly as ng


def boom():
    raise RuntimeError("no file")


def test_skips_follow_failures():
    ran = []
    steps = [
        ng.Step("prices", lambda: ran.append("prices")),
        ng.Step("fundamentals", boom, tolerate_failure=True),
        ng.Step("zones", boom, ("prices",)),
        ng.Step("scores", lambda: ran.append("scores"), ("prices", "fundamentals")),
        ng.Step("alerts", lambda: ran.append("alerts"), ("zones",)),
    ]
    got = ng.run(steps)
    assert got == {"prices": "ok", "fundamentals": "tolerated", "zones": "failed", "scores": "ok", "alerts": "skipped"}
    assert ran == ["prices", "scores"] and ng.exit_code(got) == 1


def test_idle_night_and_order():
    assert ng.run([ng.Step("a", boom), ng.Step("b", lambda: None)], lambda: True, ("b",)) == {"a": "skipped", "b": "ok"}
    with pytest.raises(ValueError):
        ng.ordered([ng.Step("a", boom, ("b",)), ng.Step("b", boom)])


def test_audit(spark):
    runs = []
    with pytest.raises(RuntimeError), ng.audited("x", runs):
        boom()
    with ng.audited("y", runs) as a:
        a.rows_out = 3
        a.errors.append("one symbol")
    got = {r["job"]: (r["status"], r["rows_out"]) for r in ng.audit_frame(spark, runs).collect()}
    assert got == {"x": ("failed", 0), "y": ("partial", 3)}


def test_weights():
    assert ng.weights({"q": 5, "v": 45}, {"v": "50"}.get) == {"q": 5.0, "v": 50.0}
    with pytest.raises(ValueError):
        ng.weights({"q": 0}, {}.get)
