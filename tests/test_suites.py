import math
import random
import statistics

import pytest

from wardstream.operators import evaluate, suites

TRIAGE = "classification string, severity string, confidence double, investigation_required boolean, expected_classification string, expected_severity string, findings array<array<string>>, evidence_ids array<string>"
INVESTIGATION = "status string, conclusion string, expected_conclusion string, steps array<string>, findings array<array<string>>, attempts array<string>"
INTEL = "status string, tools array<string>, findings array<array<string>>, attempts array<string>, candidates array<string>"
RETRIEVAL = "category string, retrieved array<string>, expected array<string>, expect_hit boolean, top_score double"


def one(df):
    return df.first().asDict()


def test_triage(spark):
    rows = [
        ("benign", "low", 0.5, False, "benign", "low", [["a"], ["a", "x", "y"], []], ["a", "b"]),
        ("suspicious", "high", 1.0, False, "suspicious", "low", None, None),
        ("odd", None, None, True, "benign", "low", [["z"]], None),
    ]
    r = one(suites.triage(spark.createDataFrame(rows, TRIAGE)))
    assert (r["n"], r["n_findings"], r["n_hallucinated"]) == (3, 4, 3)
    assert (r["accuracy"], r["severity_accuracy"], r["investigation_agreement"]) == (0.6667, 0.3333, 0.3333)
    assert (r["mean_confidence"], r["validity"], r["grounding"], r["hallucination"]) == (0.75, 0.6667, 0.25, 0.75)
    r = one(suites.triage(spark.createDataFrame([], TRIAGE)))
    assert (r["n"], r["accuracy"], r["mean_confidence"], r["grounding"], r["hallucination"]) == (0, 0.0, 0.0, 1.0, 0.0)


def test_agents(spark):
    rows = [("completed", "benign", "benign", list("abcdef"), [["e"], []], ["q"]), ("failed", None, None, None, None, None)]
    r = one(suites.investigation(spark.createDataFrame(rows, INVESTIGATION)))
    assert (r["completion"], r["conclusion_accuracy"], r["mean_steps"], r["n_over_limit"]) == (0.5, 1.0, 3.0, 1)
    assert (r["grounding"], r["hallucination"], r["n_attempts"]) == (0.5, 0.5, 1)
    rows = [("insufficient_evidence", ["threat_intel", None, "shell", "mitre_lookup"], None, None, ["i"]), (None, None, None, None, None)]
    r = one(suites.threat_intel(spark.createDataFrame(rows, INTEL)))
    assert (r["completion"], r["n_intel_queries"], r["n_technique_queries"], r["n_unauthorized"], r["n_candidates"]) == (0.5, 1, 1, 2, 1)
    assert (r["grounding"], r["hallucination"]) == (1.0, 0.0)
    assert one(suites.threat_intel(spark.createDataFrame([], INTEL)))["completion"] == 0.0


def test_retrieval(spark):
    rows = [
        ("exact_ip", ["a", "b"], ["b"], True, 3.0), ("exact_hash", None, ["b"], True, None), ("mitre_technique", ["t"], ["t"], True, 2.0),
        ("unknown_indicator", [], [], False, None), ("unknown_indicator", ["z"], [], False, 1.0),
    ]
    r = one(suites.retrieval_suite(spark.createDataFrame(rows, RETRIEVAL)))
    assert (r["hit_at_1"], r["hit_at_3"], r["exact_rate"], r["technique_rate"], r["rejection_rate"]) == (0.3333, 0.6667, 0.5, 1.0, 0.5)
    r = one(suites.retrieval_suite(spark.createDataFrame([], RETRIEVAL)))
    assert (r["n"], r["hit_at_1"], r["exact_rate"]) == (0, 0.0, 1.0)


def test_manifest_review_and_shares(spark):
    rows = spark.createDataFrame([(1, "abc", 95, "draft"), (2, "x", 40, "draft"), (3, None, None, None)], "id int, body string, quality_score int, review_status string")
    manifest = spark.createDataFrame([(1, "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), (2, "00"), (4, None), (3, "00")], "id int, record_hash string")
    assert dict(suites.check_manifest(manifest, rows, "id", "body").collect()) == {1: "ok", 2: "changed", 3: "changed", 4: "missing"}
    assert [r.review_status for r in suites.approve(rows).orderBy("id").collect()] == ["approved", "draft", None]
    s = one(suites.score_stats(rows, "quality_score"))
    assert (s["n"], s["mean"], s["least"], s["most"]) == (2, 67.5, 40, 95)
    assert suites.allocate(10, {"a": 1, "b": 1, "c": 1}) == {"a": 3, "b": 3, "c": 4}


@pytest.mark.parametrize("few", [evaluate.FEW_ROWS, 0])
def test_order_statistics(spark, monkeypatch, few):
    rng = random.Random(4)
    values = [rng.gauss(5, 2) for _ in range(3000)] + [7.5] * 500 + [1e308, -1e308, 5e-324, 1e-323, 0.0, -0.0] + [round(rng.random(), 2) for _ in range(500)]
    d = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    monkeypatch.setattr(evaluate, "FEW_ROWS", few)
    places = [1, 2, 500, 1000, 2003, 3900, len(values) - 1, len(values), 3000, 3001]
    assert evaluate.order_statistics(d, "v", places) == [sorted(values)[p - 1] for p in places]
    assert math.isnan(evaluate.order_statistics(d, "v", [len(values) + 1])[0])
    row = evaluate.latency(d.filter("v > 0 and v < 100"), "v").first()
    good = sorted(v for v in values if 0 < v < 100)
    want = [statistics.median(good), good[min(int(0.95 * len(good)), len(good) - 1)], good[0], good[-1]]
    assert row.n == len(good) and all(abs(a - b) < 0.0051 for a, b in zip((row["median"], row.p95, row["min"], row["max"]), want))
    assert tuple(evaluate.latency(d.limit(0), "v").first()) == (0, None, None, None, None, None)
