import pytest

from ledgerloom.operators import admission as op, evaluation, resolve

EVIDENCE = "evidence_id string, batch string, ordinal long, related long, call_id string, actor string, origin string, text string"
FACTS = "batch string, fact_id string, kind string, outcome string, evidence_ids array<string>"
CANDIDATE = "candidate_id string, batch string, ordinal long, claim_type string, status string, statement string, subject string, scope string, confidence double, attribution string, actor string, origin string, outcome string, supporting array<string>, contradicting array<string>, fact_ids array<string>"
BASE = {
    "candidate_id": "c", "batch": "b", "ordinal": 0, "claim_type": "verification", "status": "observed", "statement": "The suite passed.", "subject": None, "scope": None, "confidence": 0.9, "attribution": None, "actor": None, "origin": None,
    "outcome": "success", "supporting": ["e1"], "contradicting": [], "fact_ids": ["ok"],
}
ROWS = [("e0", "b", 0, None, "k", "model", "model", "call"), ("e1", "b", 1, 0, "k", "tool", "tool", "good"), ("e2", "b", 2, 0, "k", "tool", "tool", "bad"), ("e3", "b", 3, None, None, "human", "human", "far"), ("x1", "b2", 1, None, None, "tool", "tool", "x")]
FACT_ROWS = [("b", "ok", "exit-code", "success", ["e1"]), ("b", "bad", "exit-code", "failure", ["e2"]), ("b", "far", "exit-code", "failure", ["e3"]), ("b", "note", "command", "not-applicable", ["e0"]), ("b2", "out", "exit-code", "success", ["x1"])]
CASES = [
    ({}, "claim-outcome-conflict"),  # the failing fact of the same call is linked and speaks against it
    ({"status": "inferred"}, "claim-outcome-conflict"), ({"status": "inferred", "contradicting": ["e2"]}, None), ({"status": "inferred", "contradicting": None, "outcome": "unknown"}, None), ({"outcome": "unknown", "fact_ids": ["ok", "bad"]}, None),
    ({"supporting": ["e3"], "fact_ids": ["far"], "outcome": "failure"}, None), ({"supporting": ["e3"], "fact_ids": ["far"], "outcome": "failure", "claim_type": "failed-attempt"}, None), ({"claim_type": "failed-attempt"}, "claim-outcome-type-invalid"),
    ({"claim_type": "decision"}, "claim-outcome-type-invalid"), ({"claim_type": "decision", "outcome": None}, None), ({"claim_type": "decision", "outcome": None, "statement": " The suite passed. "}, "claim-duplicate"), ({"claim_type": "nope"}, "claim-value-invalid"), ({"status": None}, "claim-value-invalid"), ({"statement": " "}, "claim-value-invalid"), ({"statement": "x" * 2049}, "claim-value-invalid"),
    ({"scope": "x" * 513}, "claim-value-invalid"), ({"confidence": 1.5}, "claim-value-invalid"), ({"confidence": float("nan")}, "claim-value-invalid"), ({"confidence": None}, "claim-value-invalid"), ({"attribution": "actor"}, "claim-provenance-invalid"), ({"attribution": "unknown", "claim_type": "lesson", "outcome": None}, None),
    ({"statement": "We passed."}, "claim-free-text-attribution-invalid"), ({"statement": "The modelled suite passed.", "claim_type": "lesson", "outcome": None}, None), ({"supporting": []}, "claim-evidence-required"), ({"supporting": None}, "claim-evidence-required"), ({"supporting": ["e1", "e1"]}, "claim-evidence-duplicate"),
    ({"supporting": ["e1", None]}, "claim-evidence-duplicate"), ({"supporting": ["x1"]}, "claim-evidence-unknown"), ({"supporting": ["zz", "zz"]}, "claim-evidence-unknown"), ({"supporting": ["e1", "e1", "zz"]}, "claim-evidence-duplicate"), ({"supporting": [f"z{i}" for i in range(513)]}, "claim-evidence-limit"),
    ({"contradicting": ["zz"]}, "claim-evidence-unknown"), ({"contradicting": ["e1"]}, "claim-evidence-overlap"), ({"fact_ids": ["zz"]}, "claim-fact-unknown"), ({"fact_ids": [f"z{i}" for i in range(257)]}, "claim-fact-limit"), ({"fact_ids": ["note"], "supporting": ["e3"]}, "claim-outcome-unsupported"),
    ({"fact_ids": ["out"]}, "claim-fact-unknown"), ({"fact_ids": ["ok", "ok"]}, "claim-fact-duplicate"), ({"actor": "tool", "claim_type": "lesson", "outcome": None}, None), ({"actor": "human"}, "claim-provenance-invalid"), ({"actor": "robot"}, "claim-provenance-invalid"), ({"origin": "human"}, "claim-provenance-invalid"),
]


def candidates(spark, cases):
    return spark.createDataFrame([tuple((BASE | c | {"candidate_id": f"c{i}", "ordinal": i}).values()) for i, c in enumerate(cases)], CANDIDATE)


def test_first_failing_check(spark):
    evidence, facts = spark.createDataFrame(ROWS, EVIDENCE), spark.createDataFrame(FACT_ROWS, FACTS)
    judged = op.judge(candidates(spark, [c for c, _ in CASES]), evidence, facts)
    got = {r.candidate_id: r.category for r in judged.collect()}
    assert [(c, got[f"c{i}"]) for i, (c, want) in enumerate(CASES) if got[f"c{i}"] != want] == []
    batch = op.batches(judged).collect()[0]
    assert not batch.admitted and batch.category == "claim-outcome-conflict" and batch.candidates == len(CASES)
    good = op.batches(op.judge(candidates(spark, [c | {"subject": f"s{i}"} for i, (c, w) in enumerate(CASES) if w is None]), evidence, facts)).collect()[0]
    assert good.admitted and good.category is None
    many = op.batches(op.judge(candidates(spark, [{"claim_type": "lesson", "outcome": None}] * 65), evidence, facts)).collect()[0]
    assert not many.admitted and many.category == "claim-value-invalid"
    assert op.judge(candidates(spark, []), evidence, facts).count() == 0


def linked(a, b):
    return a[2] == b[2] or (a[4] and a[4] == b[4]) or (a[3] is not None and a[3] == b[2]) or (b[3] is not None and b[3] == a[2]) or (a[3] is not None and a[3] == b[3])


def test_link_keys_equal_the_predicate(spark):
    from pyspark.sql import functions as F

    rows = [(f"r{o}{r}{c}", "d", o, r, c, None, None, None) for o in range(3) for r in (None, 0, 1, 5) for c in (None, "", "k")]
    keys = {r.evidence_id: set(r.k) for r in spark.createDataFrame(rows, EVIDENCE).select("evidence_id", op.link_keys(F.col("ordinal"), F.col("related"), F.col("call_id")).alias("k")).collect()}
    assert all(bool(keys[a[0]] & keys[b[0]]) == bool(linked(a, b)) for a in rows for b in rows)


def test_resolution_is_all_or_nothing(spark):
    evidence = spark.createDataFrame(ROWS, EVIDENCE.replace("batch", "doc"))
    rows = spark.createDataFrame([("a", "b", ["e2", "e1", "e2"], ["e0"]), ("b", "b", ["e1", "x1"], []), ("c", "b", None, None)], "id string, doc string, s array<string>, t array<string>")
    got = [(r.id, r.place, r.text) for r in resolve.resolve(rows, "id", ["s", "t"], evidence).orderBy("place").collect()]
    assert got == [("a", 0, "bad"), ("a", 1, "good"), ("a", 3, "call")]
    assert [tuple(r) for r in resolve.unresolved(rows, "id", ["s", "t"], evidence).collect()] == [("b", 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 40])
def test_report_ranks_and_costs(spark, n):
    import math
    from decimal import Decimal

    cases = spark.createDataFrame([(str(i), True, i % 2, 10 + i, 7 * i, Decimal("0.1")) for i in range(n)] + [("x", False, 0, None, None, None)], "case string, completed boolean, claims long, tokens long, latency long, cost decimal(38,12)")
    r = evaluation.report(cases).collect()[0]
    assert (r.p50_latency, r.p95_latency) == (7 * ((n - 1) // 2), 7 * (math.ceil(0.95 * n) - 1)) and r.mean_latency == 7 * sum(range(n)) // n
    assert (r.cases, r.completed, r.total_cost, r.mean_cost) == (n + 1, n, str((Decimal("0.1") * n).normalize().quantize(Decimal(1)) if n % 10 == 0 else (Decimal("0.1") * n).normalize()), "0.1")


def test_scores_fill_labels_with_zero(spark):
    claims, reviews = spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), spark.createDataFrame([("a", "good"), ("z", "good")], "key string, label string")
    labels = spark.createDataFrame([("good",), ("bad",), ("unreviewed",)], "label string")
    assert {tuple(r) for r in evaluation.scores(claims, reviews, labels).collect()} == {("good", 1), ("bad", 0), ("unreviewed", 2)}
    assert {tuple(r) for r in evaluation.stale(claims, reviews.union(reviews)).collect()} == {("z", "unknown"), ("a", "duplicate"), ("z", "duplicate")}


def test_references_by_their_first_problem(spark):
    import hashlib

    mark = hashlib.sha256(b"t").hexdigest()
    evidence = spark.createDataFrame([("a", "d", "g", mark, "t"), ("b", "d", None, mark, "t"), ("c", "d", "g", "0", "t"), ("o", "x", "g", mark, "t"), ("n", "d", "g", None, None)], "evidence_id string, doc string, digest string, content_hash string, text string")
    rows = spark.createDataFrame([("ok", ["a", "a", "n"]), ("lost", ["a", "zz", None]), ("two", ["a", "o"]), ("gone", ["b", "c"]), ("changed", ["a", "c"]), ("none", None)], "id string, refs array<string>")
    assert {r.id: (r.cited, r.problem) for r in resolve.reference_problems(rows, "id", "refs", evidence).collect()} == {"ok": (2, None), "lost": (3, "unknown"), "two": (2, "several-documents"), "gone": (2, "no-entry"), "changed": (2, "content")}


def test_cases_after_a_fatal_failure_are_not_tried(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, True, "m", "m", "m"), (2, False, "m", "m", "m"), (3, False, "m", "m", "n"), (4, False, None, None, None), (5, True, "m", "m", "m")], "at int, completed boolean, model string, route string, resolved string")
    cases = rows.withColumn("category", evaluation.stored_failure(*(F.col(c) for c in ("completed", "model", "route", "resolved"))))
    tried = evaluation.until_fatal(cases.withColumn("fatal", F.coalesce(F.col("category").isin(*evaluation.FATAL), F.lit(False))), ["at"])
    assert {r.at: (r.attempted, r.category) for r in tried.collect()} == {1: (True, None), 2: (True, "semantic-admission-invalid"), 3: (True, "semantic-generation-response-invalid"), 4: (True, "semantic-generation-transport-failed"), 5: (False, None)}
