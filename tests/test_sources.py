import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import facts
from ledgerloom.sources import corpus, gateway, route

PROFILE = {
    "gateway": "g", "baseUrl": "https://example.org/v1", "model": "m", "temperature": 0, "providerAllowlist": ["p"], "providerOrder": ["p"], "requiredCapabilities": ["strict"], "zeroDataRetention": False, "disallowPromptTraining": True,
    "timeoutMilliseconds": 60000, "maxOutputTokens": 4096, "maxRetries": 0, "routeVersion": "r1", "privacyPolicyVersion": "v1",
}


def test_route_is_accepted_only_as_reviewed(tmp_path):
    path = tmp_path / "route.json"
    write = lambda p, **more: path.write_text(json.dumps({"routes": {"r": p, **more}}))
    write(PROFILE)
    profile, digest = route.load_route(path, "r", PROFILE)
    assert profile == PROFILE and len(digest) == 64
    write(PROFILE | {"zeroDataRetention": True})
    assert route.load_route(path, "r", PROFILE)[1] != digest
    for change in ({"model": "n"}, {"maxRetries": 1}, {"extra": 1}, {"zeroDataRetention": None}, {"providerOrder": ["q"]}):
        write(PROFILE | change)
        with pytest.raises(route.RouteError):
            route.load_route(path, "r", PROFILE)
    write(PROFILE, other={})
    with pytest.raises(route.RouteError):
        route.load_route(path, "r", PROFILE)
    path.write_text(" " * 70000)
    for missing in (path, tmp_path / "none"):
        with pytest.raises(route.RouteError):
            route.load_route(missing, "r", PROFILE)


def response(**changes):
    claims = changes.pop("claims", {"claims": [{"type": "lesson", "statement": "x", "status": "observed", "confidence": 0.5, "supportingEvidenceIds": ["e"]}]})
    message = {"content": json.dumps(claims), "provider_metadata": {"gateway": {"cost": "0.01", "generationId": "g", "routing": {"originalModelId": "m", "canonicalSlug": "m", "resolvedProvider": "p"}}}}
    message |= changes.pop("message", {})
    body = {"id": "r", "choices": [{"finish_reason": "stop", "message": message}], "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}}
    return json.dumps(body | changes)


def test_recorded_responses(spark):
    routed = lambda slug, cost="0.01": {"provider_metadata": {"gateway": {"cost": cost, "routing": {"originalModelId": "m", "canonicalSlug": slug, "resolvedProvider": "p"}}}}
    cases = [
        (response(), None), (response(message=routed("n")), "rewritten"), (response(choices=[]), "choices"), (response(message={"refusal": "no"}), "refusal"), (response(message={"tool_calls": ["x"]}), "tool-call"), (response(message=routed("m", "a lot")), "cost"),
        (response(usage={"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 4}), "usage"), (response(claims=[]), "content"), ("x", "choices"), (response().replace('"stop"', '"length"'), "finish"), (response(usage=None), None),
    ]
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "request long, body string")
    got = gateway.decoded(rows, "m", "p").orderBy("request").collect()
    assert [r.problem for r in got] == [p for _, p in cases]
    assert got[0].claims[0].supportingEvidenceIds == ["e"] and got[0].tokens == 3 and got[1].claims is None


@pytest.mark.parametrize("status,message,late,category", [(401, None, False, "authentication"), (403, "", False, "permission"), (429, "", False, "rate-limited"), (503, "", False, "upstream"), (400, "bad Schema", False, "schema"), (400, "maximum context length", False, "context"), (422, "moderation", False, "content"), (400, "?", False, "request"), (None, None, True, "timeout"), (None, None, False, "transport")])
def test_error_categories(spark, status, message, late, category):
    row = spark.createDataFrame([(status, message, late)], "s int, m string, l boolean")
    assert row.select(gateway.error_category(F.col("s"), F.col("m"), F.col("l"))).collect()[0][0] == category


def test_sanitized(spark):
    rows = spark.createDataFrame([("a\x00\nb\x7f",), ("é" * 1000,), (None,)], "t string")
    assert [r[0] for r in rows.select(gateway.sanitized(F.col("t"))).collect()] == ["a b", "é" * 512, None]


def case(**changes):
    segment = lambda t: [{"ordinal": 0, "kind": "text", "origin": "tool", "text": t}]
    base = {
        "id": "case-1", "intent": "i",
        "entries": [
            {"ordinal": 0, "kind": "tool-call", "actor": "model", "toolCallId": "c", "toolName": "exec_command", "segments": segment('{"cmd": "pytest"}')},
            {"ordinal": 1, "kind": "tool-result", "actor": "tool", "relatedEntryOrdinal": 0, "toolCallId": "c", "segments": segment("Process exited with code 1")},
        ],
        "facts": [{"id": "f1", "kind": "exit-code", "outcome": "failure", "evidence": [{"entryOrdinal": 1, "segmentOrdinal": 0}], "value": {"exitCode": 1}}],
        "machineExpectations": [{"id": "x1", "kind": "must-not-include-outcome", "value": "success"}], "humanCriteria": [{"id": "h1", "description": "useful"}],
    }
    return json.loads(json.dumps(base)) | changes


def loaded(spark, tmp_path, *cases):
    text = json.dumps({"schemaVersion": 1, "cases": cases})
    (tmp_path / "c.json").write_text(text)
    (tmp_path / "unreviewed.json").write_text(text + " ")
    return corpus.load(spark, str(tmp_path), [hashlib.sha256(text.encode()).hexdigest()])


def test_corpus(spark, tmp_path):
    good = loaded(spark, tmp_path, case())
    assert good.cases.count() == 1 and corpus.violations(good).count() == 0
    made = facts.extract(*corpus.documents(good))
    assert {r.kind for r in made.collect()} == {"tool-call", "command", "test-command", "tool-result", "exit-code", "test-result"}
    assert corpus.same_profile(good.cases, good) and not corpus.same_profile(good.cases.filter("false"), good)


def test_broken_corpora(spark, tmp_path):
    entries = case()["entries"]
    forward = [entries[0] | {"relatedEntryOrdinal": 1}, entries[1]]
    other = [entries[0], entries[1] | {"toolCallId": "d"}]
    fact = case()["facts"][0]
    broken = [
        case(id="a", entries=forward), case(id="b", entries=other), case(id="c", entries=[entries[0] | {"actor": "robot"}, entries[1]]), case(id="d", facts=[fact, fact]), case(id="e", facts=[fact | {"value": {}}]),
        case(id="f", facts=[fact | {"evidence": [{"entryOrdinal": 9}]}]), case(id="g", machineExpectations=[{"id": "x", "kind": "must-be-empty", "value": "v"}]), case(id="h", humanCriteria=[{"id": "h1", "description": " "}]),
    ]
    got = {(r.case, r.rule) for r in corpus.violations(loaded(spark, tmp_path, *broken)).collect()}
    assert got == {("a", "relation"), ("b", "tool-relation"), ("c", "entry"), ("d", "duplicate-id"), ("e", "fact"), ("f", "coordinate"), ("g", "expectation"), ("h", "criterion")}
