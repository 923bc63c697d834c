import copy
import hashlib
import json

import pytest

from ledgerloom.sources import exports

REF = {"canonicalId": "s@local:1", "source": {"kind": "desk", "instanceId": "w1"}, "nativeId": "n1"}
DIGEST = {"scheme": "sha256-canonical-v1", "digest": "a" * 64}


def text_segment(place, text):
    n = len(text.encode())
    return {"ordinal": place, "kind": "text", "origin": "model", "originConfidence": "high", "text": {"text": text, "truncated": False, "originalUtf8Bytes": n, "emittedUtf8Bytes": n}, "contentHash": {"scheme": "sha256-utf8-v1", "digest": hashlib.sha256(text.encode()).hexdigest()}}


def record(kind, **body):
    return {"schemaVersion": 1, "command": "export", "type": kind, "disposition": "untrusted-history", **body}


def document():
    """A session, a relation and two entries, the second with an omitted segment."""
    count = lambda n: {"selected": n, "total": n, "truncated": False}
    first = text_segment(0, '{"cmd":"pytest"}')
    second = [text_segment(0, "1 passed é"), {"ordinal": 1, "kind": "omitted", "origin": "tool", "originConfidence": "low", "contentClass": "image", "sourceType": "png"}]
    size = first["text"]["emittedUtf8Bytes"] + second[0]["text"]["emittedUtf8Bytes"]
    snapshot = {
        "session": REF, "documentDigest": DIGEST, "capturedAt": "2026-01-01T00:00:00.000Z", "sourceState": "present", "sourceObservedAt": "2026-01-01T00:00:00.000Z", "adapterVersion": "1", "freshness": "current", "lineageCoverage": "complete",
        "selection": {"mode": "full", "relations": count(1), "entries": {**count(2), "firstOrdinal": 0, "lastOrdinal": 1}, "segments": count(3), "segmentText": {"emittedUtf8Bytes": size, "originalUtf8Bytes": size, "truncated": False}, "canonicalOmittedSegments": 1, "truncatedTextSegments": 0},
    }
    entry = lambda n, kind, content, **more: record("entry", session=REF, documentDigest=DIGEST, entry={"ordinal": n, "kind": kind, "actor": "model", "content": content, "omittedSegmentCount": 0, **more})
    return [
        record("session", snapshot=snapshot), record("relation", session=REF, documentDigest=DIGEST, relation={"ordinal": 0, "kind": "parent", "target": REF, "confidence": "high"}),
        entry(0, "tool-call", [first], toolCallId="c1", toolName="shell"), entry(1, "tool-result", second, relatedEntryOrdinal=0, timestamp="2026-01-01T00:00:01.000Z"),
    ]


def put(lines, place, path, value):
    """A changed copy; the value ``...`` removes the field."""
    lines = copy.deepcopy(lines)
    at = lines[place]
    *way, last = path.split(".")
    for step in way:
        at = at[int(step) if step.isdigit() else step]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return lines


ABSENT = "required field is absent or malformed"
MUTATIONS = [
    ((0, "schemaVersion", 2), "unsupported schema version"), ((0, "command", "x"), "unexpected command"), ((2, "disposition", "trusted"), "unsupported trust disposition"), ((3, "documentDigest", {**DIGEST, "digest": "b" * 64}), "session identity or document digest drift"),
    ((3, "session", {**REF, "nativeId": "other"}), "session identity or document digest drift"), ((2, "entry.content.0.text.truncated", True), "invalid selected text"), ((0, "snapshot.selection.entries.total", ...), ABSENT),
    ((0, "snapshot.capturedAt", "2026-01-01T00:00:00Z"), "invalid timestamp"), ((2, "entry.content.0.text.text", None), ABSENT), ((3, "entry.timestamp", None), ABSENT), ((3, "entry.relatedEntryOrdinal", None), ABSENT), ((2, "entry.toolName", None), ABSENT),
    ((0, "snapshot.unknown", 1), "invalid session record"), ((2, "entry.unknown", 1), "invalid entry record"), ((3, "entry.ordinal", 2), "invalid entry coordinate"), ((2, "entry.content.0.contentHash.digest", "c" * 64), "content hash mismatch"),
    ((2, "entry.actor", "robot"), "invalid entry coordinate"), ((3, "entry.relatedEntryOrdinal", 7), "related entry ordinal is out of range"), ((3, "entry.relatedEntryOrdinal", 1), "invalid related entry ordinal"), ((1, "relation.kind", "x"), "invalid relation"),
    ((0, "snapshot.selection.segments", {"selected": 4, "total": 4, "truncated": False}), "segment counts do not match selection"), ((0, "snapshot.selection.mode", "range"), "export selection is not full"), ((3, "entry.content.1.contentClass", "x"), "invalid omitted segment"),
    ((3, "entry.omittedSegmentCount", 1), "full export omitted segment records"), ((0, "snapshot.adapterVersion", ""), "adapter version is absent"), ((0, "snapshot.freshness", "x"), "invalid source metadata"),
]


def lines_of(name, records):
    return [(name, i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]


def test_mutations_of_a_valid_document(spark):
    good = document()
    rows, expected = lines_of("good", good), {"good": None}
    for i, (change, category) in enumerate(MUTATIONS):
        rows += lines_of(f"m{i}", put(good, *change))
        expected[f"m{i}"] = category
    extra = {
        "swap": ([good[0], good[2], good[1], good[3]], "relation record is out of order"), "two": ([good[0], *good], "session record must be first and unique"), "headless": (good[2:], "entry record cannot precede session"),
        "short": (good[:3], "record counts do not match selection"), "torn": (good[:3] + [json.dumps(good[3])[:40]], "invalid JSON"), "other": (good[:1] + [{**good[1], "type": "x"}], ABSENT),
        "blank": ([good[0], "  ", *good[1:]], None), "string version": (put(good, 1, "schemaVersion", "1"), "unsupported schema version"),
    }
    for name, (records, category) in extra.items():
        rows += lines_of(name, records)
        expected[name] = category
    frame = spark.createDataFrame(rows, "doc string, line_no long, record_json string")
    records = exports.read_records(frame)
    assert {r.doc: r.category for r in exports.judge(records).collect()} == expected
    assert {r.doc for r in exports.accepted(records).select("doc").collect()} == {"good", "blank"}
    assert exports.judge(exports.read_records(frame.filter("false"))).count() == 0


def test_folder_and_reviewed_files(spark, tmp_path):
    text = "\n".join(map(json.dumps, document()))
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text(text[:-9])
    judged = exports.judge(exports.read_records(exports.read_folder(spark, str(tmp_path)))).collect()
    assert {r.doc.rsplit("/", 1)[1]: r.category for r in judged} == {"a.jsonl": None, "b.jsonl": "invalid JSON"}
    mark = hashlib.sha256(text.encode()).hexdigest()
    seen = lambda *a, **k: {(r.path.rsplit("/", 1)[1], r.text, r.failure) for r in exports.reviewed(spark, str(tmp_path), *a, **k).collect()}
    assert seen([mark]) == {("a.jsonl", text, None), ("b.jsonl", None, "not-reviewed")}
    assert seen([mark], limit=10) == {("a.jsonl", None, "too-large"), ("b.jsonl", None, "too-large")}


@pytest.mark.parametrize("error,category", [("context canceled", "canceled"), ("output exceeds cap", "too-large"), ("session not found", "not-found"), ("executable file missing", "unavailable"), ("exit 3", "exit"), (None, None)])
def test_failure_categories(spark, error, category):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(error,)], "e string").select(exports.failure_category(F.col("e"))).collect()[0][0] == category


def test_files_that_cannot_be_read_are_reported(spark, tmp_path, monkeypatch):
    (tmp_path / "large.jsonl").write_text("x" * 60)
    (tmp_path / "bytes.jsonl").write_bytes(b"{\xff}")
    (tmp_path / "fine.jsonl").write_text("{}\n")
    monkeypatch.setattr(exports, "MAX_EXPORT_BYTES", 50)
    got = {(r.doc.rsplit("/", 1)[1], r.line_no, r.record_json, r.failure) for r in exports.read_folder(spark, str(tmp_path)).collect()}
    assert got == {("large.jsonl", 0, None, "too-large"), ("bytes.jsonl", 0, None, "invalid-utf8"), ("fine.jsonl", 0, "{}", None), ("fine.jsonl", 1, "", None)}


def test_commands_are_run_for_each_session(spark):
    def runner(key):
        return {"a": (0, b"{}\n{}", ""), "b": (1, b"", "session not found"), "c": (0, b"\xff", ""), "d": (127, b"", ""), "e": (-2, b"", ""), "f": (3, b"", None)}[key]

    rows = exports.run_command(spark, spark.createDataFrame([(k,) for k in "abcdefa"], "session_id string"), runner).collect()
    assert {(r.doc, r.line_no, r.failure) for r in rows} == {("a", 0, None), ("a", 1, None), ("b", 0, "not-found"), ("c", 0, "invalid-utf8"), ("d", 0, "unavailable"), ("e", 0, "canceled"), ("f", 0, "exit")}


def test_requested_sessions(spark):
    judged = spark.createDataFrame([("a", None), ("b", None), ("c", "broken")], "doc string, category string")
    records = spark.createDataFrame([("a", 0, "s1"), ("b", 0, "s9"), ("b", 1, "s2"), ("c", 0, "s3")], "doc string, line_no long, session_id string")
    wanted = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3"), ("d", "s4")], "doc string, session_id string")
    got = {r.doc: r.category for r in exports.requested(judged, records, wanted).collect()}
    assert got == {"a": None, "b": "exported session does not match the request", "c": "broken", "d": "session was not found"}


def test_constants_are_no_json_and_lone_surrogates_count_as_replacement():
    assert exports.read_record('{"schemaVersion": NaN}')["category"] == "invalid JSON"
    assert exports._utf8("a\ud800") == "a\ufffd".encode() and exports._utf8("é") == b"\xc3\xa9"
