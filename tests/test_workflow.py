import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import identity
from ledgerloom.operators import workflow as op

ENTRY = "doc string, digest string, ordinal long, kind string, actor string, related long, call_id string, tool_name string, tool_namespace string, source_kind string, source_instance_id string, native_id string, entry_ts timestamp"
SEGMENT = "doc string, ordinal long, segment long, evidence_id string, segment_kind string, origin string, origin_confidence string, text string, content_class string, source_type string"
FACT = "fact_id string, ordinal long, kind string, outcome string, value_json string, evidence_ids array<string>"
RANGE = "analysis string, doc string, first long, last long, route struct<alias:string,gateway:string,model:string,provider:string,routeVersion:string,privacyPolicyVersion:string>, prompt string, schema string"
ROUTE = ("a", "g", "m", "p", "v1", op.POLICY)


def tables(spark, texts):
    """One document for each key of ``texts``: an entry with one segment for each text."""
    entries = [(d, "0" * 64, i, "message", "human", None, None, None, None, "k", "i", "n", None) for d, ts in texts.items() for i in range(len(ts))]
    segments = [(d, i, 0, f"{d}{i}", "text", "human", "high", t, None, None) for d, ts in texts.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(entries, ENTRY), spark.createDataFrame(segments, SEGMENT)


def prepared(spark, texts, ranges, facts=()):
    entries, segments = tables(spark, texts)
    evidence = segments.select("evidence_id", "doc", "ordinal")
    asked = spark.createDataFrame([(f"q{i}", *r[:3], r[3] if len(r) > 3 else ROUTE, "p9", "{}") for i, r in enumerate(ranges)], RANGE)
    return {r.analysis: r for r in op.prepare(asked, entries, segments, spark.createDataFrame(list(facts), FACT), evidence).collect()}


TEXTS = {
    "plain": ["one", "two", "three"], "large": ["x" * 9000, "y"], "many": ["t"] * 51, "path": ["see /srv/app/x.log", "fine"], "blocked": ["-----BEGIN RSA PRIVATE KEY-----", "fine"],
    "grows": ["/a/b " * 1600, "z"],
}


def test_every_outcome_with_the_lineage_it_reached(spark):
    got = prepared(
        spark, TEXTS,
        [("plain", None, None), ("plain", 1, 2), ("plain", 1, 3), ("plain", None, 1), ("plain", 2, 1), ("none", None, None), ("large", None, None), ("large", 0, 1), ("many", None, None), ("many", 1, 50), ("path", None, None), ("blocked", None, None), ("blocked", 1, 1),
         ("grows", None, None), ("grows", 0, 1), ("plain", None, None, ("a", "g", "m", "", "v1", op.POLICY)), ("plain", None, None, ("a", "g", "10.0.0.1", "p", "v1", op.POLICY)), ("plain", None, None, ("a", "g", "m", "p", "v1", "other"))],
    )
    problems = [got[f"q{i}"].problem for i in range(len(got))]
    assert problems == [None, None, *[op.INVALID] * 3, op.UNAVAILABLE, op.TOO_LARGE, None, op.TOO_LARGE, None, None, op.BLOCKED, None, op.TOO_LARGE, None, *[op.INVALID] * 3]
    assert got["q11"].blocked == ["private-key"] and got["q11"].processing_key is None and got["q11"].selection_json is None and got["q11"].fact_ids == []
    assert [tuple(x) for x in got["q10"].redactions] == [("local-path", 1)]
    whole, part, cut, grown = (json.loads(got[q].selection_json) for q in ("q0", "q1", "q7", "q14"))
    assert (whole["mode"], whole["coverage"], whole["selectedEntries"]) == ("complete", op.COMPLETE, 3) and (part["mode"], part["coverage"], part["firstOrdinal"], part["lastOrdinal"]) == ("range", op.PARTIAL, 1, 2)
    assert (cut["truncatedTextSegments"], cut["emittedTextUtf8Bytes"], cut["originalTextUtf8Bytes"]) == (1, 8193, 9001) and (grown["truncatedTextSegments"], grown["emittedTextUtf8Bytes"]) == (1, 8193)
    view = json.loads(got["q1"].run_selection_json)
    assert view["relations"] == {"selected": 0, "total": 0, "truncated": False} and view["entries"] == {"selected": 2, "total": 3, "truncated": True, "firstOrdinal": 1, "lastOrdinal": 2}
    assert got["q0"].processing_key != got["q1"].processing_key and len({r.processing_key for r in got.values() if r.processing_key}) == sum(p is None for p in problems)


def test_facts_are_kept_only_with_all_their_evidence(spark):
    facts = [
        ("f1", 0, "command", "not-applicable", '{"command": {"text": "cat /etc/a/b"}}', ["plain1"]), ("f2", 1, "exit-code", "success", '{"exitCode": 0}', ["plain1", "plain2"]), ("f3", 2, "exit-code", "success", '{"exitCode": 0}', ["plain0", "plain1"]),
        ("f4", 3, "tool-call", "not-applicable", '{"tool": {"kind": "call", "name": "x", "callId": "c"}}', ["plain2"]), ("f5", 4, "exit-code", "success", "{}", ["plain1", "zz"]), ("f6", 5, "exit-code", "success", "{}", ["plain1", "path0"]),
    ]
    got = prepared(spark, TEXTS, [("plain", 1, 2), ("plain", None, None)], facts)
    assert (got["q0"].fact_ids, got["q0"].excluded) == (["f1", "f2", "f4"], 3) and (got["q1"].fact_ids, got["q1"].excluded) == (["f1", "f2", "f3", "f4"], 2)
    assert [tuple(x) for x in got["q0"].redactions] == [("local-path", 1)]


def test_an_empty_document_has_an_empty_input(spark):
    """The conformance check: no entries, no facts, and still a complete input with its key."""
    entries, segments = tables(spark, {"d": ["x"]})
    sound = op.resolved(spark.createDataFrame([("q", "d", None, None, ROUTE, "p", "{}")], RANGE), op.documents(entries, segments).withColumn("total", F.lit(0)).withColumn("whole", F.lit(True)))
    assert [(r.low, r.high, r.n_entries, r.problem) for r in sound.collect()] == [(None, None, 0, None)]
    e, s = op.chosen_content(sound, entries, segments)
    facts = spark.createDataFrame([], FACT)
    f = op.chosen_facts(sound, e, facts, op.fact_homes(facts, segments.select("evidence_id", "doc", "ordinal")))
    row = op.encoded(sound, e, s, f, spark.createDataFrame([], "doc string, doc_facts long")).collect()[0]
    body = json.loads(row.input_json)
    assert body["entries"] == [] == body["facts"] and body["selection"]["coverage"] == op.COMPLETE and "firstOrdinal" not in body["selection"]


def test_sizes_by_sums_are_those_of_the_whole_text(spark):
    entries, segments = tables(spark, TEXTS)
    entries = entries.withColumns({"related": F.when(F.col("ordinal") > 0, 0).cast("long"), "tool_name": F.when(F.col("ordinal") == 1, "é<"), "entry_ts": F.lit("2026-01-01").cast("timestamp")})
    segments = segments.unionByName(segments.withColumns({"segment": F.lit(1).cast("long"), "text": F.lit(None).cast("string"), "segment_kind": F.lit("omitted")})).filter("not (doc = 'path' and ordinal = 1)")
    facts = spark.createDataFrame([("f1", 0, "command", "not-applicable", '{"command": {"text": "a<b"}}', ["plain1"]), ("f2", 1, "exit-code", "success", '{"exitCode": 0}', ["plain1", "plain2"])], FACT)
    places = segments.select("evidence_id", "doc", "ordinal").distinct()
    asked = spark.createDataFrame([(f"q{i}", d, None, None, ROUTE, "p", "{}") for i, d in enumerate(TEXTS)] + [("r", "plain", 1, 2, ROUTE, "p", "{}")], RANGE)
    sound = op.resolved(asked, op.documents(entries, segments).withColumn("whole", F.lit(True))).filter("problem is null")
    e, s = op.chosen_content(sound, entries, segments)
    f = op.chosen_facts(sound, e, facts, op.fact_homes(facts, places))
    per_doc = spark.createDataFrame([("plain", 2)], "doc string, doc_facts long")
    columns = ["analysis", "n_entries", "n_segments", "n_facts", "excluded", "original", "emitted", "cut", "omitted", "coverage", "selection_json", "entries_bytes", "facts_bytes", "input_bytes"]
    both = [sorted(tuple(r) for r in way(sound, e, s, f, per_doc).select(*columns).collect()) for way in (op.encoded, op.measured)]
    assert both[0] == both[1] and len(both[0]) == len(TEXTS)


def test_gaps_in_a_document_make_it_unsound(spark):
    entries, segments = tables(spark, {"a": ["x", "y"], "b": ["x", "y"], "c": ["x"]})
    docs = {r.doc: r.whole for r in op.documents(entries.filter("not (doc = 'a' and ordinal = 0)"), segments.filter("doc <> 'b' or ordinal > 0").unionByName(segments.filter("doc = 'b' and ordinal = 0").withColumn("segment", F.lit(1).cast("long")))).collect()}
    assert docs == {"a": False, "b": False, "c": True}


def test_changed_lineage_shows(spark):
    entries, segments = tables(spark, TEXTS)
    asked = spark.createDataFrame([("q", "plain", None, None, ROUTE, "p9", "{}")], RANGE)
    row = op.prepare(asked, entries, segments, spark.createDataFrame([], FACT), segments.select("evidence_id", "doc", "ordinal"))
    of = lambda df: df.select(op.lineage_problem().alias("p")).first().p
    assert of(row) is None
    for change in ({"prompt": F.lit("other")}, {"input_digest": F.lit("0" * 64)}, {"fact_ids": F.array(F.lit("f"))}, {"schema": F.lit("[]")}, {"revision": F.lit("{}")}):
        assert of(row.withColumns(change)) == "processing-identity"
    assert of(row.withColumn("run_selection_json", F.replace("run_selection_json", F.lit('"selected":3'), F.lit('"selected":2')))) == "selection-projection"
    assert of(row.withColumn("selection_json", F.lit(None).cast("string"))) == "incomplete" and of(row.withColumn("problem", F.lit("x"))) == "failed-with-key"


@pytest.mark.parametrize("stamp,text", [("2026-01-02 03:04:05.678", "2026-01-02T03:04:05.678Z"), ("2026-01-02 03:04:05", "2026-01-02T03:04:05Z"), ("2026-01-02 03:04:05.100200", "2026-01-02T03:04:05.1002Z")])
def test_times(spark, stamp, text):
    assert spark.range(1).select(op._timestamp(F.lit(stamp).cast("timestamp"))).first()[0] == text


def test_keys_need_their_components():
    with pytest.raises(ValueError):
        identity.claim_key({"Revision": F.lit(1)})
