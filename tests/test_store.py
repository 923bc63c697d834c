import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import events as op, records
from ledgerloom.operators.ranking import ranked
from ledgerloom.plans import store_queries
from ledgerloom.plans.commit import RunStore
from ledgerloom.streaming import sinks

OUTBOX = "event_id string, attempt_count long, status string, last_failure string, delivered_at timestamp, acknowledgement string"


def test_runs_are_committed_once_and_read_through_manifests(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    assert store.manifests().count() == 0
    rows = spark.range(3).withColumn("v", F.lit("x"))
    assert store.commit("k1", {"facts": rows, "runs": rows.limit(1)}) and not store.commit("k1", {"facts": rows})
    assert store.commit("k2", {"facts": rows.limit(1)}) and store.commit("k3", {}, failed="extract")
    rows.write.parquet(str(tmp_path / "runs/unfinished/facts"))
    assert {(r.run_key, r.n) for r in store.read("facts").groupBy("run_key").agg(F.count("*").alias("n")).collect()} == {("k1", 3), ("k2", 1)}
    wanted = spark.createDataFrame([("k1",), ("k3",), ("k4",)], "key string")
    assert {r.key for r in store.pending(wanted, "key").collect()} == {"k3", "k4"}


def test_outbox_versions(spark):
    state = spark.createDataFrame([("a", 0, "pending", None, None, None), ("b", 1, "pending", "timeout", None, None), ("c", 1, "delivered", None, None, None)], OUTBOX)
    tries = spark.createDataFrame([("a", 0, None), ("b", 0, None), ("b", 1, "transport"), ("c", 1, None), ("a", 0, "odd")], "event_id string, expected long, failure string").withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    new = op.attempted(state, tries)
    assert sorted((r.event_id, r.attempt_count, r.status, r.last_failure) for r in new.collect()) == [("a", 1, "delivered", None), ("b", 2, "pending", "transport")]
    now = op.current(state.unionByName(new))
    assert {(r.event_id, r.attempt_count) for r in now.collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert [r.p for r in state.select("event_id", op.invalid_state().alias("p")).orderBy("event_id").collect()] == [None, None, "delivered-without-time"]


def test_built_events_keep_the_contract_and_tampering_shows(spark):
    claims = spark.createDataFrame([("c1", "a1", 0, ["f1", "f2"]), ("c2", "a1", 1, None)], "claim_id string, analysis_id string, ordinal long, fact_ids array<string>")
    made = op.claim_events(claims).unionByName(op.completion_events(claims)).withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    assert {r.p for r in made.select(op.contract(made).alias("p")).collect()} == {None} and made.count() == 3
    changes = {
        "version": made.withColumn("schema_version", F.lit(2)), "id": made.withColumn("event_id", F.lit(" x")), "fingerprint": made.withColumn("fingerprint", F.upper("fingerprint")), "type": made.withColumn("event_type", F.lit("x")), "subject-type": made.withColumn("subject_type", F.lit("x")),
        "time": made.withColumn("created_at", F.lit(None).cast("timestamp")), "references": made.withColumn("refs", F.lit(None).cast(made.schema["refs"].dataType)), "payload": made.withColumn("payload_json", F.lit("x")),
    }
    for problem, rows in changes.items():
        assert {r.p for r in rows.select(op.contract(rows).alias("p")).collect()} == {problem}
    swapped = made.withColumn("refs", F.reverse("refs"))
    assert {r.p for r in swapped.filter("size(refs) > 1").select(op.contract(swapped).alias("p")).collect()} == {"claim-contract", "completion-contract"}


def test_line_sink_repairs_and_rolls_back(tmp_path, monkeypatch):
    path = tmp_path / "out.jsonl"
    sinks.append_line(path, {"id": 1})
    with open(path, "ab") as f:
        f.write(b'{"id": 2, "to')
    sinks.append_line(path, {"id": 3})
    assert [json.loads(x)["id"] for x in path.read_text().splitlines()] == [1, 3]
    before, write = path.read_bytes(), os.write
    monkeypatch.setattr(os, "write", lambda h, data: write(h, data[:3]))
    with pytest.raises(OSError):
        sinks.append_line(path, {"id": 4})
    assert path.read_bytes() == before


def test_reports_are_never_replaced(tmp_path):
    sinks.write_report(tmp_path / "r.json", {"a": 1})
    with pytest.raises(FileExistsError):
        sinks.write_report(tmp_path / "r.json", {})
    with pytest.raises(FileExistsError):
        sinks.distinct_outputs(tmp_path / "x", tmp_path / "x")
    with pytest.raises(FileExistsError):
        sinks.distinct_outputs(tmp_path / "x", tmp_path / "r.json")
    with pytest.raises(ValueError):
        sinks.write_report(tmp_path / "big.json", {"a": "x" * sinks.MAX_REPORT})


def test_event_stream_writes_lines(spark, tmp_path):
    spark.createDataFrame([("e1", 1), ("e2", 2)], "event_id string, n long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id string, n long").parquet(str(tmp_path / "in"))
    sinks.publish_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.value for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out")).collect()) == ['{"event_id":"e1","n":1}', '{"event_id":"e2","n":2}']


def test_ranks_over_chunks(spark, monkeypatch):
    from ledgerloom.operators import ranking

    monkeypatch.setattr(ranking, "CHUNK", 5)
    rows = spark.createDataFrame([("hot", i * 3, i % 2) for i in range(40)] + [("b", 7, 1)], "k string, o long, odd int")
    got = ranked(rows, ["k"], "o", "r", (), F.col("odd") == 1).orderBy("k", "o").collect()
    assert [r.r for r in got if r.k == "hot"] == [i // 2 for i in range(40)]


def test_publish_next_until_nothing_is_pending(spark, tmp_path):
    events = spark.createDataFrame([("e2", "2026-01-02"), ("e1", "2026-01-01"), ("e3", "2026-01-01")], "event_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    state = spark.createDataFrame([(e, 0, "pending", None, None, None) for e in ("e1", "e2")] + [("e3", 1, "delivered", None, None, None)], OUTBOX)
    path = tmp_path / "events.jsonl"
    for _ in range(3):
        new = sinks.publish_next(events, op.current(state), path)
        if new is None:
            break
        state = spark.createDataFrame(state.unionByName(new).collect(), OUTBOX)
    assert new is None and [json.loads(x)["event_id"] for x in path.read_text().splitlines()] == ["e1", "e2"]
    failed = sinks.publish_next(events, spark.createDataFrame([("e1", 0, "pending", None, None, None)], OUTBOX), tmp_path)
    assert [(r.attempt_count, r.status, r.last_failure) for r in failed.collect()] == [(1, "pending", "transport")]


def test_the_second_pass_reuses_what_the_first_committed(spark, data):
    rows = {r["pass"]: r for r in store_queries.run_incremental(spark, data).collect()}
    asked = store_queries.idn_processing_keys(spark, data).count()
    assert rows["second"].reused == rows["first"].extracted > 0 and rows["first"].extracted + rows["second"].extracted == asked
    assert rows["first"].facts > 0 and rows["first"].facts == rows["first"].fact_ids


def test_schema_problems(spark, tmp_path):
    spark.range(1).selectExpr("id a").write.parquet(str(tmp_path / "t.parquet"))
    got = {(r.table_name, r.column_name): r.present for r in records.schema_problems(spark, str(tmp_path), {"t": ("a", "b"), "u": ("a",)}).collect()}
    assert got == {("t", "a"): True, ("t", "b"): False, ("u", "a"): False}


def test_records_are_checked_against_each_other(spark):
    claims = spark.createDataFrame([("c1", "a1", 0), ("c2", "a1", 1), ("c3", "a2", 0), ("c4", "a3", 0), ("c5", "a4", 0)], "claim_id string, analysis_id string, ordinal long")
    analyses = spark.createDataFrame([(f"a{i}",) for i in range(1, 7)], "analysis_id string")
    made = op.claim_events(claims.withColumn("fact_ids", F.array().cast("array<string>"))).unionByName(op.completion_events(claims)).select("event_type", "subject_id", "payload_json", "refs")
    empty = op.completion_events(claims.filter("analysis_id = 'a4'")).select("event_type", F.lit("a5").alias("subject_id"), "payload_json", F.slice("refs", 1, 0).alias("refs"))
    lost = made.filter("not (subject_id = 'c3') and not (subject_id = 'a4')").withColumn("refs", F.when(F.col("subject_id") == "a3", F.array(F.struct(F.lit("claim").alias("record_type"), F.lit("zz").alias("record_id")))).otherwise(F.col("refs"))).unionByName(empty)
    got = {r.analysis_id: r.problem for r in records.completed_records(analyses, claims, lost).collect()}
    assert got == {"a1": None, "a2": "claim-event", "a3": "completion-claims", "a4": "completion-event", "a5": None, "a6": "completion-event"}
    failed = spark.createDataFrame([("a1", None, None, None), ("a9", "{}", None, None), ("b", None, None, "{}"), ("c", "{}", "{}", "{}"), ("a5", None, None, None)], "analysis_id string, semantic_selection_json string, privacy_report_json string, model_json string")
    got = {r.analysis_id: r.problem for r in records.failed_records(failed, claims, lost).collect()}
    assert got == {"a1": "admitted-claims", "a9": "selection-without-policy", "b": "model-without-selection", "c": None, "a5": "events"}


def test_changed_events_show_when_their_fingerprint_is_recomputed(spark):
    claims = spark.createDataFrame([("c1", "a1", 0, ["f1"]), ("c2", "a1", 1, None)], "claim_id string, analysis_id string, ordinal long, fact_ids array<string>")
    made = op.claim_events(claims).unionByName(op.completion_events(claims))
    of = lambda df: {r.problem for r in records.tampered_events(df).collect()}
    assert of(made) == {None} and of(made.withColumn("payload_json", F.replace("payload_json", F.lit(":"), F.lit(" : ")))) == {None}
    assert of(made.withColumn("subject_id", F.lit("x"))) == {"fingerprint"} == of(made.withColumn("refs", F.slice("refs", 1, 0))) and of(made.withColumn("event_id", F.lit("evt_0"))) == {"id"}


def test_stale_reviews_are_checked_against_all_documents(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (1, 5, 10, 11)], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, "prose"), (5, "list"), (10, "junk"), (10, "junk"), (15, "log"), (16, "log"), (16, "code")]
    spark.createDataFrame(labels, "doc_id long, label string").write.parquet(str(tmp_path / "doc_labels.parquet"))
    assert {r.problem: r.n for r in store_queries.evl_stale(spark, str(tmp_path)).collect()} == {"unknown": 2, "duplicate": 2}
