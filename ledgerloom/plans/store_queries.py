"""Queries of the store, events, outbox, reuse and evaluation (STO, EVT, OBX, RUN, EVL), with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.text import clean_id, sql_clean_id
from ..operators import evaluation, events as op, records, workflow
from ..session import cut, scratch, table
from . import adapters
from .claim_queries import ADM, CANDIDATES, FACTS, PREPARED, adm_batches, candidates, facts, prepared
from .claim_queries import ORACLE as CLAIM_ORACLE
from .claim_queries import _SEL as SELECTED
from .commit import RunStore
from .fact_queries import CTE as FACT_CTE
from .fact_queries import facts_of

#: The first delivery of each event; its outbox record follows from the delivery's number (some records are invalid).
EVENTS = adapters.EVENTS
OUTBOX = f"""
select event_id, case when delivery_id % 3 = 0 then 'delivered' when delivery_id % 97 = 1 then 'lost' else 'pending' end as status, delivery_id % 4 as attempt_count,
  case when delivery_id % 3 <> 0 and delivery_id % 4 > 0 and delivery_id % 5 > 0 then 'timeout' end as last_failure,
  case when delivery_id % 3 = 0 and delivery_id % 7 > 0 then received_at end as delivered_at, cast(null as string) as acknowledgement
from ({EVENTS}) e
"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.events(spark, d)


def outbox(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("delivery_id")
    pending, delivered = n % 3 != 0, n % 3 == 0
    return events(spark, d).select(
        "event_id", F.when(delivered, "delivered").when(n % 97 == 1, "lost").otherwise("pending").alias("status"), (n % 4).alias("attempt_count"), F.when(pending & (n % 4 > 0) & (n % 5 > 0), "timeout").alias("last_failure"),
        F.when(delivered & (n % 7 > 0), F.col("received_at")).alias("delivered_at"), F.lit(None).cast("string").alias("acknowledgement"),
    )


def sto_events(spark: SparkSession, d: str) -> DataFrame:
    """STO-1: pending events with their outbox state, by time and id."""
    rows = events(spark, d).join(outbox(spark, d).filter("status = 'pending'"), "event_id")
    return rows.select("event_id", "event_type", "subject_id", "attempt_count", "last_failure").orderBy("created_at", "event_id")


def sto_event(spark: SparkSession, d: str) -> DataFrame:
    """STO-2, 13, 14: one event by id."""
    wanted = events(spark, d).agg(F.max("event_id").alias("event_id"))
    return events(spark, d).join(F.broadcast(wanted), "event_id").join(outbox(spark, d), "event_id").select("event_id", "event_type", "subject_id", "status", "attempt_count")


def sto_next_pending(spark: SparkSession, d: str) -> DataFrame:
    """STO-3: the oldest pending event."""
    return op.oldest_pending(events(spark, d), outbox(spark, d)).select("event_id", "event_type", "subject_id")


def sto_missing_references(spark: SparkSession, d: str) -> DataFrame:
    """STO-4: references to records that are not stored, by kind."""
    done = table(spark, d, "semantic_details").filter("status = 'completed'")
    missing = op.missing_references(events(spark, d), done, table(spark, d, "claim_candidates"), table(spark, d, "facts"))
    return missing.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))


def sto_run_facts(spark: SparkSession, d: str) -> DataFrame:
    """STO-5: the facts of each run: their number, and whether their ordinals are 0..n-1, each once."""
    each = facts(spark, d).groupBy("analysis_run_id", "ordinal").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy("analysis_run_id").agg(F.sum("c").alias("n"), ((F.max("c") == 1) & (F.min("ordinal") == 0) & (F.max("ordinal") == F.sum("c") - 1)).alias("in_order"))


def idn_processing_keys(spark: SparkSession, d: str) -> DataFrame:
    """IDN-7: the processing key of each document's fact run, over its revision and its whole selection."""
    return workflow.fact_runs(workflow.documents(adapters.entries(spark, d), adapters.segments(spark, d)))


#: The first pass of the incremental fact stage takes the documents whose digest begins below this hex digit.
FIRST_PASS = "8"


def run_incremental(spark: SparkSession, d: str) -> DataFrame:
    """RUN-1, STO-5 to 11: facts of documents in two passes through a run store; the second reuses what the first committed.

    A pass reads the committed keys, extracts the facts of the other documents, and commits
    runs and facts together; the rows are read back from the store.
    """
    store = RunStore(spark, scratch(spark, "runs"))
    entries, segments = adapters.entries(spark, d), adapters.segments(spark, d)
    keys = cut(workflow.fact_runs(workflow.documents(entries, segments)))
    for name, wanted in (("first", keys.join(entries.filter(F.substring("digest", 1, 1) < FIRST_PASS).select("doc").distinct(), "doc", "left_semi")), ("second", keys)):
        due = wanted if name == "first" else wanted.join(store.read("runs").select("processing_key"), "processing_key", "left_anti")
        own = due.select("doc")
        found = facts_of(entries.join(own, "doc", "left_semi"), segments.join(own, "doc", "left_semi"))
        store.commit(name, {"runs": due, "facts": found.select("doc", "ordinal", "segment", "step", "kind", "fact_id", "fingerprint", "value_json")})
    facts_ = store.read("facts").groupBy("run_key").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("fact_id").alias("fact_ids"))
    runs = store.read("runs").groupBy("run_key").agg(F.count(F.lit(1)).alias("extracted"))
    asked = keys.count()
    out = runs.join(facts_, "run_key", "left")
    return out.select(F.col("run_key").alias("pass"), "extracted", F.when(F.col("run_key") == "second", asked - F.col("extracted")).otherwise(0).alias("reused"), F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("fact_ids", F.lit(0)).alias("fact_ids"))


def run_workflow(spark: SparkSession, d: str) -> DataFrame:
    """RUN-2, 3, STO-6 to 11: the claim stage of all analyses through a run store, twice; the second time everything is reused.

    One commit holds the runs (completed and failed), their details, claims, events and outbox
    records, and is seen as a whole or not at all.  A completed run's key is its unit of reuse; a
    failed run has no key and is tried again.
    """
    store = RunStore(spark, scratch(spark, "claims"))
    runs = cut(prepared(spark, d).select("analysis", "doc", "problem", "processing_key", "selection_json", "run_selection_json", "input_digest", "fact_ids", "redactions", "blocked"))
    judged = cut(adm_batches(spark, d).select(F.col("batch").alias("analysis"), F.col("category").alias("rejected")))
    everyone = candidates(spark, d).select(F.col("batch").alias("analysis"), "ordinal", "candidate_id", "fact_ids")
    counts = []
    for turn in ("first", "second"):
        done = store.read("runs").filter("processing_key is not null").select("processing_key").distinct() if turn == "second" else None
        due = runs if done is None else runs.join(done, "processing_key", "left_anti")
        tried = due.join(judged, "analysis", "left").withColumn("category", F.coalesce("problem", "rejected"))
        tried = cut(tried.withColumns({"status": F.when(F.col("category").isNull(), "completed").otherwise("failed"), "processing_key": F.when(F.col("category").isNull(), F.col("processing_key"))}))
        own = tried.filter("status = 'completed'").select("analysis")
        claims = cut(everyone.join(own, "analysis", "left_semi").withColumn("claim_id", identity.derived_id("claim_", F.col("candidate_id"))))
        told = claims.select("claim_id", F.col("analysis").alias("analysis_id"), "ordinal", F.coalesce("fact_ids", F.array().cast("array<string>")).alias("fact_ids"))
        silent = own.join(claims.select("analysis").distinct(), "analysis", "left_anti").select(F.lit(None).cast("string").alias("claim_id"), F.col("analysis").alias("analysis_id"), F.lit(0).cast("long").alias("ordinal"))
        made = cut(op.claim_events(told).unionByName(op.completion_events(told.select("claim_id", "analysis_id", "ordinal").unionByName(silent))))
        outbox_ = made.select("event_id", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempt_count"))
        details = tried.select("analysis", "selection_json", "run_selection_json", "input_digest", "fact_ids", "redactions", "blocked")
        store.commit(turn, {"runs": tried.select("analysis", "doc", "status", "processing_key", "category"), "details": details, "claims": claims, "events": made, "outbox": outbox_})
    for name in ("runs", "details", "claims", "events", "outbox"):
        counts.append(store.read(name).groupBy("run_key").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.col("run_key").alias("turn"), "n"))
    return reduce(DataFrame.unionByName, counts)


#: What the store must hold.
REQUIRED = {
    "facts": ("fact_id", "fingerprint", "analysis_run_id", "ordinal", "value_json", "evidence_ids"), "semantic_details": ("analysis_id", "status", "schema_digest", "model_json"), "claim_candidates": ("candidate_id", "analysis_id", "claim_id"),
    "domain_events": ("event_id", "fingerprint", "payload_json", "refs", "created_at", "attempt_count"), "event_outbox": ("event_id", "status"),
}


def sto_catalog(spark: SparkSession, d: str) -> DataFrame:
    """STO-17: the columns the store must have, and whether they are there (an outbox is not among these tables)."""
    return records.schema_problems(spark, d, REQUIRED)


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Admitted claims and first deliveries, with the ids as they compare."""
    claims = candidates(spark, d).filter("claim_id is not null").select(clean_id("claim_id").alias("claim_id"), F.col("batch").alias("analysis_id"), "ordinal")
    told = events(spark, d).select("event_type", clean_id("subject_id").alias("subject_id"), "payload_json", F.transform("refs", lambda r: F.struct(r["record_type"].alias("record_type"), clean_id(r["record_id"]).alias("record_id"))).alias("refs"))
    return claims, told


def sto_completed(spark: SparkSession, d: str) -> DataFrame:
    """STO-18: completed analyses by the first rule that their claims and events break."""
    claims, told = _stored(spark, d)
    return records.completed_records(table(spark, d, "semantic_details").filter("status = 'completed'"), claims, told)


def sto_failed(spark: SparkSession, d: str) -> DataFrame:
    """STO-19: failed analyses by the first rule they break."""
    claims, told = _stored(spark, d)
    return records.failed_records(table(spark, d, "semantic_details").filter("status = 'failed'"), claims, told)


def sto_lineage(spark: SparkSession, d: str) -> DataFrame:
    """STO-20: analyses by the first gap in their base lineage."""
    return records.lineage(table(spark, d, "semantic_details"))


def sto_tampered(spark: SparkSession, d: str) -> DataFrame:
    """STO-21: the events of all claims with their fingerprints recomputed on reading, a part of them changed after they were built."""
    claims = _claims(spark, d).withColumn("fact_ids", F.array_compact("fact_ids"))
    made = op.claim_events(claims).unionByName(op.completion_events(claims))
    last = F.substring("event_id", -1, 1)
    bent = made.withColumns({"change": F.when(last.isin("0", "1"), "subject").when(last == "2", "id").when(last == "3", "spaces"), "subject_id": F.when(last.isin("0", "1"), F.concat("subject_id", F.lit("x"))).otherwise(F.col("subject_id"))})
    bent = bent.withColumns({"payload_json": F.when(F.col("change") == "spaces", F.replace("payload_json", F.lit(":"), F.lit(" : "))).otherwise(F.col("payload_json")), "event_id": F.when(F.col("change") == "id", F.concat("event_id", F.lit("0"))).otherwise(F.col("event_id"))})
    found = records.tampered_events(bent)
    return bent.select("event_id", "change").join(found, "event_id").groupBy("change", "problem").agg(F.count(F.lit(1)).alias("n"))


def sto_claim_analyses(spark: SparkSession, d: str) -> DataFrame:
    """STO-12: completed analyses with their claims and events, by joins instead of a query for each."""
    done = table(spark, d, "semantic_details").filter("status = 'completed'").select("analysis_id")
    held = candidates(spark, d).filter("claim_id is not null").select(F.col("batch").alias("analysis_id"), clean_id("claim_id").alias("claim_id"))
    told = events(spark, d).filter("subject_type = 'claim'").select(clean_id("subject_id").alias("claim_id")).distinct().withColumn("told", F.lit(1))
    finished = events(spark, d).filter("subject_type = 'analysis'").select(clean_id("subject_id").alias("analysis_id")).distinct().withColumn("finished", F.lit(True))
    each = held.join(told, "claim_id", "left").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("claims"), F.count("told").alias("claim_events"))
    return done.join(each, "analysis_id", "left").join(finished, "analysis_id", "left").select("analysis_id", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("claim_events", F.lit(0)).alias("claim_events"), F.coalesce("finished", F.lit(False)).alias("finished"))


def sto_constraints(spark: SparkSession, d: str) -> DataFrame:
    """The store's unique keys as aggregates: rows beyond the first of their key."""
    keys = (("domain_events", "event_id"), ("facts", "fact_id"), ("facts", "fingerprint"), ("claim_candidates", "candidate_id"), ("claim_candidates", "claim_id"), ("semantic_details", "analysis_id"))
    parts = [table(spark, d, t).filter(F.col(k).isNotNull()).groupBy(k).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit(t).alias("table_name"), F.lit(k).alias("key"), "n") for t, k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sto_outbox_next(spark: SparkSession, d: str) -> DataFrame:
    """STO-15, 16, OBX-2, 3: the versions after one round of attempts, some of which lost the race."""
    state = outbox(spark, d)
    tries = state.select("event_id", (F.col("attempt_count") - F.when(F.substring("event_id", -1, 1) == "0", 1).otherwise(0)).alias("expected"), F.when(F.substring("event_id", -1, 1).isin("1", "2"), "transport").alias("failure"), F.lit("2026-06-01").cast("timestamp").alias("at"))
    new = op.attempted(state, tries)
    return op.current(state.unionByName(new)).groupBy("status", "attempt_count", "last_failure").agg(F.count(F.lit(1)).alias("n"))


def obx_states(spark: SparkSession, d: str) -> DataFrame:
    """OBX-1: outbox records by the rule they break."""
    return outbox(spark, d).select(op.invalid_state().alias("problem")).filter("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def evt_contract(spark: SparkSession, d: str) -> DataFrame:
    """EVT-3 to 5, STO-21: every delivery by the first rule it breaks."""
    rows = table(spark, d, "domain_events")
    return rows.select(op.contract(rows).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Admitted claims, each id once."""
    each = candidates(spark, d).filter("claim_id is not null").groupBy("claim_id").agg(F.min(F.struct("batch", "ordinal", "candidate_id", F.coalesce("fact_ids", F.array().cast("array<string>")).alias("fact_ids"))).alias("c"))
    return each.select("claim_id", F.col("c.batch").alias("analysis_id"), "c.ordinal", "c.fact_ids")


def evt_built(spark: SparkSession, d: str) -> DataFrame:
    """EVT-1, 2, IDN-10: the events of all claims and analyses, with their ids."""
    claims = _claims(spark, d).withColumn("fact_ids", F.array_compact("fact_ids"))
    made = op.claim_events(claims).unionByName(op.completion_events(claims))
    return made.select("event_type", "subject_id", "event_id", "fingerprint", F.size("refs").alias("references"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    model = F.from_json("model_json", "totalTokens bigint, latencyMilliseconds bigint, costUsd string")
    n = candidates(spark, d).groupBy(F.col("batch").alias("case")).agg(F.count(F.lit(1)).alias("claims"))
    rows = table(spark, d, "semantic_details").select(F.col("analysis_id").alias("case"), (F.col("status") == "completed").alias("completed"), F.col("recorded_at"), F.when(F.json_object_keys("model_json").isNotNull(), model).alias("m"))
    return rows.join(n, "case", "left").select("case", "completed", "recorded_at", F.coalesce("claims", F.lit(0)).alias("claims"), F.col("m.totalTokens").alias("tokens"), F.col("m.latencyMilliseconds").alias("latency"), F.expr("try_cast(m.costUsd as decimal(38,12))").alias("cost"))


def evl_report(spark: SparkSession, d: str) -> DataFrame:
    """EVL-2 to 8: counts, tokens, latency ranks and exact costs."""
    return evaluation.report(_cases(spark, d))


def evl_failures(spark: SparkSession, d: str) -> DataFrame:
    """EVL-2: batches by the category they fail with; admitted ones have none."""
    return adm_batches(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def evl_expectations(spark: SparkSession, d: str) -> DataFrame:
    """EVL-3, 9: expectations on each analysis' claims, passed of evaluated."""
    cases = _cases(spark, d).select("case", "completed")
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in (("must-be-empty", ""), ("must-include-type", "verification"), ("must-not-include-outcome", "failure"))])
    expected = cases.select("case", F.explode(wanted).alias("e")).select("case", "e.kind", "e.value")
    claims = candidates(spark, d).select(F.col("batch").alias("case"), "claim_type", "outcome")
    out = evaluation.expectations(cases, claims, expected)
    return out.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("passed").alias("passed"))


def evl_citations(spark: SparkSession, d: str) -> DataFrame:
    """EVL-10: each candidate's cited evidence, once, by first place."""
    from ..operators.resolve import cited

    return cited(candidates(spark, d), "candidate_id", ["supporting", "contradicting"]).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("cited"), F.max("place").alias("last_place"))


def evl_review_template(spark: SparkSession, d: str) -> DataFrame:
    """EVL-11: a row for every claim and criterion."""
    return _claims(spark, d).select("claim_id", F.explode(F.array(*map(F.lit, ("supported", "useful", "scoped")))).alias("criterion"))


def evl_attempted(spark: SparkSession, d: str) -> DataFrame:
    """EVL-12: analyses in order of time, those after the first fatal failure not attempted, the others by their failure."""
    model = F.from_json("model_json", "requestedRoute struct<model:string>, resolvedModel string")
    rows = table(spark, d, "semantic_details").select("analysis_id", "recorded_at", (F.col("status") == "completed").alias("completed"), F.when(F.json_object_keys("model_json").isNotNull(), model).alias("m"))
    cases = rows.withColumn("category", evaluation.stored_failure(F.col("completed"), F.col("m"), F.col("m.requestedRoute.model"), F.col("m.resolvedModel")))
    cases = cases.withColumn("fatal", F.coalesce(F.col("category").isin(*evaluation.FATAL), F.lit(False)))
    tried = evaluation.until_fatal(cases, ["recorded_at", "analysis_id"])
    return tried.groupBy("attempted", F.when(F.col("attempted"), F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_labels").groupBy(F.col("doc_id").alias("key")).agg(F.min("label").alias("label"))


def evl_scores(spark: SparkSession, d: str) -> DataFrame:
    """EVL-13: documents by review label, with zero-filled labels and the unreviewed."""
    names = spark.createDataFrame([(x,) for x in ("prose", "list", "table", "log", "code", "junk", "useful", "unreviewed")], "label string")
    return evaluation.scores(table(spark, d, "documents").select(F.col("doc_id").alias("key")), _reviews(spark, d), names)


def evl_useful(spark: SparkSession, d: str) -> DataFrame:
    """EVL-14: sessions with a document that is labelled prose."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "session_id")
    return docs.join(_reviews(spark, d).filter("label = 'prose'"), "key").agg(F.count_distinct("session_id").alias("sessions"))


def evl_stale(spark: SparkSession, d: str) -> DataFrame:
    """EVL-15: reviews that must be rejected, by problem."""
    reviews = table(spark, d, "doc_labels").select(F.col("doc_id").alias("key"))
    return evaluation.stale(table(spark, d, "documents").select(F.col("doc_id").alias("key")), reviews).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


_Q = """'"' || replace({}, '"', '\\"') || '"'"""
_EV = f"with ev as ({EVENTS}), ob as ({OUTBOX.replace('as string', 'as varchar')})\n"
_CL = f"""with ca as ({CANDIDATES}), cl as (select claim_id, batch analysis_id, ordinal, list_filter(coalesce(fact_ids, []::varchar[]), lambda x: x is not null) fact_ids from ca where claim_id is not null
  qualify row_number() over (partition by claim_id order by batch, ordinal, candidate_id) = 1)
"""
_KINDS = ", ".join(f"'{k}'" for k in op.REFERENCE_TYPES)
_B = lambda x, n: f"coalesce(length({x}) > 0 and trim({x}, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(133)||chr(160)) = {x} and strlen({x}) <= {n}, false)"
_RUN = f"""with en as ({adapters.ENTRIES}), sg as ({adapters.SEGMENTS}),
e as (select doc, count(*) n, min(coalesce(digest, '')) dg, min(coalesce(source_kind, '')) sk, min(coalesce(source_instance_id, '')) si, min(coalesce(native_id, '')) ni from en group by doc),
s as (select doc, count(*) n, coalesce(sum(strlen(text)), 0)::bigint b, count(case when segment_kind = 'omitted' then 1 end) o from sg group by doc),
k as (select e.doc, dg, sha256('{{"Revision":{{"sourceKind":"sessions","canonicalId":"' || e.doc || '","nativeSourceKind":"' || sk || '","sourceInstanceId":"' || si || '","nativeId":"' || ni || '","documentDigest":{{"scheme":"sha256-sessions-document-jcs-v1","digest":"' || dg
  || '"}}}},"Selection":{{"mode":"full","relations":{{"selected":0,"total":0,"truncated":false}},"entries":{{"selected":' || e.n || ',"total":' || e.n || ',"truncated":false,"firstOrdinal":0,"lastOrdinal":' || e.n - 1 || '}},"segments":{{"selected":' || coalesce(s.n, 0) || ',"total":' || coalesce(s.n, 0)
  || ',"truncated":false}},"segmentText":{{"emittedUtf8Bytes":' || coalesce(b, 0) || ',"originalUtf8Bytes":' || coalesce(b, 0) || ',"truncated":false}},"canonicalOmittedSegments":' || coalesce(o, 0) || ',"truncatedTextSegments":0,"coverage":"complete-retained-snapshot"}},"Extractor":"sessions-deterministic-facts","Version":"1","Schema":1}}') processing_key
  from e left join s using (doc))
"""
_OBJ = lambda c: f"(json_type(case when json_valid({c}) then {c} end) = 'OBJECT')"
_REC = f"""with ev as ({EVENTS}), ca as ({CANDIDATES}), h as (select {sql_clean_id("claim_id")} claim_id, batch analysis_id, min(ordinal) o from ca where claim_id is not null group by all),
t as (select event_type, {sql_clean_id("subject_id")} sid, payload_json p, list_transform(refs, lambda r: {sql_clean_id("r.record_id")}) ids from ev)
"""
_CASES = f"""with ca as ({CANDIDATES}), cs as (
  select analysis_id "case", status = 'completed' completed, recorded_at, coalesce((select count(*) from ca where batch = analysis_id), 0) claims,
    case when json_valid(model_json) then try_cast(json_extract_string(model_json, '$.totalTokens') as bigint) end tokens,
    case when json_valid(model_json) then try_cast(json_extract_string(model_json, '$.latencyMilliseconds') as bigint) end latency,
    case when json_valid(model_json) then try_cast(json_extract_string(model_json, '$.costUsd') as decimal(38,12)) end cost from semantic_details)
"""
_DEC = lambda x: f"regexp_replace(regexp_replace(({x})::decimal(38,12)::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"

_BUILT = _CL + """, ce as (select 'claim.admitted' event_type, claim_id subject_id, 'claim' st, '{"analysisId":"' || analysis_id || '","claimId":"' || claim_id || '"}' p,
        '{"recordType":"analysis","recordId":"' || analysis_id || '"}' || list_aggregate(list_transform(fact_ids, lambda x: ',{"recordType":"fact","recordId":' || to_json(x)::varchar || '}') || [''], 'string_agg', '') refs, len(fact_ids) + 1 nr from cl),
      ae as (select 'analysis.completed', analysis_id, 'analysis', '{"analysisId":"' || analysis_id || '","claimIds":[' || string_agg('"' || claim_id || '"', ',' order by ordinal, claim_id) || ']}',
        string_agg('{"recordType":"claim","recordId":"' || claim_id || '"}', ',' order by ordinal, claim_id), count(*) from cl group by analysis_id),
      u as (select * from ce union all select * from ae), f as (select *, sha256('{"SchemaVersion":1,"Type":"' || event_type || '","SubjectType":"' || st || '","SubjectID":"' || subject_id || '","Payload":' || p || ',"References":[' || refs || ']}') fp from u)
, bt as (select event_type, subject_id, 'evt_' || left(sha256(fp), 32) event_id, fp fingerprint, nr "references" from f)
"""

ORACLE_OF_BATCHES = CLAIM_ORACLE["adm_batches"]
ORACLE = {
    "sto_events": _EV + "select event_id, event_type, subject_id, attempt_count, last_failure from ev join ob using (event_id) where status = 'pending'",
    "sto_event": _EV + "select event_id, event_type, subject_id, status, attempt_count from ev join ob using (event_id) where event_id = (select max(event_id) from ev)",
    "sto_next_pending": _EV + "select event_id, event_type, subject_id from ev join ob using (event_id) where status = 'pending' order by created_at, event_id limit 1",
    "sto_missing_references": f"""with ev as ({EVENTS}), r as (select distinct event_id, u.record_type record_type, u.record_id record_id from (select event_id, unnest(refs) u from ev))
      select record_type, count(*) n, count(distinct event_id) events from r where not exists (select 1 from (
        select 'analysis' t, analysis_id i from semantic_details where status = 'completed' union all select 'claim', claim_id from claim_candidates union all select 'fact', fact_id from facts) k
        where k.t = r.record_type and k.i = r.record_id) group by 1""",
    "sto_run_facts": f"with f as ({FACTS}) select analysis_run_id, count(*) n, count(*) = count(distinct ordinal) and min(ordinal) = 0 and max(ordinal) = count(*) - 1 in_order from f group by 1",
    "idn_processing_keys": _RUN + "select doc, processing_key from k",
    "run_incremental": FACT_CTE + """, ks as (select doc, min(digest) dg, bool_or(left(digest, 1) < '8') early from en group by doc), fn as (select doc, count(*) n from fa group by 1),
      g as (select case when early then 'first' else 'second' end "pass", count(*) extracted, coalesce(sum(n), 0)::bigint facts from ks left join fn using (doc) group by 1)
      select "pass", extracted, case when "pass" = 'second' then (select count(*) from ks) - extracted else 0 end reused, facts, facts fact_ids from g""",
    "run_workflow": PREPARED + ADM[len(SELECTED):] + f""",
      bt as (select batch, count(*) n, case when count(*) > 64 then 'x' else min(category) end bad from jn group by 1),
      st as (select pr.analysis, coalesce(bt.n, 0) n, problem is null and bad is null ok from pr left join bt on bt.batch = pr.analysis),
      t as (select count(*) runs, count(case when ok then 1 end) done, coalesce(sum(case when ok then n end), 0)::bigint claims from st)
      select u.* from t, lateral (values ('runs', 'first', runs), ('runs', 'second', runs - done), ('details', 'first', runs), ('details', 'second', runs - done), ('claims', 'first', claims), ('events', 'first', claims + done), ('outbox', 'first', claims + done)) u(table_name, turn, n) where n > 0""",
    "sto_catalog": "select t.table_name, t.column_name, exists (select 1 from information_schema.columns c where c.table_name = t.table_name and c.column_name = t.column_name) present from (values " + ", ".join(f"('{t}', '{c}')" for t, cs in REQUIRED.items() for c in cs) + ") t(table_name, column_name)",
    "sto_completed": _REC + """, ce as (select sid, count(*) n, min(ids[1]) r, min(case when json_valid(p) then json_extract_string(p, '$.analysisId') end) a from t where event_type = 'claim.admitted' group by 1),
      x as (select analysis_id, bool_or(coalesce(n <> 1, true)) un, bool_or(not coalesce(r = analysis_id and a = analysis_id, false)) el, list(claim_id order by o, claim_id) ids from h left join ce on sid = claim_id group by 1),
      dn as (select sid, count(*) n, min(ids) ids from t where event_type = 'analysis.completed' group by 1)
      select s.analysis_id, case when coalesce(un, false) then 'claim-event' when coalesce(el, false) then 'claim-event-analysis' when coalesce(dn.n <> 1, true) then 'completion-event' when coalesce(x.ids, []::varchar[]) <> coalesce(dn.ids, []::varchar[]) then 'completion-claims' end problem
      from semantic_details s left join x using (analysis_id) left join dn on dn.sid = s.analysis_id where s.status = 'completed'""",
    "sto_failed": _REC + f"""select analysis_id, case when analysis_id in (select analysis_id from h) then 'admitted-claims' when analysis_id in (select sid from t where sid is not null) then 'events'
      when coalesce({_OBJ("semantic_selection_json")}, false) and not coalesce({_OBJ("privacy_report_json")}, false) then 'selection-without-policy' when coalesce({_OBJ("model_json")}, false) and not coalesce({_OBJ("semantic_selection_json")}, false) then 'model-without-selection' end problem
      from semantic_details where status = 'failed'""",
    "sto_lineage": f"""select analysis_id, case when coalesce(session_id, '') = '' then 'source' when coalesce(schema_name, '') = '' then 'schema-name' when coalesce(schema_version < 1, true) then 'schema-version' when not coalesce(regexp_full_match(schema_digest, '[0-9a-f]{{64}}'), false) then 'schema-digest'
      when not coalesce({_OBJ("model_json")}, false) then 'model' when coalesce(json_extract_string(case when json_valid(model_json) then model_json end, '$.requestedRoute.alias'), '') = '' then 'route' when recorded_at is null then 'time' end problem from semantic_details""",
    "sto_tampered": _BUILT + """, z as (select case when right(event_id, 1) in ('0', '1') then 'subject' when right(event_id, 1) = '2' then 'id' when right(event_id, 1) = '3' then 'spaces' end change from bt)
      select change, case change when 'subject' then 'fingerprint' when 'id' then 'id' end problem, count(*) n from z group by all""",
    "sto_claim_analyses": f"""with ev as ({EVENTS}), ca as ({CANDIDATES}), h as (select batch, {sql_clean_id("claim_id")} claim_id from ca where claim_id is not null),
      t as (select distinct {sql_clean_id("subject_id")} i from ev where subject_type = 'claim'), a as (select distinct {sql_clean_id("subject_id")} i from ev where subject_type = 'analysis')
      select analysis_id, (select count(*) from h where batch = analysis_id) claims, (select count(*) from h where batch = analysis_id and claim_id in (select i from t)) claim_events,
        analysis_id in (select i from a) finished from semantic_details where status = 'completed'""",
    "sto_constraints": " union all ".join(f"select '{t}' table_name, '{k}' \"key\", count({k}) - count(distinct {k}) n from {t}" for t, k in (("domain_events", "event_id"), ("facts", "fact_id"), ("facts", "fingerprint"), ("claim_candidates", "candidate_id"), ("claim_candidates", "claim_id"), ("semantic_details", "analysis_id"))),
    "sto_outbox_next": _EV + """select case when won and not failed then 'delivered' else status end status, attempt_count + case when won then 1 else 0 end attempt_count,
        case when won then case when failed then 'transport' end else last_failure end last_failure, count(*) n
      from (select *, status = 'pending' and right(event_id, 1) <> '0' won, right(event_id, 1) in ('1', '2') failed from ob) group by all""",
    "obx_states": _EV + f"""select problem, count(*) n from (select case when attempt_count < 0 then 'attempts' when status = 'pending' and delivered_at is not null then 'pending-acknowledged'
        when status = 'pending' and attempt_count = 0 and coalesce(last_failure, '') <> '' then 'unattempted-failure' when status = 'pending' and attempt_count > 0 and coalesce(last_failure, '') not in ({", ".join(f"'{f}'" for f in op.FAILURES)}) then 'attempted-without-failure'
        when status = 'delivered' and attempt_count < 1 then 'delivered-unattempted' when status = 'delivered' and delivered_at is null then 'delivered-without-time' when status = 'delivered' and coalesce(last_failure, '') <> '' then 'delivered-with-failure'
        when status not in ('pending', 'delivered') then 'status' end problem from ob) where problem is not null group by 1""",
    "evt_contract": f"""with e as (select *, list_transform(refs, lambda r: r.record_id) ids, list_transform(refs, lambda r: r.record_type) kinds, case when json_valid(payload_json) and json_type(payload_json) = 'OBJECT' then payload_json end p from domain_events),
      f as (select *, len(json_keys(p)) nk, json_extract_string(p, '$.analysisId') a, json_extract_string(p, '$.claimId') c, json_extract(p, '$.claimIds')::varchar[] cs from e)
      select case when schema_version is distinct from 1 then 'version' when not {_B("event_id", op.MAX_ID)} then 'id' when not coalesce(regexp_full_match(fingerprint, '[0-9a-f]{{64}}'), false) then 'fingerprint'
        when not {_B("event_type", op.MAX_TYPE)} then 'type' when not coalesce(subject_type in ({_KINDS}), false) then 'subject-type' when not {_B("subject_id", op.MAX_SUBJECT)} then 'subject' when created_at is null then 'time'
        when refs is null or len(refs) > {op.MAX_REFERENCES} then 'references' when len(list_filter(refs, lambda r: not coalesce(r.record_type in ({_KINDS}), false) or not {_B("r.record_id", op.MAX_SUBJECT)})) > 0 then 'reference'
        when p is null or strlen(p) > {op.MAX_PAYLOAD} then 'payload'
        when event_type = 'claim.admitted' then case when not coalesce(subject_type = 'claim' and nk = 2 and c = subject_id and kinds[1] = 'analysis' and ids[1] = a and len(list_filter(kinds[2:], lambda k: k <> 'fact')) = 0 and len(list_distinct(ids[2:])) = len(ids[2:]), false) then 'claim-contract' end
        when event_type = 'analysis.completed' then case when not coalesce(subject_type = 'analysis' and nk = 2 and a = subject_id and cs = ids and len(list_filter(kinds, lambda k: k <> 'claim')) = 0 and len(list_distinct(ids)) = len(ids), false) then 'completion-contract' end
        else 'type' end problem, count(*) n from f group by 1""",
    "evt_built": _BUILT + "select event_type, subject_id, event_id, fingerprint, \"references\" from bt",
    "evl_report": _CASES + f"""select count(*) cases, count_if(completed)::bigint completed, count_if(completed and claims = 0)::bigint empty, sum(claims)::bigint claims, count(tokens) token_cases, count(latency) latency_cases, sum(tokens)::bigint tokens,
      (sum(latency) // count(latency))::bigint mean_latency, quantile_disc(latency, 0.5) p50_latency, quantile_disc(latency, 0.95) p95_latency, max(latency) max_latency, {_DEC("sum(cost)")} total_cost,
      {_DEC("((sum(cost) * 1000000000000)::hugeint / count(cost))::decimal(38,0) * 0.000000000001")} mean_cost, count(cost) cost_cases from cs""",
    "evl_failures": f"select category, count(*) n from ({ORACLE_OF_BATCHES}) group by 1",
    "evl_expectations": _CASES + """, k as (select batch, count(*) n, count(case when claim_type = 'verification' then 1 end) v, count(case when outcome = 'failure' then 1 end) f from ca group by 1),
      j as (select coalesce(n, 0) n, coalesce(v, 0) v, coalesce(f, 0) f from cs left join k on batch = "case" where completed)
      select 'must-be-empty' kind, '' "value", count(*) evaluated, count(case when n = 0 then 1 end) passed from j
      union all select 'must-include-type', 'verification', count(*), count(case when v > 0 then 1 end) from j
      union all select 'must-not-include-outcome', 'failure', count(*), count(case when f = 0 then 1 end) from j""",
    "evl_citations": f"""with ca as ({CANDIDATES}), i as (select candidate_id, unnest(l) e, generate_subscripts(l, 1) - 1 p from (select candidate_id, list_concat(coalesce(supporting, []::varchar[]), coalesce(contradicting, []::varchar[])) l from ca)),
      g as (select candidate_id, e, min(p) p from i group by all) select candidate_id, count(*) cited, max(p) last_place from g group by 1""",
    "evl_review_template": _CL + "select claim_id, unnest(['supported', 'useful', 'scoped']) criterion from cl",
    "evl_attempted": f"""with c as (select analysis_id, recorded_at, status = 'completed' ok, case when {_OBJ("model_json")} then model_json end m from semantic_details),
      k as (select *, case when ok then null when m is null then 'semantic-generation-transport-failed' when not coalesce(json_extract_string(m, '$.requestedRoute.model') = json_extract_string(m, '$.resolvedModel'), false) then 'semantic-generation-response-invalid' else 'semantic-admission-invalid' end category from c),
      s as (select min((recorded_at, analysis_id)) f from k where category = 'semantic-generation-transport-failed'), t as (select coalesce((recorded_at, analysis_id) <= f, true) attempted, category from k, s)
      select attempted, case when attempted then category end category, count(*) n from t group by all""",
    "evl_scores": """with r as (select doc_id, min(label) label from doc_labels group by 1), j as (select coalesce(label, 'unreviewed') label from documents left join r using (doc_id))
      select n.label, (select count(*) from j where j.label = n.label) n from (select unnest(['prose', 'list', 'table', 'log', 'code', 'junk', 'useful', 'unreviewed']) label) n""",
    "evl_useful": "select count(distinct session_id) sessions from documents where doc_id in (select doc_id from (select doc_id, min(label) l from doc_labels group by 1) where l = 'prose')",
    "evl_stale": """select 'unknown' problem, count(distinct doc_id) n from doc_labels where doc_id not in (select doc_id from documents) having count(*) > 0
      union all select 'duplicate', count(*) from (select doc_id from doc_labels group by 1 having count(*) > 1) having count(*) > 0""",
}

QUERIES = {
    f.__name__: f
    for f in (
        sto_events, sto_event, sto_next_pending, sto_missing_references, sto_run_facts, idn_processing_keys, run_incremental, run_workflow, sto_catalog, sto_completed, sto_failed, sto_lineage, sto_tampered, sto_claim_analyses, sto_constraints, sto_outbox_next, obx_states, evt_contract, evt_built,
        evl_report, evl_failures, evl_expectations, evl_citations, evl_review_template, evl_attempted, evl_scores, evl_useful, evl_stale,
    )
}
