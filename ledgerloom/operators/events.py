"""Domain events and their outbox as tables.

Events are built with their fingerprints from admitted claims; the outbox is a table of
versions (event_id, attempt_count), of which the highest is current.  A transition writes
the next version; two that start from the same attempt give one key twice, of which the
later is the one that lost.  Concurrent writers need a lock on the outbox folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.regexes import HEX_DIGEST
from .facts import trimmed

#: Event kinds, reference kinds, failure categories and limits.
CLAIM_ADMITTED, ANALYSIS_COMPLETED = "claim.admitted", "analysis.completed"
REFERENCE_TYPES = ("analysis", "claim", "fact", "summary", "episode")
FAILURES = ("timeout", "transport", "unavailable")
MAX_ID, MAX_TYPE, MAX_SUBJECT, MAX_PAYLOAD, MAX_REFERENCES = 128, 128, 256, 16384, 256
_REF = "array<struct<record_type:string,record_id:string>>"


def claim_events(claims: DataFrame) -> DataFrame:
    """One event for each claim (claim_id, analysis_id, fact_ids): the analysis first, then its facts."""
    refs = F.concat(
        F.array(F.struct(F.lit("analysis").alias("record_type"), F.col("analysis_id").alias("record_id"))),
        F.transform(F.coalesce("fact_ids", F.array().cast("array<string>")), lambda x: F.struct(F.lit("fact").alias("record_type"), x.alias("record_id"))),
    )
    payload = identity.record([("analysisId", identity.string("analysis_id")), ("claimId", identity.string("claim_id"))])
    return _built(claims, CLAIM_ADMITTED, "claim", F.col("claim_id"), payload, refs)


def completion_events(claims: DataFrame) -> DataFrame:
    """One event for each analysis, with its claims in order (an analysis admits at most 64); a null claim stands for an analysis without any."""
    listed = claims.groupBy("analysis_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "claim_id"))), lambda x: x["claim_id"]).alias("claim_ids"))
    listed = listed.withColumn("claim_ids", F.array_compact("claim_ids"))
    refs = F.transform("claim_ids", lambda x: F.struct(F.lit("claim").alias("record_type"), x.alias("record_id")))
    payload = identity.record([("analysisId", identity.string("analysis_id")), ("claimIds", identity.strings("claim_ids"))])
    return _built(listed, ANALYSIS_COMPLETED, "analysis", F.col("analysis_id"), payload, refs)


def _built(rows: DataFrame, kind: str, subject_type: str, subject: Column, payload: Column, refs: Column) -> DataFrame:
    base = rows.select(F.lit(1).alias("schema_version"), F.lit(kind).alias("event_type"), F.lit(subject_type).alias("subject_type"), subject.alias("subject_id"), payload.alias("payload_json"), refs.cast(_REF).alias("refs"))
    mark = identity.event_fingerprint(*(F.col(c) for c in ("schema_version", "event_type", "subject_type", "subject_id", "payload_json", "refs")))
    marked = base.withColumn("fingerprint", mark)
    return marked.withColumn("event_id", identity.derived_id("evt_", F.col("fingerprint")))


def _bounded(col: Column, limit: int) -> Column:
    return F.coalesce((F.length(col) > 0) & (trimmed(col) == col) & (F.octet_length(col) <= limit), F.lit(False))


def contract(events: DataFrame) -> Column:
    """The first rule of the envelope or of its kind that a stored event breaks, or null."""
    payload = F.from_json("payload_json", "analysisId string, claimId string, claimIds array<string>")
    keys = F.size(F.json_object_keys("payload_json"))
    refs = F.col("refs")
    first = F.get(refs, F.lit(0))
    rest = F.slice(refs, 2, MAX_REFERENCES + 1)
    ids = F.transform(refs, lambda r: r["record_id"])
    rest_ids = F.transform(rest, lambda r: r["record_id"])
    claim_bad = (
        (F.col("subject_type") != "claim") | (keys != 2) | ~F.coalesce((payload["claimId"] == F.col("subject_id")) & (first["record_type"] == "analysis") & (first["record_id"] == payload["analysisId"]), F.lit(False))
        | F.exists(rest, lambda r: r["record_type"] != "fact") | (F.size(F.array_distinct(rest_ids)) != F.size(rest_ids))
    )
    done_bad = (
        (F.col("subject_type") != "analysis") | (keys != 2) | ~F.coalesce((payload["analysisId"] == F.col("subject_id")) & (payload["claimIds"] == ids), F.lit(False))
        | F.exists(refs, lambda r: r["record_type"] != "claim") | (F.size(F.array_distinct(ids)) != F.size(ids))
    )
    kind = F.col("event_type")
    return (
        F.when(F.coalesce(F.col("schema_version") != 1, F.lit(True)), "version").when(~_bounded(F.col("event_id"), MAX_ID), "id").when(~F.coalesce(F.col("fingerprint").rlike(HEX_DIGEST), F.lit(False)), "fingerprint")
        .when(~_bounded(kind, MAX_TYPE), "type").when(~F.coalesce(F.col("subject_type").isin(*REFERENCE_TYPES), F.lit(False)), "subject-type").when(~_bounded(F.col("subject_id"), MAX_SUBJECT), "subject")
        .when(F.col("created_at").isNull(), "time").when(F.coalesce(F.size(refs) > MAX_REFERENCES, F.lit(True)), "references")
        .when(F.exists(refs, lambda r: ~F.coalesce(r["record_type"].isin(*REFERENCE_TYPES), F.lit(False)) | ~_bounded(r["record_id"], MAX_SUBJECT)), "reference")
        .when(F.coalesce(F.octet_length("payload_json") > MAX_PAYLOAD, F.lit(True)) | keys.isNull(), "payload")
        .when(kind == CLAIM_ADMITTED, F.when(F.coalesce(claim_bad, F.lit(True)), "claim-contract")).when(kind == ANALYSIS_COMPLETED, F.when(F.coalesce(done_bad, F.lit(True)), "completion-contract")).otherwise("type")
    )


def current(versions: DataFrame) -> DataFrame:
    """The current state of each event's outbox record."""
    rest = [c for c in versions.columns if c not in ("event_id", "attempt_count")]
    return versions.groupBy("event_id").agg(F.max("attempt_count").alias("attempt_count"), F.max_by(F.struct(*rest), "attempt_count").alias("s")).select("event_id", "attempt_count", "s.*")


def invalid_state(_: DataFrame | None = None) -> Column:
    """The rule that an outbox record breaks, or null."""
    pending, delivered, n = F.col("status") == "pending", F.col("status") == "delivered", F.col("attempt_count")
    failure = F.coalesce("last_failure", F.lit(""))
    return (
        F.when(n.isNull() | (n < 0), "attempts").when(pending & (F.col("delivered_at").isNotNull() | F.col("acknowledgement").isNotNull()), "pending-acknowledged").when(pending & (n == 0) & (failure != ""), "unattempted-failure")
        .when(pending & (n > 0) & ~failure.isin(*FAILURES), "attempted-without-failure").when(delivered & (n < 1), "delivered-unattempted").when(delivered & F.col("delivered_at").isNull(), "delivered-without-time")
        .when(delivered & (failure != ""), "delivered-with-failure").when(~F.coalesce(pending | delivered, F.lit(False)), "status")
    )


def attempted(outbox: DataFrame, attempts: DataFrame) -> DataFrame:
    """The next versions after attempts (event_id, expected, failure, at): only those that start from the current pending state."""
    joined = outbox.filter("status = 'pending'").join(attempts, "event_id").filter(F.col("attempt_count") == F.col("expected"))
    ok = F.col("failure").isNull()
    return joined.filter(ok | F.col("failure").isin(*FAILURES)).select(
        "event_id", (F.col("attempt_count") + 1).alias("attempt_count"), F.when(ok, "delivered").otherwise("pending").alias("status"),
        F.when(~ok, F.col("failure")).alias("last_failure"), F.when(ok, F.col("at")).alias("delivered_at"), F.lit(None).cast("string").alias("acknowledgement"),
    )


def oldest_pending(events: DataFrame, outbox: DataFrame) -> DataFrame:
    """The one event to publish next: by time of creation, then id."""
    return events.join(outbox.filter("status = 'pending'"), "event_id").orderBy("created_at", "event_id").limit(1)


def missing_references(events: DataFrame, analyses: DataFrame, claims: DataFrame, facts: DataFrame) -> DataFrame:
    """References of events to records that are not stored: (event_id, record_type, record_id)."""
    known = (
        analyses.select(F.lit("analysis").alias("record_type"), F.col("analysis_id").alias("record_id"))
        .unionByName(claims.select(F.lit("claim").alias("record_type"), F.col("claim_id").alias("record_id")))
        .unionByName(facts.select(F.lit("fact").alias("record_type"), F.col("fact_id").alias("record_id")))
    )
    refs = events.select("event_id", F.explode("refs").alias("r")).select("event_id", "r.record_type", "r.record_id").distinct()
    return refs.join(known, ["record_type", "record_id"], "left_anti")
