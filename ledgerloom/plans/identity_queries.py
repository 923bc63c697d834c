"""Queries of claim identities (IDN-8, 9), stored projections (SEL-13) and execution metadata (ADM-18), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..session import table
from ..operators import workflow
from ..operators.facts import trimmed
from ..sources import gateway
from . import adapters
from .claim_queries import CANDIDATES, PREPARED, candidates, prepared

def idn_claims(spark: SparkSession, d: str) -> DataFrame:
    """IDN-8, 9, 12: candidates of prepared analyses by the identity that their claim would have; equal ones are one claim."""
    runs = prepared(spark, d).filter("problem is null").select(F.col("analysis").alias("batch"), "processing_key", "schema", "route", "prompt")
    model = F.from_json("model_json", "resolvedProvider string, resolvedModel string")
    made = table(spark, d, "semantic_details").select(F.col("analysis_id").alias("batch"), F.col("schema_version"), model.alias("m"))
    rows = candidates(spark, d).join(runs, "batch").join(made, "batch")
    e = adapters.evidence(spark, d)
    fields = {k: F.col(c) for k, c in (("entryKind", "kind"), ("actor", "actor"), ("origin", "origin"), ("originConfidence", "origin_confidence"), ("relatedEntryOrdinal", "related"), ("toolCallId", "call_id"), ("toolName", "tool_name"), ("toolNamespace", "tool_namespace"))}
    body = identity.evidence_ref(F.col("evidence_id"), F.col("doc"), F.lit(identity.DOCUMENT_SCHEME), F.col("digest"), F.col("ordinal"), F.col("segment"), fields, F.when(F.col("content_hash").isNotNull(), identity.TEXT_SCHEME), F.col("content_hash"))
    known = e.select("evidence_id", "doc", body.alias("reference"))

    def whole(column: str) -> DataFrame:
        """(candidate_id, references in order); only candidates whose cited ids are all known in their document."""
        each = rows.select("candidate_id", "doc", F.posexplode(column).alias("place", "evidence_id")).join(known, ["doc", "evidence_id"], "left")
        listed = each.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("place", "reference"))).alias("l"), F.max(F.col("reference").isNull()).alias("lost"))  # at most 512 a candidate
        return listed.select("candidate_id", F.transform("l", lambda x: x["reference"]).alias(f"{column}_refs"), F.col("lost").alias(f"{column}_lost"))

    both = rows.join(whole("supporting"), "candidate_id", "left").join(whole("contradicting"), "candidate_id", "left").filter("not coalesce(supporting_lost, false) and not coalesce(contradicting_lost, false)")
    text = lambda c: identity.string(F.coalesce(F.col(c), F.lit("")))
    trim = lambda c: identity.string(F.coalesce(trimmed(F.col(c)), F.lit("")))
    none = F.array().cast("array<string>")
    columns = {
        "ProcessingKey": identity.string("processing_key"), "Type": text("claim_type"), "Statement": trim("statement"), "Status": text("status"), "Confidence": identity.number(F.round("confidence", 3)),
        "SupportingEvidence": identity.array(F.coalesce("supporting_refs", none)), "ContradictingEvidence": identity.array(F.coalesce("contradicting_refs", none)), "SupportingFactIDs": identity.strings(F.when(F.size("fact_ids") > 0, F.col("fact_ids"))),
        "Outcome": text("outcome"), "Actor": text("actor"), "Origin": text("origin"), "Subject": trim("subject"), "Scope": trim("scope"), "Attribution": text("attribution"),
        "ExtractorName": identity.string(F.lit(workflow.EXTRACTOR)), "ExtractorVersion": identity.string(F.lit(workflow.EXTRACTOR_VERSION)), "SchemaVersion": identity.number("schema_version"), "PromptVersion": identity.string("prompt"),
        "RequestedRoute": identity.route(F.col("route")), "ResolvedProvider": text("m.resolvedProvider"), "ResolvedModel": text("m.resolvedModel"),
    }
    mark = identity.claim_fingerprint(columns)
    return both.select("candidate_id", mark.alias("fingerprint"), identity.derived_id("claim_", mark).alias("derived_id"))


_SELECTION = "mode string, selectedEntries bigint, totalEntries bigint, firstOrdinal bigint, lastOrdinal bigint, coverage string"


def sel_projection(spark: SparkSession, d: str) -> DataFrame:
    """SEL-13: stored selections by how they differ from the document."""
    total = adapters.entries(spark, d).groupBy(F.col("doc").alias("session_id")).agg(F.count(F.lit(1)).alias("entries"))
    rows = table(spark, d, "semantic_details").join(total, "session_id", "left").select("entries", F.from_json("semantic_selection_json", _SELECTION).alias("s")).filter("s.mode is not null")
    ranged = F.col("s.mode") == "range"
    size = F.col("s.lastOrdinal") - F.col("s.firstOrdinal") + 1
    problem = (
        F.when(F.col("entries").isNull(), "no-document").when(~F.col("s.totalEntries").eqNullSafe(F.col("entries")), "total").when(F.col("s.firstOrdinal").isNull() | F.col("s.lastOrdinal").isNull(), "bounds-absent")
        .when(~F.col("s.selectedEntries").eqNullSafe(size), "bounds").when(F.col("s.coverage").eqNullSafe("complete") != (F.col("s.selectedEntries") == F.col("entries")), "coverage").otherwise("sound")
    )
    return rows.groupBy(ranged.alias("ranged"), problem.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


_MODEL = "requestedRoute struct<model:string,provider:string>, resolvedProvider string, resolvedModel string, requestId string, inputTokens bigint, outputTokens bigint, totalTokens bigint, latencyMilliseconds bigint, costUsd string"


def adm_models(spark: SparkSession, d: str) -> DataFrame:
    """ADM-18: execution metadata by the first rule it breaks; damaged JSON is its own case."""
    m = F.from_json("model_json", _MODEL)
    sound = F.json_object_keys("model_json").isNotNull()
    problem = F.when(~F.coalesce(sound, F.lit(False)), "no-object").otherwise(F.coalesce(gateway.execution_problem(m), F.lit("sound")))
    return table(spark, d, "semantic_details").groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def _s(x: str) -> str:
    return f"replace(replace(replace(to_json(coalesce({x}, ''))::varchar, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"


def _q(x: str) -> str:
    return f"replace(replace(replace(to_json({x})::varchar, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"


def _l(x: str) -> str:
    return f"""('[' || coalesce(list_aggregate(list_transform({x}, lambda y: coalesce(to_json(y)::varchar, 'null')), 'string_agg', ','), '') || ']')"""


_o = lambda k, x: f"""coalesce(',"{k}":' || {_q(f"nullif({x}, '')")}, '')"""
_t = lambda x: f"trim({x}, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(133)||chr(160))"
_N = lambda x: f"nullif(regexp_replace({x}::varchar, '\\.0$', ''), 'nan')"
_J = "json_extract_string(model_json, '$.{}')"
ORACLE = {
    "idn_claims": PREPARED + f""",
      ca as ({CANDIDATES}),
      md as (select analysis_id, schema_version sv, case when json_valid(model_json) then json_extract_string(model_json, '$.resolvedProvider') end rp, case when json_valid(model_json) then json_extract_string(model_json, '$.resolvedModel') end rm from semantic_details),
      ew as (select evidence_id, doc, '{{"id":' || {_s("evidence_id")} || ',"sourceKind":"sessions","sourceIdentity":' || {_s("doc")} || ',"documentDigestScheme":"sha256-sessions-document-jcs-v1","documentDigest":' || {_s("digest")} || ',"entryOrdinal":' || ordinal || ',"segmentOrdinal":' || segment
        || {_o("entryKind", "kind")} || {_o("actor", "actor")} || {_o("origin", "origin")} || {_o("originConfidence", "origin_confidence")} || coalesce(',"relatedEntryOrdinal":' || related, '') || {_o("toolCallId", "call_id")} || {_o("toolName", "tool_name")} || {_o("toolNamespace", "tool_namespace")}
        || coalesce(',"contentHashScheme":"sha256-utf8-v1","contentHash":"' || content_hash || '"', ',"contentHash":""') || ',"excerpt":""}}' w from ev),
      c1 as (select candidate_id, 's' k, doc, unnest(supporting) evidence_id, generate_subscripts(supporting, 1) i from ca union all select candidate_id, 'c', doc, unnest(contradicting), generate_subscripts(contradicting, 1) from ca),
      c2 as (select candidate_id, k, bool_or(w is null) lost, '[' || string_agg(w, ',' order by i) || ']' j from c1 left join ew using (evidence_id, doc) group by all),
      g as (select ca.candidate_id, sha256('{{"ProcessingKey":"' || processing_key || '","Type":' || {_s("claim_type")} || ',"Statement":' || {_s(_t("statement"))} || ',"Status":' || {_s("status")} || ',"Confidence":' || coalesce({_N("round(confidence, 3)")}, 'null')
        || ',"SupportingEvidence":' || coalesce(a.j, '[]') || ',"ContradictingEvidence":' || coalesce(b.j, '[]') || ',"SupportingFactIDs":' || case when len(fact_ids) > 0 then {_l("fact_ids")} else 'null' end
        || ',"Outcome":' || {_s("outcome")} || ',"Actor":' || {_s("actor")} || ',"Origin":' || {_s("origin")} || ',"Subject":' || {_s(_t("subject"))} || ',"Scope":' || {_s(_t("scope"))} || ',"Attribution":' || {_s("attribution")}
        || ',"ExtractorName":"semantic-claims","ExtractorVersion":"1","SchemaVersion":' || sv || ',"PromptVersion":' || {_s("prompt")} || ',"RequestedRoute":' || route || ',"ResolvedProvider":' || {_s("rp")} || ',"ResolvedModel":' || {_s("rm")} || '}}') fingerprint
        from ca join pr on pr.analysis = ca.batch and pr.problem is null join md on md.analysis_id = ca.batch left join c2 a on a.candidate_id = ca.candidate_id and a.k = 's' left join c2 b on b.candidate_id = ca.candidate_id and b.k = 'c'
        where not coalesce(a.lost, false) and not coalesce(b.lost, false))
      select candidate_id, fingerprint, 'claim_' || left(sha256(fingerprint), 32) derived_id from g""",
    "sel_projection": f"""with en as ({adapters.ENTRIES}), t as (select doc, count(*) entries from en group by 1),
      s as (select entries, json_extract_string(j, '$.mode') m, json_extract(j, '$.selectedEntries')::bigint se, json_extract(j, '$.totalEntries')::bigint te, json_extract(j, '$.firstOrdinal')::bigint f, json_extract(j, '$.lastOrdinal')::bigint l, json_extract_string(j, '$.coverage') c
        from (select session_id, semantic_selection_json j from semantic_details where json_valid(semantic_selection_json)) left join t on doc = session_id)
      select m = 'range' ranged, case when entries is null then 'no-document' when te is distinct from entries then 'total' when f is null or l is null then 'bounds-absent' when se is distinct from l - f + 1 then 'bounds'
        when coalesce(c = 'complete', false) <> (se = entries) then 'coverage' else 'sound' end problem, count(*) n from s where m is not null group by all""",
    "adm_models": f"""with j as (select case when json_valid(model_json) and left(trim(model_json, chr(32)||chr(10)||chr(9)||chr(13)), 1) = '{{' then model_json end model_json from semantic_details),
      x as (select model_json, json_extract_string(model_json, '$.requestedRoute.model') rm, json_extract_string(model_json, '$.requestedRoute.provider') rp, {_J.format("resolvedModel")} m, {_J.format("resolvedProvider")} p, {_J.format("requestId")} r,
        try_cast({_J.format("inputTokens")} as bigint) i, try_cast({_J.format("outputTokens")} as bigint) o, try_cast({_J.format("totalTokens")} as bigint) t, try_cast({_J.format("latencyMilliseconds")} as bigint) la, {_J.format("costUsd")} c from j)
      select case when model_json is null then 'no-object' when rm is null then 'route' when m is null or p is null then 'unresolved' when m <> rm or p <> rp then 'rewritten' when i < 0 or o < 0 or t < 0 or i + o <> t then 'usage' when la < 0 then 'latency'
        when not regexp_matches(c, '^[0-9]+(\\.[0-9]+)?$') then 'cost' when length(r) > 256 then 'request-id' else 'sound' end problem, count(*) n from x group by 1""",
}
QUERIES = {f.__name__: f for f in (idn_claims, sel_projection, adm_models)}
