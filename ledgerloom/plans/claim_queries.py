"""Queries of admission, selection and resolution (ADM, SEL, RES, PRV-18), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy
from ..functions import identity
from ..operators import admission, resolve, workflow
from ..session import cut, table
from . import adapters

EVIDENCE, FACTS, CANDIDATES = adapters.EVIDENCE, adapters.FACTS, adapters.CANDIDATES
evidence, facts, candidates = adapters.evidence, adapters.facts, adapters.candidates


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Candidates judged against their analysis' selection; those of an analysis without a sound one carry its category."""
    r, refs, chosen = _scope(spark, d)
    judged = admission.judge(cut(candidates(spark, d)), refs, chosen)  # exploded and joined in many ways
    out = judged.join(r, judged["batch"] == r["analysis"], "left")
    failed = F.when(F.col("analysis").isNull(), workflow.INVALID).otherwise(F.col("problem"))
    return out.select("candidate_id", "batch", "ordinal", F.coalesce(failed, "category").alias("category"))


def _scope(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per analysis its problem if it has no sound selection, the references of its selection, and its facts."""
    entries, segments, evidence_ = adapters.entries(spark, d), adapters.segments(spark, d), adapters.places(spark, d)
    r = cut(workflow.resolved(ranges(spark, d), workflow.documents(entries, segments)))
    sound = r.filter("problem is null")
    e = cut(workflow.spread_entries(sound, entries))
    own = identity.evidence_id(F.col("doc"), F.col("digest"), F.col("ordinal"), F.lit(None), F.lit(""))
    columns = (F.col("analysis").alias("batch"), "evidence_id", "ordinal", "related", "call_id", "actor", "origin")
    whole = e.withColumns({"evidence_id": own, "origin": F.lit(None).cast("string")}).select(*columns)
    parts = e.select("analysis", "doc", "ordinal", "related", "call_id", "actor").join(segments.select("doc", "ordinal", "evidence_id", "origin"), ["doc", "ordinal"]).select(*columns)
    refs = cut(whole.unionByName(parts).dropDuplicates(["batch", "evidence_id"]))  # bounded for each analysis, read many times
    chosen = workflow.chosen_facts(sound, e, facts(spark, d), workflow.fact_homes(facts(spark, d), evidence_)).select(F.col("analysis").alias("batch"), "fact_id", "kind", "outcome", "evidence_ids")
    return r.select("analysis", "problem"), refs, cut(chosen)


def adm_candidates(spark: SparkSession, d: str) -> DataFrame:
    """ADM-2 to ADM-17: the category of the first failing check of every candidate."""
    return _judged(spark, d)


def adm_batches(spark: SparkSession, d: str) -> DataFrame:
    """ADM-1: batches admitted or rejected as a whole."""
    return admission.batches(_judged(spark, d))


def adm_linked(spark: SparkSession, d: str) -> DataFrame:
    """ADM-11 to ADM-14: candidates against which a linked result fact speaks."""
    _, refs, chosen = _scope(spark, d)
    return admission.linked_outcomes(candidates(spark, d), refs, chosen).select("candidate_id", "uncited")


#: Planted candidates: their id, the field that must be rejected, its category, and the field's text.
PLANTED = (
    ("planted-1", "statement", "local-path", "The suite reads /srv/app/x.log twice."), ("planted-2", "subject", "local-or-private-host", "build-7.internal"), ("planted-3", "scope", "url-credentials", "https://u:p@example.com/x"),
    ("planted-4", "actor", "authorization-header", "authorization: Bearer abcdefgh"), ("planted-5", "origin", "private-key", "-----BEGIN RSA PRIVATE KEY-----"),
)


def adm_privacy(spark: SparkSession, d: str) -> DataFrame:
    """PRV-17, 18: free-text fields that the policy rejects, of all candidates and of planted ones (the stored ones hold none)."""
    names = ["statement", "subject", "scope", "actor", "origin"]
    planted = spark.createDataFrame([(i, *[text if n == field else None for n in names]) for i, field, _, text in PLANTED], "candidate_id string, " + ", ".join(f"{n} string" for n in names))
    fields = privacy.fields(candidates(spark, d).select("candidate_id", *names).unionByName(planted), "candidate_id", names)
    return fields.select("candidate_id", "field_path", F.explode(privacy.postflight("value")).alias("category"))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """What each analysis asks for: its range, route, schema and prompt, from its stored details."""
    chosen = F.from_json("semantic_selection_json", "mode string, firstOrdinal bigint, lastOrdinal bigint")
    model = F.from_json("model_json", "requestedRoute struct<" + ",".join(f"{f}:string" for f in identity.ROUTE_FIELDS) + ">, promptVersion string")
    rows = table(spark, d, "semantic_details").withColumns({"s": chosen, "m": model}).filter("s.mode is not null")
    ranged = F.col("s.mode") == "range"
    schema = identity.schema_identity(F.col("schema_name"), F.col("schema_version"), F.col("schema_digest"))
    return rows.select(
        F.col("analysis_id").alias("analysis"), F.col("session_id").alias("doc"), F.when(ranged, F.col("s.firstOrdinal")).alias("first"), F.when(ranged, F.col("s.lastOrdinal")).alias("last"),
        F.col("m.requestedRoute").alias("route"), F.coalesce("m.promptVersion", F.lit("")).alias("prompt"), schema.alias("schema"),
    )


def _selected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved ranges, and the encoded input of those within the limit of entries, before the policy."""
    entries, segments, evidence_ = cut(adapters.entries(spark, d)), cut(adapters.segments(spark, d)), adapters.places(spark, d)
    r = workflow.resolved(ranges(spark, d), workflow.documents(entries, segments))
    sound = r.filter("problem is null")
    e, s = workflow.chosen_content(sound, entries, segments)
    f = workflow.chosen_facts(sound, e, facts(spark, d), workflow.fact_homes(facts(spark, d), evidence_))
    per_doc = facts(spark, d).select("fact_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence_.select("evidence_id", "doc"), "evidence_id").groupBy("doc").agg(F.count_distinct("fact_id").alias("doc_facts"))
    return r, e, workflow.encoded(sound, e, s, f, per_doc)


def sel_ranges(spark: SparkSession, d: str) -> DataFrame:
    """SEL-1, 2, 10: each analysis' range against its document, with the first problem that counts alone show."""
    r = workflow.resolved(ranges(spark, d), workflow.documents(adapters.entries(spark, d), adapters.segments(spark, d)))
    return r.select("analysis", "explicit", "low", "high", "n_entries", "total", "problem")


def sel_inputs(spark: SparkSession, d: str) -> DataFrame:
    """SEL-3, 5 to 10: the canonical input of each range within the limit of entries: counts, sizes, coverage and digests of its sections."""
    rows = _selected(spark, d)[2]
    marks = [F.sha2(c, 256).alias(c.replace("json", "digest")) for c in ("entries_json", "facts_json", "selection_json")]
    return rows.select("analysis", "n_entries", "n_segments", "n_facts", "excluded", "original", "emitted", "cut", "omitted", "coverage", "entries_bytes", "facts_bytes", "input_bytes", workflow.over_limits().alias("over"), *marks)


def sel_references(spark: SparkSession, d: str) -> DataFrame:
    """SEL-4: distinct references of each selection, and ids with more than one content."""
    _, e, _ = _selected(spark, d)
    refs = e.select("analysis", "doc", "ordinal").join(adapters.segments(spark, d).select("doc", "ordinal", "segment", "evidence_id"), ["doc", "ordinal"])
    each = refs.groupBy("analysis", "evidence_id").agg(F.count(F.lit(1)).alias("contents"))
    return each.groupBy("analysis").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("contents") > 1, 1)).alias("collisions"))


def prepared(spark: SparkSession, d: str) -> DataFrame:
    """Every analysis prepared or failed.  The deduplicated tables are read by many steps, so each is made once."""
    made = [cut(rows(spark, d)) for rows in (adapters.entries, adapters.segments, facts, adapters.places)]
    return workflow.prepare(ranges(spark, d), *made)


def run_claims(spark: SparkSession, d: str) -> DataFrame:
    """SEL-11, 12, 14, 15, PRV-17, 19, IDN-8, RUN-2, 3, ADM-17: every analysis prepared or failed, with the lineage it reached."""
    return prepared(spark, d).select("analysis", "problem", "n_segments", "n_facts", "coverage", "request_bytes", "input_digest", "processing_key")


def run_policies(spark: SparkSession, d: str) -> DataFrame:
    """SEL-12, PRV-16, 17: the run's view of each prepared selection, and what the policy did to its input."""
    return prepared(spark, d).select("analysis", F.sha2("run_selection_json", 256).alias("run_selection"), F.array_join("blocked", ",").alias("blocked"), F.to_json("redactions").alias("redactions"))


def run_lineage(spark: SparkSession, d: str) -> DataFrame:
    """SEL-13, 16, RUN-4, STO-19: prepared rows by what does not follow from the rest of them, and a third of them after one field was changed."""
    rows = prepared(spark, d).withColumn("changed", F.conv(F.substring("analysis", -1, 1), 16, 10).cast("int") % 3)
    bent = rows.withColumns({"input_digest": F.when(F.col("changed") == 1, F.sha2("input_digest", 256)).otherwise(F.col("input_digest")), "prompt": F.when(F.col("changed") == 2, "other").otherwise(F.col("prompt"))})
    return bent.select("changed", workflow.lineage_problem().alias("problem"), F.col("problem").alias("category")).groupBy("changed", "category", "problem").agg(F.count(F.lit(1)).alias("n"))


def res_claims(spark: SparkSession, d: str) -> DataFrame:
    """RES-2, 3: the texts of each candidate whose references all resolve."""
    out = resolve.resolve(candidates(spark, d), "candidate_id", ["supporting", "contradicting"], evidence(spark, d))
    return out.withColumn("text", F.sha2("text", 256))


def res_facts(spark: SparkSession, d: str) -> DataFrame:
    """RES-1, 3, 4: stored facts by the first problem their references have."""
    return resolve.reference_problems(facts(spark, d), "fact_id", "evidence_ids", evidence(spark, d))


_T = "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(133)||chr(160)"
_WORDS = r"(?i)\b(?:users?|humans?|agents?|assistants?|models?|environments?|developers?|operators?|you|your|yours|we|us|our|ours|i|me|my|mine)\b"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_IDS = lambda c: f"coalesce({c}, []::varchar[])"
_J = lambda x: f"replace(replace(replace(to_json({x})::varchar, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"
_OPT = lambda k, x: f"""coalesce(',"{k}":' || {_J(f"nullif({x}, '')")}, '')"""
_SEL = f"""
with en as ({adapters.ENTRIES}), sg as ({adapters.SEGMENTS}), ev as ({EVIDENCE}), fa as ({FACTS}),
ra as (select analysis_id analysis, session_id doc, case when m = 'range' then f end first, case when m = 'range' then l end last from (
    select *, json_extract_string(semantic_selection_json, '$.mode') m, json_extract(semantic_selection_json, '$.firstOrdinal')::bigint f, json_extract(semantic_selection_json, '$.lastOrdinal')::bigint l
    from semantic_details where json_valid(semantic_selection_json)) where m is not null),
gp as (select distinct doc from (select doc, ordinal, count(*) n, count(distinct segment) u, min(segment) lo, max(segment) hi from sg group by all) where lo <> 0 or hi <> n - 1 or u <> n),
dc as (select doc, count(*) total, min(ordinal) = 0 and max(ordinal) = count(*) - 1 and doc not in (from gp) whole from en group by doc),
rs as (select analysis, ra.doc, first is not null or last is not null explicit, total,
    case when first is not null or last is not null then first when total > 0 then 0 end low, case when first is not null or last is not null then last when total > 0 then total - 1 end high,
    case when total is null then '{workflow.UNAVAILABLE}' when not whole then '{workflow.INVALID}' when (first is null) <> (last is null) then '{workflow.INVALID}'
      when first is not null and not (first >= 0 and last >= first and last < total) then '{workflow.INVALID}' when coalesce(case when first is null then total else last - first + 1 end, 0) > {workflow.MAX_ENTRIES} then '{workflow.TOO_LARGE}' end problem
  from ra left join dc using (doc)),
ok as (select * from rs where problem is null),
se as (select ok.analysis, en.* from ok join en on en.doc = ok.doc and en.ordinal between low and high),
ss as (select se.analysis, sg.* from se join sg using (doc, ordinal)),
sj as (select analysis, ordinal, count(*) n, sum(strlen(text)) bytes, count(case when segment_kind = 'omitted' then 1 end) om, string_agg('{{"evidenceId":' || {_J("evidence_id")} || ',"ordinal":' || segment || ',"kind":' || {_J("coalesce(segment_kind, '')")}
    || ',"origin":' || {_J("coalesce(origin, '')")} || ',"originConfidence":' || {_J("coalesce(origin_confidence, '')")}
    || case when text is null then '' else ',"text":{{"text":' || {_J("text")} || ',"truncated":false,"originalUtf8Bytes":' || strlen(text) || ',"emittedUtf8Bytes":' || strlen(text) || '}}' end
    || {_OPT("contentClass", "content_class")} || {_OPT("sourceType", "source_type")} || '}}', ',' order by segment) j from ss group by all),
ej as (select analysis, count(*) ne, coalesce(sum(n), 0)::bigint ns, coalesce(sum(bytes), 0)::bigint bytes, coalesce(sum(om), 0)::bigint om, '[' || string_agg('{{"evidenceId":"' || 'eref_' || left(sha256(sha256('{{"Source":"' || doc || '","Digest":"' || digest || '","Entry":' || ordinal || ',"Segment":null,"Hash":""}}')), 32)
    || '","ordinal":' || ordinal || ',"kind":' || {_J("coalesce(kind, '')")} || ',"actor":' || {_J("coalesce(actor, '')")} || coalesce(',"timestamp":"' || rtrim(rtrim(strftime(timezone('UTC', entry_ts), '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z"', '')
    || coalesce(',"relatedEntryOrdinal":' || related, '') || {_OPT("toolName", "tool_name")} || {_OPT("toolNamespace", "tool_namespace")} || ',"segments":[' || coalesce(j, '') || ']}}', ',' order by ordinal) || ']' j
  from se left join sj using (analysis, ordinal) group by analysis),
ci as (select fact_id, ev.doc, ev.ordinal from (select fact_id, unnest(evidence_ids) evidence_id from fa) left join ev using (evidence_id)),
fh as (select fact_id, min(doc) doc, min(ordinal) lo, max(ordinal) hi from ci group by 1 having not bool_or(doc is null) and min(doc) = max(doc)),
fs as (select ok.analysis, fa.*, fh.lo, case when json_valid(value_json) then value_json end v from ok join fh on fh.doc = ok.doc and fh.lo >= ok.low and fh.hi <= ok.high join fa using (fact_id)),
fj as (select analysis, count(*) nf, '[' || string_agg('{{"id":' || {_J("fact_id")} || ',"kind":' || {_J("kind")} || ',"outcome":' || {_J("outcome")} || ',"value":{{' || trim(
      case when json_exists(v, '$.tool') then ',"tool":{{"kind":' || {_J("coalesce(json_extract_string(v, '$.tool.kind'), '')")} || {_OPT("name", "json_extract_string(v, '$.tool.name')")} || {_OPT("namespace", "json_extract_string(v, '$.tool.namespace')")} || coalesce(',"relatedEntryOrdinal":' || json_extract_string(v, '$.tool.relatedEntryOrdinal'), '') || '}}' else '' end
      || coalesce(',"command":{{"text":' || {_J("json_extract_string(v, '$.command.text')")} || ',"truncated":false,"originalUtf8Bytes":' || strlen(json_extract_string(v, '$.command.text')) || ',"emittedUtf8Bytes":' || strlen(json_extract_string(v, '$.command.text')) || '}}', '')
      || case when json_exists(v, '$.test') then ',"test":{{"framework":' || {_J("coalesce(json_extract_string(v, '$.test.framework'), '')")} || coalesce(',"command":{{"text":' || {_J("json_extract_string(v, '$.test.command.text')")} || ',"truncated":false,"originalUtf8Bytes":' || strlen(json_extract_string(v, '$.test.command.text')) || ',"emittedUtf8Bytes":' || strlen(json_extract_string(v, '$.test.command.text')) || '}}', '')
        || coalesce(',"passed":' || json_extract_string(v, '$.test.passed'), '') || coalesce(',"failed":' || json_extract_string(v, '$.test.failed'), '') || coalesce(',"skipped":' || json_extract_string(v, '$.test.skipped'), '') || '}}' else '' end
      || coalesce(',"exitCode":' || json_extract_string(v, '$.exitCode'), '')
      || coalesce(',"error":{{"text":' || {_J("json_extract_string(v, '$.error.text')")} || ',"truncated":false,"originalUtf8Bytes":' || strlen(json_extract_string(v, '$.error.text')) || ',"emittedUtf8Bytes":' || strlen(json_extract_string(v, '$.error.text')) || '}}', ''), ',')
    || '}},"evidenceIds":[' || list_aggregate(list_transform(evidence_ids, lambda x: '"' || x || '"'), 'string_agg', ',') || ']}}', ',' order by ordinal, fact_id) || ']' j from fs group by analysis),
dn as (select doc, count(distinct fact_id) n from ci where doc is not null group by 1),
si as (select ok.analysis, coalesce(ne, 0) ne, coalesce(ns, 0) ns, coalesce(nf, 0) nf, coalesce(dn.n, 0) - coalesce(nf, 0) ex, coalesce(bytes, 0) bytes, coalesce(om, 0) om, coalesce(ej.j, '[]') e, coalesce(fj.j, '[]') f, explicit, total, low, high,
    case when coalesce(ne, 0) <> total then 'partial' else 'complete-retained-snapshot' end cov from ok left join ej using (analysis) left join fj using (analysis) left join dn using (doc)),
sx as (select *, '{{"mode":"' || case when explicit then 'range' else 'complete' end || '","selectedEntries":' || ne || ',"totalEntries":' || total || ',"firstOrdinal":' || low || ',"lastOrdinal":' || high || ',"originalTextUtf8Bytes":' || bytes || ',"emittedTextUtf8Bytes":' || bytes
    || ',"truncatedTextSegments":0,"truncatedFactTexts":0,"canonicalOmittedSegments":' || om || ',"excludedFactCount":' || ex || ',"coverage":"' || cov || '"}}' s from si),
sy as (select *, strlen('{{"schemaVersion":1,"disposition":"untrusted-evidence","selection":' || s || ',"entries":' || e || ',"facts":' || f || ',"omissions":{{"factAnalysis":{{"canonicalSegments":' || om || ',"omittedTextFactCount":0,"omittedTextOriginalUtf8Bytes":0,"unknownLineage":false}}}}}}') w from sx)
"""
_RJ = lambda f: _J(f"coalesce(json_extract_string(j, '$.requestedRoute.{f}'), '')")
#: Prepared analyses of texts in which the policy finds nothing.
PREPARED = _SEL + f""",
dt as (select analysis_id, schema_name, schema_version, schema_digest, case when json_valid(model_json) and json_type(model_json) = 'OBJECT' then model_json end j from semantic_details),
rt as (select analysis_id, coalesce(json_extract_string(j, '$.promptVersion'), '') prompt, '{{"name":' || {_J("schema_name")} || ',"version":' || schema_version || ',"disposition":"strict","digest":"' || schema_digest || '"}}' sch,
    coalesce({" and ".join(f"length(json_extract_string(j, '$.requestedRoute.{f}')) > 0" for f in identity.ROUTE_FIELDS)} and json_extract_string(j, '$.requestedRoute.privacyPolicyVersion') = '{workflow.POLICY}', false) good,
    '{{{",".join(f""""{f}":' || {_RJ(f)} || '""" for f in identity.ROUTE_FIELDS)}}}' route from dt),
en1 as (select distinct on (doc) doc, coalesce(digest, '') dg, coalesce(source_kind, '') sk, coalesce(source_instance_id, '') si, coalesce(native_id, '') ni from en order by doc, dg, sk, si, ni),
sz as (select sy.*, sx2.wj from sy join (select analysis, '{{"schemaVersion":1,"disposition":"untrusted-evidence","selection":' || s || ',"entries":' || e || ',"facts":' || f || ',"omissions":{{"factAnalysis":{{"canonicalSegments":' || om || ',"omittedTextFactCount":0,"omittedTextOriginalUtf8Bytes":0,"unknownLineage":false}}}}}}' wj from sx) sx2 using (analysis)),
fi as (select analysis, '[' || string_agg('"' || fact_id || '"', ',' order by ordinal, fact_id) || ']' ids, count(*) n from fs group by 1),
p0 as (select rs.analysis, rs.doc, case when not good then '{workflow.INVALID}' when problem is not null then problem when ne + ns > {workflow.MAX_REFERENCES} or nf > {workflow.MAX_FACTS} or strlen(e) > {workflow.MAX_EVIDENCE_BYTES} or strlen(f) > {workflow.MAX_FACT_BYTES} or w > {workflow.MAX_INPUT_BYTES} then '{workflow.TOO_LARGE}' end problem,
    ne, ns, nf, cov, wj, s, prompt, sch, route, coalesce(ids, '[]') ids, dg, sk, si, ni
  from rs join rt on rt.analysis_id = rs.analysis left join sz using (analysis) left join fi using (analysis) left join en1 on en1.doc = rs.doc),
pr as (select *, sha256(wj) input_digest, strlen('{{"instructions":"","promptVersion":' || {_J("prompt")} || ',"schema":' || sch || ',"route":' || route || ',"input":' || wj || '}}') request_bytes,
    sha256('{{"Revision":{{"sourceKind":"sessions","canonicalId":' || {_J("doc")} || ',"nativeSourceKind":' || {_J("sk")} || ',"sourceInstanceId":' || {_J("si")} || ',"nativeId":' || {_J("ni")} || ',"documentDigest":{{"scheme":"sha256-sessions-document-jcs-v1","digest":' || {_J("dg")}
      || '}}}},"Selection":' || s || ',"InputFactIDs":' || ids || ',"InputDigest":"' || sha256(wj) || '","Extractor":"semantic-claims","ExtractorVersion":"1","Schema":' || sch || ',"PromptVersion":' || {_J("prompt")} || ',"Route":' || route || ',"RouteConfig":"' || sha256(route)
      || '","PrivacyVersion":"{workflow.POLICY}"}}') processing_key from p0)
"""
_LINKED = "(a.ordinal = b.ordinal or (a.call_id <> '' and a.call_id = b.call_id) or a.related = b.ordinal or b.related = a.ordinal or a.related = b.related)"
_AT = lambda c: f"list_min(list_filter(list_transform(range(1, len({_IDS(c)}) + 1), lambda i: case when coalesce({_IDS(c)}[i], '') = '' or list_position({_IDS(c)}, {_IDS(c)}[i]) < i then i end), lambda i: i is not null))"
_CHECKS = lambda c, n, u, names: f"when len({_IDS(c)}) > {n} then '{names[0]}' when rep_{c} is not null and rep_{c} <= coalesce({u}, 1000000) then '{names[1]}' when {u} is not null then '{names[2]}'"
_A = admission
ADM = _SEL + f""",
ca as ({CANDIDATES}),
rf as (select distinct on (analysis, evidence_id) * from (
  select analysis, 'eref_' || left(sha256(sha256('{{"Source":"' || doc || '","Digest":"' || digest || '","Entry":' || ordinal || ',"Segment":null,"Hash":""}}')), 32) evidence_id, ordinal, related, call_id, actor, null::varchar origin from se
  union all select se.analysis, sg.evidence_id, se.ordinal, related, call_id, actor, sg.origin from se join sg using (doc, ordinal))),
sc as (select *, {_AT("supporting")} rep_supporting, {_AT("contradicting")} rep_contradicting, {_AT("fact_ids")} rep_fact_ids, case
    when not coalesce(claim_type in ({_LIST(_A.TYPES)}) and status in ({_LIST(_A.STATUSES)}), false) then '{_A.VALUE}'
    when strlen(coalesce(trim(statement, {_T}), '')) not between 1 and {_A.MAX_STATEMENT} then '{_A.VALUE}'
    when strlen(coalesce(trim(subject, {_T}), '')) > {_A.MAX_SUBJECT} or strlen(coalesce(trim(scope, {_T}), '')) > {_A.MAX_SCOPE} then '{_A.VALUE}'
    when confidence is null or isnan(confidence) or confidence < 0 or confidence > 1 then '{_A.VALUE}'
    when coalesce(attribution, '') not in ('', 'unknown') then '{_A.PROVENANCE}'
    when regexp_matches(coalesce(statement, ''), '{_WORDS}') or regexp_matches(coalesce(subject, ''), '{_WORDS}') or regexp_matches(coalesce(scope, ''), '{_WORDS}') then '{_A.WORDS}' end k from ca),
su as (select candidate_id, batch, actor cact, origin cori, unnest({_IDS("supporting")}) evidence_id, generate_subscripts({_IDS("supporting")}, 1) i from ca),
sq as (select su.candidate_id, rf.evidence_id eid, i, cact, cori, rf.actor, rf.origin from su left join rf on rf.evidence_id = su.evidence_id and rf.analysis = su.batch),
sa as (select candidate_id, min(case when eid is null then i end) u_s,
    bool_or(coalesce(cact, '') <> '' and (cact not in ({_LIST(_A.ACTORS)}) or coalesce(actor not in ('', 'unknown') and actor <> cact, false)))
      or (bool_or(coalesce(cact, '') <> '') and not bool_or(coalesce(actor not in ('', 'unknown') and actor = cact, false))) bad_actor,
    bool_or(coalesce(cori, '') <> '' and (cori not in ({_LIST(_A.ORIGINS)}) or coalesce(origin not in ('', 'unknown') and origin <> cori, false)))
      or (bool_or(coalesce(cori, '') <> '') and not bool_or(coalesce(origin not in ('', 'unknown') and origin = cori, false))) bad_origin
  from sq group by 1),
co as (select candidate_id, batch, unnest({_IDS("contradicting")}) evidence_id, generate_subscripts({_IDS("contradicting")}, 1) i from ca),
cx as (select candidate_id, min(case when not exists (select 1 from rf where rf.evidence_id = co.evidence_id and rf.analysis = co.batch) then i end) u_c from co group by 1),
fc as (select candidate_id, batch, unnest({_IDS("fact_ids")}) fact_id, generate_subscripts({_IDS("fact_ids")}, 1) i from ca),
fx as (select candidate_id, min(case when fs.fact_id is null then i end) u_f, bool_or(coalesce(kind in ('exit-code', 'test-result') and outcome = 'success', false)) s,
    bool_or(coalesce(kind in ('exit-code', 'test-result') and outcome = 'failure', false)) f, bool_or(coalesce(kind in ('exit-code', 'test-result') and outcome = 'unknown', false)) u
  from fc left join fs on fs.fact_id = fc.fact_id and fs.analysis = fc.batch group by 1),
fe as (select analysis, fact_id, kind, outcome, evidence_ids, unnest(evidence_ids) evidence_id from fs),
jc as (select * from ca where claim_type in ('failed-attempt', 'verification') and outcome is not null),
an as (select distinct candidate_id, batch, evidence_id from (
    select candidate_id, batch, evidence_id from su union all select fc.candidate_id, fc.batch, fe.evidence_id from fc join fe on fe.fact_id = fc.fact_id and fe.analysis = fc.batch)),
ln as (select distinct j.candidate_id, r.fact_id, r.evidence_ids, r.outcome observed, j.outcome claimed, j.contradicting
  from jc j join an on an.candidate_id = j.candidate_id join rf a on a.evidence_id = an.evidence_id and a.analysis = j.batch
  join rf b on b.analysis = a.analysis and {_LINKED} join fe r on r.analysis = b.analysis and r.evidence_id = b.evidence_id and r.kind in ('exit-code', 'test-result')),
cf as (select candidate_id, bool_or(not list_has_any(evidence_ids, {_IDS("contradicting")})) uncited from ln
  where claimed <> 'unknown' and (observed = 'unknown' or (claimed = 'success' and observed = 'failure') or (claimed = 'failure' and observed = 'success')) group by 1),
ju as (select sc.*, case when k is not null then k when len({_IDS("supporting")}) = 0 then '{_A.REQUIRED}' {_CHECKS("supporting", _A.MAX_EVIDENCE, "u_s", (_A.LIMIT, _A.REPEATED, _A.UNKNOWN))}
    {_CHECKS("contradicting", _A.MAX_EVIDENCE, "u_c", (_A.LIMIT, _A.REPEATED, _A.UNKNOWN))} when list_has_any({_IDS("supporting")}, {_IDS("contradicting")}) then '{_A.OVERLAP}'
    {_CHECKS("fact_ids", _A.MAX_FACTS, "u_f", (_A.FACT_LIMIT, _A.FACT_REPEATED, _A.FACT_UNKNOWN))} when coalesce(bad_actor, false) or coalesce(bad_origin, false) then '{_A.PROVENANCE}'
    when case when claim_type = 'failed-attempt' then coalesce(outcome, '') <> 'failure' when claim_type = 'verification' then coalesce(outcome, '') not in ('success', 'failure', 'unknown') else coalesce(outcome, '') <> '' end then '{_A.OUTCOME_TYPE}'
    when claim_type in ('failed-attempt', 'verification') and status = 'observed' and not coalesce(case outcome when 'success' then fx.s when 'failure' then fx.f when 'unknown' then fx.u or (fx.s and fx.f) end, false) then '{_A.UNESTABLISHED}'
    when claim_type in ('failed-attempt', 'verification') and case when status = 'observed' then cf.candidate_id is not null else coalesce(cf.uncited, false) end then '{_A.CONFLICT}' end c1
  from sc left join sa using (candidate_id) left join cx using (candidate_id) left join fx using (candidate_id) left join cf using (candidate_id)),
jd as (select *, case when c1 is null then row_number() over (partition by c1 is null, batch, claim_type, trim(statement, {_T}), status, confidence, {_IDS("supporting")}, {_IDS("contradicting")}, {_IDS("fact_ids")}, coalesce(outcome, ''), coalesce(actor, ''), coalesce(origin, ''),
    coalesce(trim(subject, {_T}), ''), coalesce(trim(scope, {_T}), ''), coalesce(attribution, '') order by ordinal, candidate_id) end k2 from ju),
jn as (select candidate_id, batch, jd.ordinal, case when rs.analysis is null then '{workflow.INVALID}' when problem is not null then problem when k2 > 1 then '{_A.DUPLICATE}' else c1 end category from jd left join rs on rs.analysis = jd.batch)
"""
ORACLE = {
    "adm_candidates": ADM + "select candidate_id, batch, ordinal, category from jn",
    "adm_batches": ADM + f"""select batch, count(*) candidates, count(category) rejected, count(*) <= {admission.MAX_CANDIDATES} and count(category) = 0 admitted,
      case when count(*) > {admission.MAX_CANDIDATES} then '{admission.VALUE}' else arg_min(category, (ordinal, candidate_id)) filter (where category is not null) end category from jn group by batch""",
    "adm_linked": ADM + "select candidate_id, uncited from cf",
    "sel_ranges": _SEL + "select analysis, explicit, low, high, coalesce(high - low + 1, 0) n_entries, total, problem from rs",
    "sel_inputs": _SEL + f"""select analysis, ne n_entries, ns n_segments, nf n_facts, ex excluded, bytes original, bytes emitted, 0::bigint cut, om omitted, cov coverage, strlen(e) entries_bytes, strlen(f) facts_bytes, w input_bytes,
      ne + ns > {workflow.MAX_REFERENCES} or nf > {workflow.MAX_FACTS} or strlen(e) > {workflow.MAX_EVIDENCE_BYTES} or strlen(f) > {workflow.MAX_FACT_BYTES} or w > {workflow.MAX_INPUT_BYTES} "over",
      sha256(e) entries_digest, sha256(f) facts_digest, sha256(s) selection_digest from sy""",
    "run_claims": PREPARED + """select analysis, problem, case when wj is not null and problem is null then ns end n_segments, case when wj is not null and problem is null then nf end n_facts, case when problem is null then cov end coverage,
      case when problem is null then request_bytes end request_bytes, case when problem is null then input_digest end input_digest, case when problem is null then processing_key end processing_key from pr""",
    "sel_references": _SEL + "select analysis, count(*) n, count(case when k > 1 then 1 end) collisions from (select analysis, evidence_id, count(*) k from ss group by all) group by 1",
    "res_claims": f"""with ev as ({EVIDENCE}), ca as ({CANDIDATES}), ids as (select candidate_id, doc, unnest(l) evidence_id, generate_subscripts(l, 1) - 1 place from (select candidate_id, doc, list_concat({_IDS("supporting")}, {_IDS("contradicting")}) l from ca)),
      fi as (select candidate_id, doc, evidence_id, min(place) place from ids group by all), j as (select fi.*, ev.evidence_id is not null ok, ev.text from fi left join ev on ev.evidence_id = fi.evidence_id and ev.doc = fi.doc)
      select candidate_id, place, evidence_id, sha256(text) text, coalesce(strlen(text) > {resolve.MAX_TEXT}, false) truncated from j where candidate_id not in (select candidate_id from j where not ok)""",
    "res_facts": f"""with ev as ({EVIDENCE}), fa as ({FACTS}), e as (select distinct fact_id, unnest(evidence_ids) evidence_id from fa),
      g as (select fact_id, count(*) cited, bool_or(ev.evidence_id is null) u, min(doc) lo, max(doc) hi, bool_or(digest is null) n, bool_or(content_hash is distinct from sha256(text)) c from e left join ev using (evidence_id) group by 1)
      select fact_id, cited, case when u then 'unknown' when lo <> hi then 'several-documents' when n then 'no-entry' when c then 'content' end problem from g""",
    "adm_privacy": "select * from (values " + ", ".join(f"('{i}', '{f}', '{c}')" for i, f, c, _ in PLANTED) + ") t(candidate_id, field_path, category)",
}

QUERIES = {f.__name__: f for f in (adm_candidates, adm_batches, adm_linked, adm_privacy, sel_ranges, sel_inputs, sel_references, run_claims, run_policies, run_lineage, res_claims, res_facts)}
