"""Queries of the fact operators (FCT, IDN) over sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import evidence_id
from ..operators import facts as op
from . import adapters

_COLUMNS = ["doc", "ordinal", "segment", "kind", "value", "framework", "passed", "failed", "skipped", "exit_code", "outcome", "parse_rule", "evidence"]


def _all(spark: SparkSession, d: str) -> DataFrame:
    return op.extract(adapters.entries(spark, d), adapters.segments(spark, d).filter("text is not null"), op.regexes.TABLE_EXIT_CODE)


def fct_facts(spark: SparkSession, d: str) -> DataFrame:
    """FCT-1, 2, 5, 12 and IDN-4: every fact with its evidence ids."""
    return _all(spark, d).select(*_COLUMNS).withColumn("evidence", F.array_join("evidence", ","))


def fct_commands(spark: SparkSession, d: str) -> DataFrame:
    """FCT-3 to FCT-7: each call's command and its test framework."""
    segments = adapters.segments(spark, d).filter("text is not null")
    return op.commands(adapters.entries(spark, d), segments).drop("ref")


def fct_results(spark: SparkSession, d: str) -> DataFrame:
    """FCT-8 to FCT-11: what the text of a result says."""
    text = F.col("text")
    results = adapters.entries(spark, d).filter("kind = 'tool-result'").select("doc", "ordinal")
    read = results.join(adapters.segments(spark, d).filter("text is not null"), ["doc", "ordinal"])
    code = op.exit_code(text, op.regexes.TABLE_EXIT_CODE)
    return read.select(
        "doc", "ordinal", "segment", code.alias("exit_code"), F.when(code == 0, "success").when(code.isNotNull(), "failure").alias("outcome"), op.error_line(text).alias("error_line"),
        *[op.count_of(text, p).alias(n) for n, p in (("passed", op.regexes.PASSED), ("failed", op.regexes.FAILED), ("skipped", op.regexes.SKIPPED))],
    )


def fct_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """FCT-13: test results by framework and outcome."""
    tests = _all(spark, d).filter("kind = 'test-result'")
    return tests.groupBy("framework", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))


def fct_budget(spark: SparkSession, d: str) -> DataFrame:
    """FCT-14, 15: the text of each fact within its document's budget."""
    cut = op.budgeted(_all(spark, d)).filter("value is not null")
    return cut.select("doc", "ordinal", "segment", "kind", "emitted", "original_bytes", "truncated", "omitted")


SMALL = {"value_bytes": 12, "values": 6, "document_bytes": 40}


def fct_small_budget(spark: SparkSession, d: str) -> DataFrame:
    """FCT-14, 15 under limits that the tables' documents pass: per document the values kept, cut and left out."""
    cut = op.budgeted(_all(spark, d), **SMALL).filter("value is not null")
    return cut.groupBy("doc").agg(F.sum(F.octet_length("emitted")).alias("emitted_bytes"), F.count(F.when(F.col("truncated"), 1)).alias("truncated"), F.count(F.when(F.col("omitted"), 1)).alias("omitted"))


def fct_omissions(spark: SparkSession, d: str) -> DataFrame:
    """FCT-16: omitted values and bytes, and omitted segments, by document."""
    return op.omissions(op.budgeted(_all(spark, d)), adapters.segments(spark, d))


def fct_violations(spark: SparkSession, d: str) -> DataFrame:
    """FCT-17: stored facts that break their contract."""
    return op.stored_violations(adapters.facts(spark, d), adapters.evidence(spark, d))


def idn_references(spark: SparkSession, d: str) -> DataFrame:
    """IDN-1, 2, 4: the id of every entry and segment from its content."""
    entries = adapters.entries(spark, d).select("doc", "digest", "ordinal")
    segments = adapters.segments(spark, d).select("doc", "ordinal", "segment", F.sha2("text", 256).alias("hash"))
    own = entries.withColumns({"segment": F.lit(None).cast("long"), "hash": F.lit(None).cast("string")})
    rows = own.unionByName(entries.join(segments, ["doc", "ordinal"]))
    return rows.select("doc", "ordinal", "segment", evidence_id(F.col("doc"), F.col("digest"), F.col("ordinal"), F.col("segment"), F.col("hash")).alias("reference_id"))


def idn_stored(spark: SparkSession, d: str) -> DataFrame:
    """IDN-5: stored references by how they differ from the rebuilt ones."""
    return op.stored_references(adapters.evidence(spark, d)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def facts_of(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """The identified facts of the given documents."""
    return op.identified(op.budgeted(op.extract(entries, segments.filter("text is not null"), op.regexes.TABLE_EXIT_CODE)), entries, segments)


def idn_facts(spark: SparkSession, d: str) -> DataFrame:
    """IDN-6: every extracted fact with its canonical value's digest, fingerprint and id."""
    rows = facts_of(adapters.entries(spark, d), adapters.segments(spark, d))
    return rows.select("doc", "ordinal", "segment", "kind", F.sha2("value_json", 256).alias("value_digest"), "fingerprint", "fact_id")


_TRIM = "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(133)||chr(160)"


def _ref(doc: str, digest: str, ordinal: str, segment: str, hash_: str) -> str:
    body = f"""'{{"Source":"' || {doc} || '","Digest":"' || {digest} || '","Entry":' || {ordinal} || ',"Segment":' || coalesce({segment}::varchar, 'null') || ',"Hash":"' || coalesce({hash_}, '') || '"}}'"""
    return f"'eref_' || left(sha256(sha256({body})), 32)"


_PREFIXES = " ".join(f"when t = '{p}' or starts_with(t, '{p} ') then '{n}'" for p, n in op.TEST_PREFIXES)
#: Quoted and escaped parts go out from left to right; what is left decides.
_BARE = """regexp_replace(t, '(?s)\\\\.|''[^'']*''|"(?:[^"\\\\]|\\\\.)*"', '', 'g')"""
_TOOLS = ", ".join(f"'{t}'" for t in op.COMMAND_TOOLS)

CTE = f"""
with en as ({adapters.ENTRIES}), sg as ({adapters.SEGMENTS}),
held as (
  select e.doc, e.digest, e.ordinal, s.segment, s.text,
    coalesce(json_extract_string(s.text, '$.cmd'), json_extract_string(s.text, '$.command')) command
  from en e join (select doc, ordinal, segment, case when json_valid(text) then text end text from sg) s using (doc, ordinal)
  where e.kind = 'tool-call' and e.tool_name in ({_TOOLS}) and s.text is not null and left(trim(s.text), 1) = '{{'
    and (json_exists(s.text, '$.cmd') <> json_exists(s.text, '$.command'))
    and coalesce(json_type(s.text, '$.cmd'), json_type(s.text, '$.command')) = 'VARCHAR'),
cm as (
  select doc, digest, ordinal, segment, command, trim(command, {_TRIM}) t, {_ref("doc", "digest", "ordinal", "segment", "sha256(text)")} ref
  from held where command <> '' qualify row_number() over (partition by doc, ordinal order by segment) = 1),
cmds as (select *, case when regexp_matches({_BARE}, '[;|&\\n`''"\\\\]') then null else case {_PREFIXES} end end framework from cm),
rs as (
  select e.doc, e.digest, e.ordinal, e.related, s.segment, s.text,
    try_cast(regexp_extract(s.text, '(?m)^(?:Process exited with code |exit code: )([0-9]+)\\s*$', 1) as bigint) exit_code,
    try_cast(regexp_extract(s.text, '(?i)\\b([0-9]+) passed\\b', 1) as bigint) passed,
    try_cast(regexp_extract(s.text, '(?i)\\b([0-9]+) failed\\b', 1) as bigint) failed,
    try_cast(regexp_extract(s.text, '(?i)\\b([0-9]+) skipped\\b', 1) as bigint) skipped,
    list_filter(list_transform(string_split(s.text, chr(10)), lambda x: trim(x, {_TRIM})), lambda x: starts_with(x, 'ERROR') or starts_with(x, 'FAIL') or starts_with(lower(x), 'error:'))[1] error_line,
    {_ref("e.doc", "e.digest", "e.ordinal", "s.segment", "sha256(s.text)")} ref
  from en e join sg s using (doc, ordinal) where e.kind = 'tool-result' and s.text is not null),
linked as (
  select r.*, c.framework, c.ref call_ref from rs r join cmds c on c.doc = r.doc and c.ordinal = r.related
  where r.exit_code is not null and c.framework is not null and c.ordinal < r.ordinal),
fa as (
  select doc, ordinal, null::bigint segment, 0 step, kind, null::varchar "value", null::varchar framework, null::bigint passed, null::bigint failed, null::bigint skipped, null::bigint exit_code,
    'not-applicable' outcome, 'sessions-entry-' || kind || '-v1' parse_rule, {_ref("doc", "digest", "ordinal", "null", "''")} evidence from en where kind in ('tool-call', 'tool-result')
  union all select doc, ordinal, segment, 1, 'command', command, null, null, null, null, null, 'not-applicable', 'tool-call-command-json-v1', ref from cmds
  union all select doc, ordinal, segment, 2, 'test-command', command, framework, null, null, null, null, 'unknown', 'recognized-test-command-v1', ref from cmds where framework is not null
  union all select doc, ordinal, segment, 1, 'exit-code', null, null, null, null, null, exit_code, case when exit_code = 0 then 'success' else 'failure' end, 'process-exit-code-v1', ref from rs where exit_code is not null
  union all select doc, ordinal, segment, 2, 'test-result', null, framework, passed, failed, skipped, exit_code,
    case when exit_code <> 0 then 'failure' when error_line is not null or coalesce(failed, 0) > 0 then 'unknown' else 'success' end, 'linked-test-result-v1', call_ref || ',' || ref from linked
  union all select doc, ordinal, segment, 3, 'error-output', error_line, null, null, null, null, null, 'failure', 'explicit-error-line-v1', ref from rs where error_line is not null)
"""
#: No text of these tables is cut by its bytes, so the number of values alone decides (the fold itself is tested by brute force).
_BUDGET = CTE + f""", ranked as (select *, row_number() over (partition by doc order by ordinal, coalesce(segment, -1), step) k from fa where "value" is not null)
select doc, ordinal, segment, kind, case when k <= {op.MAX_VALUES} then "value" else '' end emitted, strlen("value") original_bytes, k > {op.MAX_VALUES} and strlen("value") > 0 truncated, k > {op.MAX_VALUES} omitted from ranked
"""

_BUDGET_ALL = _BUDGET + " union all select doc, null, null, kind, null, null, false, false from fa where \"value\" is null"
#: The fold step by step in recursive SQL; commands and error lines of the tables are cut by bytes where that is a character's border.
_SMALL = "with recursive" + CTE.strip()[4:] + f""",
o as (select doc, "value" v, row_number() over (partition by doc order by ordinal, coalesce(segment, -1), step) k from fa where "value" is not null),
w as (select doc, k, v, list_filter(range(0, {SMALL["value_bytes"]} + 1), lambda n: n <= strlen(v) and (n = strlen(v) or substring(hex(encode(v)), 2 * n + 1, 1) not in ('8', '9', 'A', 'B'))) cuts from o where k <= {SMALL["values"]}),
r as (
  select doc, k, v, list_max(cuts) e, list_max(cuts) used from w where k = 1
  union all select w.doc, w.k, w.v, case when r.used < {SMALL["document_bytes"]} then list_max(list_filter(w.cuts, lambda n: n <= {SMALL["document_bytes"]} - r.used)) end,
    r.used + case when r.used < {SMALL["document_bytes"]} then list_max(list_filter(w.cuts, lambda n: n <= {SMALL["document_bytes"]} - r.used)) else 0 end from r join w on w.doc = r.doc and w.k = r.k + 1)
select o.doc, coalesce(sum(e), 0)::bigint emitted_bytes, count(case when coalesce(e, 0) < strlen(o.v) then 1 end) truncated, count(case when e is null then 1 end) omitted from o left join r using (doc, k) group by 1
"""

_S = lambda x: f"replace(replace(replace(to_json({x})::varchar, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"
_O = lambda k, x: f"""coalesce(',"{k}":' || {_S(f"nullif({x}, '')")}, '')"""
_EMPTY = lambda x: _S(f"coalesce({x}, '')")
_TEXT = f"""'{{"text":' || {_S("emitted")} || ',"truncated":' || truncated || ',"originalUtf8Bytes":' || original_bytes || ',"emittedUtf8Bytes":' || strlen(emitted) || ',"contentHash":{{"scheme":"sha256-utf8-v1","digest":"' || sha256("value") || '"}}}}'"""
_WHOLE = lambda seg: f"""'{{"id":"' || id || '","sourceKind":"sessions","sourceIdentity":' || {_S("doc")} || ',"documentDigestScheme":"sha256-sessions-document-jcs-v1","documentDigest":' || {_EMPTY("digest")} || ',"entryOrdinal":' || ordinal || {seg} || {_O("entryKind", "kind")} || {_O("actor", "actor")}"""
_TAIL = f"""coalesce(',"relatedEntryOrdinal":' || related, '') || {_O("toolCallId", "call_id")} || {_O("toolName", "tool_name")} || {_O("toolNamespace", "tool_namespace")}"""
#: Every fact with its value and its references written out by the templates.
_IDN = CTE + f""",
rk as (select *, case when "value" is not null then row_number() over (partition by doc, "value" is not null order by ordinal, coalesce(segment, -1), step) end k from fa),
bu as (select *, case when "value" is null then null when k <= {op.MAX_VALUES} then "value" else '' end emitted, strlen("value") original_bytes, k > {op.MAX_VALUES} and strlen("value") > 0 truncated from rk),
er as (select *, {_ref("doc", "digest", "ordinal", "null", "''")} id from en),
ws as (
  select id, {_WHOLE("''")} || {_TAIL} || ',"contentHash":"","excerpt":""}}' w from er
  union all select id, {_WHOLE("',\"segmentOrdinal\":' || segment")} || {_O("origin", "origin")} || {_O("originConfidence", "origin_confidence")} || {_TAIL} || coalesce(',"contentHashScheme":"sha256-utf8-v1","contentHash":"' || sha256(text) || '"', ',"contentHash":""') || ',"excerpt":""}}'
    from (select en.*, segment, origin, origin_confidence, text, {_ref("en.doc", "en.digest", "en.ordinal", "segment", "sha256(text)")} id from en join sg using (doc, ordinal))),
wd as (select distinct id, w from ws),
vs as (select bu.*, case when bu.kind in ('tool-call', 'tool-result') then '{{"tool":{{"kind":"' || bu.kind[6:] || '"' || {_O("name", "tool_name")} || {_O("namespace", "tool_namespace")} || {_O("callId", "call_id")} || coalesce(',"relatedEntryOrdinal":' || related, '') || '}}}}'
    when bu.kind = 'command' then '{{"command":' || {_TEXT} || '}}' when bu.kind = 'test-command' then '{{"test":{{"framework":"' || framework || '","command":' || {_TEXT} || '}}}}' when bu.kind = 'exit-code' then '{{"exitCode":' || exit_code || '}}'
    when bu.kind = 'test-result' then '{{"test":{{"framework":"' || framework || '"' || coalesce(',"passed":' || passed, '') || coalesce(',"failed":' || failed, '') || coalesce(',"skipped":' || skipped, '') || '}},"exitCode":' || exit_code || '}}'
    else '{{"error":' || {_TEXT} || '}}' end v,
    '{{"sourceKind":"sessions","canonicalId":' || {_S("doc")} || ',"nativeSourceKind":' || {_EMPTY("source_kind")} || ',"sourceInstanceId":' || {_EMPTY("source_instance_id")} || ',"nativeId":' || {_EMPTY("native_id")}
      || ',"documentDigest":{{"scheme":"sha256-sessions-document-jcs-v1","digest":' || {_EMPTY("digest")} || '}}}}' rev
  from bu join (select doc, ordinal, digest, tool_name, tool_namespace, call_id, related, source_kind, source_instance_id, native_id from en) using (doc, ordinal)),
fp as (select vs.*, sha256('{{"Revision":' || rev || ',"Kind":"' || kind || '","Value":' || v || ',"Outcome":"' || outcome || '","Rule":"' || parse_rule || '","Extractor":"sessions-deterministic-facts","Version":"1","Schema":1,"Evidence":['
    || a.w || coalesce(',' || b.w, '') || ']}}') f
  from vs join wd a on a.id = split_part(evidence, ',', 1) left join wd b on b.id = nullif(split_part(evidence, ',', 2), ''))
select doc, ordinal, segment, kind, sha256(v) value_digest, f fingerprint, 'fact_' || left(sha256(f), 32) fact_id from fp
"""

ORACLE = {
    "fct_facts": CTE + 'select doc, ordinal, segment, kind, "value", framework, passed, failed, skipped, exit_code, outcome, parse_rule, evidence from fa',
    "fct_commands": CTE + "select doc, ordinal, segment, command, framework from cmds",
    "fct_results": CTE + "select doc, ordinal, segment, exit_code, case when exit_code = 0 then 'success' when exit_code is not null then 'failure' end outcome, error_line, passed, failed, skipped from rs",
    "fct_outcomes": CTE + "select framework, outcome, count(*) n, sum(passed)::bigint passed, sum(failed)::bigint failed from fa where kind = 'test-result' group by all",
    "fct_budget": _BUDGET,
    "fct_small_budget": _SMALL,
    "fct_omissions": f"""select doc, coalesce(v, 0) omitted_values, coalesce(b, 0)::bigint omitted_bytes, coalesce(n, 0) canonical_segments
      from (select doc, count(case when omitted then 1 end) v, sum(case when omitted then original_bytes end) b from ({_BUDGET_ALL}) group by doc)
      full join (select doc, count(*) n from ({adapters.SEGMENTS}) where segment_kind = 'omitted' group by doc) using (doc)""",
    "fct_violations": f"""with f as ({adapters.FACTS}), ev as ({adapters.EVIDENCE}), c as (select fact_id, unnest(evidence_ids) evidence_id from f),
      k as (select fact_id, bool_or(doc is null) lost, min(doc) lo, max(doc) hi from c left join ev using (evidence_id) group by 1),
      j as (select *, case when json_valid(value_json) and json_type(value_json) = 'OBJECT' then value_json end o, coalesce(evidence_ids, []::varchar[]) ids from f left join k using (fact_id)),
      t as (select *, list_filter([json_extract_string(o, '$.command.text'), json_extract_string(o, '$.error.text'), json_extract_string(o, '$.test.command.text')], lambda x: x is not null) ts from j)
      select fact_id, violation from (select fact_id, case when coalesce(kind, '') = '' or coalesce(parse_rule, '') = '' then 'fields' when not coalesce(outcome in ('success', 'failure', 'unknown', 'not-applicable'), false) then 'outcome'
        when o is null then 'value' when len(ts) > 1 then 'texts' when len(list_filter(ts, lambda x: strlen(x) > {op.MAX_VALUE_BYTES})) > 0 then 'text-size' when len(ids) = 0 then 'no-evidence'
        when len(list_distinct(ids)) <> len(ids) then 'repeated-evidence' when lost then 'unknown-evidence' when lo <> hi then 'several-documents' end violation from t) where violation is not null""",
    "idn_stored": f"""with ev as ({adapters.EVIDENCE}) select case when digest is null then 'no-entry' when content_hash is distinct from sha256(text) then 'content-hash'
      when {_ref("doc", "digest", "ordinal", "segment", "sha256(text)")} is distinct from evidence_id then 'id' else 'equal' end problem, count(*) n from ev group by 1""",
    "idn_facts": _IDN,
    "idn_references": f"""with en as ({adapters.ENTRIES}), sg as ({adapters.SEGMENTS}),
      u as (select doc, digest, ordinal, null::bigint segment, null::varchar h from en union all select e.doc, digest, e.ordinal, segment, sha256(text) from en e join sg using (doc, ordinal))
      select doc, ordinal, segment, {_ref("doc", "digest", "ordinal", "segment", "h")} reference_id from u""",
}

QUERIES = {f.__name__: f for f in (fct_facts, fct_commands, fct_results, fct_outcomes, fct_budget, fct_small_budget, fct_omissions, fct_violations, idn_references, idn_stored, idn_facts)}
