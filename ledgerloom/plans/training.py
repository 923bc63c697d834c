"""Queries p3, p4 and p5 over the project's tables, with their SQL."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_clean_id
from ..operators import dedup, nested, references
from ..session import scratch, table

DELIVERY_ORDER = ("received_at", "delivery_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.children(spark, _tables(spark, d))


def _tables(spark: SparkSession, d: str) -> str:
    """The tagged rows written as tables in the shared folder."""
    path = scratch(spark, "nested")
    nested.write_tables(nested.emitted(table(spark, d, "session_exports"), table(spark, d, "semantic_details")), path)
    return path


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """Each table read under its schema: rows, rows without a parent's key, and fields filled in all rows together."""
    path, out = _tables(spark, d), None
    for tag, schema in nested.SCHEMAS.items():
        rows = nested.read_table(spark, path, tag, schema)
        fields = [c for c in rows.columns if c not in ("row_key", "parent_key", "root_key", "pos", "n_fields")]
        filled = reduce(add, [F.count(f"`{c}`") for c in fields])
        own = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("parent_key").isNull(), 1)).alias("n_roots"), filled.alias("n_filled")).select(F.lit(tag).alias("tag"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every tagged row of the export records: the input of the flat tables."""
    return nested.flatten(table(spark, d, "session_exports"), "line_id", "record_json", "record", nested.EXPORT_CONTAINERS)


def p3_orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per tag, its rows and those whose parent row was not emitted (0 for every tag)."""
    rows = p3_rows(spark, d).select("tag", "row_key", "parent_key")
    known = rows.select(F.col("row_key").alias("parent_key"), F.lit(1).alias("there")).distinct()
    lost = F.col("parent_key").isNotNull() & F.col("there").isNull()
    return rows.join(known, "parent_key", "left").groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(lost, 1)).alias("n_orphans"))


def _state(spark: SparkSession, d: str) -> references.OrphanState:
    """The orphan state after the tables came in, in three spans of their time."""
    candidates = table(spark, d, "claim_candidates")
    refs = references.project_refs(candidates, table(spark, d, "domain_events"))
    parents = references.project_parents(table(spark, d, "evidence_segments"), table(spark, d, "facts"), table(spark, d, "semantic_details"), candidates)
    return references.folded(references.OrphanState(spark, scratch(spark, "orphans")), refs, parents)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).current().filter("state is not null").select("ref_table", "row_id", "ref_field", "ref_id", "state")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot of the counts."""
    state = _state(spark, d)
    last = state.snapshots().filter(F.col("after") == state.version)
    return last.select("ref_table", "ref_field", F.date_format("period", "yyyy-MM").alias("period"), "state", "n")


def p4_timeline(spark: SparkSession, d: str) -> DataFrame:
    return references.timeline(_state(spark, d).current()).withColumn("period", F.date_format("period", "yyyy-MM"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "domain_events").select("delivery_id", "event_id", "received_at")
    return dedup.later_copies(events, "event_id", DELIVERY_ORDER).select("delivery_id")


def p5_events(spark: SparkSession, d: str) -> DataFrame:
    """The deduplicated events themselves."""
    rows = dedup.keep_one(table(spark, d, "domain_events"), "event_id", DELIVERY_ORDER)
    return rows.select("delivery_id", "event_id", "batch_id", "event_type", "subject_type", "subject_id", "payload_json")


_P4_CTE = f"""
with cand as (
  select {sql_clean_id("candidate_id")} row_id, recorded_at, supporting_evidence_ids, supporting_fact_ids from claim_candidates),
ev as (select {sql_clean_id("event_id")} row_id, received_at, refs from domain_events),
refs as (
  select 'claim_candidates' ref_table, row_id, 'supporting_evidence_ids' ref_field, 'evidence' target, {sql_clean_id("u")} ref_id
    from (select row_id, unnest(supporting_evidence_ids) u from cand)
  union select 'claim_candidates', row_id, 'supporting_fact_ids', 'fact', {sql_clean_id("u")}
    from (select row_id, unnest(supporting_fact_ids) u from cand)
  union select 'domain_events', row_id, 'record_id', {sql_clean_id("u.record_type")}, {sql_clean_id("u.record_id")}
    from (select row_id, unnest(refs) u from ev)),
seen as (
  select 'claim_candidates' ref_table, row_id, min(recorded_at) seen_at from cand group by all
  union all select 'domain_events', row_id, min(received_at) from ev group by all),
parents as (
  select target, ref_id, min(first_at) first_at, min(deleted_at) deleted_at from (
    select 'evidence' target, {sql_clean_id("evidence_id")} ref_id, recorded_at first_at, deleted_at from evidence_segments
    union all select 'fact', {sql_clean_id("fact_id")}, recorded_at, deleted_at from facts
    union all select 'analysis', {sql_clean_id("analysis_id")}, recorded_at, deleted_at from semantic_details
    union all select 'claim', {sql_clean_id("claim_id")}, recorded_at, deleted_at from claim_candidates)
  where ref_id is not null group by all),
probed as (
  select r.*, s.seen_at, p.first_at, p.deleted_at,
    case when p.ref_id is null then 'missing' when p.deleted_at is not null then 'deleted' when p.first_at > s.seen_at then 'late' end state
  from refs r join seen s using (ref_table, row_id) left join parents p on p.target = r.target and p.ref_id = r.ref_id
  where r.row_id is not null and r.ref_id is not null and r.target in ('evidence', 'analysis', 'claim', 'fact'))
"""

_P5_RANKED = f"""
with r as (select *, row_number() over (partition by {sql_clean_id("event_id")} order by received_at nulls last, delivery_id) k,
  {sql_clean_id("event_id")} id from domain_events)
"""

_OBJECT = lambda x: f"json_type(case when json_valid({x}) then {x} end) = 'OBJECT'"
#: A value at a place where JSON inside a string counts.
_HELD = lambda x: f"case when json_type({x}) = 'VARCHAR' then case when json_valid(json_extract_string({x}, '$')) then json_extract_string({x}, '$')::json end else {x} end"
_OUTER = "||".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 32, 133, 160, 0x200B, 0x200E, 0x200F, 0x2028, 0x2029, 0x2060, 0xFEFF))
_P3 = f"""
with l as (select line_id, trim(record_json, {_OUTER}) t from session_exports),
r as (select line_id, t::json j from l where {_OBJECT("t")}),
e as (select line_id, {_HELD("json_extract(j, '$.entry')")} e, {_HELD("json_extract(j, '$.snapshot')")} s from r),
c as (select line_id, {_HELD("json_extract(e, '$.content')")} c, {_HELD("json_extract(s, '$.selection')")} s from e),
i as (select line_id, unnest(json_extract(c, '$[*]')) x, generate_subscripts(json_extract(c, '$[*]'), 1) - 1 pos from c where json_type(c) = 'ARRAY' union all select line_id, c, 0 from c where json_type(c) = 'OBJECT'),
h as (select line_id, pos, {_HELD("x")} x from i),
m as (select analysis_id, trim(model_json, {_OUTER}) t from semantic_details),
n as (select analysis_id, {_HELD("t::json")} x from m where json_valid(t))
"""

ORACLE = {
    "p3_found": _P3 + """select line_id::varchar parent_id, 'segment' child_kind, pos child_pos from h where json_type(x) = 'OBJECT'
      union all select line_id::varchar, 'selection', 0 from c where json_type(s) = 'OBJECT' and len(json_keys(s)) > 0
      union all select analysis_id, 'model', 0 from n where json_type(x) = 'OBJECT' and len(json_keys(x)) > 0""",
    "p4_found": _P4_CTE + "select ref_table, row_id, ref_field, ref_id, state from probed where state is not null",
    "p4_report": _P4_CTE + "select ref_table, ref_field, strftime(seen_at, '%Y-%m') period, state, count(*) n from probed where state is not null group by all",
    "p4_timeline": _P4_CTE + """, ch as (
      select ref_table, seen_at t, 1 o, 0 s, 0 r from probed where first_at is null or first_at > seen_at
      union all select ref_table, first_at, 0, 1, 0 from probed where first_at > seen_at
      union all select ref_table, greatest(deleted_at, seen_at, first_at), 0, 0, 1 from probed where deleted_at is not null),
      g as (select ref_table, strftime(t, '%Y-%m') period, sum(o)::bigint opened, sum(s)::bigint resolved, sum(r)::bigint reopened from ch group by all)
      select *, (sum(opened + reopened - resolved) over (partition by ref_table order by period))::bigint open_at_end from g""",
    "p5_found": _P5_RANKED + "select delivery_id from r where id is not null and k > 1",
    "p5_events": _P5_RANKED + "select delivery_id, event_id, batch_id, event_type, subject_type, subject_id, payload_json from r where id is null or k = 1",
}

QUERIES = {f.__name__: f for f in (p3_found, p3_rows, p3_tables, p3_orphan_rows, p4_found, p4_report, p4_timeline, p5_found, p5_events)}
