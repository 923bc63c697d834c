"""The project's tables in the shape the operators take.

Received rows repeat; of each key the first by its order counts, as a partial minimum over
(order, row), which is combined before the shuffle, so that a key with a third of all rows
costs one row per task.  The SQL constants say the same for the comparison in DuckDB, in
that engine's own terms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_id, sql_clean_id
from ..session import table


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key: the first by ``order``, nulls last."""
    rest = [c for c in rows.columns if c not in keys]
    place = [x for c in order for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(f"o_{c}"))]
    held = rows.groupBy(*keys).agg(F.min(F.struct(*place, F.struct(*rest).alias("row"))).alias("m"))
    return held.select(*keys, "m.row.*")


def _named(rows: DataFrame, **columns: str | Column) -> DataFrame:
    return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def entries(spark: SparkSession, d: str) -> DataFrame:
    """One entry per (doc, ordinal): the first received."""
    rows = _named(
        table(spark, d, "evidence_entries"), doc="session_id", ordinal="ordinal", recorded_at="recorded_at", batch_id="batch_id", entry_id="entry_id", digest="document_digest", kind="entry_kind", actor=F.lower(F.trim("actor")),
        related="related_entry_ordinal", call_id="tool_call_id", tool_name="tool_name", tool_namespace="tool_namespace", source_kind="source_kind", source_instance_id="source_instance_id", native_id="native_id", entry_ts="entry_ts",
    )
    return first_rows(rows, ["doc", "ordinal"], ["recorded_at", "batch_id", "entry_id"]).drop("recorded_at", "batch_id")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """One segment per (doc, entry, segment): the first received."""
    rows = _named(
        table(spark, d, "evidence_segments"), doc="session_id", ordinal="entry_ordinal", segment="segment_ordinal", recorded_at="recorded_at", evidence_id="evidence_id", segment_kind="segment_kind", origin="origin",
        origin_confidence="origin_confidence", text="text", content_class="content_class", source_type="source_type", content_hash="content_hash",
    )
    return first_rows(rows, ["doc", "ordinal", "segment"], ["recorded_at", "evidence_id"]).drop("recorded_at")


def places(spark: SparkSession, d: str) -> DataFrame:
    """(evidence_id, doc, ordinal): where each stored evidence id stands."""
    rows = _named(table(spark, d, "evidence_segments"), evidence_id="evidence_id", recorded_at="recorded_at", ordinal="entry_ordinal", doc="session_id")
    return first_rows(rows, ["evidence_id"], ["recorded_at", "ordinal"]).drop("recorded_at")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each stored evidence id with its segment's and its entry's fields."""
    rows = _named(table(spark, d, "evidence_segments"), evidence_id="evidence_id", recorded_at="recorded_at", ordinal="entry_ordinal", doc="session_id", segment="segment_ordinal", origin="origin", origin_confidence="origin_confidence", content_hash="content_hash", text="text")
    own = first_rows(rows, ["evidence_id"], ["recorded_at", "ordinal"]).drop("recorded_at")
    entry = entries(spark, d).select("doc", "ordinal", "digest", "kind", "actor", "related", "call_id", "tool_name", "tool_namespace")
    return own.join(entry, ["doc", "ordinal"], "left")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Each stored fact once."""
    rows = _named(
        table(spark, d, "facts"), fact_id="fact_id", recorded_at="recorded_at", ordinal="ordinal", kind="fact_kind", outcome="outcome", evidence_ids="evidence_ids", analysis_run_id="analysis_run_id", value_json="value_json",
        parse_rule="parse_rule", extractor_name="extractor_name", extractor_version="extractor_version", schema_version="schema_version", fingerprint="fingerprint",
    )
    return first_rows(rows, ["fact_id"], ["recorded_at", "ordinal"]).drop("recorded_at")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each claim candidate of a known analysis once."""
    rows = _named(
        table(spark, d, "claim_candidates"), candidate_id="candidate_id", recorded_at="recorded_at", ordinal="ordinal", batch="analysis_id", claim_type="claim_type", status="status", statement="statement", subject="subject", scope="scope",
        confidence="confidence", attribution="attribution", actor="actor", origin="origin", outcome="outcome", supporting="supporting_evidence_ids", contradicting="contradicting_evidence_ids", fact_ids="supporting_fact_ids", claim_id="claim_id",
    )
    home = table(spark, d, "semantic_details").select(F.col("analysis_id").alias("batch"), F.col("session_id").alias("doc"))
    return first_rows(rows, ["candidate_id"], ["recorded_at", "ordinal"]).drop("recorded_at").join(home, "batch")


def events(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each event, with its number."""
    rows = table(spark, d, "domain_events").withColumn("key", clean_id("event_id")).filter("key is not null")
    return first_rows(rows.drop("batch_id"), ["key"], ["received_at", "delivery_id"]).drop("key")


# The same in DuckDB.
ENTRIES = """
select session_id as doc, document_digest as digest, ordinal, entry_kind as kind, lower(trim(actor)) as actor,
  related_entry_ordinal as related, tool_call_id as call_id, tool_name, tool_namespace, entry_id, source_kind, source_instance_id, native_id, entry_ts
from (select *, row_number() over (partition by session_id, ordinal order by recorded_at, batch_id, entry_id) as rn from evidence_entries) t
where rn = 1
"""
SEGMENTS = """
select session_id as doc, entry_ordinal as ordinal, segment_ordinal as segment, segment_kind, origin, origin_confidence, text, content_class, source_type, evidence_id, content_hash
from (select *, row_number() over (partition by session_id, entry_ordinal, segment_ordinal order by recorded_at, evidence_id) as rn from evidence_segments) t
where rn = 1
"""
EVIDENCE = f"""
select s.*, e.digest, e.kind, e.related, e.call_id, e.actor, e.tool_name, e.tool_namespace
from (select evidence_id, session_id as doc, entry_ordinal as ordinal, segment_ordinal as segment, origin, origin_confidence, content_hash, text,
        row_number() over (partition by evidence_id order by recorded_at, entry_ordinal) as rk from evidence_segments) s
left join ({ENTRIES}) e on s.doc = e.doc and s.ordinal = e.ordinal
where rk = 1
"""
FACTS = """
select fact_id, fact_kind as kind, outcome, evidence_ids, analysis_run_id, ordinal, value_json, parse_rule, extractor_name, extractor_version, schema_version, fingerprint
from (select *, row_number() over (partition by fact_id order by recorded_at, ordinal) as rk from facts) t where rk = 1
"""
CANDIDATES = """
select c.candidate_id, c.analysis_id as batch, d.session_id as doc, c.ordinal, claim_type, c.status, statement, subject, scope, confidence, attribution, actor, origin, outcome,
  supporting_evidence_ids as supporting, contradicting_evidence_ids as contradicting, supporting_fact_ids as fact_ids, claim_id
from (select *, row_number() over (partition by candidate_id order by recorded_at, ordinal) as rk from claim_candidates) c
join semantic_details d on c.analysis_id = d.analysis_id where rk = 1
"""
EVENTS = f"""
select * from (select *, row_number() over (partition by {sql_clean_id("event_id")} order by received_at, delivery_id) as rk from domain_events where {sql_clean_id("event_id")} is not null) t where rk = 1
"""
