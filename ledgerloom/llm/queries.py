"""Queries p1, p2 and p6 to p9 over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_clean_id, sql_has_text
from ..session import table
from . import bpe, conversations, packing, pii, quality, splitting


def limits(spark: SparkSession, d: str) -> dict[str, int]:
    """The limits of the fixed small table ``size_limits``."""
    return {r["limit_name"]: r["limit_value"] for r in table(spark, d, "size_limits").collect()}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.left_out(table(spark, d, "evidence_entries"), table(spark, d, "evidence_segments"))


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "evidence_entries"), table(spark, d, "evidence_segments"))


def p1_messages(spark: SparkSession, d: str) -> DataFrame:
    """The conversations' message parts without the episodes."""
    return p1_conversations(spark, d).drop("episode")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that may hold personal data: those of segments and those prepared for an analysis."""
    segments = table(spark, d, "evidence_segments").select(F.col("evidence_id").alias("text_id"), "text")
    return segments.unionByName(table(spark, d, "semantic_texts").select("text_id", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(_texts(spark, d), "text_id", "text").select("text_id", "pii_type", "start_char").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(_texts(spark, d), "text_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    size = limits(spark, d)
    pieces = splitting.text_pieces(table(spark, d, "semantic_texts"), "text_id", "text", size["text_bytes"], size["text_overlap"])
    texts = pieces.filter("piece = 1").select(F.lit("text").alias("item_kind"), F.col("text_id").alias("item_id"))
    long = splitting.oversized_sessions(table(spark, d, "evidence_entries"), size["session_entries"], size["session_overlap"])
    return texts.unionByName(long.select(F.lit("session").alias("item_kind"), F.col("session_id").alias("item_id")))


def p6_text_pieces(spark: SparkSession, d: str) -> DataFrame:
    size = limits(spark, d)
    return splitting.text_pieces(table(spark, d, "semantic_texts"), "text_id", "text", size["text_bytes"], size["text_overlap"])


def p6_session_pieces(spark: SparkSession, d: str) -> DataFrame:
    size = limits(spark, d)
    return splitting.session_pieces(table(spark, d, "evidence_entries"), size["session_entries"], size["session_overlap"])


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """How often a piece breaks what holds for all pieces (never): its limit, its overlap, the text or session it is cut from."""
    size = limits(spark, d)
    return splitting.broken_pieces(
        table(spark, d, "semantic_texts"), p6_text_pieces(spark, d), size["text_bytes"], size["text_overlap"], p6_session_pieces(spark, d), size["session_entries"], size["session_overlap"]
    )


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), "doc_id", "text", limits(spark, d)["container_tokens"])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of p8_packed are, against the least number any packing needs."""
    return packing.fill(p8_packed(spark, d), limits(spark, d)["container_tokens"])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    words: dict[str, list[str]] = {}
    for r in table(spark, d, "common_words").collect():  # a fixed table of 210 rows
        words.setdefault(r["lang"], []).append(r["word"])
    return quality.scored(table(spark, d, "documents"), table(spark, d, "doc_labels"), words)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(_scored(spark, d))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


_P1 = f"""
with e as (
  select entry_id, session_id, ordinal, {sql_clean_id("entry_kind")} kind, {sql_clean_id("actor")} actor, related_entry_ordinal rel,
    case when {sql_has_text("tool_call_id")} then tool_call_id end call_id
  from evidence_entries where entry_id is not null and session_id is not null
  qualify row_number() over (partition by entry_id order by recorded_at nulls last, batch_id) = 1),
t as (select distinct entry_id from evidence_segments where {sql_has_text("text")}),
m as (select e.*, t.entry_id is not null txt, e.actor = 'model' and e.kind = 'message' and t.entry_id is not null reply from e left join t using (entry_id)),
a as (select session_id from m group by 1
  having count(*) <> count(distinct ordinal) or min(ordinal) <> 0 or max(ordinal) <> count(*) - 1 or not bool_or(txt)),
h as (select session_id, ordinal, lead(ordinal) over (partition by session_id order by ordinal) nxt from m where actor = 'human'),
c as (select h.session_id from h where not exists (
  select 1 from m where m.session_id = h.session_id and m.reply and m.ordinal > h.ordinal and (h.nxt is null or m.ordinal < h.nxt))),
d as (select session_id from m where rel is not null and not exists (
  select 1 from m x where x.session_id = m.session_id and x.ordinal = m.rel and x.ordinal < m.ordinal)),
calls as (select session_id, ordinal, call_id from m where kind = 'tool-call'),
res as (select r.session_id, r.ordinal, r.rel, r.call_id, count(distinct case when k.ordinal = r.rel then k.ordinal end) na,
    count(distinct case when k.call_id = r.call_id then k.ordinal end) nb, max(case when k.ordinal = r.rel then k.ordinal end) ta,
    max(case when k.call_id = r.call_id then k.ordinal end) tb
  from m r left join calls k on k.session_id = r.session_id and k.ordinal < r.ordinal and (k.ordinal = r.rel or k.call_id = r.call_id)
  where r.kind = 'tool-result' group by all),
f as (select session_id from res where (rel is null and call_id is null) or (rel is not null and na <> 1) or (call_id is not null and nb <> 1)
  or (rel is not null and call_id is not null and ta <> tb)),
g as (select k.session_id from calls k where not exists (
  select 1 from res where res.session_id = k.session_id and coalesce(res.ta, res.tb) = k.ordinal)),
bad as (select session_id from a union select session_id from c union select session_id from d union select session_id from f union select session_id from g)
"""

_CHECKS = ("text over limit", "text overlap", "text not covered", "text changed", "session over limit", "session overlap", "session entry twice")
ORACLE = {
    "p6_checks": "select unnest([" + ", ".join(f"'{c}'" for c in _CHECKS) + "]) rule, 0::bigint n",
    "p1_found": _P1 + "select session_id from bad",
    "p1_messages": _P1 + f""", s as (select evidence_id, entry_id, segment_ordinal, arg_min(text, (recorded_at, text)) text, max(deleted_at) gone from evidence_segments where entry_id is not null group by all),
      l as (select * from s where gone is null and {sql_has_text("text")})
      select m.session_id, m.ordinal turn, case m.actor when 'human' then 'user' when 'model' then 'assistant' when 'tool' then 'tool' when 'system' then 'system' else case m.kind when 'tool-call' then 'assistant' when 'reasoning' then 'assistant' when 'tool-result' then 'tool' when 'context' then 'system' else 'unknown' end end "role", m.kind, m.entry_id, l.segment_ordinal part, l.text
      from m left join l using (entry_id) where m.session_id not in (from bad)""",
    "p6_found": """
      select 'text' item_kind, text_id item_id from semantic_texts, size_limits where limit_name = 'text_bytes' and strlen(text) > limit_value
      union all select 'session', session_id from evidence_entries where session_id is not null group by session_id
      having count(distinct ordinal) > (select limit_value from size_limits where limit_name = 'session_entries')""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_conversations, p1_messages, p2_found, p2_redacted, p6_found, p6_text_pieces, p6_session_pieces, p6_checks, p7_ids, p8_packed, p8_fill, p9_found, p9_statistics)}
