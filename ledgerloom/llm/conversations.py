"""Conversations from message rows, and the sessions that are left out.

Everything is keyed by (session, ordinal) or smaller, never by the session alone: a
session that holds a third of all rows is cut into chunks of ``CHUNK`` ordinals,
each chunk is reduced to a short summary, and only summaries meet per session.

1. Each ``entry_id`` once (its first row by ``recorded_at``), with whether any of its
   segments has text: one aggregation by entry over both tables.
2. Per (session, tool call id) the two first calls, by a limited rank.  A result's
   call id leads to a single earlier call if the first is earlier and the second is not.
3. Per (session, ordinal) one aggregation of entries and of the results' targets gives
   repeated ordinals, targets that are no call, and calls without a result.
4. Human entries and replies in order of ordinal, per chunk and then across chunks,
   give human entries without a reply.

Inactivity gaps: within a session the order is that of the ordinals, and a pause is
the time since the last message before that has one, in whatever chunk; a pause longer
than the limit calibrated for its source (a multiple of a high quantile of all its
pauses) starts a new episode.

Defined results: rows without an ``entry_id`` or a session are no messages; a null
ordinal breaks its session; actor and kind are compared in lower case without outer
white space; a blank tool call id is none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import clean_id, has_text
from ..session import cut

CHUNK = 4096
#: The role of each actor in a conversation, and of an entry's kind where the actor tells none.
ROLES = {"human": "user", "model": "assistant", "tool": "tool", "system": "system"}
KIND_ROLES = {"tool-call": "assistant", "reasoning": "assistant", "tool-result": "tool", "context": "system"}
GAP_QUANTILE, GAP_FACTOR = 0.95, 4.0


def messages(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """Each entry once, with ``has_text``: any of its segments has non-blank text, deleted ones too."""
    row = F.struct(
        F.col("recorded_at").isNull().alias("a"), F.col("recorded_at").alias("b"), F.col("batch_id").alias("c"), "session_id", "ordinal",
        clean_id("entry_kind").alias("kind"), clean_id("actor").alias("actor"), "entry_ts", F.col("related_entry_ordinal").alias("related"),
        F.when(has_text("tool_call_id"), F.col("tool_call_id")).alias("call_id"), "source_kind",
    )
    ours = entries.filter("entry_id is not null and session_id is not null").select("entry_id", row.alias("e"), F.lit(False).alias("t"))
    texts = segments.filter(has_text("text") & F.col("entry_id").isNotNull()).select("entry_id", F.lit(None).cast(ours.schema["e"].dataType).alias("e"), F.lit(True).alias("t"))
    both = ours.unionByName(texts).groupBy("entry_id").agg(F.min("e").alias("e"), F.max("t").alias("has_text"))
    return both.filter("e is not null").select("entry_id", "e.session_id", "e.ordinal", "e.kind", "e.actor", "e.entry_ts", "e.related", "e.call_id", "e.source_kind", "has_text")


def _targets(msgs: DataFrame) -> DataFrame:
    """(session, ordinal, bad) per tool result: the ordinal it leads to, or bad."""
    named = msgs.filter("kind = 'tool-call' and call_id is not null").select("session_id", "call_id", "ordinal")
    order = W.partitionBy("session_id", "call_id").orderBy("ordinal")
    two = named.withColumn("k", F.row_number().over(order)).filter("k <= 2")
    firsts = two.groupBy("session_id", "call_id").agg(F.min("ordinal").alias("c1"), F.max(F.when(F.col("k") == 2, F.col("ordinal"))).alias("c2"))
    results = msgs.filter("kind = 'tool-result'").select("session_id", "ordinal", "related", "call_id")
    r = results.join(firsts, ["session_id", "call_id"], "left")
    single = (F.col("c1") < F.col("ordinal")) & (F.col("c2").isNull() | (F.col("c2") >= F.col("ordinal")))
    by_id = F.when(F.col("call_id").isNotNull() & F.coalesce(single, F.lit(False)), F.col("c1"))
    bad = (
        (F.col("call_id").isNull() & F.col("related").isNull())
        | (F.col("call_id").isNotNull() & by_id.isNull())
        | F.coalesce(F.col("related") >= F.col("ordinal"), F.lit(False))
        | F.coalesce(by_id != F.col("related"), F.lit(False))
    )
    return r.select("session_id", F.coalesce(by_id, "related").alias("ordinal"), bad.alias("bad"))


def _positions(msgs: DataFrame) -> DataFrame:
    """One row per (session, ordinal): its entries, symbol and tool links."""
    symbol = F.when(F.col("actor") == "human", "H").when((F.col("actor") == "model") & (F.col("kind") == "message") & F.col("has_text"), "R")
    no = F.lit(False)
    own = msgs.select(
        "session_id", "ordinal", F.lit(1).alias("n"), symbol.alias("symbol"), F.coalesce(F.col("kind") == "tool-call", no).alias("is_call"), no.alias("is_target"),
        F.coalesce((F.col("related") < 0) | (F.col("related") >= F.col("ordinal")), no).alias("bad"), "has_text",
    )
    aimed = _targets(msgs).select("session_id", "ordinal", F.lit(0).alias("n"), F.lit(None).cast("string").alias("symbol"), no.alias("is_call"), F.lit(True).alias("is_target"), "bad", no.alias("has_text"))
    return own.unionByName(aimed).groupBy("session_id", "ordinal").agg(
        F.sum("n").alias("n"), F.min("symbol").alias("symbol"), F.max("is_call").alias("is_call"), F.max("is_target").alias("is_target"), F.max("bad").alias("bad"), F.max("has_text").alias("has_text")
    )


def chunk_of(ordinal: Column) -> Column:
    return F.floor(ordinal / CHUNK)


def _unanswered(positions: DataFrame) -> DataFrame:
    """Sessions with a human entry without a reply before the next one or the end."""
    marks = positions.filter("symbol is not null and ordinal is not null").select("session_id", "ordinal", "symbol", chunk_of(F.col("ordinal")).alias("chunk"))
    follow = F.lead("symbol").over(W.partitionBy("session_id", "chunk").orderBy("ordinal"))
    inner = marks.withColumn("follow", follow).groupBy("session_id", "chunk").agg(
        F.min_by("symbol", "ordinal").alias("first"), F.max_by("symbol", "ordinal").alias("last"), F.max((F.col("symbol") == "H") & (F.col("follow") == "H")).alias("bad")
    )
    after = F.lead("first").over(W.partitionBy("session_id").orderBy("chunk"))
    open_end = (F.col("last") == "H") & (after.isNull() | (after == "H"))
    return inner.withColumn("bad", F.coalesce(F.col("bad"), F.lit(False)) | open_end).groupBy("session_id").agg(F.max("bad").alias("unanswered"))


def session_faults(msgs: DataFrame) -> DataFrame:
    """Per session of ``messages`` the faults found: broken order, no text, broken links, no reply."""
    positions = _positions(msgs)
    own = positions.filter("n > 0 or is_target or bad")
    faults = own.groupBy("session_id").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("n") > 0, F.col("ordinal"))).alias("low"), F.max(F.when(F.col("n") > 0, F.col("ordinal"))).alias("high"),
        F.max((F.col("n") > 1) | (F.col("ordinal").isNull() & (F.col("n") > 0))).alias("repeated"),
        F.max("has_text").alias("text"), F.max("bad").alias("bad"), F.max(F.col("is_call") != F.col("is_target")).alias("unlinked"),
    )
    broken = F.col("repeated") | F.coalesce(F.col("low") != 0, F.lit(True)) | F.coalesce(F.col("high") != F.col("n") - 1, F.lit(True))
    return faults.join(_unanswered(positions), "session_id", "left").select(
        "session_id", "n", broken.alias("broken_order"), (~F.col("text")).alias("no_text"), (F.col("bad") | F.col("unlinked")).alias("broken_links"), F.coalesce("unanswered", F.lit(False)).alias("no_reply")
    )


def faulty(msgs: DataFrame) -> DataFrame:
    """The sessions of ``messages`` with any fault."""
    return session_faults(msgs).filter("broken_order or no_text or broken_links or no_reply").select("session_id")


def left_out(entries: DataFrame, segments: DataFrame) -> DataFrame:
    return faulty(messages(entries, segments))


def gap_limits(msgs: DataFrame) -> DataFrame:
    """Per source the pause that starts a new episode: GAP_FACTOR times the GAP_QUANTILE of its pauses."""
    pause = _pauses(msgs)
    q = F.percentile_approx("pause_s", GAP_QUANTILE, 1000)
    return pause.filter("pause_s is not null").groupBy("source_kind").agg((q * GAP_FACTOR).alias("limit_s"))


def _pauses(msgs: DataFrame) -> DataFrame:
    """Each message with the seconds since the last message before it that has a time: in its chunk, else as chunks' summaries carry it."""
    timed = msgs.withColumns({"chunk": chunk_of(F.col("ordinal")), "at": F.unix_micros("entry_ts") / 1e6})
    rows_before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    ends = timed.groupBy("session_id", "chunk").agg(F.max_by("at", F.when(F.col("at").isNotNull(), F.col("ordinal"))).alias("end"))
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(rows_before(W.partitionBy("session_id").orderBy("chunk")))).drop("end")
    inside = F.last("at", ignorenulls=True).over(rows_before(W.partitionBy("session_id", "chunk").orderBy("ordinal")))
    both = timed.withColumn("inside", inside).join(carried, ["session_id", "chunk"], "left")
    pause = F.col("at") - F.coalesce("inside", "carried")
    return both.withColumn("pause_s", F.when(pause.isNotNull(), F.greatest(pause, F.lit(0.0)))).drop("chunk", "at", "inside", "carried")


def conversations(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """The kept sessions' messages in order, one row per message part with text, with role and episode.

    ``turn`` is the ordinal, ``part`` the segment's; repeated segments count once and
    deleted ones are left out here.  The role follows from the actor, where that is none of
    the known ones from the entry's kind, else it is ``unknown``.
    """
    msgs = messages(entries, segments)
    kept = cut(msgs.join(faulty(msgs), "session_id", "left_anti"))  # without texts; read several times
    paused = _pauses(kept).join(gap_limits(kept), "source_kind", "left")
    chunk = chunk_of(F.col("ordinal"))
    new = F.coalesce((F.col("pause_s") > F.col("limit_s")).cast("long"), F.lit(0))
    within = F.sum("new").over(W.partitionBy("session_id", "chunk").orderBy("ordinal"))
    marked = paused.withColumns({"new": new, "chunk": chunk}).withColumn("within", within)
    starts = marked.groupBy("session_id", "chunk").agg(F.sum("new").alias("s"))
    before = F.sum("s").over(W.partitionBy("session_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    offsets = starts.select("session_id", "chunk", F.coalesce(before, F.lit(0)).alias("offset"))
    placed = marked.join(offsets, ["session_id", "chunk"])
    of = lambda roles, col: F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])[F.col(col)]
    role = F.coalesce(of(ROLES, "actor"), of(KIND_ROLES, "kind"), F.lit("unknown"))
    live = segments.filter("entry_id is not null").groupBy("evidence_id", "entry_id", "segment_ordinal").agg(F.min(F.struct("recorded_at", "text")).alias("s"), F.max("deleted_at").alias("gone"))
    parts = live.filter("gone is null").select("entry_id", "segment_ordinal", F.col("s.text").alias("text")).filter(has_text("text"))
    rows = placed.select("session_id", F.col("ordinal").alias("turn"), (F.col("within") + F.col("offset")).alias("episode"), role.alias("role"), "kind", "entry_id")
    # an inner join, since a message with very many parts can be split in it on either side
    spoken = rows.join(parts, "entry_id")
    silent = rows.join(parts.select("entry_id").distinct(), "entry_id", "left_anti").withColumns({"segment_ordinal": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})
    return spoken.unionByName(silent).select("session_id", "turn", "episode", "role", "kind", "entry_id", F.col("segment_ordinal").alias("part"), "text")
