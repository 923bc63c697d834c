"""References to records that are missing, deleted or came later.

The state is keyed by the target id and kept incrementally (``OrphanState``): new
references probe the parent index, arriving parents resolve the references that wait
for them, deletions reopen them.  What is kept of a reference and of a parent are
minima (first time, first deletion), so batches can come in any order and any number
of times; each is appended to the state and only the references it concerns are looked
at again.  Snapshots of the counts follow from the changes of each batch.

Defined results: ids are compared and returned in lower case without outer white
space; null and blank ids, of the reference or of its row, are no case; repeated
rows and repeated array items give one reference; a null time counts as unknown and
never makes a reference late; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import clean_id
from ..session import remove, scratch

REF_KEY = ["ref_table", "row_id", "ref_field", "target", "ref_id"]


def merge_refs(*parts: DataFrame) -> DataFrame:
    """Fold reference batches (REF_KEY, seen_at) into one row per reference."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.groupBy(*REF_KEY).agg(F.min("seen_at").alias("seen_at"))


def merge_parents(*parts: DataFrame) -> DataFrame:
    """Fold parent batches (target, ref_id, first_at, deleted_at) into the parent index."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.groupBy("target", "ref_id").agg(F.min("first_at").alias("first_at"), F.min("deleted_at").alias("deleted_at"))


def probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Each reference with its state: missing, deleted, late or null when sound.

    ``parents`` is unique by (target, ref_id), so a target that a third of all
    references name is a skewed left side only, which AQE splits.
    """
    found = parents.withColumn("has_parent", F.lit(True))
    joined = refs.join(found, ["target", "ref_id"], "left")
    state = (
        F.when(F.col("has_parent").isNull(), "missing")
        .when(F.col("deleted_at").isNotNull(), "deleted")
        .when(F.col("first_at") > F.col("seen_at"), "late")
    )
    return joined.withColumn("state", state).drop("has_parent")


def exploded_refs(rows: DataFrame, table: str, row_id: str, seen_at: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """References of array columns: ``fields`` maps a column to (ref_field, target).

    ``seen_at`` is the row's first time over all its copies.
    """
    base = rows.select(clean_id(row_id).alias("row_id"), F.col(seen_at).alias("seen_at"), *fields).filter("row_id is not null")
    first = base.groupBy("row_id").agg(F.min("seen_at").alias("seen_at"))
    listed = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(t).alias("target"), F.col(c).alias("ids")) for c, (f, t) in fields.items()])
    each = base.select("row_id", F.explode(listed).alias("f")).select("row_id", "f.ref_field", "f.target", F.explode("f.ids").alias("ref_id"))
    refs = each.withColumn("ref_id", clean_id("ref_id")).filter("ref_id is not null").distinct()
    return refs.join(first, "row_id").withColumn("ref_table", F.lit(table)).select(*REF_KEY, "seen_at")


def parent_rows(rows: DataFrame, target: str, id_col: str, first_at: str = "recorded_at", deleted_at: str = "deleted_at") -> DataFrame:
    out = rows.select(F.lit(target).alias("target"), clean_id(id_col).alias("ref_id"), F.col(first_at).alias("first_at"), F.col(deleted_at).alias("deleted_at"))
    return out.filter("ref_id is not null")


#: The record types of an event reference that are checked.
EVENT_TARGETS = ("analysis", "claim", "fact")


def project_refs(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """The references of claim candidates and domain events."""
    ours = exploded_refs(
        candidates, "claim_candidates", "candidate_id", "recorded_at",
        {"supporting_evidence_ids": ("supporting_evidence_ids", "evidence"), "supporting_fact_ids": ("supporting_fact_ids", "fact")},
    )
    kind = clean_id("r.record_type")
    base = events.select(clean_id("event_id").alias("row_id"), F.col("received_at").alias("seen_at"), "refs").filter("row_id is not null")
    first = base.groupBy("row_id").agg(F.min("seen_at").alias("seen_at"))
    each = base.select("row_id", F.explode("refs").alias("r")).select("row_id", kind.alias("target"), clean_id("r.record_id").alias("ref_id"))
    each = each.filter(F.col("target").isin(*EVENT_TARGETS) & F.col("ref_id").isNotNull()).distinct()
    theirs = each.join(first, "row_id").withColumns({"ref_table": F.lit("domain_events"), "ref_field": F.lit("record_id")})
    return ours.unionByName(theirs.select(*REF_KEY, "seen_at"))


def project_parents(segments: DataFrame, facts: DataFrame, details: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of all target tables as they come: arrivals and deletions, repeated ones too."""
    parts = (parent_rows(segments, "evidence", "evidence_id"), parent_rows(facts, "fact", "fact_id"), parent_rows(details, "analysis", "analysis_id"), parent_rows(candidates, "claim", "claim_id"))
    return reduce(DataFrame.unionByName, parts)


def period(col: str | Column, unit: str = "month") -> Column:
    return F.date_trunc(unit, col).cast("date")


def report(probed: DataFrame, unit: str = "month") -> DataFrame:
    """Counts of each state per table, field and period of the reference."""
    bad = probed.filter("state is not null")
    return bad.groupBy("ref_table", "ref_field", period("seen_at", unit).alias("period"), "state").agg(F.count(F.lit(1)).alias("n"))


def timeline(probed: DataFrame, unit: str = "month") -> DataFrame:
    """References open at the end of each period, per table, with what opened, resolved and reopened.

    Each reference gives at most three dated changes; they are summed per period before the running total.
    """
    late = F.col("first_at").isNull() | (F.col("first_at") > F.col("seen_at"))
    gone = F.greatest("deleted_at", "seen_at", "first_at")
    change = F.array(
        F.when(late, F.struct(F.col("seen_at").alias("at"), F.lit("opened").alias("what"))),
        F.when(F.col("first_at") > F.col("seen_at"), F.struct(F.col("first_at").alias("at"), F.lit("resolved").alias("what"))),
        F.when(F.col("deleted_at").isNotNull(), F.struct(gone.alias("at"), F.lit("reopened").alias("what"))),
    )
    dated = probed.select("ref_table", F.explode(F.array_compact(change)).alias("c"))
    summed = dated.groupBy("ref_table", period("c.at", unit).alias("period")).agg(
        *[F.count(F.when(F.col("c.what") == w, 1)).alias(w) for w in ("opened", "resolved", "reopened")]
    )
    running = W.partitionBy("ref_table").orderBy(F.col("period").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    return summed.withColumn("open_at_end", F.sum(F.col("opened") + F.col("reopened") - F.col("resolved")).over(running))


@dataclass
class OrphanState:
    """Keyed state of references and what they wait for, in a shared folder; each batch only appends.

    - ``parents``: the parent index, per batch the target ids that came or were deleted in it;
    - ``refs``: per batch the references that were new in it;
    - ``states``: per batch the references whose state it changed, with the state before.

    All three are partitioned by a hash bucket of the target id, so that a batch reads the
    buckets of its own ids only.  A batch touches its new references, which probe the index,
    and the stored references whose target it brings or deletes: what waits is resolved and
    what was sound is opened again.  Counts are carried on by the changes alone.
    A batch that comes again changes nothing.
    """

    spark: SparkSession
    path: str
    version: int = 0
    buckets: int = 8

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("target", "ref_id"), F.lit(self.buckets)).cast("int"))

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={self.version}")

    def _stored(self, name: str, until: int, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all batches up to ``until``, of the given buckets."""
        if until < 1:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        rows = self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}").filter(F.col("batch") <= until)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def touched(self, refs: DataFrame, parents: DataFrame, before: int, buckets: list[int] | None = None) -> DataFrame:
        """The references a batch has to look at: its own and the stored ones of the targets it brings or deletes."""
        stored = self._stored("refs", before, buckets)
        waiting = stored.join(parents.select("target", "ref_id"), ["target", "ref_id"], "left_semi")
        again = stored.join(refs.select(*REF_KEY), REF_KEY, "left_semi")
        return merge_refs(*(x.select(*REF_KEY, "seen_at") for x in (refs, waiting, again)))

    def update(self, refs: DataFrame, parents: DataFrame) -> None:
        """Fold one batch of references and of parents (arrivals and deletions) into the state."""
        before, self.version = self.version, self.version + 1
        self._append(self._bucketed(merge_refs(refs)), "refs")
        self._append(self._bucketed(merge_parents(parents)), "parents")
        mine = self._stored("refs", self.version).filter(F.col("batch") == self.version)
        came = self._stored("parents", self.version).filter(F.col("batch") == self.version)
        buckets = [r[0] for r in mine.select("bucket").union(came.select("bucket")).distinct().collect()]  # at most self.buckets
        looked_at = self.touched(mine, came, before, buckets)
        asked = looked_at.select("target", "ref_id").distinct()
        index = merge_parents(self._stored("parents", self.version, buckets).join(asked, ["target", "ref_id"], "left_semi").select(*_PARENT))
        now = probe(looked_at, index).withColumn("state", F.coalesce("state", F.lit("sound")))
        was = latest(self._stored("states", before, buckets)).select(*REF_KEY, F.struct("state", "seen_at", "first_at", "deleted_at").alias("was"))
        changed = now.join(was, REF_KEY, "left").filter(~F.struct("state", "seen_at", "first_at", "deleted_at").eqNullSafe(F.col("was")))
        self._append(self._bucketed(changed.withColumns({"was_state": F.col("was.state"), "was_seen_at": F.col("was.seen_at")}).drop("was")), "states")

    def current(self) -> DataFrame:
        """Every reference with its state, null when sound, and the times it follows from."""
        rows = latest(self._stored("states", self.version))
        return rows.withColumn("state", F.expr("nullif(state, 'sound')")).select(*REF_KEY, "seen_at", "first_at", "deleted_at", "state")

    def pending(self) -> DataFrame:
        """The references that wait for their parent or lost it."""
        return self.current().filter("state in ('missing', 'deleted')")

    def snapshots(self, unit: str = "month") -> DataFrame:
        """Counts of each state per table, field and period after each batch, from the changes of the batches."""
        gone = F.struct(F.col("was_state").alias("state"), F.col("was_seen_at").alias("at"), F.lit(-1).alias("d"))
        new = F.struct("state", F.col("seen_at").alias("at"), F.lit(1).alias("d"))
        moves = self._stored("states", self.version).select("batch", "ref_table", "ref_field", F.explode(F.array(gone, new)).alias("m")).filter("m.state <> 'sound'")
        steps = moves.groupBy("batch", "ref_table", "ref_field", period("m.at", unit).alias("period"), "m.state").agg(F.sum("m.d").alias("d"))
        held = steps.withColumn("after", F.explode(F.sequence("batch", F.lit(max(1, self.version)))))  # the periods' counts times the batches
        return held.groupBy("after", "ref_table", "ref_field", "period", "state").agg(F.sum("d").alias("n")).filter("n <> 0")


_PARENT = ["target", "ref_id", "first_at", "deleted_at"]
_BATCH = "batch int, bucket int"
_SCHEMAS = {
    "refs": f"ref_table string, row_id string, ref_field string, target string, ref_id string, seen_at timestamp, {_BATCH}",
    "parents": f"target string, ref_id string, first_at timestamp, deleted_at timestamp, {_BATCH}",
    "states": f"ref_table string, row_id string, ref_field string, target string, ref_id string, seen_at timestamp, first_at timestamp, deleted_at timestamp, state string, was_state string, was_seen_at timestamp, {_BATCH}",
}


def latest(states: DataFrame) -> DataFrame:
    """The last state of each reference."""
    fields = F.struct("batch", "state", "seen_at", "first_at", "deleted_at")
    return states.groupBy(*REF_KEY).agg(F.max_by(fields, "batch").alias("s")).select(*REF_KEY, "s.*")


def arrivals(refs: DataFrame, parents: DataFrame, batches: int) -> tuple[DataFrame, DataFrame]:
    """References (REF_KEY, seen_at) and parents with the ``batch`` of equal spans of time in which they come.

    A parent row gives its arrival and, where it has one, its deletion, each in its own time;
    rows without a time come first.
    """
    deleted = parents.filter("deleted_at is not null").select("target", "ref_id", F.lit(None).cast("timestamp").alias("first_at"), "deleted_at")
    both = parents.withColumn("deleted_at", F.lit(None).cast("timestamp")).unionByName(deleted)
    at = F.coalesce("first_at", "deleted_at")
    low, high = parents.agg(F.min(F.unix_micros("first_at")), F.max(F.unix_micros("first_at"))).first()
    width = max(1, ((high or 0) - (low or 0)) // batches + 1)
    batch = lambda t: F.coalesce(F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((F.unix_micros(t) - F.lit(low or 0)) / width))), F.lit(0)).cast("int")
    return refs.withColumn("slice", batch(F.col("seen_at"))), both.withColumn("slice", batch(at))


def folded(state: OrphanState, refs: DataFrame, parents: DataFrame, batches: int = 3) -> OrphanState:
    """Bring all rows into ``state`` in ``batches`` spans of time, through an inbox in the shared folder."""
    inbox = scratch(state.spark, "inbox")
    for name, rows in zip(("refs", "parents"), arrivals(refs, parents, batches)):
        rows.write.partitionBy("slice").parquet(f"{inbox}/{name}")
    own = lambda name: state.spark.read.schema(_SCHEMAS[name].replace(_BATCH, "slice int")).parquet(f"{inbox}/{name}").filter(F.col("slice") == k).drop("slice")
    for k in range(batches):
        state.update(own("refs"), own("parents"))
    remove(state.spark, inbox)
    return state
