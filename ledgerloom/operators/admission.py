"""Claim candidates admitted or rejected against the selection their analysis saw.

``candidates``: (candidate_id, batch, ordinal, claim_type, status, statement, subject, scope,
confidence, attribution, actor, origin, outcome, supporting, contradicting, fact_ids);
``references``: (batch, evidence_id, ordinal, related, call_id, actor, origin), those of the
batch's selection, unique by (batch, id); ``facts``: (batch, fact_id, kind, outcome,
evidence_ids), those whose evidence is all selected.  A selection holds at most 512
references and 256 facts, so nothing here grows with a document.

Cited ids are exploded with their place and looked up by joins, and come back as a few
aggregates per candidate.  Two references are linked when they share a link key (their
entry, the entry they relate to, or their tool call), so the five-way predicate is one
equi-join; result facts are reduced to counts of each outcome per key before it, and what
a candidate cites against itself is counted per key too: one number less than the other
means an outcome that is not cited.  No pair of candidate and linked fact is emitted.

Defined results: null arrays count as empty; the first failing check in the fixed order
names the category; among ids the first bad one decides; an empty batch admits nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import ACTOR_WORDS
from .facts import trimmed

#: Vocabularies and limits of a candidate.
TYPES = ("problem", "symptom", "hypothesis", "failed-attempt", "root-cause", "decision", "solution", "verification", "lesson")
STATUSES = ("observed", "inferred", "uncertain")
ACTORS = ("human", "model", "tool", "system")
ORIGINS = ("human", "injected", "delegated", "replayed-copied", "model", "tool", "system")
RESULT_KINDS = ("exit-code", "test-result")
MAX_CANDIDATES, MAX_STATEMENT, MAX_SUBJECT, MAX_SCOPE, MAX_EVIDENCE, MAX_FACTS = 64, 2048, 512, 512, 512, 256
#: The categories of a rejection.
VALUE, PROVENANCE, WORDS, DUPLICATE = "claim-value-invalid", "claim-provenance-invalid", "claim-free-text-attribution-invalid", "claim-duplicate"
REQUIRED, LIMIT, REPEATED, UNKNOWN, OVERLAP = "claim-evidence-required", "claim-evidence-limit", "claim-evidence-duplicate", "claim-evidence-unknown", "claim-evidence-overlap"
FACT_LIMIT, FACT_REPEATED, FACT_UNKNOWN = "claim-fact-limit", "claim-fact-duplicate", "claim-fact-unknown"
OUTCOME_TYPE, UNESTABLISHED, CONFLICT = "claim-outcome-type-invalid", "claim-outcome-unsupported", "claim-outcome-conflict"
POSTFLIGHT = "semantic-postflight-blocked"


def result_fact(kind: Column) -> Column:
    return kind.isin(*RESULT_KINDS)


def conflicts(claimed: Column, observed: Column) -> Column:
    """Whether an observed outcome speaks against a claimed one."""
    opposite = ((claimed == "success") & (observed == "failure")) | ((claimed == "failure") & (observed == "success"))
    return F.coalesce((claimed != "unknown") & ((observed == "unknown") | opposite), F.lit(False))


def link_keys(ordinal: Column, related: Column, call_id: Column) -> Column:
    """Keys of which two linked references share at least one."""
    entry = lambda c: F.concat(F.lit("e"), c.cast("string"))
    call = F.when(call_id != "", F.concat(F.lit("t"), call_id))
    return F.array_distinct(F.array_compact(F.array(entry(ordinal), entry(related), call)))


def _text(col: str) -> Column:
    return F.coalesce(trimmed(F.col(col)), F.lit(""))


def scalar_failure() -> Column:
    """The category of the first failing check that needs no lookup, or null."""
    size, conf = F.octet_length, F.col("confidence")
    statement, subject, scope = _text("statement"), _text("subject"), _text("scope")
    checks = (
        (~(F.col("claim_type").isin(*TYPES) & F.col("status").isin(*STATUSES)), VALUE),
        ((size(statement) == 0) | (size(statement) > MAX_STATEMENT), VALUE),
        ((size(subject) > MAX_SUBJECT) | (size(scope) > MAX_SCOPE), VALUE),
        (conf.isNull() | F.isnan(conf) | (conf < 0) | (conf > 1), VALUE),
        (~F.coalesce("attribution", F.lit("")).isin("", "unknown"), PROVENANCE),
        (statement.rlike(ACTOR_WORDS) | subject.rlike(ACTOR_WORDS) | scope.rlike(ACTOR_WORDS), WORDS),
    )
    return first_of(checks, F.lit(True))


def first_of(checks: Sequence[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    """The category of the first check that holds; a check that is null counts as ``otherwise`` (false)."""
    out = F.lit(None).cast("string")
    for check, category in reversed(checks):
        out = F.when(F.coalesce(check, F.lit(False) if otherwise is None else otherwise), category).otherwise(out)
    return out


def _ids(col: str) -> Column:
    return F.coalesce(F.col(col), F.array().cast("array<string>"))


def _first_repeat(col: str) -> Column:
    """The place of the first id that is null, empty or came before."""
    ids = _ids(col)
    places = F.transform(ids, lambda x, i: F.when(F.coalesce(x == "", F.lit(True)) | (F.array_position(ids, x) - 1 < i), i))
    return F.array_min(F.array_compact(places))


def cited(candidates: DataFrame, known: DataFrame, column: str, id_col: str) -> DataFrame:
    """(candidate_id, claimed actor and origin, place, what is known of each cited id), nulls where the selection lacks it."""
    each = candidates.select("candidate_id", "batch", F.col("actor").alias("claimed_actor"), F.col("origin").alias("claimed_origin"), F.posexplode(_ids(column)).alias("place", id_col))
    return each.join(known.withColumn("known", F.lit(True)), ["batch", id_col], "left")


def _source_check(claimed: Column, seen: Column, allowed: tuple[str, ...]) -> Column:
    """Aggregate: a claimed source must be valid and be every known source of its support, at least one."""
    known = seen.isNotNull() & ~seen.isin("", "unknown")
    claims = claimed.isNotNull() & (claimed != "")
    return F.max(claims & (~claimed.isin(*allowed) | F.coalesce(known & (seen != claimed), F.lit(False)))) | (F.max(claims) & ~F.max(F.coalesce(known & (seen == claimed), F.lit(False))))


def _unknown_at() -> Column:
    """Aggregate: the place of the first cited id that is not selected."""
    return F.min(F.when(F.col("known").isNull(), F.col("place")))


def _id_checks(col: str, limit: int, unknown_at: str, names: tuple[str, str, str]) -> list[tuple[Column, str]]:
    """Too many ids, then whichever of a repeated and an unknown id comes first."""
    repeat, unknown = _first_repeat(col), F.col(unknown_at)
    over, repeated, missing = names
    return [(F.size(_ids(col)) > limit, over), (repeat.isNotNull() & (unknown.isNull() | (repeat <= unknown)), repeated), (unknown.isNotNull(), missing)]


def judge(candidates: DataFrame, references: DataFrame, facts: DataFrame) -> DataFrame:
    """Each candidate with the category of its first failing check, or null (ADM-1 to 16)."""
    refs = references.select("batch", "evidence_id", F.col("actor").alias("seen_actor"), F.col("origin").alias("seen_origin"))
    s = cited(candidates, refs, "supporting", "evidence_id").groupBy("candidate_id").agg(
        _unknown_at().alias("s_unknown"), _source_check(F.col("claimed_actor"), F.col("seen_actor"), ACTORS).alias("bad_actor"), _source_check(F.col("claimed_origin"), F.col("seen_origin"), ORIGINS).alias("bad_origin")
    )
    c = cited(candidates, refs.select("batch", "evidence_id"), "contradicting", "evidence_id").groupBy("candidate_id").agg(_unknown_at().alias("c_unknown"))
    result = result_fact(F.col("kind"))
    has = lambda o: F.coalesce(F.max(result & (F.col("fact_outcome") == o)), F.lit(False))
    f = cited(candidates, facts.select("batch", "fact_id", "kind", F.col("outcome").alias("fact_outcome")), "fact_ids", "fact_id").groupBy("candidate_id").agg(
        _unknown_at().alias("f_unknown"), has("success").alias("f_success"), has("failure").alias("f_failure"), has("unknown").alias("f_unknown_outcome")
    )
    linked = linked_outcomes(candidates, references, facts)
    j = candidates.join(s, "candidate_id", "left").join(c, "candidate_id", "left").join(f, "candidate_id", "left").join(linked, "candidate_id", "left")
    false = lambda n: F.coalesce(F.col(n), F.lit(False))
    out, kind = F.coalesce("outcome", F.lit("")), F.col("claim_type")
    settled = F.when(out == "success", false("f_success")).when(out == "failure", false("f_failure")).when(out == "unknown", false("f_unknown_outcome") | (false("f_success") & false("f_failure"))).otherwise(F.lit(False))
    judged, observed = kind.isin("failed-attempt", "verification"), F.col("status") == "observed"
    later = [
        (F.size(_ids("supporting")) == 0, REQUIRED), *_id_checks("supporting", MAX_EVIDENCE, "s_unknown", (LIMIT, REPEATED, UNKNOWN)), *_id_checks("contradicting", MAX_EVIDENCE, "c_unknown", (LIMIT, REPEATED, UNKNOWN)),
        (F.arrays_overlap(_ids("supporting"), _ids("contradicting")), OVERLAP), *_id_checks("fact_ids", MAX_FACTS, "f_unknown", (FACT_LIMIT, FACT_REPEATED, FACT_UNKNOWN)), (false("bad_actor"), PROVENANCE), (false("bad_origin"), PROVENANCE),
        (F.when(kind == "failed-attempt", out != "failure").when(kind == "verification", ~out.isin("success", "failure", "unknown")).otherwise(out != ""), OUTCOME_TYPE),
        (judged & observed & ~settled, UNESTABLISHED), (judged & F.when(observed, false("conflict")).otherwise(false("uncited")), CONFLICT),
    ]
    placed = j.withColumn("category", F.coalesce(scalar_failure(), first_of(later)))
    return repeated_claims(placed).select("candidate_id", "batch", "ordinal", "category")


#: What of a candidate makes it one claim with an equal one of its batch.
CONTENT = ("claim_type", "statement", "status", "confidence", "supporting", "contradicting", "fact_ids", "outcome", "actor", "origin", "subject", "scope", "attribution")


def repeated_claims(judged: DataFrame) -> DataFrame:
    """Adds to sound candidates that say what an earlier sound one of their batch says that they are duplicates."""
    parts = [_text(c) if c in ("statement", "subject", "scope") else _ids(c) if c in ("supporting", "contradicting", "fact_ids") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CONTENT]
    marked = judged.withColumns({"mark": F.sha2(F.to_json(F.struct(*[p.alias(n) for n, p in zip(CONTENT, parts)])), 256), "place": F.struct("ordinal", "candidate_id")})
    first = marked.filter("category is null").groupBy("batch", "mark").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    both = marked.join(first, ["batch", "mark"], "left")
    return both.withColumn("category", F.when(F.col("category").isNull() & F.coalesce(F.col("place") > F.col("first"), F.lit(False)), DUPLICATE).otherwise(F.col("category")))


def linked_outcomes(candidates: DataFrame, references: DataFrame, facts: DataFrame) -> DataFrame:
    """Per candidate with an outcome: does a linked result fact conflict, and does one that is not cited as contradicting."""
    keys = link_keys(F.col("ordinal"), F.col("related"), F.col("call_id"))
    place = references.select("batch", "evidence_id", F.explode(keys).alias("key"))
    judged = candidates.filter(F.col("claim_type").isin("failed-attempt", "verification") & F.col("outcome").isNotNull()).select("candidate_id", "batch", F.col("outcome").alias("claimed"), "supporting", "contradicting", "fact_ids")
    cites = facts.select("batch", "fact_id", "kind", F.col("outcome").alias("observed"), F.explode("evidence_ids").alias("evidence_id"))
    of = ["candidate_id", "batch", "claimed"]
    by_evidence = judged.select(*of, F.explode(_ids("supporting")).alias("evidence_id"))
    by_fact = judged.select(*of, F.explode(_ids("fact_ids")).alias("fact_id")).join(cites.select("batch", "fact_id", "evidence_id"), ["batch", "fact_id"]).select(*of, "evidence_id")
    anchors = by_evidence.unionByName(by_fact).join(place, ["batch", "evidence_id"]).select(*of, "key").distinct()
    results = cites.filter(result_fact(F.col("kind"))).drop("kind")
    at_key = results.join(place, ["batch", "evidence_id"]).select("batch", "key", "fact_id", "observed").distinct()
    counts = at_key.groupBy("batch", "key").agg(*[F.count_if(F.col("observed") == o).alias(o) for o in ("success", "failure", "unknown")])
    against = F.when(F.col("claimed") == "success", F.col("failure") + F.col("unknown")).when(F.col("claimed") == "failure", F.col("success") + F.col("unknown")).otherwise(F.lit(0))
    met = anchors.join(counts, ["batch", "key"]).withColumn("against", against).filter("against > 0")
    owned = judged.select(*of, F.explode(_ids("contradicting")).alias("evidence_id")).join(results, ["batch", "evidence_id"]).filter(conflicts(F.col("claimed"), F.col("observed"))).select("candidate_id", "batch", "fact_id").distinct()
    cited_at = owned.join(at_key.select("batch", "key", "fact_id"), ["batch", "fact_id"]).groupBy("candidate_id", "batch", "key").agg(F.count(F.lit(1)).alias("cited"))
    both = met.join(cited_at, ["candidate_id", "batch", "key"], "left")
    return both.groupBy("candidate_id").agg(F.lit(True).alias("conflict"), F.max(F.col("against") > F.coalesce("cited", F.lit(0))).alias("uncited"))


def batches(judged: DataFrame) -> DataFrame:
    """Per batch: all or nothing, with the first failing candidate's category."""
    bad = F.col("category").isNotNull()
    each = judged.groupBy("batch").agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(bad, 1)).alias("rejected"), F.min(F.when(bad, F.struct("ordinal", "candidate_id", "category"))).alias("first"))
    over = F.col("candidates") > MAX_CANDIDATES
    return each.select("batch", "candidates", "rejected", (~over & (F.col("rejected") == 0)).alias("admitted"), F.when(over, VALUE).otherwise(F.col("first.category")).alias("category"))
