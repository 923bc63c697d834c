"""Checks of stored records against each other: claim analyses with their claims and events, failed runs, lineage.

Each check is a few aggregates per analysis and their joins, so an analysis with very many
rows costs partial aggregates only.  A record's first broken rule, in fixed order, is its
problem; null means it is sound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.regexes import HEX_DIGEST
from .events import ANALYSIS_COMPLETED, CLAIM_ADMITTED


def schema_problems(spark: SparkSession, path: str, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """(table_name, column_name, present) of every column the store must have (STO-17); a table that cannot be read lacks them all."""
    rows = []
    for name, columns in required.items():
        try:
            held = set(spark.read.parquet(f"{path}/{name}.parquet").columns)
        except Exception:  # noqa: BLE001 - the reader's error class differs by file system
            held = set()
        rows += [(name, c, c in held) for c in columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, present boolean")


def completed_records(analyses: DataFrame, claims: DataFrame, events: DataFrame) -> DataFrame:
    """(analysis_id, problem) of completed analyses (STO-18).

    ``claims``: (claim_id, analysis_id, ordinal); ``events``: (event_type, subject_id, payload_json, refs).
    The rules in order: each admitted claim has one event of its own; that event names the
    analysis first; the analysis has one completion event; it names the claims in order.
    """
    own = claims.groupBy("claim_id", "analysis_id").agg(F.min("ordinal").alias("ordinal"))
    told = events.filter(F.col("event_type") == CLAIM_ADMITTED).groupBy(F.col("subject_id").alias("claim_id")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(F.get(F.col("refs"), F.lit(0))["record_id"]).alias("first_ref"), F.min(F.get_json_object("payload_json", "$.analysisId")).alias("told_analysis")
    )
    each = own.join(told, "claim_id", "left").groupBy("analysis_id").agg(
        F.max(F.coalesce(F.col("n_events") != 1, F.lit(True))).alias("unmatched"), F.max(~F.coalesce((F.col("first_ref") == F.col("analysis_id")) & (F.col("told_analysis") == F.col("analysis_id")), F.lit(False))).alias("elsewhere"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "claim_id"))), lambda x: x["claim_id"]).alias("claim_ids"),  # an analysis admits at most 64
    )
    done = events.filter(F.col("event_type") == ANALYSIS_COMPLETED).groupBy(F.col("subject_id").alias("analysis_id")).agg(F.count(F.lit(1)).alias("n_done"), F.min(F.transform("refs", lambda r: r["record_id"])).alias("done_ids"))
    j = analyses.select("analysis_id").join(each, "analysis_id", "left").join(done, "analysis_id", "left")
    none = F.array().cast("array<string>")
    problem = (
        F.when(F.coalesce("unmatched", F.lit(False)), "claim-event").when(F.coalesce("elsewhere", F.lit(False)), "claim-event-analysis").when(F.coalesce(F.col("n_done") != 1, F.lit(True)), "completion-event")
        .when(F.coalesce("claim_ids", none) != F.coalesce("done_ids", none), "completion-claims")
    )
    return j.select("analysis_id", problem.alias("problem"))


def failed_records(analyses: DataFrame, claims: DataFrame, events: DataFrame) -> DataFrame:
    """(analysis_id, problem) of failed analyses (STO-19): nothing admitted, no events, and lineage only as far as it was reached."""
    held = claims.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("claims"))
    told = events.groupBy(F.col("subject_id").alias("analysis_id")).agg(F.count(F.lit(1)).alias("events"))
    j = analyses.join(held, "analysis_id", "left").join(told, "analysis_id", "left")
    given = lambda c: F.json_object_keys(c).isNotNull()
    problem = (
        F.when(F.coalesce("claims", F.lit(0)) > 0, "admitted-claims").when(F.coalesce("events", F.lit(0)) > 0, "events").when(given("semantic_selection_json") & ~given("privacy_report_json"), "selection-without-policy")
        .when(given("model_json") & ~given("semantic_selection_json"), "model-without-selection")
    )
    return j.select("analysis_id", problem.alias("problem"))


def lineage(analyses: DataFrame) -> DataFrame:
    """(analysis_id, problem) by the first gap in the base lineage (STO-20)."""
    route = F.from_json("model_json", "requestedRoute struct<" + ",".join(f"{f}:string" for f in identity.ROUTE_FIELDS) + ">")["requestedRoute"]
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    problem = (
        F.when(blank(F.col("session_id")), "source").when(blank(F.col("schema_name")), "schema-name").when(F.coalesce(F.col("schema_version") < 1, F.lit(True)), "schema-version")
        .when(~F.coalesce(F.col("schema_digest").rlike(HEX_DIGEST), F.lit(False)), "schema-digest").when(F.json_object_keys("model_json").isNull(), "model").when(route.isNull() | blank(route["alias"]), "route").when(F.col("recorded_at").isNull(), "time")
    )
    return analyses.select("analysis_id", problem.alias("problem"))


def tampered_events(events: DataFrame) -> DataFrame:
    """(event_id, problem): events whose fingerprint or id does not follow from their content (STO-21).

    The payload is brought to canonical form first: compact, its keys in order.
    """
    held = F.from_json("payload_json", "analysisId string, claimId string, claimIds array<string>")
    claim = identity.record([("analysisId", identity.string(held["analysisId"])), ("claimId", identity.string(held["claimId"]))])
    done = identity.record([("analysisId", identity.string(held["analysisId"])), ("claimIds", identity.strings(held["claimIds"]))])
    payload = F.when(F.col("event_type") == CLAIM_ADMITTED, claim).otherwise(done)
    mark = identity.event_fingerprint(*(F.col(c) for c in ("schema_version", "event_type", "subject_type", "subject_id")), payload, F.col("refs"))
    problem = F.when(~F.coalesce(mark == F.col("fingerprint"), F.lit(False)), "fingerprint").when(~F.coalesce(identity.derived_id("evt_", F.col("fingerprint")) == F.col("event_id"), F.lit(False)), "id")
    return events.select("event_id", problem.alias("problem"))
