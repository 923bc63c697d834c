"""Evaluation aggregates over analyses and reviews: exact counts, ranks and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decimal_text(value: Column) -> Column:
    """An exact decimal as text with trailing zeros stripped."""
    text = value.cast("decimal(38,12)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def report(cases: DataFrame) -> DataFrame:
    """One row over cases (completed, claims, tokens, latency, cost): nulls count nowhere but as cases."""
    latency, cost, tokens = F.col("latency"), F.col("cost"), F.col("tokens")
    total, n = F.sum(cost), F.count(cost)
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("completed")).alias("completed"), F.count_if(F.col("completed") & (F.col("claims") == 0)).alias("empty"), F.sum("claims").alias("claims"),
        F.count(tokens).alias("token_cases"), F.count(latency).alias("latency_cases"), F.sum(tokens).alias("tokens"), F.expr("sum(latency) div count(latency)").alias("mean_latency"),
        F.expr("percentile_disc(0.5) within group (order by latency)").cast("bigint").alias("p50_latency"), F.expr("percentile_disc(0.95) within group (order by latency)").cast("bigint").alias("p95_latency"),
        F.max(latency).alias("max_latency"), decimal_text(total).alias("total_cost"), decimal_text(F.round(total / n, 12)).alias("mean_cost"), n.alias("cost_cases"),
    )


def expectations(cases: DataFrame, claims: DataFrame, expected: DataFrame) -> DataFrame:
    """(case, kind, value, passed) of expectations on a case's claims; cases that did not complete are not evaluated."""
    seen = expected.join(cases.filter("completed").select("case"), "case")
    hits = seen.join(claims, "case", "left").groupBy("case", "kind", "value").agg(
        F.count("claim_type").alias("n"), F.count(F.when(F.col("claim_type") == F.col("value"), 1)).alias("types"), F.count(F.when(F.col("outcome") == F.col("value"), 1)).alias("outcomes")
    )
    passed = F.when(F.col("kind") == "must-be-empty", F.col("n") == 0).when(F.col("kind") == "must-include-type", F.col("types") > 0).when(F.col("kind") == "must-not-include-outcome", F.col("outcomes") == 0)
    return hits.select("case", "kind", "value", passed.alias("passed"))


#: Failures of generation after which no further case is tried.
FATAL = tuple(f"semantic-generation-{x}" for x in ("authentication-failed", "permission-denied", "rate-limited", "request-rejected", "schema-rejected", "upstream-unavailable", "transport-failed", "failed"))


def stored_failure(completed: Column, model: Column, route: Column, resolved: Column) -> Column:
    """The category of a stored run's failure, from what its details still hold.

    No answer at all is a failed transport, an answer of another model an invalid response,
    and anything later a rejected admission.
    """
    return F.when(completed, F.lit(None)).when(model.isNull(), "semantic-generation-transport-failed").when(~F.coalesce(route == resolved, F.lit(False)), "semantic-generation-response-invalid").otherwise("semantic-admission-invalid")


def until_fatal(cases: DataFrame, order: list[str]) -> DataFrame:
    """Each case as attempted or not: all after the first fatal one in order are not.

    The first fatal case is one row (a minimum), so the cases themselves are neither sorted nor gathered.
    """
    one = F.lit(1).alias("__one")
    first = cases.filter("fatal").agg(F.min(F.struct(*order)).alias("stop")).select("stop", one)
    joined = cases.select("*", one).join(F.broadcast(first), "__one", "left")
    return joined.withColumn("attempted", F.coalesce(F.struct(*order) <= F.col("stop"), F.lit(True))).drop("stop", "__one")


def scores(claims: DataFrame, reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n) over all labels and ``unreviewed``, zero where none: claims left-joined with their reviews."""
    joined = claims.join(reviews, "key", "left").select(F.coalesce("label", F.lit("unreviewed")).alias("label"))
    counts = joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def stale(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """(key, problem): reviews of unknown claims, and claims reviewed more than once."""
    unknown = reviews.join(claims, "key", "left_anti").select("key", F.lit("unknown").alias("problem")).distinct()
    twice = reviews.groupBy("key").count().filter("count > 1").select("key", F.lit("duplicate").alias("problem"))
    return unknown.unionByName(twice)
