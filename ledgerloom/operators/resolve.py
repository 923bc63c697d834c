"""Stored references resolved against the evidence they name.

A record's references are exploded in order, the first of each id is kept, and each is
joined with the evidence of the same revision.  One mismatch fails the record as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import utf8

MAX_TEXT = 8192


def cited(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, place, evidence_id): the ids of the given array columns one after the other, the first of each id."""
    ids = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])
    each = rows.select(key, "doc", F.posexplode(ids).alias("place", "evidence_id"))
    return each.groupBy(key, "doc", "evidence_id").agg(F.min("place").alias("place"))


def resolve(rows: DataFrame, key: str, columns: Sequence[str], evidence: DataFrame) -> DataFrame:
    """(key, place, evidence_id, text, truncated) of the records of which every reference resolves."""
    found = cited(rows, key, columns).join(evidence.select("doc", "evidence_id", "text", F.lit(True).alias("there")), ["doc", "evidence_id"], "left")
    failed = found.filter("there is null").select(key).distinct()
    whole = found.join(failed, key, "left_anti")
    return whole.select(key, "place", "evidence_id", utf8.cut(F.col("text"), MAX_TEXT).alias("text"), F.coalesce(F.octet_length("text") > MAX_TEXT, F.lit(False)).alias("truncated"))


def unresolved(rows: DataFrame, key: str, columns: Sequence[str], evidence: DataFrame) -> DataFrame:
    """(key, missing): records that do not resolve, with the number of ids that fail."""
    return cited(rows, key, columns).join(evidence.select("doc", "evidence_id"), ["doc", "evidence_id"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("missing"))


def reference_problems(rows: DataFrame, key: str, column: str, evidence: DataFrame) -> DataFrame:
    """(key, cited, problem): each record's references against the stored evidence, by the first problem any of them has (RES-1, 3, 4).

    ``evidence``: (evidence_id, doc, digest, content_hash, text), digest null where the entry
    is not there.  The problems in order: an unknown id, references of several documents, an
    entry that is not there, content that is not the one referred to.
    """
    ids = F.array_distinct(F.coalesce(F.col(column), F.array().cast("array<string>")))
    each = rows.select(key, F.explode(ids).alias("evidence_id")).join(evidence.select("evidence_id", "doc", "digest", F.col("content_hash").eqNullSafe(F.sha2("text", 256)).alias("same")), "evidence_id", "left")
    held = each.groupBy(key).agg(
        F.count(F.lit(1)).alias("cited"), F.max(F.col("doc").isNull()).alias("unknown"), F.min("doc").alias("low"), F.max("doc").alias("high"), F.max(F.col("digest").isNull()).alias("gone"), F.max(~F.coalesce("same", F.lit(False))).alias("changed")
    )
    problem = F.when(F.col("unknown"), "unknown").when(F.col("low") != F.col("high"), "several-documents").when(F.col("gone"), "no-entry").when(F.col("changed"), "content")
    return held.select(key, "cited", problem.alias("problem"))
