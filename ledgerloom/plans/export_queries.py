"""Queries of ingestion (SRC, VAL) over the raw export lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import exports


def _records(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "session_exports").select(F.col("export_id").alias("doc"), "line_no", "record_json")
    return exports.read_records(lines)


def val_records(spark: SparkSession, d: str) -> DataFrame:
    """VAL-1 to 5, 7 to 9, 12, 13: records by the first check they fail on their own."""
    return _records(spark, d).groupBy("record_type", "category").agg(F.count(F.lit(1)).alias("n"))


def val_documents(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4, VAL-6 to 11: documents by their first violation."""
    return exports.judge(_records(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def src_documents(spark: SparkSession, d: str) -> DataFrame:
    """The accepted documents' records."""
    return exports.accepted(_records(spark, d)).groupBy("doc").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.when(F.col("record_type") == "entry", F.col("n_bytes"))), F.lit(0)).alias("text_bytes"))


def src_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC-7: a filtered, pruned scan of the lines of each export."""
    return table(spark, d, "session_exports").filter("line_no >= 1 and record_json is not null").groupBy("export_id").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"))


ORACLE = {"src_lines": "select export_id, count(*) n, max(line_no) \"last\" from session_exports where line_no >= 1 and record_json is not null group by 1"}
QUERIES = {f.__name__: f for f in (val_records, val_documents, src_documents, src_lines)}
