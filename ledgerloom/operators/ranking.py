"""Ranks within groups of any size.

A window over a group that holds a third of all rows would be one task.  Here the order
column is cut into chunks, ranks are counted within a chunk and the counts of the chunks
before are added; only one row per chunk meets per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHUNK = 4096


def ranked(rows: DataFrame, keys: Sequence[str], order: str, name: str, ties: Sequence[str] = (), counted: Column | None = None) -> DataFrame:
    """Adds ``name``: how many counted rows of the group come before the row (by whole-number ``order``, then ``ties``)."""
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    cut = rows.withColumn("__chunk", F.floor(F.col(order) / CHUNK)).withColumn("__one", one)
    sums = cut.groupBy(*keys, "__chunk").agg(F.sum("__one").alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(*keys, "__chunk", F.coalesce(before, F.lit(0)).alias("__offset"))
    inner = F.sum("__one").over(W.partitionBy(*keys, "__chunk").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1))
    joined = cut.withColumn("__inner", F.coalesce(inner, F.lit(0))).join(offsets, [*keys, "__chunk"])
    return joined.withColumn(name, F.col("__offset") + F.col("__inner")).drop("__chunk", "__one", "__offset", "__inner")
