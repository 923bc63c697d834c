"""Cutting text by UTF-8 bytes without splitting a character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _continues(data: Column, at: Column) -> Column:
    """Whether the byte after the first ``at`` bytes continues a character."""
    return F.hex(F.substring(data, at + 1, F.lit(1))).rlike("^[89AB]")


def cut_length(data: Column, limit: Column) -> Column:
    """The largest length up to ``limit`` that ends at a character's border."""
    n = F.octet_length(data)
    out = limit - 3
    for back in (2, 1, 0):
        out = F.when(~_continues(data, limit - back), limit - back).otherwise(out)
    return F.when(n <= limit, n).otherwise(F.greatest(F.lit(0), out))


def cut(text: Column, limit: Column | int) -> Column:
    """``text`` within ``limit`` bytes; null stays null."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    data = text.cast("binary")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(data, F.lit(1), cut_length(data, limit)).cast("string"))
