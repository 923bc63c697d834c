"""Column helpers for ids and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as outer white space of an id or a text (Unicode White_Space, separators, BOM).
OUTER_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"
)


def stripped(col: Column | str) -> Column:
    """Without outer white space; null stays null."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(OUTER_SPACE))


def clean_id(col: Column | str) -> Column:
    """Lower case, without outer white space; a blank id becomes null."""
    value = F.lower(stripped(col))
    return F.when(F.length(value) > 0, value)


def has_text(col: Column | str) -> Column:
    """True for a text that is more than white space; never null."""
    return F.coalesce(F.length(stripped(col)) > 0, F.lit(False))


def sql_clean_id(expr: str) -> str:
    """The same as :func:`clean_id` in DuckDB SQL."""
    chars = "".join(f"chr({ord(c)})||" for c in OUTER_SPACE)[:-2]
    return f"nullif(lower(trim({expr}, {chars})), '')"


def sql_has_text(expr: str) -> str:
    chars = "".join(f"chr({ord(c)})||" for c in OUTER_SPACE)[:-2]
    return f"coalesce(length(trim({expr}, {chars})) > 0, false)"
