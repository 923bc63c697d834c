"""Exactly one row of each message that was delivered at least once.

Identifiers are split by their aggregated frequency: the counts are a map-side
combined aggregate of (id, order) only, whose repeated ids are written to the shared
folder and counted.  Where they are at most ``BROADCAST_IDS`` they are broadcast: rows
of ids seen once then pass without any shuffle, and only rows of repeated ids are
ranked; where they are more, both go through a join by id.  The rank is a comparison
with the least order of the id, which the same aggregate brings, so that a hot id (a
third of all rows, say) never meets in one task.

Defined results: an id that is null or blank is no id, its rows all pass; ids are
compared in lower case without outer white space; a null in an order column comes
last; rows equal in all order columns are copies of which any one stays; an empty
input gives an empty result; further columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_id
from ..session import cut

#: Repeated ids (an id and a few order values each) that are broadcast at most.
BROADCAST_IDS = 200_000
KEY, ORDER, COPIES, FIRST = "__dedup_key", "__dedup_order", "__dedup_copies", "__dedup_first"


def _order(columns: Sequence[str]) -> Column:
    parts = []
    for i, name in enumerate(columns):
        col = F.col(f"`{name}`")
        parts += [col.isNull().alias(f"n{i}"), col.alias(f"v{i}")]
    return F.struct(*parts)


def frequencies(rows: DataFrame, id_col: str, order_cols: Sequence[str]) -> DataFrame:
    """Per clean id: its number of rows and its least order."""
    keyed = rows.select(clean_id(F.col(f"`{id_col}`")).alias(KEY), _order(order_cols).alias(ORDER))
    return keyed.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias(COPIES), F.min(ORDER).alias(FIRST))


def repeated_ids(rows: DataFrame, id_col: str, order_cols: Sequence[str]) -> tuple[DataFrame, bool]:
    """The ids that come more than once with their least order, in the shared folder, and whether they are few enough to broadcast."""
    repeated = cut(frequencies(rows, id_col, order_cols).filter(F.col(COPIES) > 1).select(KEY, FIRST))
    return repeated, repeated.count() <= BROADCAST_IDS


def _keyed(rows: DataFrame, id_col: str, order_cols: Sequence[str]) -> DataFrame:
    return rows.withColumns({KEY: clean_id(F.col(f"`{id_col}`")), ORDER: _order(order_cols)})


def keep_one(rows: DataFrame, id_col: str, order_cols: Sequence[str]) -> DataFrame:
    """The first row of each id by ``order_cols``, and every row without an id."""
    repeated, few = repeated_ids(rows, id_col, order_cols)
    side = F.broadcast if few else lambda df: df
    keyed = _keyed(rows, id_col, order_cols)
    single = keyed.join(side(repeated.select(KEY)), KEY, "left_anti")
    ranked = keyed.join(side(repeated), KEY).filter(F.col(ORDER) == F.col(FIRST)).dropDuplicates([KEY])
    own = [F.col(f"`{c}`") for c in rows.columns]
    return single.select(*own).unionByName(ranked.select(*own))


def later_copies(rows: DataFrame, id_col: str, order_cols: Sequence[str]) -> DataFrame:
    """Every row except the first of its id; rows of ids seen once are left at the probe."""
    repeated, few = repeated_ids(rows, id_col, order_cols)
    ranked = _keyed(rows, id_col, order_cols).join(F.broadcast(repeated) if few else repeated, KEY)
    return ranked.filter(F.col(ORDER) > F.col(FIRST)).select(*[F.col(f"`{c}`") for c in rows.columns])


def admit_new(stored: DataFrame, new: DataFrame, id_col: str, order_cols: Sequence[str]) -> DataFrame:
    """The rows of ``new`` to append to ``stored``: one of each id that is not stored yet."""
    known = stored.select(clean_id(F.col(f"`{id_col}`")).alias(KEY)).filter(F.col(KEY).isNotNull()).distinct()
    fresh = new.withColumn(KEY, clean_id(F.col(f"`{id_col}`"))).join(known, KEY, "left_anti").drop(KEY)
    return keep_one(fresh, id_col, order_cols)
