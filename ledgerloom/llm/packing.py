"""Texts assigned to containers of a fixed number of tokens, balanced by cost.

A text's cost is linear plus quadratic in its tokens (attention).  Texts go in
descending size to the container of the lowest cost that has room; the number of
containers starts at the least possible, and one is opened where none has room.

Sizes are whole numbers up to the capacity, so the assignment is planned on the
histogram of sizes (at most ``capacity`` counts, whatever the number of texts):
containers with the same content so far are one group, and a size class is dealt to
whole groups at a time.  The plan is a list of runs "texts of rank a..b of size s go
to containers c..": each text finds its run by its rank in its size class.  Ranks come
from counts per (size, hash bucket), with as many buckets as the size's count asks for,
so a size that a third of all texts have is ranked in many tasks.

Defined results: a text larger than the capacity is cut into full containers and a
rest, and only such a text is cut; null and empty texts (no tokens) go to container 0
and take no room; equal texts are separate items; ties go by key.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from .bpe import encoded

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Texts of one size that are ranked in one task, on average.
BUCKET_TEXTS = 100_000


def cost(size: int) -> float:
    return LINEAR * size + QUADRATIC * size * size


def plan_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, texts, first container, texts per container) and the number of containers.

    A group is (cost, room, first container, number of containers); groups split when a size
    class ends within them.  Work and runs depend on the sizes, not on the number of texts.
    """
    total = sum(s * c for s, c in counts.items())
    opened = -(-total // capacity) if total else 0
    heaps: dict[int, list] = {}  # by room, each a heap of (cost, first, number)
    rooms: list[int] = []

    def put(room: int, group: tuple[float, int, int]) -> None:
        if room not in heaps:
            heaps[room] = []
            bisect.insort(rooms, room)
        heapq.heappush(heaps[room], group)

    def lowest(size: int) -> int | None:
        best = None
        for room in rooms[bisect.bisect_left(rooms, size) :]:
            if best is None or heaps[room][0] < heaps[best][0]:
                best = room
        return best

    if opened:
        put(capacity, (0.0, 0, opened))
    runs = []
    for size in sorted((s for s in counts if s > 0), reverse=True):
        left, rank, one = counts[size], 0, cost(size)
        while left:
            room = lowest(size)
            if room is None:
                per = capacity // size
                number = max(1, left // per)
                put(capacity, (0.0, opened, number))
                opened += number
                continue
            group_cost, first, number = heapq.heappop(heaps[room])
            if not heaps[room]:
                del heaps[room]
                rooms.pop(bisect.bisect_left(rooms, room))
            rival = lowest(size)
            ahead = (heaps[rival][0][0] - group_cost) / one if rival is not None else room // size
            each = max(1, min(room // size, int(ahead) + 1, left // number or 1))
            filled = min(number, left // each)
            if filled < number:
                put(room, (group_cost, first + filled, number - filled))
            runs.append((size, rank, filled * each, first, each))
            put(room - size * each, (group_cost + one * each, first, filled))
            rank += filled * each
            left -= filled * each
    return runs, opened


def sized_pieces(sizes: DataFrame, key_col: str, capacity: int) -> DataFrame:
    """(key, piece, first_token, n_tokens): a text as one piece, or cut where it exceeds the capacity."""
    n = F.col("n_tokens")
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(n / capacity) - 1))
    each = sizes.select(F.col(f"`{key_col}`"), n, F.explode(pieces).alias("piece"))
    start = F.col("piece") * capacity
    return each.select(F.col(f"`{key_col}`"), "piece", start.alias("first_token"), F.least(n - start, F.lit(capacity)).alias("n_tokens"))


def packed(sizes: DataFrame, key_col: str, capacity: int) -> DataFrame:
    """(key, piece, first_token, n_tokens, container) for every text.  ``sizes`` is (key, n_tokens), read three times."""
    spark = sizes.sparkSession
    pieces = sized_pieces(sizes, key_col, capacity)
    counts = {r[0]: r[1] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1))).collect()}  # at most capacity + 1 rows
    runs, _ = plan_runs(counts, capacity)
    by_size: dict[int, list] = {}
    for size, rank, _, first, each in runs:
        by_size.setdefault(size, []).append((rank, first, each))
    shared = spark.sparkContext.broadcast({s: np.array(v, dtype=np.int64) for s, v in by_size.items()})  # grows with the sizes, not with the texts
    split = spark.createDataFrame([(s, -(-c // BUCKET_TEXTS)) for s, c in counts.items()], "n_tokens long, __buckets long")
    key = F.col(f"`{key_col}`")
    placed = pieces.join(F.broadcast(split), "n_tokens").withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), "__buckets")).drop("__buckets")
    held = placed.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy("n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = held.select("n_tokens", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    place = F.row_number().over(W.partitionBy("n_tokens", "bucket").orderBy(key, "piece")) - 1
    ranked = placed.withColumn("place", place).join(offsets, ["n_tokens", "bucket"])
    ranked = ranked.select(key, "piece", "first_token", "n_tokens", (F.col("place") + F.col("offset")).alias("rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs_ = shared.value
        for pdf in batches:
            container = np.zeros(len(pdf), dtype=np.int64)
            for size, rows in pdf.groupby("n_tokens").indices.items():
                if size > 0:
                    rank, table = pdf["rank"].to_numpy()[rows], runs_[size]
                    at = np.searchsorted(table[:, 0], rank, side="right") - 1
                    container[rows] = table[at, 1] + (rank - table[at, 0]) // table[at, 2]
            yield pdf[[key_col, "piece", "first_token", "n_tokens"]].assign(container=container)

    kind = sizes.schema[key_col].dataType.simpleString()
    return ranked.mapInPandas(run, f"`{key_col}` {kind}, piece long, first_token long, n_tokens long, container long")


def fill(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: texts' pieces, tokens, containers used, the least number any packing needs, and the share left unused."""
    each = placed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    held = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.count(F.when(F.col("t") > 0, 1)).alias("containers"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"))
    return held.select("*", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), F.when(F.col("containers") > 0, 1 - F.col("n_tokens") / (F.col("containers") * capacity)).alias("unused_share"))


def pack_texts(texts: DataFrame, key_col: str, text_col: str, capacity: int, vocabulary: str | None = None) -> DataFrame:
    """Tokenise once (the sizes are checkpointed in the shared folder), then pack."""
    return packed(cut(encoded(texts, key_col, text_col, vocabulary, sizes_only=True)), key_col, capacity)
