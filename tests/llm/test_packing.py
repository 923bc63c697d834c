import random

import pytest

from ledgerloom.llm import packing


def brute(runs, counts):
    """Container of each text by (size, rank)."""
    placed = {}
    for size, rank, n, first, each in runs:
        for k in range(n):
            assert (size, rank + k) not in placed
            placed[size, rank + k] = first + k // each
    assert set(placed) == {(s, r) for s, c in counts.items() if s for r in range(c)}
    return placed


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_each_text_once_within_capacity(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([16, 100, 2048])
    counts = {}
    for _ in range(rnd.randint(0, 3000)):
        s = min(cap, max(1, int(rnd.expovariate(3 / cap)))) if seed % 2 else rnd.randint(1, cap)
        counts[s] = counts.get(s, 0) + 1
    runs, opened = packing.plan_runs(counts, cap)
    fill = {}
    for (size, _), c in brute(runs, counts).items():
        fill[c] = fill.get(c, 0) + size
    assert all(v <= cap for v in fill.values()) and len(fill) <= opened
    total = sum(s * c for s, c in counts.items())
    if seed % 2 and total > 20 * cap:
        assert len(fill) <= 1.03 * total / cap + 1


def test_plan_is_small_for_many_texts():
    counts = {s: 10**9 // s for s in range(1, 2049)}
    runs, opened = packing.plan_runs(counts, 2048)
    assert len(runs) < 200_000
    assert opened <= 1.01 * sum(s * c for s, c in counts.items()) / 2048


def test_one_hot_size():
    runs, opened = packing.plan_runs({7: 10**8}, 2048)
    assert opened == -(-(10**8) // (2048 // 7)) and len(runs) < 1000


def test_packed_cuts_only_oversized(spark):
    rows = [(i, n) for i, n in enumerate([0, 0, 1, 10, 10, 10, 16, 17, 40, 5, 6])]
    got = packing.packed(spark.createDataFrame(rows, "id long, n_tokens long"), "id", 16).toPandas()
    assert got.groupby("container").n_tokens.sum().max() <= 16
    assert got.groupby("id").n_tokens.sum().to_dict() == dict(rows)
    parts = got.groupby("id").size().to_dict()
    assert all((parts[i] > 1) == (n > 16) for i, n in rows)
    assert (got[got.n_tokens == 0].container == 0).all()
    empty = packing.packed(spark.createDataFrame([], "id long, n_tokens long"), "id", 16)
    assert empty.count() == 0


def test_many_buckets_of_one_size_and_fill(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_TEXTS", 10)
    rows = [(i % 700, 5 if i % 3 else 7) for i in range(2000)]  # repeated keys
    got = packing.packed(spark.createDataFrame(rows, "id long, n_tokens long"), "id", 20)
    filled = got.groupBy("container").sum("n_tokens").toPandas()["sum(n_tokens)"]
    assert filled.max() <= 20 and filled.sum() == sum(n for _, n in rows) and got.count() == 2000
    row = packing.fill(got, 20).first()
    assert (row.n_pieces, row.n_tokens, row.containers, row.fullest) == (2000, filled.sum(), len(filled), filled.max())
    assert row.least_containers <= row.containers <= 667
    assert packing.fill(got.filter("false"), 20).first().containers == 0
