import random

from ledgerloom.operators import dedup

SCHEMA = "delivery long, id string, at long, __dedup_key string"


def brute(rows, order):
    """One row of each id, every row without an id."""
    kept, best = [], {}
    for r in rows:
        key = (r[1] or "").strip().lower()
        if not key:
            kept.append(r)
        elif key not in best or order(r) < order(best[key]):
            best[key] = r
    return sorted(map(str, kept + list(best.values())))


def order(r):
    return (r[2] is None, r[2] or 0, r[0])


def rows_of(seed, n=400):
    rnd = random.Random(seed)
    return [(i, rnd.choice([None, "", " ", "a", "A ", "\tb\n", "hot", "hot", "hot", f"x{i}"]), rnd.choice([None, 1, 2, 3]), "c") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "delivery long, id string, at long, clash string").withColumnRenamed("clash", "n")


def test_keep_one_and_later_copies(spark):
    rows = rows_of(1)
    df = frame(spark, rows)
    kept = sorted(str(tuple(r)) for r in dedup.keep_one(df, "id", ["at", "delivery"]).collect())
    assert kept == brute(rows, order)
    rest = {r[0] for r in dedup.later_copies(df, "id", ["at", "delivery"]).collect()}
    assert rest == {r[0] for r in rows} - {eval(k)[0] for k in kept}


def test_both_ways_agree_and_singles_are_not_shuffled(spark, monkeypatch):
    df = frame(spark, rows_of(5))
    few = dedup.keep_one(df, "id", ["at", "delivery"])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(dedup, "BROADCAST_IDS", 0)
    many = dedup.keep_one(df, "id", ["at", "delivery"])
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert dedup.later_copies(df, "id", ["at", "delivery"]).count() == df.count() - few.count()


def test_identical_rows_and_empty(spark):
    rows = [(1, "a", 1, "x")] * 5 + [(2, None, 1, "x")] * 2
    assert dedup.keep_one(frame(spark, rows), "id", ["at"]).count() == 3
    assert dedup.keep_one(frame(spark, rows).filter("false"), "id", ["at"]).count() == 0


def test_new_batches_add_only_unseen_ids(spark):
    old, new = rows_of(2, 100), [(1000 + i, *r[1:]) for i, r in enumerate(rows_of(3, 100))]
    stored = dedup.keep_one(frame(spark, old), "id", ["at", "delivery"])
    added = dedup.admit_new(stored, frame(spark, new), "id", ["at", "delivery"]).collect()
    known = {(r[1] or "").strip().lower() for r in old}
    expected = brute([r for r in new if not (r[1] or "").strip() or (r[1] or "").strip().lower() not in known], order)
    assert sorted(str(tuple(r)) for r in added) == expected


def test_stream_equals_batch(spark, tmp_path):
    from ledgerloom.streaming import sinks

    rows = rows_of(4, 120)
    for k in range(3):
        frame(spark, rows[k * 40 : k * 40 + 40]).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = sinks.deduplicated_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "id", ["at", "delivery"])
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    ids = [(r["id"] or "").strip().lower() for r in got.collect()]
    named = [i for i in ids if i]
    assert len(named) == len(set(named)) == len({(r[1] or "").strip().lower() for r in rows} - {""})
    assert ids.count("") == sum(not (r[1] or "").strip() for r in rows)
