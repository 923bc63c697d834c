import datetime as dt
import random

import pytest

from ledgerloom.operators import references as op

T = [dt.datetime(2026, m, 5) for m in range(1, 7)]


def tables(spark, seed, n=120):
    rnd = random.Random(seed)
    ids = [f"E{i}" for i in range(25)]
    pick = lambda: rnd.choice([None, "", " ", rnd.choice(ids), " e3 ", "hot", "HOT"])
    cand = [(rnd.choice([None, " ", f"c{i}", f" C{i % 7}"]), rnd.choice([None, [], [pick() for _ in range(3)]]), None, rnd.choice(T), None, rnd.choice([None, f"k{i}"])) for i in range(n)]
    seg = [(rnd.choice([*ids[:18], "hot"]).lower() if rnd.random() > 0.02 else None, rnd.choice(T), rnd.choice([None, None, None, T[4]])) for _ in range(n)]
    c = spark.createDataFrame(cand, "candidate_id string, supporting_evidence_ids array<string>, supporting_fact_ids array<string>, recorded_at timestamp, deleted_at timestamp, claim_id string")
    s = spark.createDataFrame(seg, "evidence_id string, recorded_at timestamp, deleted_at timestamp")
    return cand, seg, c, s


def brute(cand, seg):
    norm = lambda x: (x or "").strip().lower()
    first, refs, parents = {}, set(), {}
    for row in cand:
        key = norm(row[0])
        if key:
            first[key] = min(first.get(key, row[3]), row[3])
            refs |= {(key, norm(i)) for i in row[1] or [] if norm(i)}
    for i, at, gone in seg:
        if norm(i):
            p = parents.setdefault(norm(i), [at, False])
            p[0], p[1] = min(p[0], at), p[1] or gone is not None
    out = set()
    for key, i in refs:
        p = parents.get(i)
        state = "missing" if not p else "deleted" if p[1] else "late" if p[0] > first[key] else None
        if state:
            out.add((key, i, state))
    return out


FIELDS = {"supporting_evidence_ids": ("supporting_evidence_ids", "evidence")}


def test_probe_equals_brute_force(spark):
    cand, seg, c, s = tables(spark, 1)
    refs = op.exploded_refs(c, "t", "candidate_id", "recorded_at", FIELDS)
    got = op.probe(op.merge_refs(refs), op.merge_parents(op.parent_rows(s, "evidence", "evidence_id")))
    assert {(r.row_id, r.ref_id, r.state) for r in got.filter("state is not null").collect()} == brute(cand, seg)


def test_state_over_batches_in_any_order_equals_one_pass(spark, tmp_path):
    cand, seg, c, s = tables(spark, 2)
    refs = op.exploded_refs(c, "t", "candidate_id", "recorded_at", FIELDS).persist()
    parents = op.parent_rows(s, "evidence", "evidence_id").persist()
    state = op.OrphanState(spark, str(tmp_path))
    for part in (2, 0, 1, 2):  # batch 2 comes again
        state.update(refs.filter(f"abs(hash(row_id, ref_id)) % 3 = {part}"), parents.filter(f"abs(hash(ref_id, first_at)) % 3 = {part}"))
    got = {(r.row_id, r.ref_id, r.state) for r in state.current().filter("state is not null").collect()}
    assert got == brute(cand, seg)
    assert state._stored("states", 4).filter("batch = 4").count() == 0
    counts = {(r.ref_table, r.ref_field, r.period, r.state): r.n for r in state.snapshots().filter("after = 4").collect()}
    assert counts == {(r.ref_table, r.ref_field, r.period, r.state): r.n for r in op.report(state.current()).collect()}


def at(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def test_references_wait_are_resolved_and_reopened(spark, tmp_path):
    """References first, parents late, a deletion last; every batch looks at its own references only."""
    state = op.OrphanState(spark, str(tmp_path), buckets=4)
    ref = "ref_table string, row_id string, ref_field string, target string, ref_id string, seen_at timestamp"
    parent = "target string, ref_id string, first_at timestamp, deleted_at timestamp"
    none_r, none_p = at(spark, [], ref), at(spark, [], parent)
    state.update(at(spark, [("t", f"r{i}", "f", "fact", f"x{i % 50}", T[0]) for i in range(100)], ref), at(spark, [("fact", f"x{i}", T[0], None) for i in range(40)], parent))
    assert state.pending().count() == 20
    late = at(spark, [("fact", "x45", T[2], None)], parent)
    assert state.touched(none_r, late, 1).count() == 2
    state.update(none_r, late)
    assert state.pending().count() == 18 and state._stored("states", 2).filter("batch = 2").count() == 2
    gone = at(spark, [("fact", "x3", None, T[3]), ("fact", "x45", None, T[3])], parent)
    assert state.touched(none_r, gone, 2).count() == 4
    state.update(none_r, gone)
    assert {(r.row_id, r.state) for r in state.current().filter("ref_id in ('x3', 'x45')").collect()} == {(f"r{i}", "deleted") for i in (3, 53, 45, 95)}
    state.update(none_r, none_p)
    ns = {(r.after, r.state): r.n for r in state.snapshots().collect()}
    assert ns == {(1, "missing"): 20, (2, "missing"): 18, (2, "late"): 2, (3, "missing"): 18, (3, "deleted"): 4, (4, "missing"): 18, (4, "deleted"): 4}


@pytest.mark.parametrize("batches", [1, 5])
def test_folding_by_time_equals_one_pass(spark, tmp_path, batches):
    cand, seg, c, s = tables(spark, 6)
    refs, parents = op.exploded_refs(c, "t", "candidate_id", "recorded_at", FIELDS), op.parent_rows(s, "evidence", "evidence_id")
    state = op.folded(op.OrphanState(spark, str(tmp_path)), refs, parents, batches)
    assert state.version == batches and {(r.row_id, r.ref_id, r.state) for r in state.current().filter("state is not null").collect()} == brute(cand, seg)
    empty = op.folded(op.OrphanState(spark, str(tmp_path / "e")), refs.filter("false"), parents.filter("false"), 2)
    assert empty.current().count() == 0 and empty.snapshots().count() == 0


def test_timeline_adds_up(spark):
    cand, seg, c, s = tables(spark, 3)
    probed = op.probe(op.merge_refs(op.exploded_refs(c, "t", "candidate_id", "recorded_at", FIELDS)), op.merge_parents(op.parent_rows(s, "evidence", "evidence_id")))
    last = op.timeline(probed).orderBy("period").collect()[-1]
    still = probed.filter("state in ('missing', 'deleted')").count()
    assert last.open_at_end == still


def test_empty(spark):
    _, _, c, s = tables(spark, 4)
    refs = op.exploded_refs(c.filter("false"), "t", "candidate_id", "recorded_at", FIELDS)
    assert op.probe(op.merge_refs(refs), op.merge_parents(op.parent_rows(s, "evidence", "evidence_id"))).count() == 0
