import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversations as op

ENTRY = "entry_id string, session_id string, ordinal long, entry_kind string, actor string, entry_ts timestamp, related_entry_ordinal long, tool_call_id string, batch_id string, recorded_at timestamp, source_kind string, clash string"
SEGMENT = "evidence_id string, entry_id string, segment_ordinal long, text string, recorded_at timestamp, deleted_at timestamp, clash string"
T0 = dt.datetime(2026, 1, 1)


def session(name, *items):
    """Items: (kind, actor, related, call id, text)."""
    entries, segments = [], []
    for i, (kind, actor, related, call, text) in enumerate(items):
        key = f"{name}-{i}"
        entries.append((key, name, i, kind, actor, T0 + dt.timedelta(seconds=30 * i), related, call, "b", T0, "desk", "x"))
        if text is not None:
            segments.append((f"ref-{key}", key, 0, text, T0, None, "y"))
    return entries, segments


ASK, SAY = ("message", " Human", None, None, "please"), ("message", "MODEL ", None, None, "done")
CALL = lambda c: ("tool-call", "model", None, c, "{}")
RESULT = lambda r, c: ("tool-result", "tool", r, c, "ok")

GOOD = {
    "plain": [ASK, SAY], "tools": [ASK, CALL("c1"), RESULT(1, "c1"), SAY], "by id": [ASK, CALL("c1"), RESULT(None, "c1"), SAY], "by place": [ASK, CALL(None), RESULT(1, None), SAY],
    "no human": [SAY], "reused id": [ASK, CALL("c"), RESULT(1, "c"), CALL("d"), RESULT(3, "d"), SAY], "related": [ASK, ("message", "model", 0, None, "x")],
}
BAD = {
    "no reply": [ASK, ASK, SAY], "end": [ASK, SAY, ASK], "blank reply": [ASK, ("message", "model", None, None, " \n")], "reasoning": [ASK, ("reasoning", "model", None, None, "x")], "no text": [("message", "model", None, None, None)],
    "late": [("message", "model", 1, None, "x"), SAY], "self": [ASK, ("message", "model", 1, None, "x")], "negative": [ASK, ("message", "model", -1, None, "x")], "lone call": [ASK, CALL("c"), SAY], "lone result": [ASK, RESULT(None, "c"), SAY],
    "both null": [ASK, CALL("c"), RESULT(1, "c"), RESULT(None, None), SAY], "disagree": [ASK, CALL("c"), CALL("d"), RESULT(1, "d"), RESULT(2, "c"), SAY], "two calls": [ASK, CALL("c"), CALL("c"), RESULT(None, "c"), RESULT(2, "c"), SAY],
    "no such call": [ASK, CALL("c"), RESULT(0, None), RESULT(1, "c"), SAY], "result first": [ASK, RESULT(2, None), CALL("c"), SAY],
}


def frames(spark, sessions, copies=0):
    entries, segments = [], []
    for name, items in sessions.items():
        e, s = session(name, *items)
        entries += e
        segments += s
    entries += [(*e[:8], "other", T0 + dt.timedelta(days=1), *e[10:]) for e in entries[:copies]]
    return spark.createDataFrame(entries, ENTRY), spark.createDataFrame(segments, SEGMENT)


@pytest.mark.parametrize("chunk", [2, 4096])
def test_cases(spark, chunk, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", chunk)
    entries, segments = frames(spark, GOOD | BAD, copies=10)
    got = {r.session_id for r in op.left_out(entries, segments).collect()}
    assert got == set(BAD)


def test_broken_ordinals_and_odd_rows(spark):
    entries, segments = frames(spark, {"a": [ASK, SAY], "b": [ASK, SAY], "c": [ASK, SAY]})
    entries = entries.withColumn("ordinal", F.when(F.col("entry_id") == "a-1", 2).when(F.col("entry_id") == "b-1", 0).otherwise(F.col("ordinal")))
    odd = spark.createDataFrame([(None, "c", 7, "message", "human", None, None, None, None, None, None, None), ("z", None, 0, "message", "human", None, None, None, None, None, None, None), ("c-2", "d", None, None, None, None, None, None, None, None, None, None)], ENTRY)
    stray = spark.createDataFrame([("q", "never came", 0, "text", T0, None, ""), (None, None, None, None, None, None, None)], SEGMENT)
    assert {r.session_id for r in op.left_out(entries.unionByName(odd), segments.unionByName(stray)).collect()} == {"a", "b", "d"}
    assert op.left_out(entries.filter("false"), segments.filter("false")).count() == 0


def brute(entries, segments):
    seen, out = {}, set()
    for e in entries:
        seen.setdefault(e[0], e)
    texts = {s[1] for s in segments if s[3].strip()}
    by = {}
    for e in seen.values():
        by.setdefault(e[1], []).append(e)
    for name, es in by.items():
        es.sort(key=lambda e: e[2])
        ok = [e[2] for e in es] == list(range(len(es))) and any(e[0] in texts for e in es)
        calls, led = {e[2]: e for e in es if e[3] == "tool-call"}, set()
        for e in es:
            actor = e[4].strip().lower()
            if actor == "human":
                rest = [x for x in es if x[2] > e[2]]
                stop = next((x[2] for x in rest if x[4].strip().lower() == "human"), 1 << 60)
                ok &= any(x[2] < stop and x[4].strip().lower() == "model" and x[3] == "message" and x[0] in texts for x in rest)
            if e[6] is not None:
                ok &= any(x[2] == e[6] and x[2] < e[2] for x in es)
            if e[3] == "tool-result":
                ways = []
                if e[6] is not None:
                    ways.append([c for c in calls if c == e[6] and c < e[2]])
                if e[7] is not None:
                    ways.append([c for c in calls if calls[c][7] == e[7] and c < e[2]])
                good = bool(ways) and all(len(w) == 1 for w in ways) and len({w[0] for w in ways}) == 1
                ok &= good
                led |= set(ways[0]) if good else set()
        if not ok or led != set(calls):
            out.add(name)
    return out


def test_random_sessions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 3)
    rnd, sessions = random.Random(11), {}
    for k in range(250):
        items = []
        for i in range(rnd.randint(1, 9)):
            kind, actor = rnd.choice([("message", "human"), ("message", "model"), ("message", "model"), ("tool-call", "model"), ("tool-result", "tool")])
            calls = [j for j, x in enumerate(items) if x[0] == "tool-call"]
            related = rnd.choice([None, i - 1, *calls]) if kind == "tool-result" and i else None
            items.append((kind, actor, related, rnd.choice([None, "c1", f"c{i}", f"c{i - 1}"]) if kind.startswith("tool") else None, rnd.choice(["x", "x", " ", "x"])))
        sessions[f"s{k}"] = items
    pairs = [session(n, *items) for n, items in sessions.items()]
    entries, segments = [e for p in pairs for e in p[0]], [s for p in pairs for s in p[1]]
    got = {r.session_id for r in op.left_out(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(segments, SEGMENT)).collect()}
    assert got == brute(entries, segments) and 0 < len(got) < 250


def test_conversations_are_ordered_with_roles_and_episodes(spark):
    items = [ASK, CALL("c1"), RESULT(1, "c1"), SAY] + [ASK, SAY] * 30
    entries, segments = frames(spark, {"a": items, "bad": BAD["end"]}, copies=5)
    entries = entries.withColumn("entry_ts", F.when(F.col("ordinal") >= 40, F.col("entry_ts") + F.expr("interval 10 days")).otherwise(F.col("entry_ts")))
    got = op.conversations(entries, segments).orderBy("turn").collect()
    assert [r.turn for r in got] == list(range(64)) and {r.session_id for r in got} == {"a"}
    assert [r.role for r in got[:4]] == ["user", "assistant", "tool", "assistant"] and got[0].text == "please"
    assert [r.episode for r in got] == [0] * 40 + [1] * 24


@pytest.mark.parametrize("chunk", [4, 4096])
def test_pauses_cross_chunks_and_messages_without_a_time(spark, chunk, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", chunk)
    entries, segments = frames(spark, {"a": [ASK, SAY] * 50})
    late = sum((F.when(F.col("ordinal") >= at, 1).otherwise(0) for at in (8, 30, 51)), F.lit(0))  # at a border, after two without a time, after a whole chunk without
    at = F.expr("timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, 0, ordinal * 30)") + late * F.expr("interval 10 minutes")
    entries = entries.withColumn("entry_ts", F.when(F.col("ordinal").isin(28, 29, *range(44, 51)), None).otherwise(at))
    # of 30 s pauses the limit is 120 s, and 600 s are more
    got = {r.turn: r.episode for r in op.conversations(entries, segments).collect()}
    assert got == {i: (i >= 8) + (i >= 30) + (i >= 51) for i in range(100)}


def test_roles_follow_from_the_kind_where_the_actor_tells_none(spark):
    rows = [("a", "s", 0, "message", "human"), ("b", "s", 1, "reasoning", None), ("c", "s", 2, "message", " Model "), ("d", "s", 3, "context", "robot"), ("e", "s", 4, "message", "robot")]
    entries = spark.createDataFrame([(e, s, o, k, a, None, None, None, "src", None, "b") for e, s, o, k, a in rows], "entry_id string, session_id string, ordinal long, entry_kind string, actor string, entry_ts timestamp, related_entry_ordinal long, tool_call_id string, source_kind string, recorded_at timestamp, batch_id string")
    segments = spark.createDataFrame([(f"v{e}", e, 0, "text", None, None) for e, *_ in rows], "evidence_id string, entry_id string, segment_ordinal long, text string, recorded_at timestamp, deleted_at timestamp")
    got = {r.entry_id: r.role for r in op.conversations(entries, segments).collect()}
    assert got == {"a": "user", "b": "assistant", "c": "assistant", "d": "system", "e": "unknown"}
