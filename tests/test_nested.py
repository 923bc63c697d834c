import json

from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.operators import nested

ROWS = [
    (1, '{"entry": {"content": [{"kind": "text"}, null, "{\\"kind\\": \\"x\\"}", [], {}]}}'),
    (2, '\ufeff {"entry": {"content": {"kind": "text"}}}\r\n'),
    (3, '{"entry": {"content": "[{\\"a\\": {\\"b\\": 1}}, null, {}]"}}'),
    (4, '{"snapshot": {"selection": {"mode": "full"}}}'),
    (5, '{"snapshot": {"selection": {}}}'),
    (6, '{"snapshot": {"selection": "{\\"mode\\": \\"full\\"}"}}'),
    (7, '{"entry": {"content": [{"kind": "text"}]}'), (8, '{"entry": {"content": [{}]}} tail'), (9, "[]"), (10, "null"), (11, None), (12, ""), (13, '{"entry": {"content": null}}'),
    (14, '{"entry": 5, "snapshot": []}'), (15, '{"entry": {"content": [{"n": NaN}]}}'), (16, '{"a": 1, "entry": {"content": []}, "entry": {"content": [{}]}}'),
    (16, '{"a": 1, "entry": {"content": []}, "entry": {"content": [{}]}}'), (17, "[" * 5000),
]
MODELS = [("m1", '{"x": 1}'), ("m2", "{}"), ("m3", None), ("m4", '"{\\"x\\": 1}"'), ("m5", "unavailable"), ("m6", "[1]"), ("m7", '"\\"{}\\""')]


def written(exports, models, path):
    nested.write_tables(nested.emitted(exports, models), str(path))
    return sorted(tuple(r) for r in nested.children(exports.sparkSession, str(path)).collect())


def test_children(spark, tmp_path):
    exports = spark.createDataFrame(ROWS, "line_id long, record_json string").selectExpr("*", "'c' as tag", "1 as pos")
    models = spark.createDataFrame(MODELS, "analysis_id string, model_json string")
    got = written(exports, models, tmp_path / "a")
    segments = [("1", 0), ("1", 2), ("1", 4), ("2", 0), ("3", 0), ("3", 2), ("16", 0), ("16", 0)]
    assert got == sorted([(p, "segment", k) for p, k in segments] + [("4", "selection", 0), ("6", "selection", 0), ("m1", "model", 0), ("m4", "model", 0)])
    assert written(exports.filter("false"), models.filter("false"), tmp_path / "b") == []


def test_every_row_keeps_its_parent_and_nothing_is_lost():
    value = {"a": 1, "b": {"c": [{"d": 1, "e": [{"f": None}, 3]}, {"d": 2}], "g": "x"}, "h": ["y", "z"]}
    rows = list(nested.visit("r", "7", json.dumps(value), frozenset()))
    keys = {r[1] for r in rows}
    assert all(r[2] is None or r[2] in keys for r in rows) and len(keys) == len(rows)
    assert [r[0] for r in rows] == ["r", "r.b", "r.b.c", "r.b.c.e", "r.b.c.e", "r.b.c", "r.h", "r.h"]
    assert json.loads(rows[3][6]) == {"f": None} and json.loads(rows[4][6]) == {"value": 3}


def test_keys_and_tags_do_not_collide():
    rows = list(nested.visit("r", "1", '{"a/b": {"x": 1}, "a": {"b": {"x": 2}}, "a.b": {}, "~1": {}, "a~1b": {}, "n": [], "m": [null, {}, []]}', frozenset()))
    assert len({r[1] for r in rows}) == len(rows) and len({(r[0], r[1]) for r in rows if r[0] != "r.m"}) == len({r[0] for r in rows if r[0] != "r.m"})
    assert {(r[4], r[5], r[6]) for r in rows if r[0] == "r.m"} == {(0, None, '{"value": null}'), (1, 0, "{}")}
    assert json.loads(rows[0][6]) == {"n": []}


def test_very_deep_records_and_long_numbers():
    depth = 20_000
    text = '{"a":' * depth + '{"b": [1, "x", {"c": -2.5e1}, true, null, {}]}' + "}" * depth
    rows = list(nested.visit("r", "1", text, frozenset()))
    keys = {r[1] for r in rows}
    assert len(rows) == depth + 1 + 6 == len(keys) and all(r[2] in keys for r in rows[1:]) and max(map(len, keys)) < 1100
    assert [json.loads(r[6]) for r in rows[-6:]] == [{"value": 1}, {"value": "x"}, {"c": -25.0}, {"value": True}, {"value": None}, {}]
    assert len({r[0] for r in rows}) <= nested.DEEP + 3
    for bad in ("[" * 20_000, "[" * 20_000 + "]" * 19_999, '{"a":' * 20_000 + "1" + "}" * 20_000 + "x", "[1 2]" * 3):
        assert nested.decoded(bad) is None
    assert nested.decoded("[" * 20_000 + "]" * 20_000) is not None
    assert json.loads(next(nested.visit("r", "1", '{"n": ' + "7" * 5000 + "}", frozenset()))[6]) == {"n": "7" * 5000}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
def test_both_decoders_agree(value):
    text = json.dumps(value)
    assert nested._deep_value(text) == (value, len(text)) and nested.decoded(text) == value


def test_tables_by_tag(spark, tmp_path):
    rows = spark.createDataFrame(ROWS[:6], "line_id long, record_json string")
    emitted = nested.flatten(rows, "line_id", "record_json", "record", nested.EXPORT_CONTAINERS)
    nested.write_tables(emitted, str(tmp_path / "t"))
    table = nested.read_table(spark, str(tmp_path / "t"), "record.snapshot.selection", "mode string")
    assert sorted((r.root_key, r.mode) for r in table.collect()) == [("4", "full"), ("5", None), ("6", "full")]
    plan = table._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tag" in plan
