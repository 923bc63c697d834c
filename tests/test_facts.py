import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import identity, regexes, utf8
from ledgerloom.operators import facts as op

ENTRY = "doc string, digest string, ordinal long, kind string, actor string, related long, call_id string, tool_name string, tool_namespace string"
SEGMENT = "doc string, ordinal long, segment long, text string"
DOC, DIGEST = "synthetic@local:one", "d" * 64


def document(spark, *items):
    """Items: (kind, related, text...) of one document."""
    entries = [(DOC, DIGEST, i, kind, "model", related, None, "exec_command", None) for i, (kind, related, *_) in enumerate(items)]
    segments = [(DOC, i, k, t) for i, (_, _, *texts) in enumerate(items) for k, t in enumerate(texts)]
    return spark.createDataFrame(entries, ENTRY), spark.createDataFrame(segments, SEGMENT)


def extracted(spark, *items):
    return op.extract(*document(spark, *items)).orderBy("ordinal", F.coalesce("segment", F.lit(-1)), "step").collect()


def test_minimal_document(spark):
    got = extracted(spark, ("tool-call", None, '{"cmd":"go test ./...","yield_time_ms":30000}'), ("tool-result", 0, "Process exited with code 0\n1 passed\n"), ("message", None, "The tests should pass now."))
    assert [r.kind for r in got] == ["tool-call", "command", "test-command", "tool-result", "exit-code", "test-result"]
    assert got[4].outcome == got[5].outcome == "success" and got[5].passed == 1 and got[5].failed is None and len(got[5].evidence) == 2


def test_pinned_reference_ids(spark):
    got = extracted(spark, ("tool-call", None, '{"cmd":"go test ./..."}'))
    assert got[0].evidence == ["eref_975931f4231050ca2bd22ffadc378ea4"]
    assert got[1].evidence == ["eref_52f8d0da6eb60e0fbd7718b13a7174ca"]


@pytest.mark.parametrize("text", ['{"cmd": "x"} tail', '{"cmd": 1}', '{"cmd": ""}', '{"cmd": "a", "command": "b"}', "[]", "", "x", '{"a": "b"}'])
def test_texts_that_hold_no_command(spark, text):
    assert op._command_of(text) is None and op._command_of(None) is None


def brute_compound(command):
    quote, escaped = "", False
    for ch in command:
        if escaped:
            escaped = False
        elif ch == "\\" and quote != "'":
            escaped = True
        elif quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in ";|&\n`":
            return True
    return bool(quote) or escaped


def test_compound_commands(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab '\"\\;|&`\n$(") for _ in range(rnd.randint(0, 9))) for _ in range(1500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", op.compound(F.col("t")).alias("c")).collect()
    assert [(r.t, r.c) for r in got if r.c != brute_compound(r.t)] == []


def test_frameworks_and_outcomes(spark):
    rows = spark.createDataFrame([("pytest",), (" pytest -q",), ("pytests",), ("npm run test x",), ("go test ./... | tee x",), ("go test 'a|b'",)], "t string")
    assert [r[0] for r in rows.select(op.framework(F.col("t"))).collect()] == ["pytest", "pytest", None, "npm-test", None, "go-test"]
    cases = [("0\n3 failed", "unknown"), ("0\nFAIL: x", "unknown"), ("1", "failure"), ("0\n2 passed", "success")]
    for text, outcome in cases:
        got = extracted(spark, ("tool-call", None, '{"cmd":"pytest"}'), ("tool-result", 0, f"Process exited with code {text}"))
        assert [r.outcome for r in got if r.kind == "test-result"] == [outcome]


def test_call_after_its_result_is_not_linked(spark):
    got = extracted(spark, ("tool-result", 1, "Process exited with code 0"), ("tool-call", None, '{"cmd":"pytest"}'))
    assert "test-result" not in [r.kind for r in got]


def test_patterns_beside_other_letters(spark):
    rows = spark.createDataFrame([("é1 passed",), ("x1 passed",), ("1 passedé",), ("1 PASSED.",)], "t string")
    got = [r[0] for r in rows.select(F.regexp_extract("t", regexes.PASSED, 1)).collect()]
    assert got == ["1", "", "1", "1"]  # only ASCII letters and digits join a word


def brute_budget(texts, value_bytes, document_bytes):
    used = count = 0
    out = []
    for t in texts:
        data = t.encode()
        if count >= op.MAX_VALUES or used >= document_bytes:
            out.append("")
            continue
        data = data[: min(value_bytes, document_bytes - used)]
        emitted = data.decode("utf-8", "ignore")
        out.append(emitted)
        used, count = used + len(emitted.encode()), count + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budget_equals_a_sequential_fold(spark, seed):
    rnd = random.Random(seed)
    value_bytes, document_bytes = (64, 501) if seed % 2 else (op.MAX_VALUE_BYTES, op.MAX_DOCUMENT_BYTES)
    texts = ["".join(rnd.choice("aé漢👍") for _ in range(rnd.randint(1, 40 if seed % 2 else 900))) for _ in range(150)]
    rows = [(DOC, i, 0, 1, t) for i, t in enumerate(texts)]
    facts = op.budgeted(spark.createDataFrame(rows, "doc string, ordinal long, segment long, step int, value string"), value_bytes, op.MAX_VALUES, document_bytes)
    got = facts.orderBy("ordinal").collect()
    assert [r.emitted for r in got] == brute_budget(texts, value_bytes, document_bytes)
    segments = spark.createDataFrame([(DOC, "omitted"), (DOC, "text"), ("other", "omitted")], "doc string, segment_kind string")
    left = {r.doc: r for r in op.omissions(facts, segments).collect()}
    assert left[DOC].omitted_values == sum(r.omitted for r in got) and left[DOC].canonical_segments == 1 and left["other"].omitted_values == 0


def test_long_quoted_commands(spark):
    """A megabyte inside quotes, escapes included, costs no stack."""
    inner = "a" * 1_000_000
    rows = [(f'echo "{inner}"', False), (f"echo '{inner}'", False), ('echo "' + '\\"x' * 300_000 + '"', False), (f'echo "{inner}', True), ("\\a" * 300_000, False), ('"a" ' * 200_000 + "| x", True)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").orderBy("i").select(op.compound(F.col("t"))).collect()]
    assert got == [c for _, c in rows]


def test_constants_are_no_json():
    assert op._command_of('{"cmd": "a", "n": NaN}') is None and op._command_of('{"cmd": "a", "n": -Infinity}') is None


def test_both_forms_of_exit_lines(spark):
    text = F.lit("x\nexit code: 3\nProcess exited with code 4")
    assert [tuple(r) for r in spark.range(1).select(op.exit_code(text), op.exit_code(text, regexes.TABLE_EXIT_CODE)).collect()] == [(4, 3)]


def test_stored_facts_that_break_their_contract(spark):
    evidence = spark.createDataFrame([("e1", "d"), ("e2", "d"), ("x", "o")], "evidence_id string, doc string")
    long = "y" * 2049
    cases = [
        ("ok", "command", "r", "success", '{"command": {"text": "a"}}', ["e1", "e2"], None), ("f", None, "r", "success", "{}", ["e1"], "fields"), ("o", "k", "r", "odd", "{}", ["e1"], "outcome"), ("v", "k", "r", "unknown", "[1]", ["e1"], "value"),
        ("t", "k", "r", "unknown", '{"command": {"text": "a"}, "error": {"text": "b"}}', ["e1"], "texts"), ("s", "k", "r", "unknown", f'{{"error": {{"text": "{long}"}}}}', ["e1"], "text-size"), ("n", "k", "r", "unknown", "{}", None, "no-evidence"),
        ("r", "k", "r", "unknown", "{}", ["e1", "e1"], "repeated-evidence"), ("u", "k", "r", "unknown", "{}", ["zz"], "unknown-evidence"), ("d", "k", "r", "unknown", "{}", ["e1", "x"], "several-documents"),
    ]
    facts = spark.createDataFrame([c[:-1] for c in cases], "fact_id string, kind string, parse_rule string, outcome string, value_json string, evidence_ids array<string>")
    assert {r.fact_id: r.violation for r in op.stored_violations(facts, evidence).collect()} == {c[0]: c[-1] for c in cases if c[-1]}


def test_fact_identity_follows_from_all_its_parts(spark):
    entries, segments = document(spark, ("tool-call", None, '{"cmd":"pytest -q"}'), ("tool-result", 0, "Process exited with code 1\n2 failed"))
    entries = entries.selectExpr("*", "'k' source_kind", "'i' source_instance_id", "'n' native_id")
    segments = segments.selectExpr("*", "'tool' origin", "'high' origin_confidence", "'text' segment_kind")
    rows = op.identified(op.budgeted(op.extract(entries, segments)), entries, segments).orderBy("ordinal", "step").collect()
    assert [r.kind for r in rows] == ["tool-call", "command", "test-command", "tool-result", "exit-code", "test-result"] and len({r.fact_id for r in rows}) == 6
    mark = "".join(("{", '"scheme":"sha256-utf8-v1","digest":"', __import__("hashlib").sha256(b"pytest -q").hexdigest(), '"}'))
    assert rows[0].value_json == '{"tool":{"kind":"call","name":"exec_command"}}' and rows[4].value_json == '{"exitCode":1}'
    assert rows[2].value_json == '{"test":{"framework":"pytest","command":{"text":"pytest -q","truncated":false,"originalUtf8Bytes":9,"emittedUtf8Bytes":9,"contentHash":' + mark + "}}}"
    assert rows[5].value_json == '{"test":{"framework":"pytest","failed":2},"exitCode":1}' and [("relatedEntryOrdinal" in r) for r in rows[5].references] == [False, True]
    other = op.identified(op.budgeted(op.extract(entries, segments)), entries.withColumn("native_id", F.lit("m")), segments).collect()
    assert not {r.fact_id for r in rows} & {r.fact_id for r in other}


def test_documents_have_one_digest_however_they_are_written():
    assert identity.compact_json('{ "b" : [1, "<é>"],\n"a":null }') == '{"b":[1,"\\u003cé\\u003e"],"a":null}'
    assert identity.document_fingerprint('{"a": 1}') == identity.document_fingerprint('{"a":1}') != identity.document_fingerprint('{"a":2}')


def test_cut_never_splits_a_character(spark):
    rows = [("aé漢👍z" * 3, n) for n in range(0, 40)] + [(None, 3), ("", 0)]
    got = spark.createDataFrame(rows, "t string, n int").select("t", "n", utf8.cut(F.col("t"), F.col("n")).alias("c")).collect()
    assert all(r.c == (None if r.t is None else r.t.encode()[: r.n].decode("utf-8", "ignore")) for r in got)


def test_canonical_json(spark):
    text = "a<b>&\u2028\"\\\n\x0b\x1fé"
    rows = spark.createDataFrame([(text, None, 2.0, True)], "s string, n string, f double, b boolean")
    body = identity.record([("S", identity.string("s")), ("N", identity.string("n")), ("F", identity.number("f")), ("B", identity.boolean("b")), ("O", identity.string("n"))], optional=("O",))
    assert rows.select(body).collect()[0][0] == '{"S":"a\\u003cb\\u003e\\u0026\\u2028\\"\\\\\\n\\u000b\\u001fé","N":null,"F":2,"B":true}'


def test_fingerprint_depends_on_every_field(spark):
    base = {"v": 1, "k": "t", "st": "claim", "si": "x", "p": "{}", "refs": [("claim", "x")]}
    changed = [base | c for c in ({}, {"v": 2}, {"k": "u"}, {"st": "fact"}, {"si": "y"}, {"p": "{ }"}, {"refs": []}, {"refs": [("fact", "x")]}, {"refs": [("claim", "y")]})]
    rows = spark.createDataFrame([tuple(c.values()) for c in changed], "v int, k string, st string, si string, p string, refs array<struct<record_type:string,record_id:string>>")
    marks = [r[0] for r in rows.select(identity.event_fingerprint(*(F.col(c) for c in base))).collect()]
    assert len(set(marks)) == len(marks)
