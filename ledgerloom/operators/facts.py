"""Deterministic facts from tool calls and their results.

``entries``: (doc, digest, ordinal, kind, actor, related, call_id, tool_name, tool_namespace);
``segments``: (doc, ordinal, segment, text).  Facts come in emission order: by entry,
then for a call tool-call, command, test-command, for a result tool-result and per
segment exit-code, test-result, error-output.

Texts have a budget per document (values and bytes, in emission order).  Only the first
``MAX_VALUES`` texts of a document can get any of it, so a limited rank picks these
before anything is gathered: a document with a third of all rows gathers no more than
any other.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import identity as idn
from ..functions import regexes, utf8
from ..functions.identity import evidence_id, number, record, string

#: Limits of extracted text, tools that take a command, and test commands by prefix in order.
MAX_VALUE_BYTES, MAX_VALUES, MAX_DOCUMENT_BYTES = 2048, 128, 65536
#: The extractor's name, version and schema version.
EXTRACTOR = ("sessions-deterministic-facts", "1", 1)
COMMAND_TOOLS = ("exec_command", "shell_command", "run_command", "terminal")
TEST_PREFIXES = (
    ("go test", "go-test"), ("pytest", "pytest"), ("python -m pytest", "pytest"), ("npm test", "npm-test"), ("npm run test", "npm-test"),
    ("pnpm test", "pnpm-test"), ("yarn test", "yarn-test"), ("cargo test", "cargo-test"), ("make test", "make-test"),
)
_PLAIN = json.JSONDecoder(parse_constant=lambda name: _refuse(name))
_SPACE = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _command_of(text: str | None) -> str | None:
    """The command of a JSON object with exactly one of the two keys, a non-empty string."""
    try:
        value = _PLAIN.decode(text) if text else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict) or ("cmd" in value) == ("command" in value):
        return None
    command = value.get("cmd", value.get("command"))
    return command if isinstance(command, str) and command else None


@F.pandas_udf(T.StringType())
def exact_command(texts: pd.Series) -> pd.Series:
    return texts.map(_command_of)


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(_SPACE))


def compound(command: Column) -> Column:
    """Whether a command has an operator outside quotes, or ends inside a quote or after a backslash.

    What is quoted or escaped is taken out first, from left to right in one alternation; a
    quote or backslash that remains was never closed.  The repetitions are possessive, which
    the pattern engine runs as loops: the length of a quoted part costs no stack.
    """
    bare = F.regexp_replace(command, r"""(?s)\\.|'[^']*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\"""", "")
    return bare.rlike(r"""[;|&\n`'"\\]""")


def framework(command: Column) -> Column:
    """The test framework of a simple command, by its first matching prefix."""
    text = trimmed(command)
    out = F.lit(None).cast("string")
    for prefix, name in reversed(TEST_PREFIXES):
        out = F.when((text == prefix) | text.startswith(prefix + " "), name).otherwise(out)
    return F.when(~compound(text), out)


def exit_code(text: Column, pattern: str = regexes.EXIT_CODE) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("bigint")


def error_line(text: Column) -> Column:
    """The first line that says it is an error."""
    lines = F.transform(F.split(text, "\n"), trimmed)
    return F.get(F.filter(lines, lambda x: x.startswith("ERROR") | x.startswith("FAIL") | F.lower(x).startswith("error:")), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("bigint")


def test_outcome(code: Column, failed: Column, has_error: Column) -> Column:
    doubtful = has_error | F.coalesce(failed > 0, F.lit(False))
    return F.when(code != 0, "failure").when(doubtful, "unknown").otherwise("success")


_FACT = ["doc", "ordinal", "segment", "step", "kind", "value", "framework", "passed", "failed", "skipped", "exit_code", "outcome", "parse_rule", "evidence"]


def _facts(rows: DataFrame, **columns: Column) -> DataFrame:
    text, whole = F.lit(None).cast("string"), F.lit(None).cast("long")
    empty = {"segment": whole, "value": text, "framework": text, "passed": whole, "failed": whole, "skipped": whole, "exit_code": whole}
    return rows.select(*[columns.get(n, empty[n] if n in empty else F.col(n)).alias(n) for n in _FACT])


def commands(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc, ordinal, segment, command, framework, ref): each call's first segment that holds a command."""
    calls = entries.filter((F.col("kind") == "tool-call") & F.col("tool_name").isin(*COMMAND_TOOLS)).select("doc", "digest", "ordinal")
    held = calls.join(segments, ["doc", "ordinal"]).withColumn("command", exact_command("text")).filter("command is not null")
    first = held.groupBy("doc", "digest", "ordinal").agg(F.min_by(F.struct("segment", "command", F.sha2("text", 256).alias("hash")), "segment").alias("c"))
    ref = evidence_id(F.col("doc"), F.col("digest"), F.col("ordinal"), F.col("c.segment"), F.col("c.hash"))
    return first.select("doc", "ordinal", "c.segment", "c.command", framework(F.col("c.command")).alias("framework"), ref.alias("ref"))


def extract(entries: DataFrame, segments: DataFrame, exit_pattern: str = regexes.EXIT_CODE) -> DataFrame:
    """All facts before the text budget: one row each, ``value`` whole.  ``exit_pattern``: how a result states its exit code."""
    tool = entries.filter(F.col("kind").isin("tool-call", "tool-result"))
    own = evidence_id(F.col("doc"), F.col("digest"), F.col("ordinal"), F.lit(None), F.lit(""))
    tools = _facts(tool, step=F.lit(0), kind=F.col("kind"), outcome=F.lit("not-applicable"), parse_rule=F.concat(F.lit("sessions-entry-"), "kind", F.lit("-v1")), evidence=F.array(own))
    made = commands(entries, segments)
    command = _facts(made, segment=F.col("segment"), step=F.lit(1), kind=F.lit("command"), value=F.col("command"), outcome=F.lit("not-applicable"), parse_rule=F.lit("tool-call-command-json-v1"), evidence=F.array("ref"))
    tests = _facts(
        made.filter("framework is not null"), segment=F.col("segment"), step=F.lit(2), kind=F.lit("test-command"), value=F.col("command"), framework=F.col("framework"),
        outcome=F.lit("unknown"), parse_rule=F.lit("recognized-test-command-v1"), evidence=F.array("ref"),
    )
    results = entries.filter("kind = 'tool-result'").select("doc", "digest", "ordinal", "related").join(segments, ["doc", "ordinal"])
    text = F.col("text")
    read = results.withColumns({"exit_code": exit_code(text, exit_pattern), "error": error_line(text)}).filter("exit_code is not null or error is not null")
    read = read.withColumn("ref", evidence_id(F.col("doc"), F.col("digest"), F.col("ordinal"), F.col("segment"), F.sha2("text", 256)))
    coded = read.filter("exit_code is not null")
    codes = _facts(coded, segment=F.col("segment"), step=F.lit(1), kind=F.lit("exit-code"), exit_code=F.col("exit_code"), outcome=F.when(F.col("exit_code") == 0, "success").otherwise("failure"), parse_rule=F.lit("process-exit-code-v1"), evidence=F.array("ref"))
    call = made.filter("framework is not null").select("doc", F.col("ordinal").alias("related"), F.col("framework").alias("call_framework"), F.col("ref").alias("call_ref"))
    linked = coded.join(call, ["doc", "related"]).filter("related < ordinal")
    linked = linked.withColumns({"passed": count_of(text, regexes.PASSED), "failed": count_of(text, regexes.FAILED), "skipped": count_of(text, regexes.SKIPPED)})
    outcomes = _facts(
        linked, segment=F.col("segment"), step=F.lit(2), kind=F.lit("test-result"), framework=F.col("call_framework"), passed=F.col("passed"), failed=F.col("failed"), skipped=F.col("skipped"),
        exit_code=F.col("exit_code"), outcome=test_outcome(F.col("exit_code"), F.col("failed"), F.col("error").isNotNull()), parse_rule=F.lit("linked-test-result-v1"), evidence=F.array("call_ref", "ref"),
    )
    errors = _facts(read.filter("error is not null"), segment=F.col("segment"), step=F.lit(3), kind=F.lit("error-output"), value=F.col("error"), outcome=F.lit("failure"), parse_rule=F.lit("explicit-error-line-v1"), evidence=F.array("ref"))
    out = tools
    for part in (command, tests, codes, outcomes, errors):
        out = out.unionByName(part)
    return out


def _fold(texts: Column, value_bytes: int, document_bytes: int) -> Column:
    """The budget fold over a document's first texts in order: struct(key, text) -> struct(key, emitted)."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<key:struct<ordinal:bigint,segment:bigint,step:int>,emitted:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        left = F.lit(document_bytes) - acc["used"]
        emitted = F.when(left <= 0, F.lit(None)).otherwise(utf8.cut(x["text"], F.least(F.lit(value_bytes), left)))
        return F.struct((acc["used"] + F.coalesce(F.octet_length(emitted), F.lit(0))).alias("used"), F.concat(acc["out"], F.array(F.struct(x["key"].alias("key"), emitted.alias("emitted")))).alias("out"))

    return F.aggregate(texts, start, step, lambda acc: acc["out"])


def budgeted(facts: DataFrame, value_bytes: int = MAX_VALUE_BYTES, values: int = MAX_VALUES, document_bytes: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """Adds to each fact with a text what of it is emitted, whether it is cut, and whether it is an omission."""
    key = F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.coalesce(F.col("segment"), F.lit(-1)).cast("long").alias("segment"), F.col("step").cast("int").alias("step"))
    texts = facts.filter("value is not null").select("doc", key.alias("key"), utf8.cut(F.col("value"), value_bytes).alias("text"))
    first = texts.withColumn("k", F.row_number().over(W.partitionBy("doc").orderBy("key"))).filter(F.col("k") <= values)
    kept = first.groupBy("doc").agg(_fold(F.array_sort(F.collect_list(F.struct("key", "text"))), value_bytes, document_bytes).alias("out")).select("doc", F.explode("out").alias("o")).select("doc", "o.key", "o.emitted")
    joined = facts.withColumn("key", key).join(kept, ["doc", "key"], "left").drop("key")
    size = F.octet_length("value")
    has = F.col("value").isNotNull()
    omitted = has & F.col("emitted").isNull()
    return joined.withColumns({"emitted": F.when(has, F.coalesce("emitted", F.lit(""))), "original_bytes": size, "truncated": F.when(has, F.octet_length(F.coalesce("emitted", F.lit(""))) < size), "omitted": omitted})


def omissions(facts: DataFrame, segments: DataFrame) -> DataFrame:
    """Per document its omitted text values, their bytes, and the segments whose text was left out at the source."""
    held = facts.groupBy("doc").agg(F.count(F.when(F.col("omitted"), 1)).alias("omitted_values"), F.coalesce(F.sum(F.when(F.col("omitted"), F.col("original_bytes"))), F.lit(0)).alias("omitted_bytes"))
    source = segments.filter("segment_kind = 'omitted'").groupBy("doc").agg(F.count(F.lit(1)).alias("canonical_segments"))
    return held.join(source, "doc", "full").fillna(0)


#: Where a fact's value holds a text.
_VALUE = "command struct<text:string>, error struct<text:string>, test struct<command:struct<text:string>>"


def stored_violations(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(fact_id, violation): stored facts by the first rule they break, against the evidence they name.

    The rules in order: kind and rule given; a known outcome; a value that is a JSON object
    with at most one text, within its limit; evidence given, each id once, all of it known
    and of one document.
    """
    ids = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    cites = facts.select("fact_id", F.explode(ids).alias("evidence_id")).join(evidence.select("evidence_id", "doc"), "evidence_id", "left")
    known = cites.groupBy("fact_id").agg(F.max(F.col("doc").isNull()).alias("unknown"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    value = F.from_json("value_json", _VALUE)
    texts = F.array_compact(F.array(value["command"]["text"], value["error"]["text"], value["test"]["command"]["text"]))
    code = (
        F.when((F.coalesce("kind", F.lit("")) == "") | (F.coalesce("parse_rule", F.lit("")) == ""), "fields").when(~F.coalesce(F.col("outcome").isin("success", "failure", "unknown", "not-applicable"), F.lit(False)), "outcome")
        .when(F.json_object_keys("value_json").isNull(), "value").when(F.size(texts) > 1, "texts").when(F.exists(texts, lambda t: F.octet_length(t) > MAX_VALUE_BYTES), "text-size").when(F.size(ids) == 0, "no-evidence")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated-evidence").when(F.col("unknown"), "unknown-evidence").when(F.col("low") != F.col("high"), "several-documents")
    )
    return facts.join(known, "fact_id", "left").select("fact_id", code.alias("violation")).filter("violation is not null")


def reference_rows(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc, ordinal, segment, reference_id, reference): the whole reference of every entry and segment (IDN-4)."""
    whole = entries.select("doc", "digest", "ordinal", "kind", "actor", "related", "call_id", "tool_name", "tool_namespace")
    none = {c: F.lit(None).cast("string") for c in ("origin", "origin_confidence", "hash")}
    parts = whole.join(segments.select("doc", "ordinal", "segment", "origin", "origin_confidence", F.sha2("text", 256).alias("hash")), ["doc", "ordinal"])
    rows = whole.withColumns({"segment": F.lit(None).cast("long"), **none}).unionByName(parts)
    mark = evidence_id(F.col("doc"), F.col("digest"), F.col("ordinal"), F.col("segment"), F.col("hash"))
    fields = {k: F.col(c) for k, c in (("entryKind", "kind"), ("actor", "actor"), ("origin", "origin"), ("originConfidence", "origin_confidence"), ("relatedEntryOrdinal", "related"), ("toolCallId", "call_id"), ("toolName", "tool_name"), ("toolNamespace", "tool_namespace"))}
    scheme = F.when(F.col("hash").isNotNull(), idn.TEXT_SCHEME)
    body = idn.evidence_ref(F.col("reference_id"), F.col("doc"), F.lit(idn.DOCUMENT_SCHEME), F.col("digest"), F.col("ordinal"), F.col("segment"), fields, scheme, F.col("hash"))
    return rows.withColumn("reference_id", mark).select("doc", "ordinal", "segment", "reference_id", body.alias("reference"))


def stored_references(evidence: DataFrame) -> DataFrame:
    """(evidence_id, problem): stored references by how they differ from the rebuilt ones (IDN-5)."""
    mark = evidence_id(F.col("doc"), F.col("digest"), F.col("ordinal"), F.col("segment"), F.sha2("text", 256))
    problem = (
        F.when(F.col("digest").isNull(), "no-entry").when(~F.col("content_hash").eqNullSafe(F.sha2("text", 256)), "content-hash").when(~F.coalesce(mark == F.col("evidence_id"), F.lit(False)), "id").otherwise("equal")
    )
    return evidence.select("evidence_id", problem.alias("problem"))


def _selected(emitted: Column, original: Column, truncated: Column) -> Column:
    return record([
        ("text", string(emitted)), ("truncated", idn.boolean(truncated)), ("originalUtf8Bytes", number(F.octet_length(original))), ("emittedUtf8Bytes", number(F.octet_length(emitted))),
        ("contentHash", idn.digest(F.lit(idn.TEXT_SCHEME), F.sha2(original, 256))),
    ])


def identified(facts: DataFrame, entries: DataFrame, segments: DataFrame) -> DataFrame:
    """Budgeted facts with their canonical value, fingerprint and id (IDN-6)."""
    tool = entries.select("doc", F.col("ordinal").cast("long").alias("ordinal"), F.struct("tool_name", "tool_namespace", "call_id", "related").alias("tool"), idn.revision(*(F.col(c) for c in ("doc", "source_kind", "source_instance_id", "native_id")), F.lit(idn.DOCUMENT_SCHEME), F.col("digest")).alias("revision"))
    rows = facts.withColumn("ordinal", F.col("ordinal").cast("long")).join(tool, ["doc", "ordinal"]).withColumn("fact", F.struct("ordinal", "segment", "step"))
    t, kind = F.col("tool"), F.col("kind")
    text = _selected(F.col("emitted"), F.col("value"), F.col("truncated"))
    called = record([("kind", string(F.regexp_replace("kind", "^tool-", ""))), ("name", string(t["tool_name"])), ("namespace", string(t["tool_namespace"])), ("callId", string(t["call_id"])), ("relatedEntryOrdinal", number(t["related"]))], optional=("name", "namespace", "callId", "relatedEntryOrdinal"))
    counts = record([("framework", string("framework")), ("passed", number("passed")), ("failed", number("failed")), ("skipped", number("skipped"))], optional=("passed", "failed", "skipped"))
    value = (
        F.when(kind.isin("tool-call", "tool-result"), record([("tool", called)])).when(kind == "command", record([("command", text)])).when(kind == "test-command", record([("test", record([("framework", string("framework")), ("command", text)]))]))
        .when(kind == "exit-code", record([("exitCode", number("exit_code"))])).when(kind == "test-result", record([("test", counts), ("exitCode", number("exit_code"))])).otherwise(record([("error", text)]))
    )
    rows = rows.withColumn("value_json", value)
    refs = reference_rows(entries, segments).select("reference_id", "reference")
    cites = rows.select("doc", "fact", F.posexplode("evidence").alias("place", "reference_id")).join(refs, "reference_id")
    listed = cites.groupBy("doc", "fact").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "reference"))), lambda x: x["reference"]).alias("references"))  # at most two
    name, version, schema = map(F.lit, EXTRACTOR)
    mark = idn.fact_fingerprint(F.col("revision"), kind, F.col("value_json"), F.col("outcome"), F.col("parse_rule"), name, version, schema, F.col("references"))
    return rows.join(listed, ["doc", "fact"]).withColumn("fingerprint", mark).withColumn("fact_id", idn.derived_id("fact_", F.col("fingerprint"))).drop("fact", "tool")
