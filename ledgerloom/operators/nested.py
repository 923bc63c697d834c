"""Nested JSON records as related flat tables, in one pass.

A depth-first visitor goes through each record once and emits one tagged row for
every object and every array item it meets: the table's tag, the row's key, its
parent's key, its position and its own scalar fields as JSON.  The rows are written
partitioned by tag and read again one table at a time under its schema.  The pass
is a map over the records (Arrow batches), without any shuffle.

Defined results: a record that is null or not one whole JSON object gives no row;
white space, control and format characters around a record do not matter; at the
declared container paths a JSON string that itself holds JSON counts as that JSON;
of repeated object keys the last counts; repeated records count each; NaN and infinities
are not JSON.  A row's key is its record's key and the path below it as a JSON pointer
(``/`` and ``~`` in names escaped, in tags also ``.``), beyond ``LONG_KEY`` characters
its digest.  A null item is a row at its position with a null ``value``, an empty object
a row without fields; an empty array stays among its parent's own fields.  Records
nested however deeply are read; rows more than ``DEEP`` levels down share their
ancestor's tag at that level.  Whole numbers of over 4,000 digits are kept as strings.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from json.decoder import scanstring
from json.scanner import NUMBER_RE

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

EMITTED = "tag string, row_key string, parent_key string, root_key string, pos long, n_fields long, payload string"


def _no_constant(name: str):
    raise ValueError(name)


def _whole(digits: str) -> int | str:
    return int(digits) if len(digits) <= 4000 else digits


_decoder = json.JSONDecoder(parse_constant=_no_constant, parse_int=_whole)
DEEP, LONG_KEY = 64, 1000
_SPACE = " \t\n\r"
_WORDS = {"true": True, "false": False, "null": None}


def _deep_value(text: str) -> tuple[object, int]:
    """Like ``raw_decode`` with a stack of its own: for records nested too deeply for the parser's recursion."""
    at, n = 0, len(text)
    holders: list = []  # open objects and arrays
    names: list = []  # the name that waits for its value, of each open object

    def skip() -> None:
        nonlocal at
        while at < n and text[at] in _SPACE:
            at += 1

    def name() -> str:
        nonlocal at
        skip()
        if text[at : at + 1] != '"':
            raise ValueError("name")
        own, at = scanstring(text, at + 1, True)
        skip()
        if text[at : at + 1] != ":":
            raise ValueError("colon")
        at += 1
        return own

    while True:
        skip()
        ch = text[at : at + 1]
        if ch in ("{", "["):
            at += 1
            holders.append({} if ch == "{" else [])
            skip()
            if text[at : at + 1] != ("}" if ch == "{" else "]"):
                names.append(name() if ch == "{" else None)
                continue
            at += 1
            value = holders.pop()
        elif ch == '"':
            value, at = scanstring(text, at + 1, True)
        elif (word := next((w for w in _WORDS if text.startswith(w, at)), None)) is not None:
            value, at = _WORDS[word], at + len(word)
        elif (m := NUMBER_RE.match(text, at)) is not None:
            whole, fraction, exponent = m.groups()
            value, at = (float(m.group()) if fraction or exponent else _whole(whole)), m.end()
        else:
            raise ValueError("value")
        while holders:  # put the value where it belongs, and close what ends with it
            top = holders[-1]
            if isinstance(top, dict):
                top[names[-1]] = value
            else:
                top.append(value)
            skip()
            ch = text[at : at + 1]
            at += 1
            if ch == ",":
                if isinstance(top, dict):
                    names[-1] = name()
                break
            if ch != ("}" if isinstance(top, dict) else "]"):
                raise ValueError("end")
            names.pop()
            value = holders.pop()
        else:
            return value, at


def _outer(ch: str) -> bool:
    return ch.isspace() or unicodedata.category(ch) in ("Cc", "Cf", "Zs", "Zl", "Zp")


def trimmed(text: str) -> str:
    """``text`` without the invisible characters around it."""
    start, end = 0, len(text)
    while start < end and _outer(text[start]):
        start += 1
    while end > start and _outer(text[end - 1]):
        end -= 1
    return text[start:end]


def decoded(text: object) -> object:
    """The JSON value of ``text``, or None if it is not one whole JSON value."""
    if not isinstance(text, str):
        return None
    text = trimmed(text)
    try:
        try:
            value, end = _decoder.raw_decode(text)
        except RecursionError:
            value, end = _deep_value(text)
    except ValueError:
        return None
    return value if end == len(text) else None


def _contained(value: object) -> object:
    """A container position's value: a string that holds an object or array counts as that."""
    while isinstance(value, str):
        value = decoded(value)
        if not isinstance(value, (str, dict, list)):
            return None
    return value


def _key(root: str, key: str, part: str | int) -> str:
    """The key of a child: the path below the record, or its digest where that grows long."""
    own = f"{key}/{part}"
    return own if len(own) <= LONG_KEY + len(root) else f"{root}/~{hashlib.sha256(own.encode('utf-8', 'surrogatepass')).hexdigest()}"


def _pointer(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def visit(tag: str, key: str, text: object, containers: frozenset[str]) -> Iterator[tuple]:
    """The rows of one record, parents before children, children in order."""
    root = _contained(text)
    if not isinstance(root, dict):
        return
    stack: list[tuple] = [(tag, key, None, 0, root, 0)]
    while stack:
        tag_, key_, parent, pos, value, depth = stack.pop()
        if isinstance(value, dict):
            own, below = {}, []
            for name, child in value.items():
                path = f"{tag_}.{_pointer(name).replace('.', '~2')}" if depth < DEEP else tag_
                held = _contained(child) if path in containers and isinstance(child, str) else child
                if isinstance(held, dict):
                    below.append((path, _key(key, key_, _pointer(name)), key_, 0, held, depth + 1))
                elif isinstance(held, list) and held:
                    inside = _key(key, key_, _pointer(name))
                    for i, item in enumerate(held):
                        inner = _contained(item) if path in containers and isinstance(item, str) else item
                        below.append((path, _key(key, inside, i), key_, i, inner, depth + 1))
                else:
                    own[name] = child
            yield tag_, key_, parent, key, pos, len(value), json.dumps(own, ensure_ascii=False)
            stack.extend(reversed(below))
        elif isinstance(value, list):
            path = f"{tag_}[]" if depth < DEEP else tag_
            stack.extend(reversed([(path, _key(key, key_, i), key_, i, item, depth + 1) for i, item in enumerate(value)]))
        else:
            yield tag_, key_, parent, key, pos, None, json.dumps({"value": value}, ensure_ascii=False)


def flatten(rows: DataFrame, key_col: str, json_col: str, tag: str, containers: Iterable[str] = (), only: Iterable[str] | None = None) -> DataFrame:
    """Every object and array item of ``json_col`` as a tagged row (EMITTED).

    ``containers``: paths at which JSON inside a string counts.  ``only``: keep these tags alone.
    """
    inside, wanted = frozenset(containers), None if only is None else frozenset(only)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in EMITTED.split(", ")]
        for pdf in batches:
            out = [r for k, t in zip(pdf["k"], pdf["j"]) for r in visit(tag, k, t, inside) if wanted is None or r[0] in wanted]
            frame = pd.DataFrame(out, columns=names)
            frame["n_fields"] = frame["n_fields"].astype("Int64")
            yield frame

    source = rows.select(F.col(f"`{key_col}`").cast("string").alias("k"), F.col(f"`{json_col}`").alias("j")).filter("k is not null")
    return spread(source).mapInPandas(run, EMITTED)


def write_tables(emitted: DataFrame, path: str) -> None:
    """Write the emitted rows partitioned by tag; one table can then be read without the others.

    Rows of a tag are brought together in files of the advisory size, a large tag in many of
    them, so that the number of files does not grow with tasks times tags.
    """
    emitted.hint("rebalance", "tag").write.mode("overwrite").partitionBy("tag").parquet(path)


_WRITTEN = T.StructType([T.StructField(*f) for f in (("row_key", T.StringType()), ("parent_key", T.StringType()), ("root_key", T.StringType()), ("pos", T.LongType()), ("n_fields", T.LongType()), ("payload", T.StringType()), ("tag", T.StringType()))])


def read_table(spark: SparkSession, path: str, tag: str, schema: str | T.StructType) -> DataFrame:
    """One flat table under its schema, with its row's and parent's keys and its number of fields."""
    rows = spark.read.schema(_WRITTEN).parquet(path).filter(F.col("tag") == tag)
    return rows.select("row_key", "parent_key", "root_key", "pos", "n_fields", F.from_json("payload", schema).alias("r")).select("row_key", "parent_key", "root_key", "pos", "n_fields", "r.*")


#: Positions of an export record and of a model description that hold JSON.
EXPORT_CONTAINERS = ("record.snapshot", "record.snapshot.selection", "record.entry", "record.entry.content")
MODEL_CONTAINERS = ("model.requestedRoute",)
_SESSION, _SOURCE, _DIGEST = "canonicalId string, nativeId string", "kind string, instanceId string", "scheme string, digest string"
_COUNTED, _TEXT = "selected long, total long, truncated boolean", "text string, truncated boolean, originalUtf8Bytes long, emittedUtf8Bytes long"
#: The schema of each table; further tags (unknown fields) stay in the written rows.
SCHEMAS = {
    "record": "schemaVersion string, command string, type string, disposition string",
    "record.session": _SESSION,
    "record.session.source": _SOURCE,
    "record.documentDigest": _DIGEST,
    "record.entry": "ordinal long, kind string, actor string, timestamp string, relatedEntryOrdinal long, toolCallId string, toolName string, toolNamespace string, omittedSegmentCount long",
    "record.entry.content": "ordinal long, kind string, origin string, originConfidence string, contentClass string, sourceType string",
    "record.entry.content.text": _TEXT,
    "record.entry.content.contentHash": _DIGEST,
    "record.snapshot": "capturedAt string, sourceState string, sourceObservedAt string, adapterVersion string, freshness string, lineageCoverage string, createdAt string, updatedAt string",
    "record.snapshot.session": _SESSION,
    "record.snapshot.session.source": _SOURCE,
    "record.snapshot.documentDigest": _DIGEST,
    "record.snapshot.title": _TEXT,
    "record.snapshot.selection": "mode string, canonicalOmittedSegments long, truncatedTextSegments long",
    "record.snapshot.selection.relations": _COUNTED,
    "record.snapshot.selection.entries": _COUNTED + ", firstOrdinal long, lastOrdinal long",
    "record.snapshot.selection.segments": _COUNTED,
    "record.snapshot.selection.segmentText": "emittedUtf8Bytes long, originalUtf8Bytes long, truncated boolean",
    "record.relation": "ordinal long, kind string, confidence string",
    "record.relation.target": _SESSION,
    "record.relation.target.source": _SOURCE,
    "model": "promptVersion string, inputTokens long, outputTokens long, totalTokens long, latencyMilliseconds long, costUsd string, resolvedProvider string, resolvedModel string, requestId string",
    "model.requestedRoute": "alias string, gateway string, model string, provider string, routeVersion string, privacyPolicyVersion string",
}
SEGMENT, SELECTION, MODEL = "record.entry.content", "record.snapshot.selection", "model"


def emitted(exports: DataFrame, details: DataFrame) -> DataFrame:
    """The tagged rows of the export records and of the model descriptions."""
    records = flatten(exports, "line_id", "record_json", "record", EXPORT_CONTAINERS)
    return records.unionByName(flatten(details, "analysis_id", "model_json", "model", MODEL_CONTAINERS))


def children(spark: SparkSession, path: str) -> DataFrame:
    """Segments, selections and models of the tables at ``path`` with their record's key (parent_id, child_kind, child_pos)."""

    def of(tag: str, kind: str, pos: Column, least: int) -> DataFrame:
        rows = read_table(spark, path, tag, SCHEMAS[tag]).filter(F.col("n_fields") >= least)
        return rows.select(F.col("root_key").alias("parent_id"), F.lit(kind).alias("child_kind"), pos.cast("long").alias("child_pos"))

    return of(SEGMENT, "segment", F.col("pos"), 0).unionByName(of(SELECTION, "selection", F.lit(0), 1)).unionByName(of(MODEL, "model", F.lit(0), 1))
