"""Session exports (JSON Lines) as documents, under strict validation.

A record is checked on its own in one map (shape, required fields, nulls, enumerations,
sizes, hashes); what depends on other records (order, identity, ordinals, counts) are
joins and aggregates by document.  Each failing check has a stage, the first failure of
the first failing record rejects the document, and nothing of a rejected document comes
out.  Ranks within a document are counted by chunks of lines, so that a document that
holds a third of all lines is not one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regexes import HEX_DIGEST, TIMESTAMP
from ..operators.ranking import ranked
from ..session import cut, spread

MAX_EXPORT_BYTES = 64 * 1024 * 1024
#: Vocabularies of an export.
ENUMS = {
    "sourceState": {"present", "missing", "unknown"}, "freshness": {"current", "stale"}, "lineageCoverage": {"complete", "unknown"},
    "relationKind": {"parent", "child", "fork", "continuation", "unknown"}, "confidence": {"high", "medium", "low", "unknown"},
    "actor": {"human", "model", "tool", "system", "unknown"},
    "origin": {"human", "injected", "delegated", "replayed-copied", "model", "tool", "system", "unknown"}, "contentClass": {"image", "resource", "structured", "unknown"},
}
#: Fields of each object of an export: required ones, then optional ones.
_TEXT = ("text truncated originalUtf8Bytes emittedUtf8Bytes", "")
_COUNT = ("selected total truncated", "")
FIELDS = {
    "session": ("schemaVersion command type disposition snapshot", ""),
    "relation": ("schemaVersion command type disposition session documentDigest relation", ""),
    "entry": ("schemaVersion command type disposition session documentDigest entry", ""),
    "snapshot": ("session documentDigest capturedAt sourceState sourceObservedAt adapterVersion freshness lineageCoverage selection", "title createdAt updatedAt"),
    "ref": ("canonicalId source nativeId", ""), "source": ("kind instanceId", ""), "digest": ("scheme digest", ""),
    "selection": ("mode relations entries segments segmentText canonicalOmittedSegments truncatedTextSegments", ""),
    "count": _COUNT, "entryCount": (_COUNT[0] + " firstOrdinal lastOrdinal", ""), "bytes": ("emittedUtf8Bytes originalUtf8Bytes truncated", ""),
    "relationBody": ("ordinal kind target confidence", ""), "entryBody": ("ordinal kind actor content omittedSegmentCount", "timestamp relatedEntryOrdinal toolCallId toolName toolNamespace"),
    "textSegment": ("ordinal kind origin originConfidence text contentHash", ""), "omittedSegment": ("ordinal kind origin originConfidence contentClass sourceType", ""), "text": _TEXT,
}
_ALLOWED = {k: (frozenset(a.split()), frozenset(a.split()) | frozenset(b.split())) for k, (a, b) in FIELDS.items()}
_STAMP, _HEX = re.compile(TIMESTAMP), re.compile(HEX_DIGEST)
#: Digest schemes of documents and of segment texts.
DOCUMENT_SCHEME = ("sha256-canonical-v1", "sha256-sessions-document-jcs-v1")
CONTENT_SCHEME = ("sha256-utf8-v1",)


class Invalid(Exception):
    """A failed check: its stage (smaller ones are looked at first) and category."""

    def __init__(self, stage: int, category: str):
        super().__init__(category)
        self.stage, self.category = stage, category


def _need(ok: object, stage: int, category: str) -> None:
    if not ok:
        raise Invalid(stage, category)


def _object(value: object, kind: str) -> dict:
    """An object with its required fields; unknown fields are a matter of a later stage."""
    _need(isinstance(value, dict) and _ALLOWED[kind][0] <= value.keys(), 2, "required field is absent or malformed")
    return value


def _strict(value: dict, kind: str, record: str) -> None:
    _need(value.keys() <= _ALLOWED[kind][1], 4, f"invalid {record} record")


def _nulls(value: object, name: str = "") -> bool:
    """Whether a null is anywhere but at the two ordinal bounds."""
    if value is None:
        return name not in ("firstOrdinal", "lastOrdinal")
    if isinstance(value, dict):
        return any(_nulls(v, k) for k, v in value.items())
    return isinstance(value, list) and any(_nulls(v, name) for v in value)


def _whole(*values: object) -> bool:
    return all(isinstance(v, int) and not isinstance(v, bool) for v in values)


def _named(ref: dict) -> bool:
    return all(isinstance(v, str) and v for v in (ref["canonicalId"], ref["nativeId"], ref["source"]["kind"], ref["source"]["instanceId"]))


def _ref(value: object, record: str) -> dict:
    ref = _object(value, "ref")
    _object(ref["source"], "source")
    _strict(ref, "ref", record)
    _strict(ref["source"], "source", record)
    return ref


def _digest(value: object, schemes: tuple[str, ...], record: str) -> bool:
    digest = _object(value, "digest")
    _strict(digest, "digest", record)
    return digest["scheme"] in schemes and isinstance(digest["digest"], str) and bool(_HEX.match(digest["digest"]))


def _utf8(text: str) -> bytes:
    """The text's bytes; a lone half of a surrogate pair counts as the replacement character."""
    try:
        return text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()


def _complete(text: dict) -> bool:
    """Whether a selected text is whole and its sizes are right."""
    return isinstance(text["text"], str) and _whole(text["originalUtf8Bytes"], text["emittedUtf8Bytes"]) and len(_utf8(text["text"])) == text["emittedUtf8Bytes"] == text["originalUtf8Bytes"] and text["truncated"] is False


def _stamp(value: object) -> bool:
    return isinstance(value, str) and bool(_STAMP.match(value)) and pd.to_datetime(value, errors="coerce") is not pd.NaT


def _snapshot(record: dict) -> dict:
    snap = _object(record["snapshot"], "snapshot")
    ref, sel = _ref(snap["session"], "session"), _object(snap["selection"], "selection")
    parts = {n: _object(sel[n], "entryCount" if n == "entries" else "count") for n in ("relations", "entries", "segments")}
    size = _object(sel["segmentText"], "bytes")
    title = _object(snap["title"], "text") if "title" in snap else None
    for value, kind in ((record, "session"), (snap, "snapshot"), (sel, "selection"), (size, "bytes"), *((p, "entryCount" if n == "entries" else "count") for n, p in parts.items()), *([(title, "text")] if title else [])):
        _strict(value, kind, "session")
    numbers = [*(v for p in parts.values() for v in (p["selected"], p["total"])), size["emittedUtf8Bytes"], size["originalUtf8Bytes"], sel["canonicalOmittedSegments"], sel["truncatedTextSegments"]]
    _need(_whole(*numbers), 4, "invalid session record")
    _need(_named(ref), 6, "invalid session identity")
    _need(_digest(snap["documentDigest"], DOCUMENT_SCHEME, "session"), 7, "invalid digest")
    _need(snap["adapterVersion"], 8, "adapter version is absent")
    _need(all(snap[n] in ENUMS[n] for n in ("sourceState", "freshness", "lineageCoverage")), 9, "invalid source metadata")
    _need(all(_stamp(snap[n]) for n in ("capturedAt", "sourceObservedAt")) and all(_stamp(snap[n]) for n in ("createdAt", "updatedAt") if snap.get(n)), 10, "invalid timestamp")
    _need(title is None or _complete(title), 11, "invalid title selection")
    _need(sel["mode"] == "full", 12, "export selection is not full")
    _need(all(p["selected"] == p["total"] >= 0 and p["truncated"] is False for p in parts.values()) and size["emittedUtf8Bytes"] == size["originalUtf8Bytes"] >= 0 and size["truncated"] is False and sel["canonicalOmittedSegments"] >= 0 and sel["truncatedTextSegments"] == 0, 13, "selection is truncated or inconsistent")
    n, bounds = parts["entries"]["selected"], (parts["entries"]["firstOrdinal"], parts["entries"]["lastOrdinal"])
    _need(bounds == ((None, None) if n == 0 else (0, n - 1)), 14, "entry selection has invalid ordinal bounds")
    return {"ref": ref, "digest": snap["documentDigest"], "n_relations": parts["relations"]["selected"], "n_entries": n, "n_segments": parts["segments"]["selected"], "n_omitted": sel["canonicalOmittedSegments"], "n_bytes": size["emittedUtf8Bytes"]}


def _relation(record: dict) -> dict:
    body = _object(record["relation"], "relationBody")
    ref, target = _ref(record["session"], "relation"), _ref(body["target"], "relation")
    _strict(record, "relation", "relation")
    _strict(body, "relationBody", "relation")
    _need(_whole(body["ordinal"]), 4, "invalid relation record")
    _need(_digest(record["documentDigest"], DOCUMENT_SCHEME, "relation"), 5, "session identity or document digest drift")
    _need(body["kind"] in ENUMS["relationKind"] and body["confidence"] in ENUMS["confidence"] and _named(target), 7, "invalid relation")
    return {"ref": ref, "digest": record["documentDigest"], "ordinal": body["ordinal"]}


def _segment(raw: object, place: int) -> tuple[int, int]:
    """(omitted, bytes) of a sound segment."""
    segment = raw
    _need(segment["ordinal"] == place and segment["origin"] in ENUMS["origin"] and segment["originConfidence"] in ENUMS["confidence"], 8, "invalid segment coordinate")
    if segment["kind"] == "text":
        _need(segment.keys() <= _ALLOWED["textSegment"][1] and segment["text"].keys() <= _ALLOWED["text"][1], 8, "invalid text segment")
        _need(_complete(segment["text"]), 8, "invalid selected text")
        mark = segment["contentHash"]
        _need(mark.keys() <= _ALLOWED["digest"][1] and mark["scheme"] in CONTENT_SCHEME and isinstance(mark["digest"], str) and _HEX.match(mark["digest"]), 8, "invalid content hash")
        _need(hashlib.sha256(_utf8(segment["text"]["text"])).hexdigest() == mark["digest"], 8, "content hash mismatch")
        return 0, segment["text"]["emittedUtf8Bytes"]
    _need(segment.keys() <= _ALLOWED["omittedSegment"][1] and segment["contentClass"] in ENUMS["contentClass"] and segment["sourceType"], 8, "invalid omitted segment")
    return 1, 0


def _entry(record: dict) -> dict:
    body = _object(record["entry"], "entryBody")
    ref = _ref(record["session"], "entry")
    _need(isinstance(body["content"], list), 2, "required field is absent or malformed")
    for raw in body["content"]:
        kind = raw.get("kind") if isinstance(raw, dict) else None
        _need(kind in ("text", "omitted"), 2, "required field is absent or malformed")
        _object(raw, f"{kind}Segment")
        if kind == "text":
            _object(raw["text"], "text")
            _object(raw["contentHash"], "digest")
    _strict(record, "entry", "entry")
    _strict(body, "entryBody", "entry")
    related = body.get("relatedEntryOrdinal")
    _need(_whole(body["ordinal"], body["omittedSegmentCount"]) and (related is None or _whole(related)), 4, "invalid entry record")
    _need(_digest(record["documentDigest"], DOCUMENT_SCHEME, "entry"), 5, "session identity or document digest drift")
    _need(isinstance(body["kind"], str) and body["kind"] and body["actor"] in ENUMS["actor"], 6, "invalid entry coordinate")
    _need(not body.get("timestamp") or _stamp(body["timestamp"]), 7, "invalid entry timestamp")
    _need(related is None or (related >= 0 and related != body["ordinal"]), 7, "invalid related entry ordinal")
    sizes = [_segment(raw, i) for i, raw in enumerate(body["content"])]
    _need(body["omittedSegmentCount"] == 0, 9, "full export omitted segment records")
    return {"ref": ref, "digest": record["documentDigest"], "ordinal": body["ordinal"], "related": related, "n_segments": len(sizes), "n_omitted": sum(o for o, _ in sizes), "n_bytes": sum(b for _, b in sizes)}


_READERS = {"session": _snapshot, "relation": _relation, "entry": _entry}


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_JSON = json.JSONDecoder(parse_constant=_refuse)


def read_record(text: str) -> dict:
    """One record with what later checks need, or its first failing check."""
    out: dict = {}
    try:
        try:
            record = _JSON.decode(text)
        except (ValueError, RecursionError):
            raise Invalid(0, "invalid JSON") from None
        _need(isinstance(record, dict), 1, "invalid record header")
        out["record_type"] = kind = record.get("type") if isinstance(record.get("type"), str) else None
        _need(record.get("schemaVersion") == 1 and not isinstance(record.get("schemaVersion"), bool), 1, "unsupported schema version")
        _need(record.get("command") == "export", 1, "unexpected command")
        _need(record.get("disposition") == "untrusted-history", 1, "unsupported trust disposition")
        _need(kind in _READERS and not _nulls(record), 2, "required field is absent or malformed")
        read = _READERS[kind](record)
        ref, digest = read.pop("ref"), read.pop("digest")
        out |= read | {"session": json.dumps([ref["canonicalId"], ref["source"]["kind"], ref["source"]["instanceId"], ref["nativeId"], digest["scheme"], digest["digest"]]), "session_id": ref["canonicalId"]}
    except Invalid as bad:
        out |= {"stage": bad.stage, "category": bad.category}
    return out


_TEXT_COLUMNS = ("record_type", "category", "session", "session_id")
_NUMBERS = ("stage", "ordinal", "related", "n_relations", "n_entries", "n_segments", "n_omitted", "n_bytes")
RECORDS = "doc string, line_no long, " + ", ".join(f"{c} string" for c in _TEXT_COLUMNS) + ", " + ", ".join(f"{c} long" for c in _NUMBERS)


def read_records(lines: DataFrame) -> DataFrame:
    """Each line (doc, line_no, record_json) as a checked record; null and blank lines between records are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = pd.DataFrame([read_record(t) for t in pdf["record_json"]], columns=[*_TEXT_COLUMNS, *_NUMBERS], index=pdf.index)
            read[list(_NUMBERS)] = read[list(_NUMBERS)].apply(pd.to_numeric).astype("Int64")
            yield pd.concat([pdf[["doc", "line_no"]], read.astype({c: object for c in _TEXT_COLUMNS})], axis=1)

    texts = lines.filter("record_json is not null and trim(record_json) <> ''").select("doc", "line_no", "record_json")
    return cut(spread(texts).mapInPandas(run, RECORDS))  # several joins and aggregates follow: parse once


def _first(stage: Column, category: Column) -> Column:
    """Aggregate: the category of the first failing record, by place, then stage."""
    return F.min(F.when(category.isNotNull(), F.struct("place", stage.alias("stage"), category.alias("category"))))


def judge(records: DataFrame) -> DataFrame:
    """(doc, category): every document with its first violation, or null."""
    placed = ranked(records, ["doc"], "line_no", "place", ("record_type",))
    placed = ranked(placed, ["doc"], "line_no", "entries_before", ("record_type",), F.col("record_type") == "entry")
    placed = ranked(placed, ["doc"], "line_no", "relations_before", ("record_type",), F.col("record_type") == "relation")
    head = placed.filter("place = 0").select("doc", F.col("session").alias("head_session"), F.col("record_type").alias("head_type"))
    j = placed.join(head, "doc", "left")
    kind, place = F.col("record_type"), F.col("place")
    order = F.when((kind == "session") & (place > 0), "session record must be first and unique").when((kind == "relation") & ((place == 0) | (F.col("entries_before") > 0)), "relation record is out of order").when((kind == "entry") & (place == 0), "entry record cannot precede session")
    drift = F.when((place > 0) & F.col("session").isNotNull() & ~F.col("session").eqNullSafe(F.col("head_session")), "session identity or document digest drift")
    ordinal = F.when((kind == "entry") & (F.col("ordinal") != F.col("entries_before")), "invalid entry coordinate").when((kind == "relation") & (F.col("ordinal") != F.col("relations_before")), "invalid relation")
    found = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(s.alias("stage"), c.alias("category"))) for s, c in ((F.col("stage"), F.col("category")), (F.lit(3).cast("long"), order), (F.lit(5).cast("long"), drift), (F.lit(6).cast("long"), ordinal))]))
    first = F.get(F.array_sort(found), F.lit(0))
    marked = j.withColumns({"stage": first["stage"], "category": first["category"]})
    total = lambda c, t: F.coalesce(F.sum(F.when(kind == t, F.col(c))), F.lit(0))
    each = marked.groupBy("doc").agg(
        _first(F.col("stage"), F.col("category")).alias("bad"), F.count(F.when(kind == "relation", 1)).alias("relations"), F.count(F.when(kind == "entry", 1)).alias("entries"), F.max("related").alias("far"),
        total("n_segments", "entry").alias("segments"), total("n_omitted", "entry").alias("omitted"), total("n_bytes", "entry").alias("bytes"),
        F.max(F.when(place == 0, F.struct("n_relations", "n_entries", "n_segments", "n_omitted", "n_bytes"))).alias("said"),
    )
    same = lambda a, b: F.coalesce(F.col(a) == F.col(f"said.{b}"), F.lit(False))
    counts = F.when(~(same("relations", "n_relations") & same("entries", "n_entries")), "record counts do not match selection").when(F.col("far") >= F.col("entries"), "related entry ordinal is out of range").when(~(same("segments", "n_segments") & same("omitted", "n_omitted") & same("bytes", "n_bytes")), "segment counts do not match selection")
    return each.select("doc", F.coalesce("bad.category", counts).alias("category"))


def accepted(records: DataFrame) -> DataFrame:
    """The records of documents without any violation."""
    return records.join(judge(records).filter("category is null").select("doc"), "doc", "left_semi")


def requested(judged: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, session_id, category): documents asked for (doc, session_id) with their first violation (SRC-1, VAL-5).

    A document whose head names another session than was asked for breaks on that; one that
    is not there was not found.
    """
    head = records.groupBy("doc").agg(F.min_by("session_id", "line_no").alias("head_id"))
    j = wanted.join(judged, "doc", "left").join(head, "doc", "left")
    other = F.when(F.col("head_id").isNull(), "session was not found").when(F.col("head_id") != F.col("session_id"), "exported session does not match the request")
    return j.select("doc", "session_id", F.coalesce(F.when(F.col("head_id").isNull(), other), "category", other).alias("category"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc, line_no, record_json, failure): lines of export files, one document per file.

    A file over the size cap or with bytes that are no UTF-8 is one row with its failure and
    no record; the content of the former is not read.
    """
    files = spark.read.format("binaryFile").load(path)
    none = F.lit(None).cast("string")
    large = files.filter(F.col("length") > MAX_EXPORT_BYTES).select(F.col("path").alias("doc"), F.lit(0).alias("line_no"), none.alias("record_json"), F.lit("too-large").alias("failure"))
    text = F.col("content").cast("string")
    held = files.filter(F.col("length") <= MAX_EXPORT_BYTES).select(F.col("path").alias("doc"), F.when(F.is_valid_utf8(text), text).alias("text"))
    lines = held.filter("text is not null").select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "record_json")).withColumn("failure", none)
    broken = held.filter("text is null").select("doc", F.lit(0).alias("line_no"), none.alias("record_json"), F.lit("invalid-utf8").alias("failure"))
    return lines.unionByName(large).unionByName(broken)


def run_command(spark: SparkSession, ids: DataFrame, runner: Callable[[str], tuple[int, bytes, str]]) -> DataFrame:
    """(doc, line_no, record_json, failure) of the sessions asked for, exported by a command (SRC-1 to 3).

    ``runner`` gets a session's id and gives exit status, output and error text; it runs on
    the workers, once for each id of ``ids`` (session_id).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for key in pdf["session_id"]:
                status, output, error = runner(key)
                failure = failed_command(status, error) or ("too-large" if len(output) > MAX_EXPORT_BYTES else None)
                try:
                    lines = output.decode().split("\n") if failure is None else []
                except UnicodeDecodeError:
                    lines, failure = [], "invalid-utf8"
                out += [(key, i, line, None) for i, line in enumerate(lines)] if failure is None else [(key, 0, None, failure)]
            yield pd.DataFrame(out, columns=["doc", "line_no", "record_json", "failure"])

    return ids.select("session_id").distinct().mapInPandas(run, "doc string, line_no long, record_json string, failure string")


def failed_command(status: int, error: str | None) -> str | None:
    """A command's exit status and error text as a fixed category; null where it succeeded."""
    if status == 0:
        return None
    text = (error or "").lower()
    if status < 0 or "cancel" in text:
        return "canceled"
    if "too large" in text or "exceeds" in text:
        return "too-large"
    if "not found" in text and "session" in text:
        return "not-found"
    return "unavailable" if status in (126, 127) or "executable" in text or "no such file" in text else "exit"


def reviewed(spark: SparkSession, path: str, digests: list[str], limit: int = 1 << 20) -> DataFrame:
    """(path, text, failure): files whose SHA-256 is among the reviewed ones; others without text and with their failure."""
    files = spark.read.format("binaryFile").load(path)
    none = F.lit(None).cast("string")
    large = files.filter(F.col("length") > limit).select("path", none.alias("text"), F.lit("too-large").alias("failure"))
    known = F.sha2("content", 256).isin(*digests)
    held = files.filter(F.col("length") <= limit).select("path", F.when(known, F.col("content").cast("string")).alias("text"), F.when(~known, "not-reviewed").alias("failure"))
    return held.unionByName(large)


def failure_category(error: Column) -> Column:
    """A command's error text as a fixed category."""
    text = F.lower(error)
    return (
        F.when(text.contains("cancel"), "canceled").when(text.contains("too large") | text.contains("exceeds"), "too-large").when(text.contains("not found") & text.contains("session"), "not-found")
        .when(text.contains("executable") | text.contains("no such file"), "unavailable").when(error.isNotNull(), "exit")
    )
