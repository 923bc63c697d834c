"""Canonical JSON and content-derived identity, as JVM column expressions.

The canonical form has its keys in declared order, no spaces, ``null`` for what is
absent unless the key is optional, and ``<``, ``>``, ``&`` and the two line separators
escaped.  Values are built from columns, so fingerprints stay in whole-stage code.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the canonical form writes unlike Spark's own JSON.
_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}
_LOWER_HEX = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def string(col: Column | str) -> Column:
    """A JSON string; null becomes ``null``."""
    col = F.col(col) if isinstance(col, str) else col
    text = F.to_json(F.array(col))
    text = F.substring(text, 2, 1_000_000_000)
    text = F.substring(text, F.lit(1), F.length(text) - 1)
    for ch, escape in _ESCAPES.items():
        text = F.replace(text, F.lit(ch), F.lit(escape))
    for digits in _LOWER_HEX:
        text = F.replace(text, F.lit(f"\\u00{digits}"), F.lit(f"\\u00{digits.lower()}"))
    return F.when(col.isNull(), F.lit("null")).otherwise(text)


def number(col: Column | str) -> Column:
    """An integer, or a float in shortest form without ``.0``; null becomes ``null``, as do values that JSON cannot hold."""
    text = F.regexp_replace((F.col(col) if isinstance(col, str) else col).cast("string"), r"\.0$", "")
    return F.coalesce(F.when(~text.rlike("[Nn]"), text), F.lit("null"))


def boolean(col: Column | str) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("null"))


def array(items: Column) -> Column:
    """An array column of JSON texts; a null array becomes ``null``, an empty one ``[]``."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), F.lit("null"))


def strings(col: Column | str) -> Column:
    """An array of strings as JSON."""
    return array(F.transform(F.col(col) if isinstance(col, str) else col, string))


def record(fields: Sequence[tuple[str, Column]], optional: Sequence[str] = ()) -> Column:
    """An object with its keys in the given order; optional keys vanish where their value is null or empty."""
    parts = []
    for key, value in fields:
        pair = F.concat(F.lit(f'"{key}":'), value)
        if key in optional:
            pair = F.when(value.isin("null", '""', "[]"), F.lit(None)).otherwise(pair)
        parts.append(pair)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fingerprint(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def derived_id(prefix: str, value: Column) -> Column:
    """The prefix and the first 16 bytes of the value's SHA-256 in hex."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, 32))


def evidence_id(source: Column, digest: Column, entry: Column, segment: Column, content_hash: Column) -> Column:
    """The id of an entry (null segment) or segment."""
    body = record([("Source", string(source)), ("Digest", string(digest)), ("Entry", number(entry)), ("Segment", number(segment)), ("Hash", string(F.coalesce(content_hash, F.lit(""))))])
    return derived_id("eref_", fingerprint(body))


def event_fingerprint(version: Column, kind: Column, subject_type: Column, subject_id: Column, payload: Column, references: Column) -> Column:
    """The identity of an event: everything but its time and publication state.

    ``payload``: canonical JSON with sorted keys; ``references``: array of (record_type, record_id).
    """
    refs = array(F.transform(references, lambda r: record([("recordType", string(r["record_type"])), ("recordId", string(r["record_id"]))])))
    return fingerprint(record([("SchemaVersion", number(version)), ("Type", string(kind)), ("SubjectType", string(subject_type)), ("SubjectID", string(subject_id)), ("Payload", payload), ("References", refs)]))


def digest(scheme: Column, value: Column) -> Column:
    return record([("scheme", string(scheme)), ("digest", string(value))])


#: The kind of source whose documents these are, and the digest schemes of documents and texts.
SOURCE_KIND, DOCUMENT_SCHEME, TEXT_SCHEME = "sessions", "sha256-sessions-document-jcs-v1", "sha256-utf8-v1"


def revision(doc: Column, native_kind: Column, instance: Column, native_id: Column, scheme: Column, document_digest: Column) -> Column:
    """The six-field identity of a document revision, keys in declared order."""
    text = lambda c: string(F.coalesce(c, F.lit("")))
    return record([
        ("sourceKind", string(F.lit(SOURCE_KIND))), ("canonicalId", text(doc)), ("nativeSourceKind", text(native_kind)), ("sourceInstanceId", text(instance)), ("nativeId", text(native_id)), ("documentDigest", digest(scheme, document_digest)),
    ])


#: The keys of a reference that vanish where they are empty.
REFERENCE_OPTIONAL = ("documentDigestScheme", "segmentOrdinal", "entryKind", "actor", "origin", "originConfidence", "relatedEntryOrdinal", "toolCallId", "toolName", "toolNamespace", "contentHashScheme")


def evidence_ref(reference_id: Column, doc: Column, scheme: Column, document_digest: Column, entry: Column, segment: Column, fields: dict[str, Column], hash_scheme: Column, content_hash: Column) -> Column:
    """A whole reference; ``fields``: entryKind, actor, origin, originConfidence, relatedEntryOrdinal, toolCallId, toolName, toolNamespace."""
    text = lambda c: string(F.coalesce(c, F.lit("")))
    f = fields
    return record([
        ("id", string(reference_id)), ("sourceKind", string(F.lit(SOURCE_KIND))), ("sourceIdentity", text(doc)), ("documentDigestScheme", text(scheme)), ("documentDigest", text(document_digest)), ("entryOrdinal", number(entry)),
        ("segmentOrdinal", number(segment)), ("entryKind", text(f["entryKind"])), ("actor", text(f["actor"])), ("origin", text(f["origin"])), ("originConfidence", text(f["originConfidence"])), ("relatedEntryOrdinal", number(f["relatedEntryOrdinal"])),
        ("toolCallId", text(f["toolCallId"])), ("toolName", text(f["toolName"])), ("toolNamespace", text(f["toolNamespace"])), ("contentHashScheme", text(hash_scheme)), ("contentHash", text(content_hash)), ("excerpt", string(F.lit(""))),
    ], optional=REFERENCE_OPTIONAL)


def counted(selected: Column, total: Column, truncated: Column) -> Column:
    return record([("selected", number(selected)), ("total", number(total)), ("truncated", boolean(truncated))])


def evidence_selection(mode: Column, relations: Column, entries: tuple[Column, Column, Column, Column, Column], segments: Column, text: tuple[Column, Column, Column], omitted: Column, truncated: Column, coverage: Column) -> Column:
    """The selection of a run: ``entries`` (selected, total, truncated, first, last), ``text`` (emitted, original, truncated)."""
    selected, total, cut, first, last = entries
    emitted, original, text_cut = text
    return record([
        ("mode", string(mode)), ("relations", relations),
        ("entries", record([("selected", number(selected)), ("total", number(total)), ("truncated", boolean(cut)), ("firstOrdinal", number(first)), ("lastOrdinal", number(last))])), ("segments", segments),
        ("segmentText", record([("emittedUtf8Bytes", number(emitted)), ("originalUtf8Bytes", number(original)), ("truncated", boolean(text_cut))])),
        ("canonicalOmittedSegments", number(omitted)), ("truncatedTextSegments", number(truncated)), ("coverage", string(coverage)),
    ])


def fact_fingerprint(rev: Column, kind: Column, value: Column, outcome: Column, rule: Column, extractor: Column, version: Column, schema: Column, evidence: Column) -> Column:
    """The identity of a fact; ``rev`` and ``value`` are canonical JSON, ``evidence`` an array of whole references as JSON."""
    names = ("Revision", "Kind", "Value", "Outcome", "Rule", "Extractor", "Version", "Schema", "Evidence")
    return fingerprint(record(list(zip(names, (rev, string(kind), value, string(outcome), string(rule), string(extractor), string(version), number(schema), array(evidence))))))


def fact_key(rev: Column, selection: Column, extractor: Column, version: Column, schema: Column) -> Column:
    """The processing key of a fact run."""
    return fingerprint(record([("Revision", rev), ("Selection", selection), ("Extractor", string(extractor)), ("Version", string(version)), ("Schema", number(schema))]))


def schema_identity(name: Column, version: Column, mark: Column) -> Column:
    return record([("name", string(name)), ("version", number(version)), ("disposition", string(F.lit("strict"))), ("digest", string(mark))])


#: The fields of a requested route.
ROUTE_FIELDS = ("alias", "gateway", "model", "provider", "routeVersion", "privacyPolicyVersion")


def route(fields: Column) -> Column:
    """A requested route (a struct of ROUTE_FIELDS)."""
    return record([(f, string(F.coalesce(fields[f], F.lit("")))) for f in ROUTE_FIELDS])


#: The components of a claim run's processing key, in order.
KEY_PARTS = ("Revision", "Selection", "InputFactIDs", "InputDigest", "Extractor", "ExtractorVersion", "Schema", "PromptVersion", "Route", "RouteConfig", "PrivacyVersion")


def claim_key(parts: dict[str, Column]) -> Column:
    """The processing key of a claim run from the canonical JSON of its components."""
    if tuple(parts) != KEY_PARTS:
        raise ValueError("a processing key needs exactly its components, in order")
    return fingerprint(record(list(parts.items())))


def compact_json(text: str) -> str:
    """A JSON document in the canonical form, its keys in the order given."""
    out = json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)
    for ch, escape in _ESCAPES.items():
        out = out.replace(ch, escape)
    return out


def document_fingerprint(text: str) -> str:
    """The digest of a JSON document, such as an output schema or a route's configuration."""
    return hashlib.sha256(compact_json(text).encode()).hexdigest()


def same(left: Column, right: Column) -> Column:
    """Whether two canonical values are one: their fingerprints are equal and both are given."""
    return F.coalesce(fingerprint(left) == fingerprint(right), F.lit(False))


#: The components of a claim's identity, in order.
CLAIM_KEYS = (
    "ProcessingKey", "Type", "Statement", "Status", "Confidence", "SupportingEvidence", "ContradictingEvidence", "SupportingFactIDs", "Outcome", "Actor", "Origin", "Subject", "Scope", "Attribution",
    "ExtractorName", "ExtractorVersion", "SchemaVersion", "PromptVersion", "RequestedRoute", "ResolvedProvider", "ResolvedModel",
)


def claim_fingerprint(parts: dict[str, Column]) -> Column:
    """The identity of a claim from the canonical JSON of its components; the run's id and its time are none of them."""
    if tuple(parts) != CLAIM_KEYS:
        raise ValueError("a claim's identity needs exactly its components, in order")
    return fingerprint(record(list(parts.items())))
