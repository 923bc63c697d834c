"""The claim stage: from a document's range to a bounded, filtered input with its identity.

``ranges``: (analysis, doc, first, last, route, schema, prompt); entries, segments and
facts as the adapters give them.  A range is resolved against counts of its document
first, so only ranges within the limit of entries are ever spread to ordinals and joined,
on (doc, ordinal); the nested form then gathers at most 50 entries, 512 references and
256 facts.  The policy sees every free-text field; one blocked field blocks the analysis.

Failures carry the lineage reached so far: what was not reached is null.  A run's
processing key is its unit of reuse (``plans.commit.RunStore``).

Defined results: an analysis of an unknown document is ``source-revision-unavailable``; a
document whose ordinals are not 0..n-1, each once, or an entry whose segments are not, is
``semantic-input-invalid``, as are bounds that are not paired, reversed or beyond the end;
without bounds the whole document is meant, and a text that had to be cut is then an
error.  Without a configuration of its own a route is its configuration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as idn
from ..functions import privacy, utf8
from ..functions.identity import array, boolean, number, record, string
from ..session import cut
from .facts import EXTRACTOR as EXTRACTOR_OF_FACTS

#: Limits, names and labels of the claim stage.
MAX_ENTRIES, MAX_REFERENCES, MAX_FACTS = 50, 512, 256
MAX_TEXT, MAX_EVIDENCE_BYTES, MAX_FACT_BYTES, MAX_INPUT_BYTES, MAX_REQUEST_BYTES = 8192, 262_144, 131_072, 524_288, 524_288
EXTRACTOR, EXTRACTOR_VERSION, POLICY = "semantic-claims", "1", "deterministic-privacy-v1"
COMPLETE, PARTIAL = "complete-retained-snapshot", "partial"
UNAVAILABLE, INVALID, TOO_LARGE, BLOCKED = "source-revision-unavailable", "semantic-input-invalid", "semantic-input-too-large", "semantic-preflight-blocked"
_FACT_VALUE = (
    "tool struct<kind:string,name:string,namespace:string,relatedEntryOrdinal:bigint>, command struct<text:string>, error struct<text:string>, "
    "test struct<framework:string,command:struct<text:string>,passed:bigint,failed:bigint,skipped:bigint>, exitCode bigint"
)


def documents(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """Per document its revision, totals and whether its order is whole (SEL-2).  Entries and segments are unique by their keys."""
    text = F.octet_length("text")
    per_entry = segments.groupBy("doc", "ordinal").agg(
        F.count(F.lit(1)).alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"), F.sum(text).alias("bytes"), F.count(F.when(F.col("segment_kind") == "omitted", 1)).alias("omitted")
    )
    own = entries.groupBy("doc").agg(
        F.count(F.lit(1)).alias("total"), F.min("ordinal").alias("low_ordinal"), F.max("ordinal").alias("high_ordinal"),
        F.min(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("digest", "source_kind", "source_instance_id", "native_id")])).alias("r"),
    )
    parts = per_entry.groupBy("doc").agg(
        F.sum("n").alias("segments"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("text_bytes"), F.sum("omitted").alias("omitted"), F.max((F.col("low") != 0) | (F.col("high") != F.col("n") - 1)).alias("gaps")
    )
    out = own.join(parts, "doc", "left").fillna(0, ["segments", "text_bytes", "omitted"])
    whole = (F.col("low_ordinal") == 0) & (F.col("high_ordinal") == F.col("total") - 1) & ~F.coalesce("gaps", F.lit(False))
    rev = idn.revision(F.col("doc"), F.col("r.source_kind"), F.col("r.source_instance_id"), F.col("r.native_id"), F.lit(idn.DOCUMENT_SCHEME), F.col("r.digest"))
    return out.select("doc", "total", "segments", "text_bytes", F.col("omitted").alias("doc_omitted"), F.coalesce(whole, F.lit(False)).alias("whole"), F.col("r.digest").alias("digest"), rev.alias("revision"))


def fact_runs(docs: DataFrame) -> DataFrame:
    """(doc, processing_key) of each document's fact run (IDN-7): the whole document, as it was retained."""
    no = F.lit(False)
    last = F.when(F.col("total") > 0, F.col("total") - 1)
    chosen = idn.evidence_selection(
        F.lit("full"), idn.counted(F.lit(0), F.lit(0), no), (F.col("total"), F.col("total"), no, F.when(F.col("total") > 0, 0), last), idn.counted(F.col("segments"), F.col("segments"), no),
        (F.col("text_bytes"), F.col("text_bytes"), no), F.col("doc_omitted"), F.lit(0), F.lit(COMPLETE),
    )
    return docs.select("doc", idn.fact_key(F.col("revision"), chosen, *map(F.lit, EXTRACTOR_OF_FACTS)).alias("processing_key"))


def resolved(ranges: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranges against their documents (SEL-1, 2, 10): bounds, mode, and the first problem that needs no content."""
    r = ranges.join(docs, "doc", "left")
    paired = F.col("first").isNull() == F.col("last").isNull()
    explicit = F.col("first").isNotNull() | F.col("last").isNotNull()
    low = F.when(explicit, F.col("first")).otherwise(F.when(F.col("total") > 0, 0)).cast("long")
    high = F.when(explicit, F.col("last")).otherwise(F.when(F.col("total") > 0, F.col("total") - 1)).cast("long")
    inside = F.coalesce((F.col("first") >= 0) & (F.col("last") >= F.col("first")) & (F.col("last") < F.col("total")), F.lit(False))
    size = F.coalesce(high - low + 1, F.lit(0))
    problem = (
        F.when(F.col("total").isNull(), UNAVAILABLE).when(~F.col("whole"), INVALID).when(~paired | (explicit & ~inside), INVALID).when(size > MAX_ENTRIES, TOO_LARGE)
    )
    return r.withColumns({"explicit": explicit, "low": low, "high": high, "n_entries": size, "problem": problem})


def spread_entries(sound: DataFrame, entries: DataFrame) -> DataFrame:
    """(analysis, entry...) of sound ranges, by an equal join on (doc, ordinal): at most MAX_ENTRIES rows each."""
    each = sound.filter("low is not null").select("analysis", "doc", F.explode(F.sequence("low", "high")).alias("ordinal"))
    return each.join(entries, ["doc", "ordinal"])


def fact_homes(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per fact the one document and span of entries that hold all its evidence; facts without are left out."""
    cites = facts.select("fact_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", "doc", F.col("ordinal").alias("at")), "evidence_id", "left")
    spans = cites.groupBy("fact_id").agg(F.min("doc").alias("doc"), F.max("doc").alias("other"), F.max(F.col("doc").isNull()).alias("lost"), F.min("at").alias("ordinal"), F.max("at").alias("until"))
    return spans.filter("not lost and doc = other").select("fact_id", "doc", "ordinal", "until")


def _clean(report: Column, i: int) -> Column:
    return F.get(report["texts"], F.lit(i))


def _timestamp(at: Column) -> Column:
    fraction = F.rtrim(F.date_format(at, "SSSSSS"), F.lit("0"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.lit("Z"))


_ENTRY_TEXTS, _SEGMENT_TEXTS = ("kind", "actor", "tool_name", "tool_namespace"), ("segment_kind", "origin", "origin_confidence", "content_class", "source_type", "text")


def _text_json(text: Column, original: Column, cut: Column) -> Column:
    body = record([("text", string(text)), ("truncated", boolean(cut)), ("originalUtf8Bytes", number(original)), ("emittedUtf8Bytes", number(F.octet_length(text)))])
    return F.when(text.isNull(), F.lit("null")).otherwise(body)


def _segment_json(s: Column) -> Column:
    return record([
        ("evidenceId", string(s["evidence_id"])), ("ordinal", number(s["segment"])), ("kind", string(F.coalesce(s["segment_kind"], F.lit("")))), ("origin", string(F.coalesce(s["origin"], F.lit("")))),
        ("originConfidence", string(F.coalesce(s["origin_confidence"], F.lit("")))), ("text", _text_json(s["text"], s["original"], s["cut"])), ("contentClass", string(s["content_class"])), ("sourceType", string(s["source_type"])),
    ], optional=("text", "contentClass", "sourceType"))


def _fact_json() -> Column:
    """The outbound form of a fact (SEL-6): without its call id; texts as they are, with their sizes."""
    v, none = F.col("v"), ("null", "{}")
    text = lambda t: _text_json(t, F.octet_length(t), F.lit(False))
    tool = record([("kind", string(F.coalesce(v["tool"]["kind"], F.lit("")))), ("name", string(v["tool"]["name"])), ("namespace", string(v["tool"]["namespace"])), ("relatedEntryOrdinal", number(v["tool"]["relatedEntryOrdinal"]))], optional=("name", "namespace", "relatedEntryOrdinal"))
    test = record([("framework", string(F.coalesce(v["test"]["framework"], F.lit("")))), ("command", text(v["test"]["command"]["text"])), *[(k, number(v["test"][k])) for k in ("passed", "failed", "skipped")]], optional=("command", "passed", "failed", "skipped"))
    given = lambda name, body: F.when(v[name].isNull(), F.lit("null")).otherwise(body)
    value = record([("tool", given("tool", tool)), ("command", text(v["command"]["text"])), ("test", given("test", test)), ("exitCode", number(v["exitCode"])), ("error", text(v["error"]["text"]))], optional=("tool", "command", "test", "exitCode", "error"))
    return record([("id", string("fact_id")), ("kind", string("kind")), ("outcome", string("outcome")), ("value", value), ("evidenceIds", idn.strings(F.coalesce("evidence_ids", F.array().cast("array<string>"))))])


def chosen_content(sound: DataFrame, entries: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and segments of sound ranges, texts within MAX_TEXT."""
    e = spread_entries(sound, entries)
    s = e.select("analysis", "doc", "ordinal").join(segments, ["doc", "ordinal"])
    kept = utf8.cut(F.col("text"), MAX_TEXT)
    s = s.withColumns({"original": F.octet_length("text"), "kept": kept}).withColumn("cut", F.coalesce(F.octet_length("kept") < F.col("original"), F.lit(False)))
    return e, s.drop("text").withColumnRenamed("kept", "text")


def chosen_facts(sound: DataFrame, e: DataFrame, facts: DataFrame, homes: DataFrame) -> DataFrame:
    """(analysis, fact...) of the facts whose evidence is all selected (SEL-5)."""
    held = e.select("analysis", "doc", "ordinal").join(homes, ["doc", "ordinal"]).join(sound.select("analysis", "high"), "analysis").filter("until <= high")
    return held.select("analysis", "fact_id").join(facts, "fact_id").withColumn("v", F.from_json("value_json", _FACT_VALUE))


def filtered(e: DataFrame, s: DataFrame, f: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entries, segments and facts after the policy has seen all their free text (PRV-17), and the report of each analysis."""
    e2 = e.withColumn("p", privacy.preflight_all(F.array(*_ENTRY_TEXTS)))
    s2 = s.withColumn("p", privacy.preflight_all(F.array(*_SEGMENT_TEXTS)))
    texts = [F.col("kind"), F.col("outcome"), F.col("v.tool.kind"), F.col("v.tool.name"), F.col("v.tool.namespace"), F.col("v.command.text"), F.col("v.error.text"), F.col("v.test.framework"), F.col("v.test.command.text")]
    f2 = f.withColumn("p", privacy.preflight_all(F.array(*texts)))
    reports = reduce(DataFrame.unionByName, [x.select("analysis", "p.redactions", "p.blocked") for x in (e2, s2, f2)])
    blocked = reports.groupBy("analysis").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("blocked")))).alias("blocked"))  # few categories
    counts = reports.select("analysis", F.explode("redactions").alias("c")).groupBy("analysis", "c.category").agg(F.sum("c.count").alias("count"))
    listed = counts.groupBy("analysis").agg(F.array_sort(F.collect_list(F.struct("category", "count"))).alias("redactions"))
    v, p = F.col("v"), F.col("p")
    tool = F.when(v["tool"].isNotNull(), v["tool"].withField("kind", _clean(p, 2)).withField("name", _clean(p, 3)).withField("namespace", _clean(p, 4)))
    test = F.when(v["test"].isNotNull(), v["test"].withField("framework", _clean(p, 7)).withField("command", F.when(v["test"]["command"].isNotNull(), F.struct(_clean(p, 8).alias("text")))))
    command, error = (F.when(v[n].isNotNull(), F.struct(_clean(p, i).alias("text"))) for n, i in (("command", 5), ("error", 6)))
    f3 = f2.withColumn("v", v.withField("tool", tool).withField("test", test).withField("command", command).withField("error", error)).withColumns({"kind": _clean(p, 0), "outcome": _clean(p, 1)})
    e3 = e2.withColumns({c: _clean(p, i) for i, c in enumerate(_ENTRY_TEXTS)})
    s3 = s2.withColumns({c: _clean(p, i) for i, c in enumerate(_SEGMENT_TEXTS)})
    return e3.drop("p"), rebound(s3.drop("p")), f3.drop("p"), blocked.join(listed, "analysis", "left")


def rebound(s: DataFrame) -> DataFrame:
    """Texts that grew beyond MAX_TEXT by their placeholders, cut again (SEL-11)."""
    over = F.coalesce(F.octet_length("text") > MAX_TEXT, F.lit(False))
    return s.withColumns({"grown": over, "cut": F.col("cut") | over, "text": utf8.cut(F.col("text"), MAX_TEXT)})


def _entry_json(segments_json: Column) -> Column:
    ref = idn.evidence_id(F.col("doc"), F.col("digest"), F.col("ordinal"), F.lit(None), F.lit(""))
    return record([
        ("evidenceId", string(ref)), ("ordinal", number("ordinal")), ("kind", string(F.coalesce("kind", F.lit("")))), ("actor", string(F.coalesce("actor", F.lit("")))),
        ("timestamp", F.when(F.col("entry_ts").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), _timestamp(F.col("entry_ts")), F.lit('"')))), ("relatedEntryOrdinal", number("related")), ("toolName", string("tool_name")), ("toolNamespace", string("tool_namespace")),
        ("segments", segments_json),
    ], optional=("timestamp", "relatedEntryOrdinal", "toolName", "toolNamespace"))


_SEGMENT = ("segment", "evidence_id", "segment_kind", "origin", "origin_confidence", "text", "original", "cut", "content_class", "source_type")
_TALLY = ("original", "emitted", "cut", "omitted")


def _tallied() -> list[Column]:
    return [F.sum("original").alias("original"), F.sum(F.octet_length("text")).alias("emitted"), F.count(F.when(F.col("cut"), 1)).alias("cut"), F.count(F.when(F.col("segment_kind") == "omitted", 1)).alias("omitted"), F.count(F.lit(1)).alias("n")]


def _listed(n: Column) -> Column:
    """The bytes of brackets and commas around ``n`` items."""
    return F.greatest(n - 1, F.lit(0)) + 2


def measured(sound: DataFrame, e: DataFrame, s: DataFrame, f: DataFrame, facts_per_doc: DataFrame) -> DataFrame:
    """What ``encoded`` gives for the sizes alone, from sums: no section is put together."""
    per_entry = s.groupBy("analysis", "ordinal").agg(*_tallied(), F.sum(F.octet_length(_segment_json(F.struct(*_SEGMENT)))).alias("bytes"))
    own = e.join(per_entry, ["analysis", "ordinal"], "left").fillna(0, ["n", "bytes"])
    size = F.octet_length(_entry_json(F.lit(""))) + _listed(F.col("n")) + F.col("bytes")
    entries_ = own.groupBy("analysis").agg((F.sum(size) + _listed(F.count(F.lit(1)))).alias("entries_size"), F.sum("n").alias("n_segments"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _TALLY])
    facts_ = f.groupBy("analysis").agg((F.sum(F.octet_length(_fact_json())) + _listed(F.count(F.lit(1)))).alias("facts_size"), F.count(F.lit(1)).alias("n_facts"))
    out = sound.join(entries_, "analysis", "left").join(facts_, "analysis", "left").join(facts_per_doc, "doc", "left").fillna(0, ["n_segments", "n_facts", "doc_facts", *_TALLY])
    out = out.withColumns({"entries_size": F.coalesce("entries_size", F.lit(2)), "facts_size": F.coalesce("facts_size", F.lit(2)), "excluded": F.col("doc_facts") - F.col("n_facts")})
    out = _whole(out, F.lit(""), F.lit(""))
    return out.withColumns({"entries_bytes": F.col("entries_size"), "facts_bytes": F.col("facts_size"), "input_bytes": F.octet_length("input_json") + F.col("entries_size") + F.col("facts_size")})


def encoded(sound: DataFrame, e: DataFrame, s: DataFrame, f: DataFrame, facts_per_doc: DataFrame) -> DataFrame:
    """Per analysis its canonical input (SEL-3, 6, 8) with statistics and sizes; sections in order."""
    grouped = s.groupBy("analysis", "ordinal").agg(F.array_sort(F.collect_list(F.struct(*_SEGMENT))).alias("parts"), *_tallied())
    body = _entry_json(F.coalesce(array(F.transform(F.coalesce("parts", F.array().cast(grouped.schema["parts"].dataType)), _segment_json)), F.lit("[]")))
    own = e.join(grouped, ["analysis", "ordinal"], "left").withColumn("body", body)
    entries_json = own.groupBy("analysis").agg(
        array(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "body"))), lambda x: x["body"])).alias("entries_json"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_segments"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _TALLY],
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("place"), "fact_id", _fact_json().alias("body"))))
    facts_json = f.groupBy("analysis").agg(listed.alias("l")).select("analysis", array(F.transform("l", lambda x: x["body"])).alias("facts_json"), F.transform("l", lambda x: x["fact_id"]).alias("fact_ids"))
    out = sound.join(entries_json, "analysis", "left").join(facts_json, "analysis", "left").join(facts_per_doc, "doc", "left")
    zero = F.lit(0)
    out = out.withColumns({
        "entries_json": F.coalesce("entries_json", F.lit("[]")), "facts_json": F.coalesce("facts_json", F.lit("[]")), "fact_ids": F.coalesce("fact_ids", F.array().cast("array<string>")),
        **{c: F.coalesce(c, zero) for c in ("n_segments", "original", "emitted", "cut", "omitted")},
    })
    out = out.withColumns({"n_facts": F.size("fact_ids"), "excluded": F.coalesce("doc_facts", zero) - F.size("fact_ids")})
    out = _whole(out, F.col("entries_json"), F.col("facts_json"))
    return out.withColumns({"entries_bytes": F.octet_length("entries_json"), "facts_bytes": F.octet_length("facts_json"), "input_bytes": F.octet_length("input_json")})


def _whole(out: DataFrame, entries_json: Column, facts_json: Column) -> DataFrame:
    """Adds mode, coverage, the selection and the whole input around the given sections."""
    zero = F.lit(0)
    coverage = F.when((F.col("n_entries") != F.col("total")) | (F.col("cut") > 0), PARTIAL).otherwise(COMPLETE)
    out = out.withColumns({"coverage": coverage, "mode": F.when(F.col("explicit"), "range").otherwise("complete")})
    chosen = record([
        ("mode", string("mode")), ("selectedEntries", number("n_entries")), ("totalEntries", number("total")), ("firstOrdinal", number("low")), ("lastOrdinal", number("high")), ("originalTextUtf8Bytes", number("original")),
        ("emittedTextUtf8Bytes", number("emitted")), ("truncatedTextSegments", number("cut")), ("truncatedFactTexts", number(zero)), ("canonicalOmittedSegments", number("omitted")), ("excludedFactCount", number("excluded")), ("coverage", string("coverage")),
    ], optional=("firstOrdinal", "lastOrdinal"))
    omissions = record([("factAnalysis", record([("canonicalSegments", number("omitted")), ("omittedTextFactCount", number(zero)), ("omittedTextOriginalUtf8Bytes", number(zero)), ("unknownLineage", boolean(F.lit(False)))]))])
    out = out.withColumn("selection_json", chosen)
    whole = record([("schemaVersion", number(F.lit(1))), ("disposition", string(F.lit("untrusted-evidence"))), ("selection", F.col("selection_json")), ("entries", entries_json), ("facts", facts_json), ("omissions", omissions)])
    return out.withColumn("input_json", whole)


def over_limits() -> Column:
    """Whether an encoded input passes a limit (SEL-9, 10), or a text of a whole document was cut (SEL-7)."""
    return (
        (F.col("n_entries") + F.col("n_segments") > MAX_REFERENCES) | (F.col("n_facts") > MAX_FACTS) | (~F.col("explicit") & (F.col("cut") > 0))
        | (F.col("entries_bytes") > MAX_EVIDENCE_BYTES) | (F.col("facts_bytes") > MAX_FACT_BYTES) | (F.col("input_bytes") > MAX_INPUT_BYTES)
    )


def within_references(sound: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds to ranges within the limit of entries the problem of too many references, from counts alone."""
    counts = segments.groupBy("doc", "ordinal").agg(F.count(F.lit(1)).alias("c"))
    n = spread_entries(sound, counts).groupBy("analysis").agg(F.sum("c").alias("refs"))
    return sound.join(n, "analysis", "left").withColumn("problem", F.when(F.col("n_entries") + F.coalesce("refs", F.lit(0)) > MAX_REFERENCES, TOO_LARGE)).drop("refs")


def run_selection() -> Column:
    """The run's view of a prepared selection (SEL-12): relations are never selected."""
    partial = F.col("coverage") != COMPLETE
    return idn.evidence_selection(
        F.col("mode"), idn.counted(F.lit(0), F.lit(0), F.lit(False)), (F.col("n_entries"), F.col("total"), partial, F.col("low"), F.col("high")), idn.counted(F.col("n_segments"), F.col("segments"), partial),
        (F.col("emitted"), F.col("original"), F.col("cut") > 0), F.col("omitted"), F.col("cut"), F.col("coverage"),
    )


def route_problem() -> Column:
    """Whether a route is no sound one (PRV-19): its fields given, of the policy's version, and unchanged by the policy."""
    values = [F.coalesce(F.col("route")[f], F.lit("")) for f in idn.ROUTE_FIELDS]
    report = privacy.preflight_all(F.array(*values))
    kept = (F.size(report["blocked"]) == 0) & (report["texts"] == F.array(*values))
    given = F.col("route").isNotNull() & (F.least(*[F.length(v) for v in values]) > 0) & (F.col("route.privacyPolicyVersion") == POLICY)
    return ~F.coalesce(given & kept, F.lit(False))


_LINEAGE = ("selection_json", "run_selection_json", "input_digest", "processing_key", "fact_ids")


def processing_key() -> Column:
    """IDN-8 of a prepared row."""
    return idn.claim_key({
        "Revision": F.col("revision"), "Selection": F.col("selection_json"), "InputFactIDs": idn.strings("fact_ids"), "InputDigest": string("input_digest"), "Extractor": string(F.lit(EXTRACTOR)), "ExtractorVersion": string(F.lit(EXTRACTOR_VERSION)),
        "Schema": F.col("schema"), "PromptVersion": string("prompt"), "Route": idn.route(F.col("route")), "RouteConfig": string(idn.fingerprint(idn.route(F.col("route")))), "PrivacyVersion": string(F.lit(POLICY)),
    })


def prepare(ranges: DataFrame, entries: DataFrame, segments: DataFrame, facts: DataFrame, evidence: DataFrame, instructions: str = "") -> DataFrame:
    """Every analysis prepared, or failed with its category and the lineage reached (SEL-15, RUN-2, 3, ADM-17)."""
    routed = ranges.withColumn("bad_route", route_problem())
    r = resolved(routed, documents(entries, segments))
    r = cut(r.withColumn("problem", F.when(F.col("bad_route"), INVALID).otherwise(F.col("problem"))))  # one row an analysis, read many times
    early = r.filter("problem is not null")
    counted = cut(within_references(r.filter("problem is null"), segments))
    sound = counted.filter("problem is null")
    homes = fact_homes(facts, evidence)
    per_doc = facts.select("fact_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", "doc"), "evidence_id").groupBy("doc").agg(F.count_distinct("fact_id").alias("doc_facts"))
    e, s = map(cut, chosen_content(sound, entries, segments))
    f = cut(chosen_facts(sound, e, facts, homes))
    raw = measured(sound, e, s, f, per_doc).select("analysis", over_limits().alias("large"))
    e2, s2, f2, reports = filtered(e, s, f)
    grown = s2.groupBy("analysis").agg(F.max("grown").alias("grown"))
    out = encoded(sound, e2, s2, f2, per_doc).join(raw, "analysis").join(reports, "analysis", "left").join(grown, "analysis", "left")
    out = out.withColumn("run_selection_json", run_selection()).withColumn("input_digest", idn.fingerprint(F.col("input_json")))
    request = record([("instructions", string(F.lit(instructions))), ("promptVersion", string("prompt")), ("schema", F.col("schema")), ("route", idn.route(F.col("route"))), ("input", F.col("input_json"))])
    out = out.withColumns({"request_bytes": F.octet_length(request), "processing_key": processing_key()})
    complete = ~F.col("explicit") & F.coalesce("grown", F.lit(False))
    seen = F.size(F.coalesce("blocked", F.array().cast("array<string>")))
    problem = F.when(F.col("large"), TOO_LARGE).when(seen > 0, BLOCKED).when(complete | over_limits() | (F.col("request_bytes") > MAX_REQUEST_BYTES), TOO_LARGE)
    out = out.withColumn("problem", problem).withColumn("bounded", ~F.col("large") & (seen == 0) & ~complete & ~over_limits())
    sized = F.col("bounded")
    lineage = {
        "fact_ids": F.when(~F.col("large"), F.col("fact_ids")), "redactions": F.when(~F.col("large"), F.when(seen > 0, F.lit(None)).otherwise(F.col("redactions"))), "blocked": F.when(~F.col("large"), F.col("blocked")),
        **{c: F.when(sized, F.col(c)) for c in ("selection_json", "run_selection_json", "input_digest", "request_bytes")}, "processing_key": F.when(F.col("problem").isNull(), F.col("processing_key")),
    }
    columns = ["analysis", "doc", "revision", "schema", "route", "prompt", "problem", "n_entries", "n_segments", "n_facts", "excluded", "coverage", "entries_bytes", "facts_bytes", "input_bytes", "request_bytes", "redactions", "blocked", *_LINEAGE]
    done = out.withColumns(lineage).select(*columns)
    failed = early.unionByName(counted.filter("problem is not null")).select("analysis", "doc", "revision", "schema", "route", "prompt", "problem", "n_entries")
    return done.unionByName(failed, allowMissingColumns=True)


def lineage_problem() -> Column:
    """What of a prepared row does not follow from the rest of it (SEL-16, RUN-4), or null."""
    partly = F.col("problem").isNotNull()
    whole = F.col("selection_json").isNotNull() & F.col("run_selection_json").isNotNull() & F.col("input_digest").isNotNull() & F.col("fact_ids").isNotNull()
    chosen = F.from_json("selection_json", "mode string, selectedEntries bigint, firstOrdinal bigint, lastOrdinal bigint, coverage string, emittedTextUtf8Bytes bigint")
    view = F.from_json("run_selection_json", "mode string, coverage string, entries struct<selected:bigint,firstOrdinal:bigint,lastOrdinal:bigint>, segmentText struct<emittedUtf8Bytes:bigint>")
    agree = (
        chosen["mode"].eqNullSafe(view["mode"]) & chosen["coverage"].eqNullSafe(view["coverage"]) & chosen["selectedEntries"].eqNullSafe(view["entries"]["selected"]) & chosen["firstOrdinal"].eqNullSafe(view["entries"]["firstOrdinal"])
        & chosen["lastOrdinal"].eqNullSafe(view["entries"]["lastOrdinal"]) & chosen["emittedTextUtf8Bytes"].eqNullSafe(view["segmentText"]["emittedUtf8Bytes"])
    )
    return (
        F.when(partly & F.col("processing_key").isNotNull(), "failed-with-key").when(partly & F.col("input_digest").isNotNull() & F.col("selection_json").isNull(), "digest-without-selection").when(partly, F.lit(None).cast("string"))
        .when(~whole | F.col("processing_key").isNull(), "incomplete").when(~agree, "selection-projection").when(~F.coalesce(processing_key() == F.col("processing_key"), F.lit(False)), "processing-identity")
    )
