"""Evaluation corpora: reviewed JSON files as tables, checked as a whole.

A corpus file is read under an explicit schema and exploded into cases, entries, segments,
facts and expectations.  What a row can tell alone is a predicate; relations between
entries are an equi-join of a result with the entry it relates to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.admission import TYPES
from .exports import reviewed

MAX_BYTES = 1 << 20
SCHEMA = """
schemaVersion int, cases array<struct<id:string,intent:string,
 entries:array<struct<ordinal:bigint,kind:string,actor:string,relatedEntryOrdinal:bigint,toolCallId:string,toolName:string,toolNamespace:string,segments:array<struct<ordinal:bigint,kind:string,origin:string,text:string>>>>,
 facts:array<struct<id:string,kind:string,outcome:string,evidence:array<struct<entryOrdinal:bigint,segmentOrdinal:bigint>>,value:struct<exitCode:bigint,error:string,test:struct<framework:string,passed:bigint,failed:bigint,skipped:bigint>>>>,
 machineExpectations:array<struct<id:string,kind:string,value:string>>,humanCriteria:array<struct<id:string,description:string>>>>
""".replace("\n", "")
#: Vocabularies of a corpus.
ENTRY_KINDS, ACTORS = ("message", "system", "tool-call", "tool-result"), ("human", "model", "tool", "system")
FACT_KINDS, OUTCOMES = ("error-output", "exit-code", "test-result"), ("success", "failure", "unknown")
EXPECTATIONS = ("must-be-empty", "must-include-claim-type", "must-not-include-outcome")
ID = r"^[a-z0-9][a-z0-9-]{0,127}$"


@dataclass
class Corpus:
    """The tables of a corpus, each keyed by its case."""

    cases: DataFrame
    entries: DataFrame
    segments: DataFrame
    facts: DataFrame
    expectations: DataFrame
    criteria: DataFrame


def load(spark: SparkSession, path: str, digests: list[str]) -> Corpus:
    """The reviewed corpora below ``path``: files within the size cap with one of the digests."""
    files = reviewed(spark, path, digests, MAX_BYTES).filter("failure is null").select(F.from_json("text", SCHEMA).alias("c"))
    cases = files.select(F.posexplode("c.cases").alias("place", "c")).select("place", F.col("c.id").alias("case"), "c.*")
    entries = cases.select("case", F.posexplode("entries").alias("place", "e")).select("case", "place", "e.*")
    segments = entries.select("case", F.col("ordinal").alias("entry"), F.posexplode("segments").alias("place", "s")).select("case", "entry", "place", "s.*")
    facts = cases.select("case", F.posexplode("facts").alias("place", "f")).select("case", "place", "f.*")
    expectations = cases.select("case", F.explode("machineExpectations").alias("x")).select("case", "x.*")
    criteria = cases.select("case", F.explode("humanCriteria").alias("x")).select("case", "x.*")
    return Corpus(cases.select("place", "case", "intent"), entries, segments, facts, expectations, criteria)


def _bad(rows: DataFrame, rule: str, condition) -> DataFrame:
    return rows.filter(F.coalesce(condition, F.lit(True))).select("case", F.lit(rule).alias("rule"))


def violations(c: Corpus) -> DataFrame:
    """(case, rule) of every broken rule of the corpus; an admissible corpus has none."""
    e, f = c.entries, c.facts
    entry = ~(F.col("ordinal") == F.col("place")) | ~F.col("kind").isin(*ENTRY_KINDS) | ~F.col("actor").isin(*ACTORS) | (F.coalesce(F.size("segments"), F.lit(0)) < 1)
    relation = F.coalesce((F.col("relatedEntryOrdinal") < 0) | (F.col("relatedEntryOrdinal") >= F.col("place")), F.lit(False))
    calls = e.select("case", F.col("ordinal").alias("relatedEntryOrdinal"), F.col("kind").alias("call_kind"), F.col("toolCallId").alias("call_id"))
    results = e.filter("kind = 'tool-result' and relatedEntryOrdinal is not null").join(calls, ["case", "relatedEntryOrdinal"], "left")
    tool = ~((F.col("call_kind") == "tool-call") & (F.col("call_id") != "") & (F.col("call_id") == F.col("toolCallId")))
    segment = ~(F.col("ordinal") == F.col("place")) | (F.col("kind") != "text") | ~F.col("origin").isin(*ACTORS) | ~F.octet_length(F.trim("text")).between(1, 8192)
    values = sum(F.when(F.col(f"value.{n}").isNotNull(), 1).otherwise(0) for n in ("exitCode", "error", "test"))
    fact = (
        ~F.col("id").rlike(ID) | ~F.col("kind").isin(*FACT_KINDS) | ~F.col("outcome").isin(*OUTCOMES) | (F.coalesce(F.size("evidence"), F.lit(0)) < 1) | (values == 0)
        | ((F.col("kind") == "error-output") & (values != 1)) | ((F.col("kind") == "test-result") & (F.col("value.test").isNull() | F.col("value.exitCode").isNull()))
    )
    cited = f.select("case", F.explode("evidence").alias("x")).select("case", F.col("x.entryOrdinal").alias("ordinal"), F.col("x.segmentOrdinal").alias("segment"))
    placed = cited.join(e.select("case", "ordinal", F.size("segments").alias("n")), ["case", "ordinal"], "left")
    coordinate = F.col("n").isNull() | F.coalesce((F.col("segment") < 0) | (F.col("segment") >= F.col("n")), F.lit(False))
    kind, value = F.col("kind"), F.coalesce("value", F.lit(""))
    expectation = ~F.col("id").rlike(ID) | ~kind.isin(*EXPECTATIONS) | ((kind == EXPECTATIONS[0]) & (value != "")) | ((kind == EXPECTATIONS[1]) & ~value.isin(*TYPES)) | ((kind == EXPECTATIONS[2]) & ~value.isin(*OUTCOMES))
    criterion = ~F.col("id").rlike(ID) | ~F.octet_length(F.trim("description")).between(1, 1024)
    ids = c.expectations.select("case", "id").unionByName(c.criteria.select("case", "id"))
    twice = ids.groupBy("case", "id").count().filter("count > 1").unionByName(f.groupBy("case", "id").count().filter("count > 1"))
    out = _bad(e, "entry", entry)
    for part in (
        _bad(e, "relation", relation), _bad(results, "tool-relation", tool), _bad(c.segments, "segment", segment), _bad(f, "fact", fact), _bad(placed, "coordinate", coordinate),
        _bad(c.expectations, "expectation", expectation), _bad(c.criteria, "criterion", criterion), twice.select("case", F.lit("duplicate-id").alias("rule")),
    ):
        out = out.unionByName(part)
    return out


def documents(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Entries and segments of the cases in the shape that the operators take."""
    entries = c.entries.select(F.col("case").alias("doc"), F.sha2("case", 256).alias("digest"), "ordinal", "kind", "actor", F.col("relatedEntryOrdinal").alias("related"), F.col("toolCallId").alias("call_id"), F.col("toolName").alias("tool_name"), F.col("toolNamespace").alias("tool_namespace"))
    return entries, c.segments.select(F.col("case").alias("doc"), F.col("entry").alias("ordinal"), F.col("ordinal").alias("segment"), "origin", "text")


def same_profile(reported: DataFrame, c: Corpus) -> bool:
    """Whether a report (place, case) lists the corpus' cases in their order: one count of what differs."""
    both = reported.select("place", "case", F.lit(1).alias("n")).unionByName(c.cases.select("place", "case", F.lit(-1).alias("n")))
    return both.groupBy("place", "case").agg(F.sum("n").alias("n")).filter("n <> 0").isEmpty()
