"""Recorded model responses as candidates and execution metadata, and errors as categories.

No call is made here: responses are rows of raw JSON (a table or a folder of files).
``from_json`` reads what is needed; a predicate per rule names the first that fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of a response.
MAX_RESPONSE, MAX_TOKENS, MAX_REQUEST_ID = 2 * 1024 * 1024, 1_000_000_000, 256
CANDIDATE = (
    "struct<type:string,statement:string,status:string,confidence:double,supportingEvidenceIds:array<string>,contradictingEvidenceIds:array<string>,supportingFactIds:array<string>,"
    "outcome:string,actor:string,origin:string,subject:string,scope:string,attribution:string>"
)
RESPONSE = (
    "id string, choices array<struct<finish_reason:string,message:struct<content:string,refusal:string,tool_calls:array<string>,"
    "provider_metadata:struct<gateway:struct<cost:string,generationId:string,routing:struct<originalModelId:string,canonicalSlug:string,resolvedProvider:string>>>>>>, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
)
COST = r"^(?=.{1,64}$)[0-9]+(\.[0-9]+)?$"


def usage_problem(given: Column, made: Column, total: Column) -> Column:
    """Whether token counts are out of range or do not add up; absent ones are no problem."""
    odd = [F.coalesce((c < 0) | (c > MAX_TOKENS), F.lit(False)) for c in (given, made, total)]
    return odd[0] | odd[1] | odd[2] | F.coalesce(given + made != total, F.lit(False))


def execution_problem(m: Column) -> Column:
    """The first rule that execution metadata (a struct) breaks, or null."""
    route = m["requestedRoute"]
    rewritten = F.coalesce((m["resolvedModel"] != route["model"]) | (m["resolvedProvider"] != route["provider"]), F.lit(False))
    unresolved = m["resolvedModel"].isNull() | m["resolvedProvider"].isNull()
    return (
        F.when(route["model"].isNull(), "route").when(unresolved, "unresolved").when(rewritten, "rewritten").when(usage_problem(m["inputTokens"], m["outputTokens"], m["totalTokens"]), "usage")
        .when(F.coalesce(m["latencyMilliseconds"] < 0, F.lit(False)), "latency").when(F.coalesce(~m["costUsd"].rlike(COST), F.lit(False)), "cost")
        .when(F.coalesce((F.octet_length(m["requestId"]) > MAX_REQUEST_ID) | m["requestId"].rlike(r"[\x00-\x20\x7f]"), F.lit(False)), "request-id")
    )


def decoded(responses: DataFrame, model: str, provider: str) -> DataFrame:
    """(request, problem, resolved model and provider, tokens, cost, claims) of raw responses (request, body)."""
    large = F.octet_length("body") > MAX_RESPONSE
    r = responses.select("request", large.alias("large"), F.from_json(F.when(~large, F.col("body")), RESPONSE).alias("r"))
    choice = F.get("r.choices", F.lit(0))
    message, gateway = choice["message"], choice["message"]["provider_metadata"]["gateway"]
    routing, usage = gateway["routing"], F.col("r.usage")
    claims = F.from_json(message["content"], f"claims array<{CANDIDATE}>")["claims"]
    problem = (
        F.when(F.col("large"), "too-large").when(F.coalesce(F.size("r.choices"), F.lit(-1)) != 1, "choices").when(~choice["finish_reason"].eqNullSafe("stop"), "finish").when(F.coalesce(message["refusal"], F.lit("")) != "", "refusal")
        .when(F.coalesce(F.size(message["tool_calls"]), F.lit(0)) > 0, "tool-call").when(~(routing["originalModelId"].eqNullSafe(model) & routing["canonicalSlug"].eqNullSafe(model) & routing["resolvedProvider"].eqNullSafe(provider)), "rewritten")
        .when(F.coalesce(~gateway["cost"].rlike(COST), F.lit(False)), "cost").when(usage_problem(usage["prompt_tokens"], usage["completion_tokens"], usage["total_tokens"]), "usage").when(claims.isNull(), "content")
    )
    return r.select("request", problem.alias("problem"), routing["canonicalSlug"].alias("model"), routing["resolvedProvider"].alias("provider"), usage["total_tokens"].alias("tokens"), gateway["cost"].alias("cost"), F.when(problem.isNull(), claims).alias("claims"))


def error_category(status: Column, message: Column, timed_out: Column) -> Column:
    """A failed request as a fixed category, by its status and what its message speaks of."""
    text = F.lower(F.coalesce(message, F.lit("")))
    says = lambda *words: text.rlike("|".join(words))
    rejected = F.when(says("schema", "response_format"), "schema").when(says("context length", "maximum context", "context window", "too many tokens"), "context").when(says("content policy", "safety policy", "moderation"), "content").otherwise("request")
    return (
        F.when(timed_out | (status == 408), "timeout").when(status == 401, "authentication").when(status.isin(402, 403), "permission").when(status == 429, "rate-limited").when(status >= 500, "upstream").when(status >= 400, rejected).otherwise("transport")
    )


def sanitized(text: Column, limit: int = 1024) -> Column:
    """A failure text without control characters, within the limit."""
    from ..functions.utf8 import cut

    return cut(F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " ")), limit)
