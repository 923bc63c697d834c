"""Deterministic privacy policy over text: what blocks, what is redacted, in which order.

The blocking forms and path forms are JVM expressions as well (:func:`blocked_by`,
:func:`without_paths`); URLs, addresses and tokens need parsing, so the whole policy runs
as Arrow-backed pandas UDFs (:func:`preflight`, :func:`postflight`).
"""

from __future__ import annotations

import base64
import binascii
import ipaddress
import json
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLICY = "deterministic-privacy-v1"
PATH, CREDENTIALS, HOST = "local-path", "url-credentials", "local-or-private-host"
PLACEHOLDER = {c: f"<redacted:{c}>" for c in (PATH, CREDENTIALS, HOST)}

#: Forms that block a batch.
PRIVATE_KEY = r"(?i)-----BEGIN[ \t]+(?:(?:ENCRYPTED[ \t]+)?(?:RSA[ \t]+|EC[ \t]+|DSA[ \t]+|OPENSSH[ \t]+)?PRIVATE[ \t]+KEY|PGP[ \t]+PRIVATE[ \t]+KEY[ \t]+BLOCK)-----"
AUTHORIZATION = r"""(?i)(?:^|[^A-Za-z0-9_-])(?:proxy-)?authorization(?:\\?["'])?[\t\n\f\r ]*[:=][\t\n\f\r ]*(?:\\?["'])?[\t\n\f\r ]*[A-Za-z][A-Za-z0-9+._~-]*(?:[ \t]+[A-Za-z0-9._~+/=-]{4,})?"""
PROVIDER_TOKEN = r"(?:^|[^A-Za-z0-9_-])(?:sk-(?:proj-|svcacct-|ant-)?[A-Za-z0-9_-]{20,}|csk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{20,255}|xox[baprs]-[A-Za-z0-9-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[0-9A-Za-z_-]{35}|sk_(?:live|test)_[A-Za-z0-9]{16,})(?:$|[^A-Za-z0-9_-])"
JWT = r"(?:^|[^A-Za-z0-9_-])([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)(?:$|[^A-Za-z0-9_-])"
#: Forms of paths, URLs, addresses and local hosts.
QUOTED_PATH = r"""(?i)(["'`])((?:~?/|[A-Z]:[\\/])[^"'`\r\n]+)(["'`])"""
POSIX_PATH = r"""(^|[\t\r\n >"'(:=\[{`])((?:~(?:/[^/\t\n\f\r "'<>),;}\]]+)+|/(?:[^/\t\n\f\r "'<>),;}\]]+)(?:/[^/\t\n\f\r "'<>),;}\]]+)+|/(?:tmp|root)))"""
WINDOWS_PATH = r"""(?i)(^|[\t\r\n >"'(=\[{`])([A-Z]:[\\/][^\\/\t\n\f\r "'<>),;}\]]+(?:[\\/][^\\/\t\n\f\r "'<>),;}\]]+)*)"""
URL = r"""(?i)(?<![0-9A-Za-z_])[a-z][a-z0-9+.-]*://[^\t\n\f\r <>"']+"""
URL_CREDENTIALS = r"(?i)(?<![0-9A-Za-z_])[a-z][a-z0-9+.-]*://([^\t\n\f\r /@]+(?::[^\t\n\f\r /@]*)?)@"
IPV4 = r"(?<![0-9A-Za-z_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z_])"
BRACKETED_IP = r"\[[0-9A-Fa-f:.%]+\]"
IPV6 = r"(?i)(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?:%[a-z0-9_.-]+)?"
LOOPBACK_V6 = r"(?<![0-9A-Fa-f:])::1(?![0-9A-Fa-f:])"
LOCAL_HOST = r"(?i)(?<![0-9A-Za-z_])(?:localhost|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:localhost|local|internal|lan))(?::[0-9]{1,5})?(?![0-9A-Za-z_])"
LOCAL_SUFFIXES = (".localhost", ".local", ".internal", ".lan")
LOCAL_NETWORKS = tuple(map(ipaddress.ip_network, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/32", "100.64.0.0/10", "fc00::/7", "::1/128", "fe80::/10", "::/128")))

_RE = {n: re.compile(p, re.ASCII) for n, p in (("key", PRIVATE_KEY), ("auth", AUTHORIZATION), ("token", PROVIDER_TOKEN), ("jwt", JWT), ("quoted", QUOTED_PATH), ("posix", POSIX_PATH), ("windows", WINDOWS_PATH), ("url", URL), ("cred", URL_CREDENTIALS), ("v4", IPV4), ("bracket", BRACKETED_IP), ("v6", IPV6), ("loop", LOOPBACK_V6), ("host", LOCAL_HOST))}


def local_address(text: str) -> bool:
    """Whether a literal address is private, loopback, link-local, unspecified or carrier-grade."""
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return False
    address = getattr(address, "ipv4_mapped", None) or address
    return any(address.version == n.version and ipaddress.ip_address(str(address).split("%")[0]) in n for n in LOCAL_NETWORKS)


def local_host(name: str) -> bool:
    host = name.lower().removesuffix(".")
    return host == "localhost" or host.endswith(LOCAL_SUFFIXES) or local_address(host.split("%")[0])


def _json_object(part: str) -> dict | None:
    try:
        value = json.loads(base64.b64decode(part + "=" * (-len(part) % 4), altchars=b"-_", validate=True))
    except (ValueError, binascii.Error):
        return None
    return value if isinstance(value, dict) else None


def _has_jwt(text: str) -> bool:
    for head, body, _ in _RE["jwt"].findall(text):
        header = _json_object(head)
        algorithm = header.get("alg") if header else None
        if isinstance(algorithm, str) and algorithm.strip() and _json_object(body) is not None:
            return True
    return False


def blocking(text: str) -> set[str]:
    """Categories for which a text may not leave at all."""
    tests: tuple[tuple[str, Callable[[str], object]], ...] = (("private-key", _RE["key"].search), ("authorization-header", _RE["auth"].search), ("provider-token", _RE["token"].search), ("jwt", _has_jwt))
    return {name for name, test in tests if test(text)}


def _url(found: str, counts: Counter) -> str:
    core = found.rstrip(".,;!?)")
    tail = found[len(core) :]
    scheme, _, rest = core.partition("://")
    scheme = scheme.lower()
    if scheme == "file":
        counts[PATH] += 1
        return PLACEHOLDER[PATH] + tail
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    authority, path = rest[:end], rest[end:]
    user, at, place = authority.rpartition("@")
    name = place[1 : place.find("]")] if place.startswith("[") and "]" in place else place.split(":")[0]
    if not place or (not place.startswith("[") and not re.fullmatch(r"[^\s\[\]\\^`{|}:]*(?::\d*)?", place)):
        return found
    if at:
        counts[CREDENTIALS] += 1
    if local_host(name):
        counts[HOST] += 1
        place = PLACEHOLDER[HOST]
    return f"{scheme}://{PLACEHOLDER[CREDENTIALS] + '@' if at else ''}{place}{path}{tail}"


def redact(text: str, counts: Counter) -> str:
    """Paths, then URLs, then addresses, then hosts; the order is part of the policy."""

    def path(form: str, keep_after: bool) -> None:
        nonlocal text
        text, n = _RE[form].subn(lambda m: m[1] + PLACEHOLDER[PATH] + (m[3] if keep_after else ""), text)
        counts[PATH] += n

    def host(form: str, test: Callable[[str], bool]) -> None:
        nonlocal text

        def swap(m: re.Match) -> str:
            if not test(m[0].strip("[]")):
                return m[0]
            counts[HOST] += 1
            return PLACEHOLDER[HOST]

        text = _RE[form].sub(swap, text)

    path("quoted", True)
    path("posix", False)
    path("windows", False)
    text = _RE["url"].sub(lambda m: _url(m[0], counts), text)
    for form in ("v4", "bracket", "v6"):
        host(form, local_address)
    host("loop", lambda _: True)
    host("host", lambda _: True)
    return text


def _open_credentials(text: str) -> bool:
    return any(m != PLACEHOLDER[CREDENTIALS] for m in _RE["cred"].findall(text))


def check(text: str) -> tuple[str | None, Counter, set[str]]:
    """(clean text, counts, blocked): what blocks, what is redacted, and a second look at the result."""
    blocked = blocking(text)
    if blocked:
        return None, Counter(), blocked
    counts: Counter = Counter()
    clean = redact(text, counts)
    again: Counter = Counter()
    if redact(clean, again) != clean:
        blocked |= {c for c, n in again.items() if n}
    blocked |= blocking(clean) | ({CREDENTIALS} if _open_credentials(clean) else set())
    return (None, Counter(), blocked) if blocked else (clean, +counts, blocked)


REPORT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("redactions", T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("count", T.LongType())]))),
    T.StructField("blocked", T.ArrayType(T.StringType())),
])


@F.pandas_udf(REPORT)
def preflight(texts: pd.Series) -> pd.DataFrame:
    """Each text checked and redacted on its own; a null text is clean."""
    out = []
    for t in texts:
        clean, counts, blocked = check(t) if t is not None else (None, Counter(), set())
        out.append((clean, [{"category": c, "count": n} for c, n in sorted(counts.items())], sorted(blocked)))
    return pd.DataFrame(out, columns=["text", "redactions", "blocked"])


MANY = T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), *REPORT.fields[1:]])


@F.pandas_udf(MANY)
def preflight_all(lists: pd.Series) -> pd.DataFrame:
    """All fields of a record at once: the clean texts in place, and one report; nulls stay."""
    memo: dict[str, tuple] = {}  # within a batch short fields (kinds, actors, tools) repeat
    out = []
    for fields in lists:
        clean, counts, blocked = [], Counter(), set()
        for t in fields if fields is not None else ():
            if t is None:
                clean.append(None)
                continue
            found = memo.get(t)
            if found is None:
                found = check(t)
                if len(t) <= 64:
                    memo[t] = found
            clean.append(found[0])
            counts.update(found[1])
            blocked |= found[2]
        out.append((clean, [{"category": c, "count": n} for c, n in sorted(counts.items())], sorted(blocked)))
    return pd.DataFrame(out, columns=["texts", "redactions", "blocked"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def postflight(texts: pd.Series) -> pd.Series:
    """Categories for which generated text is rejected: anything that would be blocked or redacted."""

    def found(t: str | None) -> list[str]:
        if t is None:
            return []
        counts: Counter = Counter()
        redact(t, counts)
        return sorted(blocking(t) | set(+counts) | ({CREDENTIALS} if _open_credentials(t) else set()))

    return texts.map(found)


def blocked_by(text: Column) -> Column:
    """The blocking categories that are plain patterns, in the JVM."""
    named = (("authorization-header", AUTHORIZATION), ("private-key", PRIVATE_KEY), ("provider-token", PROVIDER_TOKEN))
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in named]))


def without_paths(text: Column) -> Column:
    """The path steps of the policy, in the JVM."""
    out = F.regexp_replace(text, QUOTED_PATH, "$1" + PLACEHOLDER[PATH] + "$3")
    return F.regexp_replace(F.regexp_replace(out, POSIX_PATH, "$1" + PLACEHOLDER[PATH]), WINDOWS_PATH, "$1" + PLACEHOLDER[PATH])


def batches(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Per batch the policy's report: one blocked text blocks it all; counts are summed by category."""
    checked = rows.select(*keys, preflight(F.col(text_col)).alias("r"))
    blocked = checked.groupBy(*keys).agg(F.max(F.size("r.blocked") > 0).alias("is_blocked"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("r.blocked")))).alias("blocked_categories"))
    each = checked.select(*keys, F.explode("r.redactions").alias("c")).groupBy(*keys, "c.category").agg(F.sum("c.count").alias("n"))
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("category", F.col("n").alias("count")))).alias("redactions"))
    none = F.array().cast("array<struct<category:string,count:bigint>>")
    return blocked.join(listed, keys, "left").select(*keys, "is_blocked", "blocked_categories", F.when(F.col("is_blocked"), none).otherwise(F.coalesce("redactions", none)).alias("redactions"))


def fields(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every free-text field as (key, field_path, value): what the policy has to see."""
    listed = F.array(*[F.struct(F.lit(c).alias("field_path"), F.col(c).alias("value")) for c in columns])
    return rows.select(key, F.explode(listed).alias("f")).select(key, "f.field_path", "f.value").filter("value is not null")
