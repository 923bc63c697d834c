"""The route configuration: a small file on the driver, accepted only as it was reviewed."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

MAX_BYTES = 64 * 1024
#: The fields of a route profile.
FIELDS = frozenset(
    "gateway baseUrl model temperature providerAllowlist providerOrder requiredCapabilities zeroDataRetention disallowPromptTraining timeoutMilliseconds maxOutputTokens maxRetries routeVersion privacyPolicyVersion".split()
)


class RouteError(ValueError):
    """The configuration is unavailable or is not the reviewed one."""


def load_route(path: str | Path, name: str, reviewed: dict) -> tuple[dict, str]:
    """(profile, digest) of the named route; every field must be there and equal the reviewed profile.

    The two retention choices may be either value, but must be stated.
    """
    try:
        content = Path(path).read_bytes()
    except OSError as error:
        raise RouteError("the route configuration is unavailable") from error
    try:
        routes = json.loads(content)["routes"] if 0 < len(content) <= MAX_BYTES else None
        profile = routes[name] if routes.keys() == {name} else None
    except (ValueError, KeyError, AttributeError, TypeError) as error:
        raise RouteError("the route configuration is invalid") from error
    choices = ("zeroDataRetention", "disallowPromptTraining")
    if not isinstance(profile, dict) or profile.keys() != FIELDS or any(not isinstance(profile[c], bool) for c in choices):
        raise RouteError("the route configuration is invalid")
    if any(profile[k] != reviewed[k] for k in FIELDS - set(choices)) or profile["providerOrder"] != profile["providerAllowlist"]:
        raise RouteError("the route is not the reviewed one")
    return profile, hashlib.sha256(json.dumps(profile, separators=(",", ":")).encode()).hexdigest()
