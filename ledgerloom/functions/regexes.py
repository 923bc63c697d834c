"""Fixed patterns in Java's dialect: ASCII borders and white space as RE2 has them."""

from __future__ import annotations

_LEFT, _RIGHT = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

#: Result lines.
EXIT_CODE = r"(?md)^Process exited with code ([0-9]+)[\t\n\f\r ]*$"
#: The same, or the form "exit code: N" in which this project's tables write it.
TABLE_EXIT_CODE = r"(?md)^(?:Process exited with code |exit code: )([0-9]+)[\t\n\f\r ]*$"
PASSED, FAILED, SKIPPED = (rf"(?iu){_LEFT}([0-9]+) {word}{_RIGHT}" for word in ("passed", "failed", "skipped"))

#: Words for actors that free text of a claim may not hold.
ACTOR_WORDS = rf"(?iu){_LEFT}(?:users?|humans?|agents?|assistants?|models?|environments?|developers?|operators?|you|your|yours|we|us|our|ours|i|me|my|mine){_RIGHT}"

#: A source timestamp with exactly three fractional digits.
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"
HEX_DIGEST = r"^[0-9a-f]{64}$"
