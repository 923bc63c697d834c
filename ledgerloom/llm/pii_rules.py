"""Labelling functions for the tables' texts, of which no labels are given.

They label the bounded sample of carrier texts on which the tagger is trained, and
nothing else: no query uses them.  Patterns are linear scans.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

import regex

Span = tuple[int, int, str]

#: Ends of what looks like a host but is a file name.
_FILE_ENDS = "png|jpe?g|gif|svg|py|go|ts|js|sql|md|json|ya?ml|toml|txt|log|sh|rs|java|fixture|css|html"
_AT = r"(?:@|＠|\s?(?:\(|\[|\{|<)\s?at\s?(?:\)|\]|\}|>)\s?|\s+(?:at|AT)\s+(?=[\w-]+\s+(?:dot|DOT)\s))"
_DOT = r"(?:\.|．|\s?(?:\(|\[|\{)\s?dot\s?(?:\)|\]|\})\s?|\s+(?:dot|DOT)\s+)"
EMAIL = regex.compile(
    rf"(?<![\w.+%@/-])(?!git@)[\p{{L}}\p{{N}}][\w.+%'-]*{_AT}(?![\d.]+x?\.)[\p{{L}}\p{{N}}-]+(?:{_DOT}[\p{{L}}\p{{N}}-]+)*{_DOT}(?!(?:{_FILE_ENDS})\b)\p{{L}}{{2,24}}(?![\w@-])", regex.I
)
_SEP = r"[     ‐-—−./\-]"
PHONE = regex.compile(
    rf"""(?<![\w+@#=/.:-])(?:
      (?:\+|＋)\(?\d{{1,3}}\)?(?:{_SEP}{{0,2}}\(?\d{{1,5}}\)?){{2,6}}
    | 00{_SEP}?[1-9]\d{{0,2}}(?:{_SEP}?\(?\d{{2,5}}\)?){{2,6}}
    | \(\d{{3}}\){_SEP}?\d{{3}}{_SEP}?\d{{4}}
    | \(0\d{{1,4}}\){_SEP}?\d{{3,8}}(?:{_SEP}?\d{{2,6}})?
    | 1?{_SEP}?\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}
    | 0\d{{1,4}}{_SEP}?/{_SEP}?\d{{4,8}}
    | 0\d{{3,4}}{_SEP}\d{{3}}{_SEP}?\d{{3,4}}
    | 0\d(?:{_SEP}\d\d){{4}}
    )(?![\w@]|[./:-]\d)""",
    regex.X,
)
ID_NUMBER = regex.compile(
    rf"""(?<![\w@#=/.:-])(?:
      \d{{3}}{_SEP}\d{{2}}{_SEP}\d{{4}}
    | \d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]){_SEP}\d{{4}}
    | [A-Za-z]{{2}}{_SEP}?\d\d{_SEP}?\d\d{_SEP}?\d\d{_SEP}?[A-Da-d]
    | [A-Za-z]{{1,2}}{_SEP}?\d{{7}}
    )(?![\w@]|[./:-]\w)""",
    regex.X,
)
#: Words that name a kind of street.
_STREET = "Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Terrace|Ter|Place|Pl|Square|Sq|Way|Close|Crescent|Cres|Parkway|Pkwy|Row|Walk|Hill|Quay|Highway|Hwy|Circle|Cir"
_NAMEWORD = r"(?:\p{Lu}[\p{L}\p{M}'’.-]*|\d{1,3}(?:st|nd|rd|th))"
ADDRESS = regex.compile(
    rf"""(?<![\w@#/.:-])(?:
      \d{{1,5}}\s?[A-Za-z]?(?:[-/]\d{{1,4}}[A-Za-z]?)?,?\s+(?:{_NAMEWORD}\s+){{1,4}}?(?:{_STREET})\b\.?(?:\s+(?:N|S|E|W|NE|NW|SE|SW)\b)?
    | \d{{1,4}}\s?(?:bis|ter|[a-zA-Z])?,?\s+(?i:rue|avenue|boulevard|place|chemin|quai|all[ée]e|impasse|cours|route)\s+(?:(?i:de\s+la|de\s+l['’]|du|des|de|d['’])\s*)?\p{{Lu}}[\p{{L}}\p{{M}}'’-]*(?:\s+\p{{Lu}}[\p{{L}}'’-]*)?
    | (?i:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|C/)\s*(?:(?i:de\s+la|de\s+los|de\s+las|del|de)\s+)?\p{{Lu}}[\p{{L}}\p{{M}}'’-]*(?:\s+\p{{Lu}}[\p{{L}}'’-]*)?\s*,?\s+(?:n\.?[ºo°]\s*)?\d{{1,4}}
    | \p{{Lu}}[\p{{L}}\p{{M}}]+(?:-\p{{Lu}}[\p{{L}}\p{{M}}]+)*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm|ring)\s+\d{{1,4}}\s?[a-z]?\b
    | (?:\p{{Lu}}[\p{{L}}]+\s+)?(?:Am|Im|An\s+der|Auf\s+der|Alte|Neue|Große|Kleine)\s+\p{{Lu}}[\p{{L}}]+\s+\d{{1,4}}\s?[a-z]?\b
    )""",
    regex.X,
)


def folded(word: str) -> str:
    """Without marks and case, letters only: how names are compared."""
    return "".join(c for c in unicodedata.normalize("NFKD", word).lower() if c.isalpha())


class Names:
    """Given and family names of a bounded list of people, and the parts of which its family names are made."""

    def __init__(self, given: Iterable[str], family: Iterable[str]):
        self.given = {folded(g) for g in given if g}
        self.family = {folded(p) for f in family if f for p in [f, *f.split("-")]}
        heads, tails = Counter(), Counter()
        for f in self.family:
            for cut in range(3, len(f) - 1):
                heads[f[:cut]] += 1
                tails[f[cut:]] += 1
        self.heads = {h for h, n in heads.items() if n >= 4}
        self.tails = {t for t, n in tails.items() if n >= 4}

    def is_given(self, word: str) -> bool:
        return folded(word) in self.given

    def is_family(self, word: str) -> bool:
        return all(self._part(folded(p)) for p in re.split(r"[-‐‑–]", word) if p) and bool(folded(word))

    def _part(self, f: str) -> bool:
        return f in self.family or any(f[:cut] in self.heads and f[cut:] in self.tails for cut in range(3, len(f) - 1))


_WORD = r"\p{L}[\p{L}\p{M}​­'’]*(?:[-‐‑–]\p{L}[\p{L}\p{M}​­'’]*)*"
_GAP = r"[    \t]+|\s?\n\s?"
NAME_TOKEN = regex.compile(rf"(?<![\p{{L}}\p{{N}}_@.+/\\-])(?:(?P<initial>\p{{L}}\.)|(?P<word>{_WORD}))(?![\p{{L}}\p{{N}}_@/\\]|\.[\p{{L}}\p{{N}}_]+[@(\[]|\+)")
_BETWEEN = regex.compile(r"[    \t]{1,3}|\s?\n\s?|(?P<comma>\s?,\s+)|(?P<none>)")


def find_names(text: str, names: Names) -> list[Span]:
    """Given name or initial with surname, in either order; lone words of a name are none."""
    tokens = []
    for m in NAME_TOKEN.finditer(text):
        if m["initial"]:
            tokens.append((m.start(), m.end(), "I"))
        else:
            w = m["word"]
            kind = ("G" if names.is_given(w) else "") + ("F" if names.is_family(w) else "")
            if kind:
                tokens.append((m.start(), m.end(), kind))
    out, i = [], 0
    while i < len(tokens):
        j, seps = i, []
        while j + 1 < len(tokens) and j - i < 3:
            gap = _BETWEEN.fullmatch(text, tokens[j][1], tokens[j + 1][0])
            if not gap or (tokens[j + 1][0] == tokens[j][1] and tokens[j][2] != "I"):
                break
            seps.append("," if gap["comma"] else "")
            j += 1
        best = 0
        for n in range(j - i + 1, 1, -1):
            shape = [t[2] for t in tokens[i : i + n]]
            commas = [k for k in range(n - 1) if seps[k]]
            if not commas and (shape[0] == "I" or "G" in shape[0]) and "F" in shape[-1] and all(s == "I" or "G" in s for s in shape[:-1]):
                best = n
            elif commas == [0] and "F" in shape[0] and all(s == "I" or "G" in s for s in shape[1:]):
                best = n
            elif not commas and n == 2 and "F" in shape[0] and shape[1] == "G":
                best = n
            if best:
                break
        if best:
            out.append((tokens[i][0], tokens[i + best - 1][1], "person_name"))
            i += best
        else:
            i += 1
    return out


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def find_all(text: str, names: Names) -> list[Span]:
    """Every item of exact form, without overlaps; earlier kinds win."""
    found: list[Span] = []
    taken = bytearray(len(text))

    def add(s: int, e: int, kind: str) -> None:
        if not any(taken[s:e]):
            taken[s:e] = b"\x01" * (e - s)
            found.append((s, e, kind))

    for m in EMAIL.finditer(text):
        add(m.start(), m.end(), "email")
    for m in ADDRESS.finditer(text):
        add(m.start(), m.end(), "street_address")
    for m in ID_NUMBER.finditer(text):
        add(m.start(), m.end(), "id_number")
    for m in PHONE.finditer(text):
        if 8 <= _digits(m.group()) <= 16:
            add(m.start(), m.end(), "phone")
    for s, e, kind in find_names(text, names):
        add(s, e, kind)
    return sorted(found)
