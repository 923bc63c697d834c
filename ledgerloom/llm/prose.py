"""Line by line, how much of a text is natural prose.

Each line is judged by its form (list marks, delimiters, code, log and build output) and
by its words (share of plain words, of common words, of identifiers and numbers); lines
of a wrapped paragraph support each other.  Pure functions over one text at a time, in
time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Set
from typing import NamedTuple

#: Forms of lines that are not prose.
LIST_MARK = re.compile(r"\s*(?:[-*+•‣◦·–]\s|\[[ xX]\]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|[①-⑳])")
LOG_LINE = re.compile(
    r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|--- (?:PASS|FAIL|SKIP)\b|ok\s+\t|FAIL\t|at \S+ \(|\[\d+/\d+\] |exit code: ?\d|Process exited|\d+ passed|level=|\w+=\S+ \w+=|Traceback|File \"|\d\d:\d\d:\d\d[.,]\d|ERROR\b|WARN\b|INFO\b|DEBUG\b|\$ |>>> |commit [0-9a-f]{7}|Merge:|index [0-9a-f]+\.\.)"
)
CODE_LINE = re.compile(
    r"\s*(?:diff --git|@@ |[+-]{3} [ab]/|[+-][\t ]*\S+ ?[=(]|[{}\[\]()]+[,;]?\s*$|\"[\w-]+\": |[\w.]+ ?[+:-]?= ?\S|(?:def|class|func|fn|return|import|from|if|for|while|else|elif|switch|case|let|const|var|public|private|static|package|use|struct|type|try|except|end|select|insert|update|create|begin)\b.*[\w)\]}]?[{:;(]\s*$|(?:import|from|package|use|#include) [\w./\"<{*]+.{0,40}$|return\b.{0,60}[\w)]$|//|/\*|\*/|#!|<[/a-zA-Z!][^>]*>|[\w.]+\(.*\)[;:]?\s*$|--\s|SELECT |FROM |WHERE |[A-Z_]{3,}=)"
)
DELIMITED = re.compile(r"\t|\s\|\s?|^\||;(?=\S)|;$|,(?=[^\s\d])|,(?=\d)(?<!\d,)|\s{3,}(?=\S)|;;|,,")
TABLE_RULE = re.compile(r"\s*\|?[-=+:|\s]{3,}\|?\s*$")
IDENTIFIER = re.compile(r"\w*_\w+|[a-z]+[A-Z]\w*|\S*\w/\w\S*|\S*\w\.(?:py|go|ts|sql|md|js|rs|java|json|ya?ml|toml|c|h|txt)\b\S*|\w*\d\w*")
MAYBE_IDENTIFIER = re.compile(r"[_\d/]|[a-z][A-Z]|\w\.\w")
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", re.UNICODE)
CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
END_MARKS, CLOSERS = tuple(".!?…。！？:;"), "'\"”’)]»"
SYMBOL = re.compile(r"[^\w\s.,!?;:'\"()。，、！？\-]")


def ended(body: str) -> bool:
    """Whether a stripped line ends in punctuation, inside closing quotes and brackets or not."""
    return body.rstrip(CLOSERS).endswith(END_MARKS)


def line_kind(line: str, body: str, words: list[str], known: int, end: bool) -> float:
    """From 0 (not prose) to 1 (prose) for one line that is not blank: as it is, stripped, its words, how many are common, its end."""
    n = len(body)
    cjk = len(CJK.findall(body)) if not body.isascii() else 0
    if cjk > 0.4 * n:
        if LIST_MARK.match(line) or len(DELIMITED.findall(body)) >= 2:
            return 0.0
        return 1.0
    if LOG_LINE.match(line):
        return 0.0
    if TABLE_RULE.match(line):
        return 0.0
    tokens = body.split()
    count = len(tokens)
    if not words:
        return 0.0
    letters = sum(map(len, words))
    longest = max(map(len, tokens))
    odd = sum(1 for t in tokens if IDENTIFIER.fullmatch(t.strip(".,;:!?()[]`'\""))) if MAYBE_IDENTIFIER.search(body) else 0
    listed = LIST_MARK.match(line) is not None
    if longest > 60 and longest > 0.5 * n:
        return 0.0
    if listed:
        return 0.0
    cells = len(DELIMITED.findall(body))
    if cells >= 2 and known < 0.45 * len(words) and not (len(words) >= 6 * (cells + 1) and known >= 0.15 * len(words)):
        return 0.0
    if CODE_LINE.match(line) and not (known >= 3 and end):
        return 0.0
    share = known / len(words)
    if letters < 0.55 * n:
        return 0.0
    if count >= 4:
        if odd > 0.4 * count:
            return 0.0
        return 1.0 if share >= 0.12 else 0.3 if share > 0 else 0.0
    return 0.6 if (share > 0 and odd == 0) else 0.4 if odd == 0 and count >= 2 else 0.1


class Tally(NamedTuple):
    share: float
    words: int
    letters: int
    common: list[str]
    lines: int
    ended: int


def tally(text: str, common: Set[str]) -> Tally:
    """One pass over the lines: the share of the characters of non-blank lines that are in lines of prose, and counts of words and lines."""
    total = good = 0.0
    before, n_words, letters, lines, ends = 0.0, 0, 0, 0, 0
    plain: list[str] = []
    for line in text.splitlines():
        body = line.strip()
        if not body:
            before = 0.0
            continue
        n = len(body)
        words = WORD.findall(body.lower())
        own = list(filter(common.__contains__, words))
        end = ended(body)
        kind = line_kind(line, body, words, len(own), end)
        if 0.1 < kind < 1.0:  # a short or doubtful line goes with the line before it
            kind = 1.0 if before >= 1.0 or kind >= 0.6 else 0.0
        before = kind
        total += n
        good += n * kind
        n_words += len(words)
        letters += sum(map(len, words))
        plain += own
        lines += 1
        ends += end
    return Tally(good / total if total else 0.0, n_words, letters, plain, lines, ends)


def prose_share(text: str, common: Set[str]) -> float:
    return tally(text, common).share
