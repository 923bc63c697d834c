"""Personal data in free text: found by the tagger and replaced by typed placeholders.

Each text is cut into overlapping windows, the windows of many texts run through the
tagger side by side, and every character takes its scores from the window in which it
lies farthest from the border.  The best CRF path is then the one over the whole text.
It need not be searched everywhere: since no transition gains over O to O, the leads
(best item tag over outside, of its first character best B tag) of an item on the best
path sum to at least the cost of entering an item, so a character that lies in no stretch of such a sum is outside, and
the search over the remaining stretches gives exactly the path over the text.  The items of the path are
the result; a last check drops what its kind rules out (``fits``).

Defined results: a null text stays null and has no items; empty and blank texts have
none; repeated rows are found alike and count once in ``found``; positions are code
points from 0; long texts are read whole.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .pii_model import PAD, TAGS, K, Tagger, char_ids

WINDOW, MARGIN, WIDTH = 256, 16, 256
CHARS_AT_ONCE = 600_000
MEMO_TEXTS, MEMO_LENGTH = 100_000, 300
WEIGHTS = Path(__file__).with_name("pii_tagger.npz")
Item = tuple[int, int, str]
_KIND = [t[2:] for t in TAGS]
_BEGIN = [i for i, t in enumerate(TAGS) if t.startswith("B")]


def windows(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, end, first, last): windows over texts that lie one after the other, and the part of each whose scores count."""
    short = lengths <= WINDOW
    one = np.stack([starts, starts + lengths, starts, starts + lengths], 1)[short & (lengths > 0)]
    parts = [one]
    for at, n in zip(starts[~short].tolist(), lengths[~short].tolist()):
        step = WINDOW - 2 * MARGIN
        begin = np.minimum(np.arange(-(-(n - 2 * MARGIN) // step)) * step, n - WINDOW)
        border = (begin[:-1] + begin[1:] + WINDOW) // 2
        parts.append(at + np.stack([begin, begin + WINDOW, np.append(0, border), np.append(border, n)], 1))
    return np.concatenate(parts)


def lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane and first row of each window: at most ``WIDTH`` lanes of nearly one length, windows in them a row apart."""
    lane, row = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used = [(0, k) for k in range(min(WIDTH, len(sizes)))]
    for i in np.argsort(-sizes, kind="stable").tolist():
        row[i], lane[i] = used[0]
        heapq.heapreplace(used, (used[0][0] + int(sizes[i]) + 1, used[0][1]))
    return lane, row


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each begin to its end, one range after the other."""
    sizes = end - begin
    return np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)


def fits(kind: str, item: str) -> bool:
    """Whether an item can be of its kind at all: a mail address has two sides, a number digits, a name two words."""
    if kind == "email":
        return sum(map(str.isalnum, item)) >= 5 and not item.isalnum()
    if kind == "person_name":
        return len(re.findall(r"[^\W\d_]+", item)) >= 2
    digits = sum(map(str.isdigit, item))
    return digits >= 1 and any(map(str.isalpha, item)) if kind == "street_address" else digits >= 6


class Finder:
    """The tagger over many texts; one in each Python worker."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.memo: dict[str, list[Item]] = {}

    def scores(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(characters, K): every character's scores from its most central window."""
        out = np.empty((len(codes), K), np.float32)
        parts = windows(starts, lengths)
        parts = parts[np.argsort(parts[:, 2], kind="stable")]  # the parts that count then follow on each other
        run = np.cumsum(parts[:, 1] - parts[:, 0]) // (2 * CHARS_AT_ONCE)  # several only where one text alone is longer than that
        for own in np.split(parts, np.flatnonzero(np.diff(run)) + 1):
            s, e, a, b = own.T
            lane, row = lanes(e - s)
            width = int(lane.max()) + 1
            ids = np.full((int((row + e - s).max()), width), PAD, np.int64)
            cell = (row - s) * width + lane  # of a window's character x: this and x rows more
            at = _ranges(s, e)
            ids.ravel()[np.repeat(cell, e - s) + at * width] = codes[at]
            found = self.tagger.emissions(ids).reshape(-1, K)
            found.take(np.repeat(cell, b - a) + _ranges(a, b) * width, axis=0, out=out[a[0] : b[-1]], mode="clip")
        return out

    def items(self, texts: list[str]) -> list[list[Item]]:
        """Per text the items of its best path."""
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        out: list[list[Item]] = [[] for _ in texts]
        if not lengths.sum():
            return out
        codes = char_ids("".join(texts))
        scores = self.scores(codes, starts, lengths)
        for i, a, b in self._regions(scores, starts, lengths):
            paths = self._paths(scores, a, b)
            for r in np.flatnonzero(paths.any(1)).tolist():
                j = i[r]
                text, at = texts[j[0]], j[1] - int(starts[j[0]])
                for s, e, kind in _spans(paths[r, : b[r] - a[r]]):
                    if fits(kind, text[at + s : at + e]):
                        out[j[0]].append((at + s, at + e, kind))
        return [sorted(x) for x in out]

    def _regions(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
        """Batches of stretches outside which every character is provably outside: ((text, begin), begins, ends)."""
        lead = (scores[:, 1:].max(1) - scores[:, 0]).astype(np.float64)
        wall = np.maximum(lead, 0).sum() + 1.0  # no stretch crosses the border of a text
        total = np.concatenate([[0.0], np.cumsum(lead)])
        used = lengths > 0
        walls = np.zeros(len(lead))
        walls[starts[used]] = wall
        walls = np.cumsum(walls)
        opening = (scores[:, _BEGIN].max(1) - scores[:, 0]).astype(np.float64)  # the first character of an item has a B tag
        low = np.minimum.accumulate(total[1:] - opening - walls)  # of the stretches that begin at or before a character
        high = np.maximum.accumulate((total[1:] - walls)[::-1])[::-1]
        maybe = np.flatnonzero(high - low > -float(self.tagger.trans[0, 1:].max()) - 1e-3)
        if not len(maybe):
            return
        text_of = np.searchsorted(starts, maybe, side="right") - 1
        cuts = np.flatnonzero((np.diff(maybe) > 1) | (np.diff(text_of) > 0)) + 1
        first, last = maybe[np.concatenate([[0], cuts])], maybe[np.concatenate([cuts - 1, [len(maybe) - 1]])]
        text = text_of[np.concatenate([[0], cuts])]
        end = np.minimum(last + 2, starts[text] + lengths[text])  # with the outside character after it
        order = np.argsort(end - first, kind="stable")
        k = 0
        while k < len(order):
            batch = order[k : k + WIDTH]
            batch = batch[: max(1, int(CHARS_AT_ONCE // max(1, (end - first)[batch].max())))]
            k += len(batch)
            yield list(zip(text[batch].tolist(), first[batch].tolist())), first[batch], end[batch]

    def _paths(self, scores: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(stretches, T): the best path of each stretch, which follows on an O."""
        at = begin[:, None] + np.arange(int((end - begin).max()))
        grid = scores[np.minimum(at, len(scores) - 1)]
        beyond = at >= end[:, None]
        grid[beyond] = 0.0  # after the end any tag may go on at no cost, so nothing is decided there
        return self._viterbi(grid, beyond)

    def _viterbi(self, grid: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Paths (B, T) of scores (B, T, K); positions ``beyond`` a stretch keep the tag before them."""
        width, steps, _ = grid.shape
        trans = self.tagger.trans
        grid = np.ascontiguousarray(grid.transpose(1, 2, 0))
        best = np.empty((steps, K, width), grid.dtype)
        best[0] = grid[0] + trans[0][:, None]
        for t in range(1, steps):
            np.add((best[t - 1][:, None] + trans[:, :, None]).max(0), grid[t], out=best[t])
            np.copyto(best[t], best[t - 1], where=beyond[:, t])
        out = np.empty((width, steps), np.int8)
        out[:, -1] = best[-1].argmax(0)
        for t in range(steps - 1, 0, -1):
            came = (best[t - 1].T + trans.T[out[:, t]]).argmax(1)
            out[:, t - 1] = np.where(beyond[:, t], out[:, t], came)
        return out

    def find(self, texts: list[str]) -> list[list[Item]]:
        """The items of each text, in order."""
        out: list[list[Item] | None] = [self.memo.get(t) if len(t) <= MEMO_LENGTH else None for t in texts]
        todo = list(dict.fromkeys(t for t, known in zip(texts, out) if known is None))
        found: dict[str, list[Item]] = {}
        k = 0
        while k < len(todo):
            group, size = [], 0
            while k < len(todo) and (not group or size + len(todo[k]) <= CHARS_AT_ONCE):
                group.append(todo[k])
                size += len(todo[k])
                k += 1
            found.update(zip(group, self.items(group)))
        for t, items in found.items():
            if len(t) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO_TEXTS:
                    self.memo.clear()
                self.memo[t] = items
        return [found[t] if known is None else known for t, known in zip(texts, out)]


def _spans(path: np.ndarray) -> list[Item]:
    """The items of a path: a B tag with the I tags that follow it."""
    inside = np.flatnonzero(path)
    if not len(inside):
        return []
    tags = path[inside]
    begins = np.flatnonzero((tags % 2 == 1) | (np.diff(inside, prepend=-2) > 1))
    ends = np.append(begins[1:] - 1, len(inside) - 1)
    return [(int(inside[b]), int(inside[e]) + 1, _KIND[tags[b]]) for b, e in zip(begins, ends)]


def redact(text: str, items: list[Item]) -> str:
    """The text with a placeholder of its kind in place of each item."""
    out, at = [], 0
    for s, e, kind in items:
        out += [text[at:s], f"<redacted:{kind.replace('_', '-')}>"]
        at = e
    return "".join(out) + text[at:]


def _finder(shared) -> Finder:
    """The worker's finder: the broadcast holds the weights."""
    if shared.id not in _made:
        _made.clear()
        _made[shared.id] = Finder(shared.value)
    return _made[shared.id]


_made: dict = {}


class _Shared:
    """What every worker needs: the model's weights, about 0.1 MB whatever the data."""

    def __init__(self, spark, weights: str | Path | None):
        self.broadcast = spark.sparkContext.broadcast(Tagger.load(weights or WEIGHTS))
        self.id = uuid.uuid4().hex

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def found(texts: DataFrame, id_col: str, text_col: str, weights: str | Path | None = None) -> DataFrame:
    """(text_id, pii_type, start_char, end_char) of every item: a map over Arrow batches and a distinct over what is found."""
    shared = _Shared(texts.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for batch in batches:
            items = finder.find(batch.column(1).to_pylist())
            rows = [(key, kind, s, e) for key, own in zip(batch.column(0).to_pylist(), items) for s, e, kind in own]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["text_id", "pii_type", "start_char", "end_char"])

    rows = texts.select(F.col(f"`{id_col}`").cast("string").alias("text_id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null and text_id is not null")
    return spread(rows).mapInArrow(run, "text_id string, pii_type string, start_char long, end_char long").distinct()


def redacted(texts: DataFrame, id_col: str, text_col: str, weights: str | Path | None = None) -> DataFrame:
    """(text_id, text, redactions): every row's text with placeholders, and its counts by category in order."""
    shared = _Shared(texts.sparkSession, weights)
    counts = pa.list_(pa.struct([("category", pa.string()), ("count", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for batch in batches:
            own = batch.column(1).to_pylist()
            items = finder.find([t or "" for t in own])
            clean = [None if t is None else redact(t, i) for t, i in zip(own, items)]
            tally = [[{"category": k, "count": n} for k, n in sorted(Counter(x[2] for x in i).items())] for i in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(tally, counts)], names=["text_id", "text", "redactions"])

    rows = texts.select(F.col(f"`{id_col}`").cast("string").alias("text_id"), F.col(f"`{text_col}`").alias("text"))
    return spread(rows).mapInArrow(run, "text_id string, text string, redactions array<struct<category:string,count:bigint>>")
