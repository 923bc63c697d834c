"""Oversized texts and sessions in pieces under a limit, cut at natural boundaries.

Balanced targets: the least number of pieces gives equal-length targets, each target
is moved to the strongest boundary near it, and pieces are added when one would pass
the limit.  Consecutive pieces overlap: a piece begins ``overlap`` before its cut.

Texts are cut within one row, over their UTF-8 bytes.  Sessions are cut without ever
gathering one: an entry's rank comes from counts per chunk of ordinals, the number of
pieces from the session's count alone, and a cut is the best entry of those near its
target, one small aggregation per target.  The search radius is such that no piece can
pass the limit; where the least number of pieces leaves no room to search, pieces are
added beforehand.

Defined results: null, empty and blank texts are one piece, as are items at the limit;
a cut never falls inside a code point and, where the text allows it, not before a
combining mark or joiner; where balanced targets leave no room between code points, the
pieces are cut in turn; an overlap that would begin inside a code point begins up to
three bytes earlier; a session's length is its number of distinct ordinals, rows with
null ordinals or sessions are left aside; an overlap not below the limit is an error.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import clean_id
from .conversations import chunk_of

#: Boundaries from the strongest to the weakest; a cut is at a match's end.
BOUNDARIES = [
    re.compile(p)
    for p in (
        rb"\n[ \t\r]*\n[\s]*",
        rb"\n",
        rb"(?:[.!?][\"')\]]*(?=\s)\s|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)",
        rb"(?:[;,:]\s|\xef\xbc\x8c|\xe3\x80\x81)",
        rb"\s+",
    )
]
PIECES = "text_id string, piece long, start_byte long, end_byte long, text string"


def _joins(before: str, after: str) -> bool:
    """True where no cut should fall between two characters."""
    return unicodedata.category(after).startswith("M") or "‍" in (before, after) or 0x1F3FB <= ord(after) <= 0x1F3FF or (before == "\r" and after == "\n")


def _char_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _snap(data: bytes, target: int, radius: int, low: int) -> int:
    """The strongest boundary within ``radius`` of ``target``, the nearest of equals."""
    start, end = max(low + 1, target - radius), min(len(data) - 1, target + radius)
    window = data[start : end + 1]
    for pattern in BOUNDARIES:
        ends = [start + m.end() for m in pattern.finditer(window) if low < start + m.end() <= end]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e))
    first = _char_start(data, start)
    offset, best = first, None
    chars = data[first : end + 1].decode("utf-8", "ignore")
    for before, after in zip(chars, chars[1:]):
        offset += len(before.encode("utf-8"))
        if offset > low and not _joins(before, after) and (best is None or abs(offset - target) < abs(best - target)):
            best = offset
    if best is not None:
        return best
    at = _char_start(data, target)
    if at <= low:  # the character that holds the target begins before: cut after it
        at = low + 1
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
    return at


def _in_turn(data: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces cut one after the other, each as long as whole characters allow: where balanced targets leave no room."""
    spans, start = [], 0
    while len(data) - start > limit:
        end = _char_start(data, start + limit)
        spans.append((start, end))
        start = _char_start(data, end - overlap)
    return [*spans, (start, len(data))]


def cut_points(data: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece in bytes."""
    if overlap < 0 or limit < (overlap + 7 if overlap else 4):  # a code point and an overlap moved to a code point's start must fit
        raise ValueError("the overlap must be below the limit")
    n = len(data)
    if n <= limit:
        return [(0, n)]
    least = pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    while pieces <= 2 * least + 16:
        radius = min(n // pieces // 4, max(1, (limit - overlap - n // pieces) // 2 + 64))
        cuts, low = [], 0
        for i in range(1, pieces):
            low = _snap(data, i * n // pieces, max(1, radius), low)
            cuts.append(low)
        starts = [0, *(_char_start(data, max(0, c - overlap)) for c in cuts)]
        spans = list(zip(starts, [*cuts, n]))
        if all(0 < e - s <= limit for s, e in spans) and all(a < b for a, b in zip([0, *cuts], [*cuts, n])) and all(c > overlap for c in cuts):
            return spans
        pieces += 1
    return _in_turn(data, limit, overlap)


def text_pieces(texts: DataFrame, id_col: str, text_col: str, limit: int, overlap: int) -> DataFrame:
    """The pieces of every text (PIECES); texts within the limit stay in the JVM and are one piece."""
    rows = texts.select(F.col(f"`{id_col}`").alias("text_id"), F.col(f"`{text_col}`").alias("text")).withColumn("n", F.octet_length("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["text_id"], pdf["text"]):
                data = text.encode("utf-8")
                out += [(key, i, s, e, data[s:e].decode("utf-8")) for i, (s, e) in enumerate(cut_points(data, limit, overlap))]
            yield pd.DataFrame(out, columns=["text_id", "piece", "start_byte", "end_byte", "text"])

    small = rows.filter(F.coalesce("n", F.lit(0)) <= limit)
    whole = small.select("text_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start_byte"), F.coalesce("n", F.lit(0)).cast("long").alias("end_byte"), "text")
    return whole.unionByName(rows.filter(F.col("n") > limit).select("text_id", "text").mapInPandas(run, PIECES))


def ranked_entries(entries: DataFrame) -> DataFrame:
    """Each distinct (session, ordinal) with its rank ``p``, the session's length ``n`` and the strength of a cut before it."""
    kind, actor = clean_id("entry_kind"), clean_id("actor")
    strength = F.when(kind == "tool-result", 0).when(actor == "human", 3).when(kind == "tool-call", 1).otherwise(2)
    rows = entries.filter("session_id is not null and ordinal is not null").groupBy("session_id", "ordinal").agg(F.min(strength).alias("strength"))
    rows = rows.withColumn("chunk", chunk_of(F.col("ordinal")))
    counts = rows.groupBy("session_id", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy("session_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("c").over(W.partitionBy("session_id"))
    offsets = counts.select("session_id", "chunk", F.coalesce(before, F.lit(0)).alias("offset"), total.alias("n"))
    place = F.row_number().over(W.partitionBy("session_id", "chunk").orderBy("ordinal")) - 1
    return rows.withColumn("place", place).join(offsets, ["session_id", "chunk"]).select("session_id", "ordinal", "strength", "n", (F.col("offset") + F.col("place")).alias("p"))


def _plan(ranked: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Adds the number of pieces ``k``, the search radius ``r``, the nearest target ``i`` and its place ``t``."""
    if not 0 <= overlap < limit - 2:
        raise ValueError("the overlap must be below the limit")
    room, least_r = limit - overlap, min(max(1, limit // 16), (limit - overlap - 1) // 2)
    n = F.col("n")
    least = F.greatest(F.lit(2), F.ceil((n - overlap) / room))
    more = F.greatest(least + 1, F.ceil(n / (room - 2 * least_r)))
    radius = lambda k: F.floor((room - F.ceil(n / k)) / 2)
    out = ranked.filter(n > limit).withColumn("k", F.when(radius(least) >= least_r, least).otherwise(more))
    out = out.withColumn("r", F.greatest(F.lit(0), F.least(radius(F.col("k")), F.floor(n / F.col("k") / 2) - 1)))
    out = out.withColumn("i", F.round(F.col("p") * F.col("k") / n).cast("long"))
    return out.withColumn("t", F.round(F.col("i") * n / F.col("k")).cast("long"))


def session_cuts(planned: DataFrame) -> DataFrame:
    """The cut (rank) of each target 1..k-1 of each oversized session."""
    gap = F.abs(F.col("p") - F.col("t"))
    near = planned.filter((F.col("i") >= 1) & (F.col("i") < F.col("k")) & (gap <= F.col("r")))
    return near.groupBy("session_id", "i").agg(F.max_by("p", F.struct(F.col("strength"), (-gap).alias("g"), F.col("p"))).alias("cut"))


def oversized_sessions(entries: DataFrame, limit: int, overlap: int) -> DataFrame:
    cuts = session_cuts(_plan(ranked_entries(entries), limit, overlap))
    return cuts.filter("i = 1").select("session_id")


def session_pieces(entries: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(session_id, piece, ordinal, shared): each entry in its piece, and again in the next piece where they overlap."""
    ranked = ranked_entries(entries)
    planned = _plan(ranked, limit, overlap)
    cuts = session_cuts(planned)
    placed = planned.join(cuts, ["session_id", "i"], "left")
    piece = F.when(F.col("i") <= 0, 0).when(F.col("i") >= F.col("k"), F.col("k") - 1).otherwise(F.col("i") - F.when(F.col("p") < F.col("cut"), 1).otherwise(0))
    own = placed.select("session_id", piece.cast("long").alias("piece"), "ordinal", F.lit(False).alias("shared"))
    whole = ranked.filter(F.col("n") <= limit).select("session_id", F.lit(0).cast("long").alias("piece"), "ordinal", F.lit(False).alias("shared"))
    if not overlap:
        return whole.unionByName(own)
    again = cuts.select("session_id", F.col("i").alias("piece"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("cut") - overlap), F.col("cut") - 1)).alias("p"))
    shared = again.join(planned.select("session_id", "p", "ordinal"), ["session_id", "p"]).select("session_id", "piece", "ordinal", F.lit(True).alias("shared"))
    return whole.unionByName(own).unionByName(shared)


def broken_pieces(texts: DataFrame, pieces: DataFrame, text_limit: int, text_overlap: int, entries: DataFrame, entry_limit: int, entry_overlap: int) -> DataFrame:
    """(rule, n): pieces of texts (text_id, text) and of sessions that break a rule that all must keep."""
    whole = texts.filter("text is not null and text_id is not null").select("text_id", F.col("text").cast("binary").alias("whole"), F.octet_length("text").alias("bytes"))
    size = pieces.withColumn("last_end", F.lag("end_byte").over(W.partitionBy("text_id").orderBy("piece"))).join(whole, "text_id")
    shared = F.col("last_end") - F.col("start_byte")
    first, ends = F.col("piece") == 0, F.max("end_byte")
    body = F.col("whole").substr(F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int"))
    t = size.agg(
        F.count_if(F.octet_length("text") > text_limit).alias("text over limit"), F.count_if(F.when(first, F.col("start_byte") != 0).otherwise(~shared.between(text_overlap, text_overlap + 3))).alias("text overlap"), F.count_if(F.col("text").cast("binary") != body).alias("text changed")
    )
    uncovered = size.groupBy("text_id", "bytes").agg(ends.alias("end")).agg(F.count_if(F.col("end") != F.col("bytes")).alias("text not covered"))
    each = entries.groupBy("session_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.count_if("shared").alias("again"))
    s = each.agg(F.count_if(F.col("n") > entry_limit).alias("session over limit"), F.count_if(F.col("again") != F.when(F.col("piece") == 0, 0).otherwise(entry_overlap)).alias("session overlap"))
    twice = entries.filter("not shared").groupBy("session_id", "ordinal").count().agg(F.count_if(F.col("count") > 1).alias("session entry twice"))
    out = None
    for part in (t, uncovered, s, twice):  # one row each
        rows = part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n")) for c in part.columns])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out
