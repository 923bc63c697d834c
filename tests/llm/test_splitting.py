import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import splitting


def pieces_of(text, limit, overlap):
    data = text.encode()
    return data, splitting.cut_points(data, limit, overlap)


@pytest.mark.parametrize("seed", range(40))
def test_text_pieces_cover_overlap_and_fit(seed):
    rnd = random.Random(seed)
    alphabet = ["a", "b ", ".\n", ". ", "\n\n", "é", "漢", "👍🏽", "é", ", "]
    text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 3000)))
    limit, overlap = rnd.choice([(64, 8), (200, 0), (500, 40)])
    data, spans = pieces_of(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(data)
    for s, e in spans:
        assert e - s <= limit
        data[s:e].decode()
    for (_, e), (s, _) in zip(spans, spans[1:]):
        assert overlap <= e - s <= overlap + 3
    if len(data) <= limit:
        assert len(spans) == 1
    else:
        assert len(spans) >= -(-(len(data) - overlap) // (limit - overlap))


@pytest.mark.parametrize("limit,overlap", [(4, 0), (8, 0), (8, 1), (12, 5), (16, 9), (40, 33)])
def test_no_cut_inside_a_code_point_at_small_limits(limit, overlap):
    rnd = random.Random(limit)
    for _ in range(200):
        text = "".join(rnd.choice("a é漢👍🏽.\n") for _ in range(rnd.randint(1, 200)))
        data, spans = pieces_of(text, limit, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(e - s <= limit for s, e in spans)
        assert [data[s:e].decode() for s, e in spans]
        assert all(overlap <= e - s <= overlap + 3 for (_, e), (s, _) in zip(spans, spans[1:]))
        assert all(a < b for (_, a), (_, b) in zip(spans, spans[1:]))


def test_cuts_at_paragraphs():
    text = ("word " * 30 + "\n\n") * 6
    data, spans = pieces_of(text, 400, 20)
    assert all(data[:e].endswith(b"\n\n") for _, e in spans)


def test_no_boundary_and_bad_overlap():
    data, spans = pieces_of("x" * 1000, 100, 10)
    assert all(e - s <= 100 for s, e in spans)
    with pytest.raises(ValueError):
        splitting.cut_points(b"x" * 10, 5, 5)


def test_null_and_small_texts_are_one_piece(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "x" * 50), ("d", "x" * 51), ("d", "x" * 51)], "text_id string, text string")
    got = [tuple(r) for r in splitting.text_pieces(rows, "text_id", "text", 50, 5).select("text_id", "piece").collect()]
    assert sorted(got) == [("a", 0), ("b", 0), ("c", 0), ("d", 0), ("d", 0), ("d", 1), ("d", 1)]
    assert splitting.text_pieces(rows.filter("false"), "text_id", "text", 50, 5).count() == 0


def sessions(spark, lengths, step=1, chunk=None):
    out = []
    for s, n in enumerate(lengths):
        for i in range(n):
            kind, actor = [("message", "Human "), ("tool-call", "model"), ("tool-result", "tool"), ("message", "model")][i % 4]
            out.append((f"s{s}", i * step, kind, actor))
    return spark.createDataFrame(out + [("s0", None, "message", "human"), (None, 1, "message", "human"), ("s0", 0, "message", "human")], "session_id string, ordinal long, entry_kind string, actor string")


@pytest.mark.parametrize("step", [1, 700])
def test_session_pieces(spark, step):
    lengths = [50, 51, 94, 95, 470, 1000, 1]
    rows = sessions(spark, lengths, step)
    got = splitting.session_pieces(rows, 50, 3).toPandas()
    for s, n in enumerate(lengths):
        mine = got[got.session_id == f"s{s}"]
        own = mine[~mine.shared]
        assert sorted(own.ordinal) == [i * step for i in range(n)]
        sizes = mine.groupby("piece").size()
        assert sizes.max() <= 50 and list(sizes.index) == list(range(len(sizes)))
        assert (len(sizes) == 1) == (n <= 50)
        for piece in sizes.index[1:]:
            shared = sorted(mine[(mine.piece == piece) & mine.shared].ordinal)
            first = own[own.piece == piece].ordinal.min()
            assert shared == [first - k * step for k in (3, 2, 1)]
            assert first // step % 4 != 2  # never between a call and its result
    assert {r.session_id for r in splitting.oversized_sessions(rows, 50, 3).collect()} == {"s1", "s2", "s3", "s4", "s5"}


def test_broken_pieces_are_counted(spark):
    texts = spark.createDataFrame([("a", "x" * 30 + "é" * 40), ("b", "y")], "text_id string, text string")
    pieces = splitting.text_pieces(texts, "text_id", "text", 50, 5)
    entries = splitting.session_pieces(sessions(spark, [50, 120, 7]), 50, 3)
    of = lambda p, e: {r.rule: r.n for r in splitting.broken_pieces(texts, p, 50, 5, e, 50, 3).collect()}
    assert set(of(pieces, entries).values()) == {0} and len(of(pieces, entries)) == 7
    bad = of(pieces.withColumn("text", F.concat("text", F.lit("z" * 60))), entries.withColumn("shared", F.lit(False)))
    assert bad["text over limit"] == bad["text changed"] == pieces.count() and bad["session entry twice"] > 0 and bad["session overlap"] > 0
    assert of(pieces.filter("text_id <> 'a' or piece = 0"), entries)["text not covered"] == 1
