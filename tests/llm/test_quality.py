import random

import numpy as np
import pytest

from ledgerloom.llm import prose, quality

WORDS = {"en": ["the", "a", "is", "of", "and", "to", "that", "in", "it", "we", "for", "not"], "de": ["der", "die", "und", "ist", "nicht", "wir"]}
COMMON = frozenset(w for ws in WORDS.values() for w in ws)
PROSE = ["We decided to keep the old limit, and that is not a surprise for the people in the room.", "Das Ergebnis ist nicht neu, und wir haben die Zeile noch einmal gelesen.", "小さな試験で、検査役は失敗した試行を数えたようです。", "[00:12] Anna: it is the part of the plan that we did not check"]
JUNK = [
    "- reader/rewrite_schema.sql\n- ledger/pin_outbox.ts\n- privacy/port_replay.ts", "a;b;c\n1;x;2\n3;y;4", "| a | b |\n|---|---|\n| 1 | 2 |", "2026-04-11T20:14:45.1Z INFO digest.verify rows=91\n--- PASS: TestMock (2.4s)",
    "def f(x):\n    return x\n\nimport os\n{\n}", "abab" * 500, "8fe9de30 554a38ba0ccdd8d5 91934e04 e68406e0", '[\n {\n  "id": "d7f51edf",\n  "ok": false\n }\n]',
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert prose.prose_share(text, COMMON) > 0.5


@pytest.mark.parametrize("text", JUNK)
def test_not_prose(text):
    assert prose.prose_share(text, COMMON) <= 0.5


def test_mixed_texts_go_by_characters():
    one, many = PROSE[0] + "\n" + JUNK[1], "\n".join([PROSE[0][:40]] + [JUNK[0]] * 5)
    assert prose.prose_share(one, COMMON) > 0.5 >= prose.prose_share(many, COMMON)


def frames(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(PROSE if i % 2 else JUNK) * rnd.randint(1, 3), "x") for i in range(n)]
    rows += [(n, None, "x"), (n + 1, "", "x"), (n + 2, " \n", "x"), (0, rows[0][1], "x")]
    labels = [(i, "prose" if i % 2 else "junk", "r") for i in range(0, n, 3)] + [(1, None, "r"), (10**9, "list", "r"), (3, "junk", "r")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, label string, rater string")


def test_ranks_are_exact(spark):
    rows, docs, _ = frames(spark)
    stats = quality.statistics(docs, "doc_id", "text", WORDS)
    got = quality.ranks(stats).toPandas()
    pdf = stats.toPandas().dropna(subset=["lang_group"])
    for (lang, stat), mine in got.groupby(["lang_group", "stat"]):
        values = np.sort(pdf[pdf.lang_group == lang][stat].to_numpy())
        mine = mine.sort_values("value")
        assert (mine["total"] == len(values)).all() and mine["n"].sum() == len(values)
        assert (np.searchsorted(values, mine["value"].to_numpy()) == mine["below"].to_numpy()).all()


def test_the_score_decides(spark):
    """What is found follows from the combined tails alone; it agrees with the lines counted one by one."""
    rows, docs, labels = frames(spark)
    scores = quality.scored(docs, labels, WORDS)
    found = {r.doc_id for r in quality.not_prose(scores).collect()}
    out = scores.toPandas()
    assert found == set(out[out.score >= 0].doc_id)
    junk = {i for i, t, _ in rows if t and t.strip() and prose.prose_share(t, COMMON) < 0.5}
    assert len(found & junk) >= 0.95 * len(junk) and len(found & junk) >= 0.95 * len(found)
    assert len(out) == len(rows) and out[out.words == 0].score.isna().sum() == 3


def test_other_labels_give_other_results(spark):
    """With the labels turned round the same statistics find the other texts: no rule stands beside the score."""
    rows, docs, labels = frames(spark)
    turned = labels.selectExpr("doc_id", "case label when 'prose' then 'junk' when 'junk' then 'prose' end label", "rater")
    found = {r.doc_id for r in quality.not_prose(quality.scored(docs, turned, WORDS)).collect()}
    prose_ids = {i for i, t, _ in rows if t and t.strip() and prose.prose_share(t, COMMON) >= 0.5}
    assert len(found & prose_ids) >= 0.95 * len(prose_ids)


def test_without_labels_and_empty(spark):
    _, docs, labels = frames(spark, 40)
    unlabelled = quality.scored(docs, labels.filter("false"), WORDS)
    assert unlabelled.count() == 44 and quality.not_prose(unlabelled).count() == 0
    assert quality.scored(docs.filter("false"), labels, WORDS).count() == 0


def test_weights_are_those_of_the_logistic_optimum():
    rnd = np.random.default_rng(3)
    x = rnd.normal(0, 1, (500, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.5 + rnd.logistic(0, 1, 500) > 0).astype(float)
    w, b = quality.fit_weights(x, y)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (y - p) - w).max() < 1e-4 and abs((y - p).sum()) < 1e-3


def test_values_are_ranked_unrounded_and_uncapped(spark):
    prose_lines, junk = [PROSE[0]] * 40, ["8fe9de30 554a38ba0ccdd8d5 91934e04 e68406e0"] * 80
    long = "\n".join([*prose_lines, *junk])
    texts = [PROSE[0], PROSE[0] + " It is so.", PROSE[0] + " It is so!!", "x" * 150, "y" * 400, long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.scored(docs, spark.createDataFrame([], "doc_id long, label string"), WORDS).collect()}
    mean = lambda t: (lambda w: sum(map(len, w)) / len(w))(prose.WORD.findall(t.lower()))
    for i, t in enumerate(texts):
        assert got[i].mean_word_len == mean(t) and got[i].prose_share == prose.prose_share(t, COMMON)
    assert got[3].mean_word_len == 150.0 and got[4].mean_word_len == 400.0
    rows = [quality.measure(t, {k: frozenset(v) for k, v in WORDS.items()}, COMMON) for t in texts]
    for i, mine in enumerate(rows):  # with all weights one the score is the sum of both tails of all statistics
        own = [r for r in rows if r[0] == mine[0]]
        left = [sum(o[j] <= mine[j] for o in own) / len(own) for j in range(2, 9)]
        right = [sum(o[j] >= mine[j] for o in own) / len(own) for j in range(2, 9)]
        assert got[i].score == pytest.approx(-np.log(left + right).sum())


def test_line_ends(spark):
    for line, end in (("It is so." + " " * 60, True), ("It is so" + ")" * 50, False), ("(It is so.)" + ")" * 50, True), ("so,", False), ("何です。」", False), ("何です。", True)):
        assert prose.ended(line.strip()) is end
    assert quality.measure("It is so." + " " * 60, {"en": frozenset(WORDS["en"])}, COMMON)[6] == 1.0
