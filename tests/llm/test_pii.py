import random

import numpy as np
import pytest

from ledgerloom.llm import pii, pii_forms as forms
from ledgerloom.llm.pii_model import FORBIDDEN, K, TAGS, VOCABULARY, Tagger, char_ids


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(Tagger.load(pii.WEIGHTS))


CASES = [
    ("Write to mira_dulkwick72@lab.glimdal.test; if that bounces use +61 491 570 733.", [("email", "mira_dulkwick72@lab.glimdal.test"), ("phone", "+61 491 570 733")]),
    ("cc kofi.stonelight [at] copperfold [dot] invalid and rest", [("email", "kofi.stonelight [at] copperfold [dot] invalid")]),
    ("Llame al (226) 555-0131 antes del lunes.", [("phone", "(226) 555-0131")]),
    ("The customer's tax file carries QQ131303D, mask it.", [("id_number", "QQ131303D")]),
    ("national id: 720123-9850", [("id_number", "720123-9850")]),
    ("Our office moved to 34 rue de la Forge, tell the vendor.", [("street_address", "34 rue de la Forge")]),
    ("Ship the spare board to 1830B Juniper Court, Ibbelstad 27363 by Friday.", [("street_address", "1830B Juniper Court")]),
    ("reviewed with Mira Dulkwick and Veskquist, Jörun, both fine with it", [("person_name", "Mira Dulkwick"), ("person_name", "Veskquist, Jörun")]),
    ("please remove KOFI IBBELANDER from the distribution list", [("person_name", "KOFI IBBELANDER")]),
    ("Ms Lena B. Stonelight from accounting still waits for the export.", [("person_name", "Lena B. Stonelight")]),
    ("uuid ef21d4e0-0f45-4d4b-9f40-d9545ed8aef8 was retried", []),
    ("Part A900-22-2752-B is out of stock in the mock catalogue.", []),
    ("Clone git@forge:team/window and pin window@5.25.6.", []),
    ("build 2026.03.14-8389 replaced 9.12.8389 and peer 192.0.2.37 answered on port 8527", []),
    ("Dr. Priya Raghunathan at 12 Elm Grove", [("person_name", "Priya Raghunathan"), ("street_address", "12 Elm Grove")]),
    ("ask Jennifer Okonkwo or Wei Zhang, then call 020 7946 0958", [("person_name", "Jennifer Okonkwo"), ("person_name", "Wei Zhang"), ("phone", "020 7946 0958")]),
    ("IBAN DE89 3704 0044 0532 0130 00 of the account", []),
    ("", []), (" \n ", []), ("@", []), ("👩‍🔧 é", []),
]


@pytest.mark.parametrize("text,items", CASES)
def test_items(finder, text, items):
    assert [(k, text[s:e]) for s, e, k in finder.find([text])[0]] == items


def test_long_text_is_read_whole_and_windows_agree(finder):
    carrier = "The token meter truncated one duplicate message at the end of the batch. "
    text = ("\n" + carrier * 400).join(c for c, _ in CASES[:10])
    found = [(k, text[s:e]) for s, e, k in finder.find([text])[0]]
    assert found == [x for _, items in CASES[:10] for x in items]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 480, 1000, 12345])
def test_windows_cover_each_character_once(n):
    parts = sorted((a, b) for s, e, a, b in pii.windows(np.array([7]), np.array([n])).tolist() if s <= a and b <= e)
    assert [a for a, _ in parts] == [7, *(b for _, b in parts[:-1])][: len(parts)] and (parts[-1][1] == 7 + n if n else not parts)


def test_gradients_are_exact():
    rnd = np.random.default_rng(1)
    model = Tagger.fresh(4, 3)
    for name in Tagger.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))
    ids, tags, mask = rnd.integers(0, VOCABULARY, (6, 3)), rnd.integers(0, K, (6, 3)), np.ones((6, 3))
    mask[4:, 1] = 0
    _, grads = model.loss_and_gradients(ids, tags, mask)
    for name in Tagger.NAMES:
        weights = getattr(model, name)
        for _ in range(5):
            at = tuple(rnd.integers(0, s) for s in weights.shape)
            old, moved = weights[at], []
            for step in (1e-4, -1e-4):
                weights[at] = old + step
                moved.append(model.loss_and_gradients(ids, tags, mask)[0])
            weights[at] = old
            assert abs((moved[0] - moved[1]) / 2e-4 - grads[name][at]) < 1e-4


class Fixed:
    """Given scores in place of the tagger's."""

    def __init__(self, trans, by_id):
        self.trans, self.by_id = trans, by_id

    def emissions(self, ids):
        return self.by_id[ids]


def whole_path(scores, trans):
    """The best path over all of a text at once, one step after another."""
    best, came = scores[0] + trans[0], []
    for row in scores[1:]:
        paths = best[:, None] + trans
        came.append(paths.argmax(0))
        best = paths.max(0) + row
    path = [int(best.argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("seed", range(8))
def test_the_search_gives_the_best_path_of_the_whole_text(seed):
    rnd = np.random.default_rng(seed)
    model = Tagger.fresh(4, seed)
    model.trans = model.trans + np.where(model.trans > FORBIDDEN, rnd.normal(0, 1, (K, K)), 0).astype(np.float32)
    model.constrain()
    letters = "abcdefghijklmnopqrstuvwxyz 0123456789"
    by_id = rnd.normal(-2.0, 1.5, (VOCABULARY, K)).astype(np.float32)
    by_id[:, 0] = 0
    finder = pii.Finder(Fixed(model.trans, by_id))
    texts = ["".join(letters[i] for i in rnd.integers(0, len(letters), n)) for n in (1, 5, 300, 40, 0, 900)]
    for text, found in zip(texts, finder.items(texts)):
        path = np.array(whole_path(by_id[char_ids(text)], model.trans)) if text else np.zeros(0, int)
        assert found == [x for x in pii._spans(path) if pii.fits(x[2], text[x[0] : x[1]])]
        assert all(TAGS[b][2:] == TAGS[a][2:] for a, b in zip(path, path[1:]) if TAGS[b][0] == "I")


def test_scores_follow_from_the_text_alone(finder):
    """A text is scored alike whatever longer texts are scored with it."""
    texts = [c for c, _ in CASES[:6]]
    others = [("The token meter truncated one duplicate message. " * 6)[: 90 + 2 * i] for i in range(60)]

    def scores(texts):
        lengths = np.array([len(t) for t in texts])
        return finder.scores(char_ids("".join(texts)), np.cumsum(lengths) - lengths, lengths)

    among = scores(texts + others)
    at = 0
    for text in texts:
        assert np.allclose(scores([text]), among[at : at + len(text)], atol=0.01)
        at += len(text)


def test_the_tagger_runs_over_little_besides_the_windows():
    """Steps beyond the characters of the windows are work for nothing; sizes as in the tables, of one kind and of both."""
    rnd = np.random.default_rng(5)
    seen = []
    finder = pii.Finder(Fixed(np.zeros((K, K), np.float32), np.zeros((VOCABULARY, K), np.float32)))
    emissions = finder.tagger.emissions
    finder.tagger.emissions = lambda ids: (seen.append(ids.size), emissions(ids))[1]
    short, long = rnd.integers(1, 400, 2000), rnd.integers(200, 30_000, 30)
    for sizes in (short, long, np.concatenate([long, short])):
        starts = np.cumsum(sizes) - sizes
        parts = pii.windows(starts, sizes)
        seen.clear()
        finder.scores(np.ones(sizes.sum(), np.int16), starts, sizes)
        assert sum(seen) <= 1.06 * (parts[:, 1] - parts[:, 0]).sum()


def test_held_out_rows(finder):
    """Made sentences of another seed, and forms that training never makes: precision and recall of the tagger alone."""
    for held, least in ((False, {"recall": 0.98, "precision": 0.98}), (True, {"recall": 0.85, "precision": 0.95})):
        rnd = random.Random(4711)
        rows = [forms.sentence(rnd, held) for _ in range(600)]
        gold = [{(s, k) for s, _, k in spans} for _, spans in rows]
        found = [{(s, k) for s, _, k in items} for items in finder.find([t for t, _ in rows])]
        both = sum(len(g & f) for g, f in zip(gold, found))
        assert both / sum(map(len, gold)) >= least["recall"] and both / sum(map(len, found)) >= least["precision"]


def test_frames(spark):
    rows = [("a", "Call +44 (0)7700 900404. Call +44 (0)7700 900404.", 1), ("a", "Call +44 (0)7700 900404. Call +44 (0)7700 900404.", 2), ("b", None, 3), ("c", "", 4), (None, "Call +44 7700 900404.", 5), ("d", "owner: Mira Dulkwick", 6)]
    texts = spark.createDataFrame(rows, "text_id string, text string, pii_type long")
    found = sorted(tuple(r)[:3] for r in pii.found(texts, "text_id", "text").collect())
    assert found == [("a", "phone", 5), ("a", "phone", 30), ("d", "person_name", 7)]
    clean = {r.text_id: (r.text, [tuple(x) for x in r.redactions]) for r in pii.redacted(texts, "text_id", "text").collect()}
    assert clean["a"] == ("Call <redacted:phone>. Call <redacted:phone>.", [("phone", 2)]) and clean["b"] == (None, []) and clean["d"] == ("owner: <redacted:person-name>", [("person_name", 1)])
    assert pii.found(texts.filter("false"), "text_id", "text").count() == 0


def test_characters_beyond_ascii():
    assert len(char_ids("aé漢👍\ud800"[:4])) == 4 and char_ids("é")[0] == char_ids("e")[0] and len(TAGS) == 11
