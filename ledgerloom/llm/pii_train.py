"""Training of the tagger from labelled spans.

    OPENBLAS_NUM_THREADS=1 python -m ledgerloom.llm.pii_train DATA_DIR SECONDS [PROCESSES]

Three kinds of rows: windows of the tables' texts around the items that the labelling
functions mark, half of the time with items made anew in their place; windows of the
same texts without any item, among them those in which the tagger was wrong before;
and made sentences (``pii_forms``) alone or inside such a text.  The texts are a sample
of at most ``TEXTS`` chosen by hash.  Processes hold equal copies of the model, each
works out the gradient of its own batch, and all apply the mean of the gradients.
"""

from __future__ import annotations

import multiprocessing as mp
import random
import sys
import time
import zlib
from pathlib import Path

import numpy as np

from . import pii_forms as forms
from . import pii_rules as rules
from .pii_model import PAD, TAGS, Adam, Tagger, char_ids

TEXTS = 60_000
WINDOW = 128
HIDDEN = 32
WIDTH = 64
WEIGHTS = Path(__file__).with_name("pii_tagger.npz")
TAG_OF = {t: i for i, t in enumerate(TAGS)}
Labelled = tuple[str, list[rules.Span]]


def read_texts(data: str) -> tuple[list[str], rules.Names]:
    import pyarrow.parquet as pq

    texts: set[str] = set()
    for name in ("semantic_texts", "evidence_segments"):
        texts.update(t for t in pq.read_table(f"{data}/{name}.parquet", columns=["text"])["text"].to_pylist() if t and t.strip())
    chosen = sorted(texts, key=lambda t: (zlib.crc32(t.encode()), t))[:TEXTS]
    people = pq.read_table(f"{data}/people.parquet")
    return chosen, rules.Names(people["given_name"].to_pylist(), people["family_name"].to_pylist())


def window(text: str, spans: list[rules.Span], centre: int) -> Labelled:
    a = max(0, min(centre - WINDOW // 2, len(text) - WINDOW))
    b = min(len(text), a + WINDOW)
    return text[a:b], [(s - a, min(e, b) - a, k) for s, e, k in spans if s < b and e > a]


def varied(text: str, spans: list[rules.Span], rnd: random.Random) -> Labelled:
    """The text with other items, or other digits, in place of some of its items; labels move along."""
    out, length, at, moved = [], 0, 0, []
    for s, e, kind in spans:
        item, roll = text[s:e], rnd.random()
        if roll < 0.3:
            item = forms.MAKERS[kind](rnd)
        elif roll < 0.6 and kind in ("phone", "id_number", "street_address", "email"):
            item = "".join(rnd.choice("0123456789") if c.isdigit() and i > 1 and rnd.random() < 0.7 else c for i, c in enumerate(item))
        out += [text[at:s], item]
        length += s - at
        moved.append((length, length + len(item), kind))
        length += len(item)
        at = e
    return "".join(out) + text[at:], moved


def arrays(batch: list[Labelled]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, tags and mask (T, B) of a batch; an item cut off at the left begins with its I tag."""
    steps = min(WINDOW + 48, max(len(t) for t, _ in batch))
    ids, tags, mask = np.full((steps, len(batch)), PAD, np.int16), np.zeros((steps, len(batch)), np.int64), np.zeros((steps, len(batch)), np.float32)
    for j, (text, spans) in enumerate(batch):
        codes = char_ids(text)[:steps]
        ids[: len(codes), j] = codes
        mask[: len(codes), j] = 1
        for s, e, kind in spans:
            if s < steps:
                tags[max(s, 0) : e, j] = TAG_OF[f"I-{kind}"]
                if s >= 0:
                    tags[s, j] = TAG_OF[f"B-{kind}"]
    return ids, tags, mask


class Rows:
    """Endless labelled rows for training."""

    def __init__(self, labelled: list[Labelled], rnd: random.Random):
        self.rnd = rnd
        self.with_items = [x for x in labelled if x[1]]
        self.without = [x for x in labelled if not x[1]]
        self.hard: list[tuple[str, list[rules.Span], int]] = []

    def one(self) -> Labelled:
        rnd, roll = self.rnd, self.rnd.random()
        if roll < 0.42:
            text, spans = rnd.choice(self.with_items)
            text, spans = varied(text, spans, rnd) if rnd.random() < 0.6 else (text, spans)
            centre = sum(rnd.choice(spans)[:2]) // 2 + rnd.randint(-50, 50)
            return window(text, spans, centre)
        if roll < 0.58 and self.hard:
            text, spans, at = rnd.choice(self.hard)
            return window(text, spans, at + rnd.randint(-40, 40))
        if roll < 0.78:
            made, spans = forms.sentence(rnd)
            if rnd.random() < 0.5:
                other, theirs = forms.sentence(rnd)
                gap = rnd.choice((" ", "\n", ". ", "; "))
                spans = spans + [(s + len(made) + len(gap), e + len(made) + len(gap), k) for s, e, k in theirs]
                made += gap + other
            if rnd.random() < 0.6:
                text = rnd.choice(self.without)[0]
                at = rnd.randrange(len(text) + 1)
                before, after = text[max(0, at - rnd.randint(0, 70)) : at], text[at : at + rnd.randint(0, 60)]
                before += rnd.choice((" ", "\n", ". "))
                made, spans = before + made + rnd.choice((" ", "\n", ". ")) + after, [(s + len(before), e + len(before), k) for s, e, k in spans]
            return made[: WINDOW + 48], [(s, min(e, WINDOW + 48), k) for s, e, k in spans if s < WINDOW + 48]
        text, spans = rnd.choice(self.without if rnd.random() < 0.8 else self.with_items)
        return window(text, spans, rnd.randrange(len(text)))

    def mine(self, finder, count: int) -> int:
        """Take the places where the tagger is wrong on some of the texts as rows of their own."""
        some = self.rnd.sample(self.without, min(count, len(self.without))) + self.rnd.sample(self.with_items, min(count // 4, len(self.with_items)))
        for (text, spans), found in zip(some, finder.find([t for t, _ in some])):
            wrong = set(found) ^ set(spans)
            self.hard += [(text, spans, (s + e) // 2) for s, e, _ in wrong]
        self.hard = self.hard[-3000:]
        return len(self.hard)


def _work(rank: int, processes: int, labelled: list[Labelled], seconds: float, hidden: int, seed: int, start: str | None, slots, barrier, out: str) -> None:
    from .pii import Finder

    rows = Rows(labelled, random.Random(seed * 1000 + rank))
    model = Tagger.load(start) if start else Tagger.fresh(hidden, seed)
    model.constrain()
    adam = Adam(model, 0.01)
    shapes = {n: getattr(model, n).shape for n in Tagger.NAMES}
    size = sum(int(np.prod(s)) for s in shapes.values())
    shared = np.frombuffer(slots, np.float32).reshape(processes, size + 2)
    mean, average = {}, None
    began, k, losses, progress = time.time(), 0, [], 0.0
    mined = 0
    while progress < 1:
        adam.rate = (0.004 if start else 0.01) * min(1.0, 0.02 + 40 * progress) * max(0.01, min(1.0, 1.5 * (1 - progress)))
        loss, grads = model.loss_and_gradients(*arrays([rows.one() for _ in range(WIDTH)]))
        shared[rank, :size] = np.concatenate([grads[n].ravel() for n in Tagger.NAMES])
        shared[rank, size] = loss
        shared[rank, size + 1] = (time.time() - began) / seconds
        barrier.wait()
        mean_all = shared.mean(0)
        barrier.wait()
        at = 0
        for n in Tagger.NAMES:
            length = int(np.prod(shapes[n]))
            mean[n] = mean_all[at : at + length].reshape(shapes[n])
            at += length
        adam.step(mean, 3.0)
        progress = float(mean_all[size + 1])
        losses.append(float(mean_all[size]))
        k += 1
        if progress > 0.6:  # the mean of the late weights is steadier than the last
            now = {n: getattr(model, n).astype(np.float64) for n in Tagger.NAMES}
            average = now if average is None else {n: average[n] + 0.01 * (now[n] - average[n]) for n in now}
        if progress > 0.2 + mined * 0.1:
            mined += 1
            count = rows.mine(Finder(model), 1500)
            if rank == 0:
                print(f"{progress:.2f} step {k}: loss {np.mean(losses[-200:]):.4f}, {count} hard places", flush=True)
                model.save(out)
    if rank == 0:
        for n in Tagger.NAMES:
            setattr(model, n, average[n].astype(np.float32))
        model.constrain()
        model.save(out)


def train(data: str, seconds: float = 600, processes: int = 8, hidden: int = HIDDEN, seed: int = 7, start: str | None = None, out: str | Path = WEIGHTS) -> Tagger:
    texts, names = read_texts(data)
    with mp.get_context("fork").Pool(processes) as pool:
        labels = pool.starmap(rules.find_all, [(t, names) for t in texts], chunksize=500)
    labelled = list(zip(texts, labels))
    print(f"{sum(map(bool, labels))} of {len(texts)} texts have items", flush=True)
    size = sum(getattr(Tagger.fresh(hidden), n).size for n in Tagger.NAMES) + 2
    context = mp.get_context("fork")
    slots, barrier = context.RawArray("f", processes * size), context.Barrier(processes)
    workers = [context.Process(target=_work, args=(r, processes, labelled, seconds, hidden, seed, start, slots, barrier, str(out))) for r in range(processes)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    return Tagger.load(out)


if __name__ == "__main__":
    train(sys.argv[1], *(float(x) for x in sys.argv[2:3]), *(int(x) for x in sys.argv[3:4]))
