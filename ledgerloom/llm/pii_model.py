"""A character-level bidirectional LSTM with CRF transitions, in numpy.

One layer per direction.  Characters enter through a table of gate inputs (embedding and
input weights in one), gates are piecewise linear, and the tags are O and B/I of each
kind.  Training is plain back-propagation through time with the CRF's exact likelihood,
by Adam, under two constraints on the transitions: an I tag follows only the B or I of
its kind, and no transition gains over O to O, which is 0.  The second is what lets a
decoder prove that a character is outside (see ``pii.Finder``).
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
K = len(TAGS)
PAD = 0
#: Which tag may follow which: an I tag only the B or I of its kind.
ALLOWED = np.array([[not b.startswith("I") or a[2:] == b[2:] for b in TAGS] for a in TAGS])
FORBIDDEN = -1e4
#: Input of a gate that nothing opens.
CLOSED = -1e9
BLOCK, STEPS = 32, 64
_PRINTABLE = [chr(c) for c in range(32, 127)]
_CLASSES = ["upper", "lower", "other letter", "cjk", "digit", "space", "mark", "format", "dash", "quote", "punct", "symbol", "rest", "newline"]
_IDS = {c: i + 1 for i, c in enumerate(_PRINTABLE)}
_FIRST_CLASS = len(_PRINTABLE) + 1
VOCABULARY = _FIRST_CLASS + len(_CLASSES)


@cache
def _class_of(code: int) -> int:
    ch = chr(code)
    if ch in "\n\r\x85  ":
        name = "newline"
    elif 0xFF01 <= code <= 0xFF5E:
        return char_id(code - 0xFEE0)
    elif unicodedata.category(ch)[0] == "L":
        base = unicodedata.normalize("NFKD", ch)[0]
        if base.isascii() and base.isalpha():
            return _IDS[base]
        name = "cjk" if 0x2E80 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7AF or code >= 0x20000 else "upper" if ch.isupper() else "lower" if ch.islower() else "other letter"
    else:
        cat = unicodedata.category(ch)
        name = {"Nd": "digit", "No": "digit", "Nl": "digit", "Zs": "space", "Cc": "space", "Mn": "mark", "Mc": "mark", "Me": "mark", "Cf": "format", "Pd": "dash", "Pi": "quote", "Pf": "quote"}.get(cat)
        name = name or ("punct" if cat[0] == "P" else "symbol" if cat[0] == "S" else "rest")
    return _FIRST_CLASS + _CLASSES.index(name)


def char_id(code: int) -> int:
    return _IDS[chr(code)] if 32 <= code < 127 else _class_of(code)


_TABLE: np.ndarray | None = None


def char_ids(text: str) -> np.ndarray:
    """The vocabulary id of each code point."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([char_id(c) if not 0xD800 <= c <= 0xDFFF else _FIRST_CLASS + 12 for c in range(0x3100)], dtype=np.int16)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = codes < len(_TABLE)
    if low.all():
        return _TABLE[codes]
    out = np.empty(len(codes), np.int16)
    out[low] = _TABLE[codes[low]]
    out[~low] = [char_id(int(c)) for c in codes[~low]]
    return out


@dataclass
class Tagger:
    """Weights: table (2, 4H, V), recurrent (2, 4H, H), out (K, 2H), bias (K), trans (K, K), start (K)."""

    table: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    NAMES = ("table", "recurrent", "out", "bias", "trans", "start")

    @classmethod
    def fresh(cls, hidden: int, seed: int = 0) -> Tagger:
        rnd = np.random.default_rng(seed)
        table = rnd.normal(0, 0.25, (2, 4 * hidden, VOCABULARY)).astype(np.float32)
        table[:, hidden : 2 * hidden] += 1.0  # remember at first
        recurrent = (rnd.normal(0, 1, (2, 4 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        return cls(table, recurrent, rnd.normal(0, 0.2, (K, 2 * hidden)).astype(np.float32), np.zeros(K, np.float32), np.where(ALLOWED, 0, FORBIDDEN).astype(np.float32), np.zeros(K, np.float32))

    @classmethod
    def load(cls, path) -> Tagger:
        with np.load(path) as z:
            return cls(*(z[n].astype(np.float32) for n in cls.NAMES))

    def save(self, path) -> None:
        np.savez_compressed(path, **{n: getattr(self, n).astype(np.float16) for n in self.NAMES})

    @property
    def hidden(self) -> int:
        return self.recurrent.shape[2]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(T, B, K) scores of ``ids`` (T, B), a lane of windows with a PAD between them per row of every product.

        A PAD closes all gates, which leaves the state as it is before a text, so a window's
        scores follow from its own characters alone.  Each gate lies in a block of its own
        (4, B, H), so that a step runs over unbroken memory, and ``STEPS`` steps at a time are
        turned into scores while they are in the cache.  A product has at most 256 rows
        (``pii.WIDTH``) of one gate, which BLAS does not share out to threads: the cores are
        taken by as many tasks already.
        """
        steps, given = ids.shape
        width = -(-given // BLOCK) * BLOCK
        ids = np.pad(ids, ((0, 0), (0, width - given)), constant_values=PAD)
        n = self.hidden
        scores = np.empty((steps, width, K), np.float32)
        scores[:] = self.bias
        states = np.empty((STEPS, width, n), np.float32)
        gates, entering = np.empty((4, width, n), np.float32), np.empty((4, width, n), np.float32)
        into, forget, onward, soft = gates[0], gates[1], gates[2], gates[:3]
        low, high = np.float32(0), np.float32(1)
        block = VOCABULARY * np.arange(4)[:, None]
        for d in (0, 1):
            table = np.ascontiguousarray(self.table[d].reshape(4, n, VOCABULARY).transpose(0, 2, 1))
            table[:, PAD] = np.array([CLOSED, CLOSED, CLOSED, 0], np.float32)[:, None]
            table = table.reshape(-1, n)
            recurrent = np.ascontiguousarray(self.recurrent[d].reshape(4, n, n).transpose(0, 2, 1))
            out = np.ascontiguousarray(self.out[:, d * n : (d + 1) * n].T)
            h, c, new = (np.zeros((width, n), np.float32) for _ in range(3))
            for k in range(0, steps, STEPS) if d == 0 else range((steps - 1) // STEPS * STEPS, -1, -STEPS):
                rows = ids[k : k + STEPS, None] + block
                for t in range(len(rows)) if d == 0 else range(len(rows) - 1, -1, -1):
                    table.take(rows[t], 0, entering, "clip")
                    np.matmul(h, recurrent, out=gates)
                    np.add(gates, entering, out=gates)
                    soft.clip(low, high, soft)
                    np.tanh(gates[3], out=new)
                    np.multiply(new, into, out=new)
                    np.multiply(c, forget, out=c)
                    np.add(c, new, out=c)
                    np.tanh(c, out=new)
                    h = np.multiply(new, onward, out=states[t])
                scores[k : k + STEPS] += np.matmul(states[: len(rows)], out)
        return scores[:, :given]

    def constrain(self) -> None:
        """Bring the transitions back under their constraints."""
        self.trans = np.where(ALLOWED, np.minimum(self.trans, 0), FORBIDDEN).astype(self.trans.dtype)
        self.trans[0, 0] = 0
        self.start = np.minimum(self.start, 0)
        self.start[0] = 0

    # training

    def loss_and_gradients(self, ids: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of ``tags`` (T, B) and its gradients; ``mask`` (T, B) is 0 on padding at the end."""
        steps, width = ids.shape
        n = self.hidden
        order = [ids, ids[::-1]]
        h, c = np.zeros((2, n, width), np.float32), np.zeros((2, n, width), np.float32)
        raw, cell, tcell, hid = (np.empty((steps, 2, m, width), np.float32) for m in (4 * n, n, n, n))
        for t in range(steps):
            z = np.matmul(self.recurrent, h)
            for d in (0, 1):
                z[d] += self.table[d][:, order[d][t]]
            raw[t, :, : 3 * n] = z[:, : 3 * n]
            raw[t, :, 3 * n :] = np.tanh(z[:, 3 * n :])
            g = np.clip(z[:, : 3 * n], 0, 1)
            c = g[:, n : 2 * n] * c + g[:, :n] * raw[t, :, 3 * n :]
            cell[t], tcell[t] = c, np.tanh(c)
            h = g[:, 2 * n :] * tcell[t]
            hid[t] = h
        ahead, back = hid[:, 0], hid[::-1, 1]
        scores = np.matmul(self.out[:, :n], ahead) + np.matmul(self.out[:, n:], back) + self.bias[:, None]
        loss, d_scores, d_trans, d_start = self._crf(scores, tags, mask)
        grads = {"trans": d_trans, "start": d_start, "bias": d_scores.sum((0, 2))}
        grads["out"] = np.concatenate([np.tensordot(d_scores, s, ([0, 2], [0, 2])) for s in (ahead, back)], 1)
        d_hid = np.empty_like(hid)
        d_hid[:, 0] = np.matmul(self.out[:, :n].T, d_scores)
        d_hid[::-1, 1] = np.matmul(self.out[:, n:].T, d_scores)
        d_raw = np.empty_like(raw)
        dh_next, dc = np.zeros((2, n, width), np.float32), np.zeros((2, n, width), np.float32)
        back_w = self.recurrent.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            dh = d_hid[t] + dh_next
            z = raw[t]
            g = np.clip(z[:, : 3 * n], 0, 1)
            live = (z[:, : 3 * n] > 0) & (z[:, : 3 * n] < 1)
            dc = dc + dh * g[:, 2 * n :] * (1 - tcell[t] ** 2)
            before = cell[t - 1] if t else np.zeros_like(dc)
            d_raw[t, :, :n] = dc * z[:, 3 * n :] * live[:, :n]
            d_raw[t, :, n : 2 * n] = dc * before * live[:, n : 2 * n]
            d_raw[t, :, 2 * n : 3 * n] = dh * tcell[t] * live[:, 2 * n :]
            d_raw[t, :, 3 * n :] = dc * g[:, :n] * (1 - z[:, 3 * n :] ** 2)
            dh_next = np.matmul(back_w, d_raw[t])
            dc = dc * g[:, n : 2 * n]
        grads["recurrent"] = np.zeros_like(self.recurrent)
        grads["table"] = np.zeros_like(self.table)
        for d in (0, 1):
            flat = d_raw[:, d].transpose(0, 2, 1).reshape(-1, 4 * n)
            grads["recurrent"][d] = flat[width:].T @ hid[:-1, d].transpose(0, 2, 1).reshape(-1, n)
            one = np.zeros((steps * width, VOCABULARY), np.float32)
            one[np.arange(steps * width), order[d].reshape(-1)] = 1
            grads["table"][d] = flat.T @ one
        return loss, grads

    def _crf(self, scores, tags, mask):
        steps, _, width = scores.shape
        cols = np.arange(width)
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        top = lambda x, axis: (m := x.max(axis, keepdims=True), np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis))[1]
        alpha[0] = scores[0] + self.start[:, None]
        for t in range(1, steps):
            step = top(alpha[t - 1][:, None] + self.trans[:, :, None], 0) + scores[t]
            alpha[t] = np.where(mask[t], step, alpha[t - 1])
        total = top(alpha[-1], 0)
        for t in range(steps - 2, -1, -1):
            step = top((scores[t + 1] + beta[t + 1])[None] + self.trans[:, :, None], 1)
            beta[t] = np.where(mask[t + 1], step, beta[t + 1])
        marginal = np.exp(alpha + beta - total) * mask[:, None, :]
        gold = scores[0][tags[0], cols] + self.start[tags[0]]
        d_trans = np.zeros_like(self.trans)
        for t in range(1, steps):
            on = mask[t]
            gold = gold + on * (scores[t][tags[t], cols] + self.trans[tags[t - 1], tags[t]])
            pair = np.exp(alpha[t - 1][:, None] + self.trans[:, :, None] + (scores[t] + beta[t])[None] - total)
            d_trans += (pair * on).sum(2)
            np.add.at(d_trans, (tags[t - 1][on > 0], tags[t][on > 0]), -1)
        scale = np.float32(1 / width)
        d_scores = marginal.copy()
        for t in range(steps):
            d_scores[t][tags[t], cols] -= mask[t]
        d_start = marginal[0].sum(1)
        np.subtract.at(d_start, tags[0], 1)
        return float((total - gold).mean()), d_scores * scale, d_trans * scale, d_start * scale


class Adam:
    def __init__(self, model: Tagger, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {n: np.zeros_like(getattr(model, n)) for n in Tagger.NAMES}
        self.v = {n: np.zeros_like(getattr(model, n)) for n in Tagger.NAMES}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        for n, g in grads.items():
            g = g * min(1.0, clip / max(size, 1e-9))
            self.m[n] = 0.9 * self.m[n] + 0.1 * g
            self.v[n] = 0.995 * self.v[n] + 0.005 * g * g
            step = self.m[n] / (1 - 0.9**self.t) / (np.sqrt(self.v[n] / (1 - 0.995**self.t)) + 1e-8)
            setattr(self.model, n, (getattr(self.model, n) - self.rate * step).astype(np.float32))
        self.model.constrain()
