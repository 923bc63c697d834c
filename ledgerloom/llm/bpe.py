"""Exact byte-pair encoding in linear time, by backtracking over longest matches.

The vocabulary's byte strings, read as Latin-1, form an Aho-Corasick automaton that
gives the longest token at a position.  Going from left to right the longest token is
taken whose border with the token before it is one that the merges would leave; where
none is, the position is marked dead and the last token is shortened.  Whether two
adjacent tokens are compatible is decided by undoing merges from the latest on and is
memoised.  (The published linear-time backtracking encoder for byte-pair encodings.)

Words come from the tokenizer's own splitting pattern and are memoised up to a bounded
number.  Defined results: null, empty texts have no ids (an empty list); special tokens
are ordinary text; long texts without any word border stay linear.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: The splitting pattern of byte_bpe_50k, and the same over ASCII.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
MEMO_WORDS, MEMO_LENGTH = 500_000, 48


def default_vocabulary() -> str:
    """The installed vocabulary file of byte_bpe_50k."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class BytePairs:
    """The vocabulary of one tokenizer with its encoder."""

    def __init__(self, vocabulary: bytes):
        import ahocorasick

        lines = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.rank = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in lines}
        self.text = {rank: token for token, rank in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self._shorter: dict[int, int | None] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def longest(self, word: str, at: int) -> int:
        return next(self.automaton.iter_long(word, at))[1]

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self._shorter:
            text = self.text[token]
            self._shorter[token] = next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank), None)
        return self._shorter[token]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is ``token``; None for a single byte."""
        if token not in self._halves:
            text, found = self.text[token], None
            left = self.shorter(token)
            while left is not None and found is None:
                right = self.rank.get(text[len(self.text[left]) :])
                if right is not None and left < token and right < token and self.fits(left, right, below=token):
                    found = (left, right)
                left = self.shorter(left)
            self._halves[token] = found
        return self._halves[token]

    def fits(self, left: int, right: int, below: int | None = None) -> bool:
        """True if merging leaves a border between the two tokens where they meet.

        Undoes the later of the two tokens' last merges again and again: the border is lost
        if at some step the inner tokens merge before the outer one came to be.
        ``below``: regard only merges before this one.
        """
        key = (left, right)
        if below is None and key in self._fits:
            return self._fits[key]
        a, b, limit, kept = left, right, below if below is not None else 1 << 60, True
        while True:
            merged = self.rank.get(self.text[a] + self.text[b])
            if merged is not None and merged < limit and self.halves(merged) == (a, b):
                kept = False
                break
            parts_a, parts_b = self.halves(a), self.halves(b)
            if parts_a and (a > b or not parts_b):
                a, limit = parts_a[1], min(limit, a) if below is not None else a
            elif parts_b:
                b, limit = parts_b[0], min(limit, b + 1) if below is not None else b + 1
            else:
                break
        if below is None:
            self._fits[key] = kept
        return kept

    def encode_bytes(self, word: str) -> list[int]:
        """The ids of one word, given as Latin-1 text of its bytes."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        end, at, tokens, alive = len(word), 0, [], bytearray(b"\x01") * (len(word) + 1)
        token = self.longest(word, 0)
        while True:
            last = tokens[-1] if tokens else None
            while token is not None and not (alive[at + len(self.text[token])] and (last is None or self.fits(last, token))):
                token = self.shorter(token)
            if token is None:
                alive[at] = 0
                token = tokens.pop()
                at -= len(self.text[token])
                continue
            tokens.append(token)
            at += len(self.text[token])
            if at == end:
                return tokens
            token = self.longest(word, at)


class Words(dict):
    """Ids by word, filled as words come, emptied when it is full."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.pairs.encode_bytes(word.encode("utf-8").decode("latin-1")))
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


_loaded: dict[str, tuple] = {}


def encoder(vocabulary: str, content: bytes | None = None):
    """text -> array of ids; the tables are built once in each Python worker, of the file or of its ``content``."""
    if vocabulary not in _loaded:
        import regex

        words = Words(BytePairs(Path(vocabulary).read_bytes() if content is None else content))
        _loaded[vocabulary] = (words.__getitem__, re.compile(ASCII_PATTERN, re.ASCII).findall, regex.compile(PATTERN).findall)
    lookup, ascii_words, all_words = _loaded[vocabulary]

    def encode(text: str | None) -> array:
        if not text:
            return array("i")
        split = ascii_words if text.isascii() and not _RARE_SPACE(text) else all_words
        return array("i", chain.from_iterable(map(lookup, split(text))))

    return encode


#: Characters that the two patterns' white space may treat unlike.
_RARE_SPACE = re.compile("[\x1c-\x1f]").search


def encoded(rows: DataFrame, key_col: str, text_col: str, vocabulary: str | None = None, sizes_only: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens): a map over Arrow batches, without a shuffle."""
    vocabulary = vocabulary or default_vocabulary()
    kind = rows.schema[key_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # the vocabulary file, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            if sizes_only:
                sizes = pa.array([len(encode(t.as_py())) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, sizes], names=[key_col, "n_tokens"])
                continue
            flat, ends = array("i"), [0]
            for t in texts:
                flat.extend(encode(t.as_py()))
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, np.int32), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([keys, ids], names=[key_col, "ids"])

    out = f"`{key_col}` {kind}, " + ("n_tokens long" if sizes_only else "ids array<int>")
    return spread(rows.select(F.col(f"`{key_col}`"), F.col(f"`{text_col}`"))).mapInArrow(run, out)
