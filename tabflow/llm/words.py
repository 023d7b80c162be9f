"""Codes of distinct words, kept by a Python worker from batch to batch within a bound."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Encoded = tuple[np.ndarray, np.ndarray]


class _Numbers(dict):
    """Word -> its number; a word that is new gets the next one and is noted."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, word) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordCodes:
    """Word -> its token ids; every distinct word is encoded once and then looked up.

    `encode` takes distinct words and gives their ids end to end and the number of ids per word. When the store holds
    `limit` words, the half of them used most often stays, so memory is bounded whatever the vocabulary; the others are
    encoded again when they come again.
    """

    def __init__(self, encode: Callable[[list], Encoded], limit: int):
        self.encode, self.limit = encode, limit
        self.number = _Numbers()
        self.starts, self.lengths, self.pool = (np.zeros(1 << 12, kind) for kind in (np.int64, np.int32, np.int32))
        #: Calls that a word was used in, and entries of the pool.
        self.calls = np.zeros(1 << 12, np.int32)
        self.used = 0

    def _shrink(self) -> None:
        """Keep the words used in most calls, half of the limit at most; how often counts half from now on."""
        n = len(self.number)
        calls = self.calls[:n]
        kept = calls > np.partition(calls, n - 1 - self.limit // 2)[n - 1 - self.limit // 2]
        at = np.flatnonzero(kept)
        number = _Numbers()
        number.update(zip(itertools.compress(self.number, kept.tolist()), range(len(at))))
        lengths = self.lengths[at].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        pool = self.pool[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)]
        self.number, self.used = number, total
        self.starts[: len(at)], self.lengths[: len(at)], self.pool[:total] = ends - lengths, lengths, pool
        self.calls[: len(at)] = calls[at] // 2
        self.calls[len(at) :] = 0

    def _room(self, name: str, size: int) -> np.ndarray:
        held = getattr(self, name)
        if size > len(held):
            grown = np.zeros(max(size, 2 * len(held)), held.dtype)
            grown[: len(held)] = held
            setattr(self, name, grown)
        return getattr(self, name)

    def _add(self) -> None:
        """Encode the words noted as new; they have the highest numbers."""
        words, self.number.new = self.number.new, []
        ids, lengths = self.encode(words)
        n = len(self.number)
        k = n - len(words)
        self._room("starts", n)[k:n] = self.used + np.cumsum(lengths) - lengths
        self._room("lengths", n)[k:n] = lengths
        self._room("calls", n)
        self._room("pool", self.used + len(ids))[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def __call__(self, words: list) -> Encoded:
        """Ids of all words end to end, and the number of ids per word."""
        if len(self.number) >= self.limit:
            self._shrink()
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.new:
            self._add()
        self.calls[at] += 1  # once per call, however often a word occurs
        lengths = self.lengths[at].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)
        return self.pool[take], lengths

    def grouped(self, split: list[list]) -> Encoded:
        """Ids of several lists of words end to end, and the number of ids per list."""
        ids, lengths = self(list(itertools.chain.from_iterable(split)))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])]
        return ids, np.diff(at)

    def texts(self, split: list[list]) -> list[np.ndarray]:
        """Ids of several texts, given as their words."""
        ids, lengths = self.grouped(split)
        return np.split(ids, np.cumsum(lengths)[:-1]) if split else []


def distinct_words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, for each of their words its place there, and the number of words per text.

    Words stand between ASCII white space.
    """
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = split.flatten().dictionary_encode()
    distinct, at, offsets = coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy()
    # White space at a text's start or end leaves an empty word there.
    some = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)
    if some.all():
        return distinct, at, np.diff(offsets)
    kept = some[at]
    counts = np.diff(np.concatenate([[0], np.cumsum(kept)])[offsets])
    return distinct.filter(pa.array(some)), (np.cumsum(some) - 1)[at[kept]], counts


def listed(words: pa.Array) -> list[str]:
    """The words, none of them empty or with a line end, as a list; in one pass, which is faster than one by one."""
    if not len(words):
        return []
    one = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    return pc.binary_join(one, pa.scalar("\n", words.type))[0].as_py().split("\n")


def spread(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of a pool end to end, given where they start and how long they are."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def bunches(texts: Iterable[str], chars: int = 500_000) -> Iterable[list[str]]:
    """Consecutive texts in lists of about so many characters; a longer text is a list of its own."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > chars:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some
