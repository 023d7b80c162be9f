"""Byte-level BPE by ranks: a fold of ranked merges over the bytes of distinct words, and decoding by concatenation.

A text is cut into words by the vocabulary's pattern; each word's bytes are merged pair by pair, lowest rank first and
leftmost among equals, until no neighbouring pair has a rank. Equal words have equal codes, so every task folds the
merges once per distinct word and looks the rest up. Decoding joins the byte pieces of the ids.

Cutting by the pattern is the dearest step, so it is done per distinct chunk as well: a text falls apart before every
single space, since no word of the pattern holds a space behind another character. Runs of white space with two spaces
are the exception; texts that have one are cut by the pattern as a whole.

Defined results: a null text is empty and has no ids; special tokens' strings are ordinary text; repeated rows have
equal ids; ids outside the vocabulary cannot be decoded and raise.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tabflow.llm.common import kept_by_worker
from tabflow.llm.words import WordCodes, bunches
from tabflow.runtime import col

#: Two spaces in one run of white space.
_TWO_SPACES = re.compile(r" [^\S ]* ")
#: Marks that often end a word.
_TAIL = ".,;:!?"
#: Words of so many bytes are merged one at a time, with a heap.
LONG = 48
#: Distinct chunks, and distinct words, that a Python worker keeps.
CHUNKS, WORDS = 100_000, 80_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a public vocabulary: per line a piece in base64 and its rank. Read by the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


class Merges:
    """The rank map, by bytes and by pairs of ids: a pair's rank is that of its joined bytes, which is its id, too."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.none = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    pairs[left * self.none + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.none + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.none)

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and their numbers. Each round merges one pair in every unfinished word."""
        known = [(i, [self.ranks[w]] if w in self.ranks else merge_long(w, self.ranks)) for i, w in enumerate(words) if len(w) >= LONG or w in self.ranks]
        done = {i for i, _ in known}
        names = np.array([i for i in range(len(words)) if i not in done], np.int64)
        sizes = np.array([len(words[i]) for i in names.tolist()], np.int64)
        ids = self.bytes[np.frombuffer(b"".join(words[i] for i in names.tolist()), np.uint8)]
        word = np.repeat(np.arange(len(names)), sizes)
        rank = self._ranks(ids, word)
        found = [(np.array([i for i, x in known for _ in x], np.int64), np.array([t for _, x in known for t in x], np.int64))]
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            number = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            live = (least < self.none)[number]
            found.append((names[word[~live]], ids[~live]))
            # Leftmost pair of least rank in each word.
            at = np.flatnonzero(live & (rank == least[number]))
            at = at[np.concatenate([[True], number[at][1:] != number[at][:-1]])] if len(at) else at
            ids[at] = rank[at]
            live[at + 1] = False
            # Neighbours of a merged pair get new ranks; the others keep theirs.
            stale = np.zeros(len(ids), bool)
            stale[at] = True
            stale[np.maximum(at - 1, 0)] = True
            ids, word, rank, stale = ids[live], word[live], rank[live], stale[live]
            again = np.flatnonzero(stale)
            rank[again] = self._ranks(ids, word, again)
        owner = np.concatenate([x for x, _ in found])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([x for _, x in found])[order], np.bincount(owner, minlength=len(words))

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of each place with its right neighbour, if that is of the same word."""
        at = np.arange(len(ids)) if at is None else at
        right = np.minimum(at + 1, len(ids) - 1)
        return np.where((word[at] == word[right]) & (at < right), self.rank(ids[at], ids[right]), self.none)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word; parts are spans named by their start, and a heap holds pairs that may have gone stale."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (rank := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
            continue
        end[end[i]], end[i] = 0, stop  # 0: no part starts here any more
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges, self.pattern = Merges(ranks), regex.compile(pattern)
        self.words = WordCodes(lambda words: self.merges.fold([w.encode() for w in words]), WORDS)
        self.chunks = WordCodes(self._chunks, CHUNKS)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A chunk is what follows a space; a blank at its end says that no space goes before."""
        return self.words.grouped([self._cut(c[:-1] if c.endswith(" ") else " " + c) for c in chunks])

    def _cut(self, chunk: str) -> list[str]:
        body = chunk.rstrip(_TAIL)
        # A space and common letters with marks behind them need no pattern.
        if body[1:].isalpha() and body[0] == " " and max(body) < "ɐ":
            return [body, chunk[len(body) :]] if len(body) < len(chunk) else [body]
        return self.pattern.findall(chunk)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not _TWO_SPACES.search(t)]
        split = [texts[i].split(" ") for i in plain]
        for chunks in split:
            chunks[0] += " "
        for i, ids in zip(plain, self.chunks.texts(split), strict=True):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.words.texts([self.pattern.findall(texts[i]) for i in rest]), strict=True):
            out[i] = ids
        return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The named columns, or all, and `ids`, an array of token ids per row.

    The ranks are sent to each executor once; their number is that of the vocabulary. Texts come in Arrow batches and
    are encoded and given out a bunch at a time.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.md5(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    kept = [c for c in (docs.columns if carry is None else carry) if c != "ids"]
    rows = docs.select(*[col(c) for c in kept], F.coalesce(col(text), F.lit("")).alias("ids"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(("bpe", name), lambda: Encoder(held.value, pattern))
        for batch in batches:
            at = 0
            for some in bunches(x.as_py() for x in batch.column(batch.num_columns - 1)):
                found = encoder(some)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], batch.schema.names)
                at += len(some)
            pa.default_memory_pool().release_unused()  # workers outlive their tasks, and there may be several

    schema = StructType([*rows.schema.fields[:-1], StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(of, schema)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of a text: the pieces of its ids, one after the other, joined as hex digits and read back."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    known = F.split(F.lit(",".join(pieces)), ",")  # a constant of the plan, as large as the vocabulary
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(known, i + 1)), ""))
