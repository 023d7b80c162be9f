"""Token ids as wavelet matrices: one compressed binary file per shard, readable by position, count and occurrence.

Documents are encoded, put in order of their id, and laid end to end; a shard is a run of whole documents. Its ids are
kept as a wavelet matrix: one bit plane per bit of an id, the highest first, each plane in the order that results from
a stable partition by the planes before it. With a directory of ones per block every plane answers rank and select, and
so the shard answers `access`, `count` and `find` without decoding the rest.

File format (little endian): magic, number of ids, of documents and of planes; then as Zstandard frames with their
lengths: document ids, which of them are null, ids per document, and for each plane its number of zeros, its ones before
each block, and its bits.

Defined results: a null text is empty and holds only the end id; a null document id comes first; documents with one id
are ordered by text; repeated rows are kept; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabflow.llm.common import kept_by_worker
from tabflow.llm.words import WordCodes, bunches, distinct_words, listed, spread
from tabflow.runtime import col, scratch_dir

MAGIC = b"WVM1"
#: Ids after which a shard is closed at the next end of a document.
SHARD = 4_000_000
#: Bytes of a plane per entry of its directory.
BLOCK = 512
#: Distinct pre-tokens, and distinct words of more than letters and marks, that a Python worker keeps.
PIECES, OTHERS = 500_000, 150_000
#: Characters of texts whose distinct words are looked up together.
BUNCH = 2_000_000
#: Pre-tokens per call of the library, whose time per pre-token grows with longer texts.
CALL = 1000

# --- encoding -------------------------------------------------------------------------------------------------


class WordTokenizer:
    """Encodes by distinct words what the tokenizer would encode text by text.

    ASCII white space separates words for this tokenizer whatever stands beside it, so a text's ids are those of its
    words. Of the distinct words of some texts, those of letters, perhaps with marks behind them, are parted and lower-cased
    as Arrow columns; other words of common letters and marks fall apart by the tokenizer's own pattern. Those pre-tokens
    go to the library in one call, side by side, and their ids part where a token closes a pre-token. All other words
    go to the library one by one, also those that hold one of the file's added tokens, such as `<|endoftext|>`: the
    library takes these out of the text before it applies the pattern.
    """

    #: The pattern of the vocabulary file's pre-tokenizer; a fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Characters that no normal form joins, and whose lower case is one character.
    PLAIN = re.compile("[!-~À-įı-ſ]+")
    #: Letters of those, perhaps with marks behind them.
    LETTERS = r"^(?P<body>[A-Za-zÀ-ÖØ-öø-įı-ſ]+)(?P<marks>[.,;:!?]*)$"

    def __init__(self, file: str):
        self.library = Tokenizer.from_str(file)
        added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cut = regex.compile(self.PATTERN).findall
        self.pieces = WordCodes(self._pieces, PIECES)
        self.others = WordCodes(self._others, OTHERS)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        some = (" ".join(pieces[i : i + CALL]) for i in range(0, len(pieces), CALL))
        ids = np.array([i for t in some for i in self.library.encode_batch_fast([t], add_special_tokens=False)[0].ids], np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer does not close every pre-token")
        return ids, np.diff(ends, prepend=0)

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.cut(w.lower()) if self.PLAIN.fullmatch(w) and not self.added.search(w) else [] for w in words]
        ids, lengths = self.pieces.grouped(split)
        odd = [i for i, pieces in enumerate(split) if not pieces]
        if not odd:
            return ids, lengths
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for i, e in zip(odd, self.library.encode_batch([words[i] for i in odd], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, np.int64)
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and the number of ids per word."""
        parted = pc.extract_regex(words, self.LETTERS)
        whole = parted.is_valid()
        lettered = whole.to_numpy(zero_copy_only=False)
        bodies = pc.utf8_lower(parted.filter(whole).field("body")).dictionary_encode()
        marks = parted.filter(whole).field("marks").dictionary_encode()
        # What a word begins with, all of it unless there are marks, and what it ends with.
        starts, lengths = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        pools, used = [], 0

        def put(found: tuple[np.ndarray, np.ndarray], rows: np.ndarray, column: int, at: np.ndarray) -> None:
            nonlocal used
            ids, sizes = found
            starts[rows, column], lengths[rows, column] = (used + np.cumsum(sizes) - sizes)[at], sizes[at]
            pools.append(ids)
            used += len(ids)

        rows = np.flatnonzero(lettered)
        if len(rows):
            put(self.pieces(listed(bodies.dictionary)), rows, 0, bodies.indices.to_numpy())
            kinds = marks.dictionary.to_pylist()
            put(self.pieces.grouped([[m] if m else [] for m in kinds]), rows, 1, marks.indices.to_numpy())
        rest = np.flatnonzero(~lettered)
        if len(rest):
            put(self.others(listed(words.filter(pc.invert(whole)))), rest, 0, np.arange(len(rest)))
        return spread(np.concatenate(pools), starts.ravel(), lengths.ravel()), lengths.sum(1)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        distinct, at, counts = distinct_words(texts)
        if not len(at):
            return [np.zeros(0, np.int64) for _ in texts]
        ids, lengths = self._words(distinct)
        sizes = lengths[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return np.split(spread(ids, (np.cumsum(lengths) - lengths)[at], sizes), ends[np.cumsum(counts)[:-1]])


# --- the matrix -----------------------------------------------------------------------------------------------


class Plane:
    """Bits with rank and select."""

    def __init__(self, packed: np.ndarray, n: int, zeros: int, before: np.ndarray):
        self.packed, self.n, self.zeros, self.before = packed, n, zeros, before

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros(-(-len(packed) // BLOCK) * BLOCK, np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        return cls(packed, len(bits), int(len(bits) - ones.sum()), np.concatenate([[0], np.cumsum(ones)]))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n, bitorder="little").view(bool)

    def get(self, i: int) -> int:
        return int(self.packed[i >> 3]) >> (i & 7) & 1

    def ones(self, i: int) -> int:
        """Ones before place i."""
        block = (i >> 3) // BLOCK
        count = int(self.before[block]) + int(np.bitwise_count(self.packed[block * BLOCK : i >> 3]).sum())
        return count + ((int(self.packed[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) of the ones or zeros."""
        starts = np.arange(len(self.before)) * (BLOCK * 8)
        before = self.before if bit else starts - self.before
        block = int(np.searchsorted(before[:-1], k, side="right")) - 1
        part = self.packed[block * BLOCK : (block + 1) * BLOCK]
        bits = np.unpackbits(part, count=min(len(part) * 8, self.n - block * BLOCK * 8), bitorder="little")
        return block * BLOCK * 8 + int(np.flatnonzero(bits == bit)[k - int(before[block])])


#: Ids that are moved at a time: with their places they stay in a processor's cache.
_STEP = 1 << 16


def _parted(ids: np.ndarray, bits: np.ndarray, zeros: int) -> np.ndarray:
    """The ids whose bit is 0, then those whose bit is 1, each in order."""
    out, low, high = np.empty_like(ids), 0, zeros
    for at in range(0, len(ids), _STEP):
        some, one = ids[at : at + _STEP], bits[at : at + _STEP]
        ones, others = np.compress(one, some), np.compress(~one, some)
        out[low : low + len(others)], out[high : high + len(ones)] = others, ones
        low, high = low + len(others), high + len(ones)
    return out


def _joined(ids: np.ndarray, bits: np.ndarray, zeros: int, bit: int) -> np.ndarray:
    """The ids back in the order before `_parted`, with their bit."""
    out, low, high = np.empty_like(ids), 0, zeros
    for at in range(0, len(ids), _STEP):
        part, one = out[at : at + _STEP], bits[at : at + _STEP]
        zero_at, one_at = np.flatnonzero(~one), np.flatnonzero(one)
        part[zero_at] = ids[low : low + len(zero_at)]
        part[one_at] = ids[high : high + len(one_at)] | bit
        low, high = low + len(zero_at), high + len(one_at)
    return out


class Shard:
    """Ids of whole documents as a wavelet matrix."""

    def __init__(self, docs: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, planes: list[Plane]):
        self.docs, self.nulls, self.lengths, self.planes = docs, nulls, lengths, planes
        self.n = int(lengths.sum())

    @classmethod
    def build(cls, docs: list[int | None], texts: list[np.ndarray], width: int) -> Shard:
        ids = np.concatenate(texts).astype(np.uint16 if width <= 16 else np.uint32)
        planes = []
        for b in range(width - 1, -1, -1):
            bits = (ids >> b & 1).view(bool) if ids.itemsize == 1 else (ids >> b & 1).astype(bool)
            planes.append(Plane.of(bits))
            ids = _parted(ids, bits, planes[-1].zeros)
        nulls = np.array([d is None for d in docs])
        return cls(np.array([d or 0 for d in docs], np.int64), nulls, np.array([len(t) for t in texts], np.int64), planes)

    def tokens(self) -> np.ndarray:
        """All ids in order: planes are undone from the last to the first."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, plane in enumerate(reversed(self.planes)):
            out = _joined(out, plane.bits(), plane.zeros, out.dtype.type(1 << b))
        return out

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for plane in self.planes:
            bit = plane.get(i)
            out = out << 1 | bit
            i = plane.zeros + plane.ones(i) if bit else i - plane.ones(i)
        return out

    def _narrow(self, token: int, low: int, high: int) -> tuple[int, int]:
        for b, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes, strict=True):
            one_low, one_high = plane.ones(low), plane.ones(high)
            bit = token >> b & 1
            low, high = (plane.zeros + one_low, plane.zeros + one_high) if bit else (low - one_low, high - one_high)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id among the places from low up to high."""
        start, stop = self._narrow(token, low, self.n if high is None else high)
        return stop - start

    def find(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0; -1 if there are not so many."""
        start, stop = self._narrow(token, 0, self.n)
        if not 0 <= k < stop - start:
            return -1
        at = start + k
        for b, plane in enumerate(reversed(self.planes)):
            at = plane.select(1, at - plane.zeros) if token >> b & 1 else plane.select(0, at)
        return at

    def to_bytes(self) -> bytes:
        press = zstandard.ZstdCompressor(level=1)
        out = [MAGIC, struct.pack("<QIB", self.n, len(self.docs), len(self.planes))]

        def put(data: np.ndarray) -> None:
            frame = press.compress(data.tobytes())
            out.extend([struct.pack("<Q", len(frame)), frame])

        put(np.diff(self.docs, prepend=0).astype("<i8"))
        put(self.nulls)
        put(self.lengths.astype("<i8"))
        for plane in self.planes:
            out.append(struct.pack("<Q", plane.zeros))
            put(np.diff(plane.before).astype("<u2"))
            put(plane.packed)
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        n, docs, width = struct.unpack_from("<QIB", data, 4)
        at, open_ = 4 + struct.calcsize("<QIB"), zstandard.ZstdDecompressor()

        def take(kind: str) -> np.ndarray:
            nonlocal at
            size = struct.unpack_from("<Q", data, at)[0]
            at += 8 + size
            return np.frombuffer(open_.decompress(data[at - size : at]), kind)

        ids, nulls, lengths = np.cumsum(take("<i8")), take("?"), take("<i8")
        planes = []
        for _ in range(width):
            zeros = struct.unpack_from("<Q", data, at)[0]
            at += 8
            before = np.concatenate([[0], np.cumsum(take("<u2"), dtype=np.int64)])
            planes.append(Plane(take("u1"), n, zeros, before))
        return cls(ids[:docs], nulls, lengths, planes)


# --- writing and reading --------------------------------------------------------------------------------------

SHARDS = "part int, seq int, start long, n_tokens long, shard binary"


def write(docs: DataFrame, file: str, end: int, path: str, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode all documents and write the shards in order of the document ids, one per output row.

    Ranges of ids are dealt to tasks, which sort, encode and close a shard every `SHARD` ids: a task never holds more
    than one. The files go through Spark's own writer, so a task that is repeated leaves one copy, in any store.
    `start` counts the ids before a shard in its part; parts follow each other in order.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(file)
    vocabulary = hashlib.md5(file.encode()).hexdigest()
    rows = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text), F.lit("")).alias("t"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", "t").select(F.col("id").cast("string").alias("id"), "t")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = kept_by_worker(("words", vocabulary), lambda: WordTokenizer(held.value))
        width = max(len(encode.closes) - 1, end).bit_length()
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def close() -> pd.DataFrame:
            return pd.DataFrame([(part, seq, start, size, Shard.build(names, ids, width).to_bytes())], columns=["part", "seq", "start", "n_tokens", "shard"])

        for batch in batches:
            keys = iter(batch["id"])  # as text: whole numbers beside nulls would become floating ones
            for some in bunches(batch["t"], BUNCH):
                for tokens in encode(some):
                    key = next(keys)
                    names.append(None if key is None else int(key))
                    ids.append(np.append(tokens, end))
                    size += len(tokens) + 1
                    if size >= SHARD:
                        yield close()
                        seq, start, size, names, ids = seq + 1, start + size, 0, [], []
        if names:
            yield close()
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    dealt.mapInPandas(shards, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(start, n_tokens, shard) with the ids before each shard; only one number per part passes through the driver."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])]).tolist()
    base = F.element_at(F.from_json(F.lit(str([int(x) for x in before])), "array<long>"), F.col("part") + 1)
    return shards.select((base + F.col("start")).alias("start"), "n_tokens", "shard")


def documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, tokens): every document of the shards, its ids as little-endian unsigned 32-bit integers."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, data in zip(batch["start"], batch["shard"], strict=True):
                shard = Shard.from_bytes(data)
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths)
                # A few thousand documents at a time: their ids leave as bytes.
                for at in range(0, len(ends), 2000):
                    stop = ends[at : at + 2000]
                    first = stop - shard.lengths[at : at + 2000]
                    names = pd.array(shard.docs[at : at + 2000], "Int64")
                    names[shard.nulls[at : at + 2000]] = pd.NA
                    yield pd.DataFrame({"doc_id": names, "start": start + first, "tokens": [ids[a:b].tobytes() for a, b in zip(first, stop, strict=True)]})

    return shards.mapInPandas(of, "doc_id long, start long, tokens binary")


def stored(docs: DataFrame, file: str, end: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards to a new folder and read their documents back."""
    path = scratch_dir(docs.sparkSession, "shards")
    write(docs, file, end, path, id_col, text)
    return documents(read(docs.sparkSession, path))
