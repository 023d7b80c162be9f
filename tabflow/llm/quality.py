"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A word counts under two forms: itself in lower case, and its shape (letters, digits and marks by kind, runs squeezed,
or a sign that it repeats one of the words just before it). Single words and pairs of neighbours under both forms are
hashed into `2 ** BITS` buckets; a text's value in a bucket is `SCALE` times the share of its n-grams there. The score is the logistic function of the sparse dot product with the learned weights.

Training takes a bounded, documented sample of labelled rows, chosen by a hash of the key; all else is done for every
row. Defined results: a null or empty text has no n-grams and scores by the bias alone; null labels are not learned;
without any labels every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabflow.llm.common import drop_settled, kept_by_worker, settle
from tabflow.runtime import col

BITS = 18
#: Labelled rows that are learned from at most, and passes over them.
SAMPLE = 6_000
PASSES = 2
#: Learning rate and regularisation of the leader.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
#: A word counts as repeated if it is one of so many before it.
NEAR = 4
SCALE = 10.0

_KINDS = [(re.compile(p), s) for p, s in ((r"[^\W\d_]+", "a"), (r"\d+", "9"), (r"(\W)\1+", r"\1"))]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _shape(word: str) -> str:
    upper = "A" if len(word) > 1 and word.isupper() else ""
    bare = word.rstrip(".,")
    if bare.isalpha():
        return upper + "a" + word[len(bare) :]
    for kind, sign in _KINDS:
        word = kind.sub(sign, word)
    return upper + word


class Forms(dict):
    """Word -> hash of its shape and hash of itself in one number, filled as words come; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        both = zlib.crc32(_shape(word).encode(), 1) << 32 | zlib.crc32(word.lower().encode())
        self[word] = both
        return both


def forms_of_worker() -> Forms:
    return kept_by_worker("forms", Forms)


def grams(text: str | None, held: Forms) -> np.ndarray:
    """Bucket of every n-gram, repeats included."""
    words = (text or "").split()
    forms = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
    own, shape = forms & _LOW, forms >> np.uint64(32)
    again = np.zeros(len(words), bool)
    for d in range(1, NEAR + 1):
        again[d:] |= own[d:] == own[:-d]
    shape[again] = 1
    kinds = [own, shape * np.uint64(3) + np.uint64(1)]
    kinds += [x[:-1] * np.uint64(31) + x[1:] + np.uint64(k) for k, x in ((2, own), (3, shape))]
    return ((np.concatenate(kinds) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def vector(text: str | None, held: Forms) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, ascending, and their values."""
    buckets, counts = np.unique(grams(text, held), return_counts=True)
    return buckets, counts * (SCALE / max(1, counts.sum()))


class Leader:
    """Follow-the-regularised-leader state: only buckets that were seen have weights."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 + (1 << BITS)), np.zeros(1 + (1 << BITS))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
        at, x = np.append(buckets, 1 << BITS), np.append(values, 1.0)
        w = self.weights(at)
        g = (_logistic(w @ x) - label) * weight * x
        was = self.n[at]
        self.z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / ALPHA * w
        self.n[at] = was + g * g


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, float(x)))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights per bucket, the bias last, from vectors and their labels."""
    leader = Leader()
    share = sum(label for *_, label in rows) / len(rows)
    # The rarer class weighs more, within bounds, so that it is learned; scores stay near the base rate for no text.
    weight = {1: 1.0, 0: min(4.0, max(1.0, share / max(1 - share, 1e-9) / 2))}
    for _ in range(PASSES):
        for buckets, values, label in rows:
            leader.learn(buckets, values, label, weight[label])
    return leader.weights()


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [vector(t, forms_of_worker()) for t in batch["t"]]
        yield pd.DataFrame(
            {
                "h": batch["h"],
                "y": batch["y"],
                "buckets": [b.astype("<i4").tobytes() for b, _ in found],
                "counts": [v.astype("<f4").tobytes() for _, v in found],
            }
        )


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for batch in batches:
        for h, y, b, v in zip(batch["h"], batch["y"], batch["buckets"], batch["counts"], strict=True):
            rows.append((h, y, np.frombuffer(b, "<i4"), np.frombuffer(v, "<f4")))
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
    weights = train([(b.astype(np.int64), v.astype(np.float64), int(y)) for _, y, b, v in rows])
    yield pd.DataFrame({"weights": [weights.astype("<f4").tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = SAMPLE) -> np.ndarray | None:
    """Weights learned in one task from at most `sample` labelled rows, those with the smallest hash of the key.

    Labels are ranked without texts; the chosen ones are broadcast, and only their documents leave the scan. Whole
    texts become vectors where they are read, so that the one task gets no more than `sample` vectors.
    """
    h = F.xxhash64(col(key).cast("string"))
    known = labels.filter(col(label).isNotNull() & col(key).isNotNull()).select(h.alias("h"), col(key).alias("k"), col(label).cast("int").alias("y"))
    chosen = known.distinct().orderBy("h", "k", "y").limit(sample)
    rows = docs.filter(col(text).isNotNull()).select(col(key).alias("d"), col(text).alias("t"))
    some = rows.join(F.broadcast(chosen), F.col("d") == F.col("k")).select("h", "y", "t")  # at most `sample` rows of three numbers
    made = some.mapInPandas(_vectors, "h long, y int, buckets binary, counts binary")
    # Documents may share an id: the sample is bounded once more, of vectors; no text leaves its task.
    order = F.xxhash64("buckets", "counts").alias("u")
    vectors = settle(made.select("*", order).orderBy("h", "y", "u", "buckets", "counts").limit(sample).drop("u"), "vectors")
    learned = vectors.repartition(1).mapInPandas(_learn, "weights binary").first() if vectors.limit(1).count() else None
    drop_settled(vectors)
    return None if learned is None else np.frombuffer(learned["weights"], "<f4").astype(np.float64)


def scores(text: Column, weights: np.ndarray | None) -> Column:
    """Score from 0 to 1 of any text; the weights travel with the task, a fixed 2 ** BITS numbers."""
    held = None if weights is None else weights.astype("<f4").tobytes()

    @F.pandas_udf(DoubleType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = None if held is None else np.frombuffer(held, "<f4").astype(np.float64)
        forms = forms_of_worker()
        for batch in texts:
            yield pd.Series([_score(t, w, forms) for t in batch], dtype="float64")

    return of(text)


def _score(text: str | None, weights: np.ndarray | None, held: Forms) -> float:
    if weights is None:
        return 0.5
    found = weights[grams(text, held)]
    return _logistic(found.sum() * (SCALE / max(1, len(found))) + weights[-1])
