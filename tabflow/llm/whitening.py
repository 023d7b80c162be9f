"""Whitening of embeddings: principal components of a distributed covariance, refined from float32 to double precision.

Vectors become whole numbers x = floor(64 * c) + 1000000. Tasks sum them and their products about the task's own mean;
a second job brings the tasks' sums together about the common mean, so nothing is multiplied before it is centred and
the vectors are read once for it. What reaches the driver is one matrix of dimension by dimension, whatever the number of
vectors.

Its eigenvectors are found in float32 and corrected by the iteration of Ogita and Aishima: matrix products in extended
precision give the residual of orthogonality and of the diagonal form, and from both a correction that doubles the right
digits per round. Eigenvalues too close together for that, as seen from the first residual, are handled as a cluster: the
matrix is projected on the cluster's vectors, shifted by their mean, and that small problem is solved by itself.

Defined results: a null vector, and one with a null or non-finite entry, or with an entry beyond 2^55 in size (it has no
long x), is dropped; the dimension is the length of most non-null vectors (ties: the longer), others are dropped too; repeated rows
and null ids are rows like others; an empty table gives an empty one. A component whose eigenvalue is zero but for rounding
(always the case for a single vector, or for equal ones) has no scale: its `whitened` is null and it does not count in
`identity_error`, which is null if no component has a scale. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import drop_settled, settle
from tabflow.runtime import col

SCALE, OFFSET = 64.0, 1_000_000
#: Entries from here on have no x that sums could hold.
BEYOND = 2.0**55
#: Components to return.
COMPONENTS = 32


class Fit(NamedTuple):
    """What a pass over the vectors needs: counts and sums, exact, and the components."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    scaled: int


# --- eigenvectors ---------------------------------------------------------------------------------------------


def _norm(m: np.ndarray) -> float:
    return float(np.sqrt((m * m).sum()))


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of neighbouring eigenvalues without a gap between them, one array per run."""
    order = np.argsort(values)
    return np.split(order, np.flatnonzero(np.diff(values[order]) > apart) + 1)


#: Eigenvalues closer than so many times the residual of the float32 vectors are a cluster.
CLUSTER = 16


def refined(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix to double precision.

    A round corrects the vectors between clusters and their lengths, solves each cluster for itself, and makes the
    vectors orthogonal again. The last round is that whose correction is below the last digit of a double, or no longer
    shrinks, so that only rounding is left.
    """
    size = float(np.abs(a).max(initial=0.0))
    if size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    exact = (a / size).astype(np.longdouble)
    unit = np.eye(len(a), dtype=np.longdouble)
    x = np.linalg.eigh((a / size).astype(np.float32))[1].astype(np.longdouble)
    together, last = None, np.inf
    while True:
        skew = unit - x.T @ x
        form = x.T @ exact @ x
        values = np.diag(form) / (1 - np.diag(skew))
        if together is None:
            residual = _norm(form - np.diag(values)) + _norm(exact) * _norm(skew)
            runs = _clusters(values, CLUSTER * residual)
            number = np.empty(len(a), np.int64)
            for i, run in enumerate(runs):
                number[run] = i
            together = number[:, None] == number[None, :]
        gap = np.where(together, 1, values[None, :] - values[:, None])
        step = np.where(together, skew / 2, (form + values[None, :] * skew) / gap)
        x = x + x @ step
        for run in runs:
            if len(run) > 1:
                x[:, run] = x[:, run] @ _solved(x[:, run], exact, values[run].mean())
        x = x + x @ (unit - x.T @ x) / 2
        moved = float(np.abs(step).max())
        if moved <= 2.0**-54 or not moved < last:
            break
        last = moved
    x = x / np.sqrt((x * x).sum(0))
    values = (x * (exact @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.sign(x[np.abs(x).argmax(0), np.arange(len(a))])
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


def _solved(part: np.ndarray, exact: np.ndarray, middle: float) -> np.ndarray:
    """The rotation that makes a cluster diagonal: its matrix less the mean eigenvalue, so that only the spread is left."""
    small = part.T @ (exact @ part) - middle * (part.T @ part)
    spread = np.abs(small).max()
    if spread == 0:
        return np.eye(part.shape[1])
    return np.linalg.eigh(((small + small.T) / (2 * spread)).astype(np.float64))[1]


# --- passes over the vectors ----------------------------------------------------------------------------------


def _matrix(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that count, and their x."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = np.flatnonzero(np.asarray(vectors.value_lengths().fill_null(-1)) == dimension)
    flat = vectors.take(pa.array(rows)).flatten()
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dimension)
    sound = (np.abs(c) < BEYOND).all(1)  # false for nan, and nulls are nan here
    return rows[sound], np.floor(SCALE * c[sound]).astype(np.int64) + OFFSET


def _exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and float(np.abs(x).max()) * len(x) > 2.0**62:
        return [int(s) for s in x.astype(object).sum(0)]
    return x.sum(0).tolist()


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean: the whole part goes first, exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def _batches(batches: Iterator[pa.RecordBatch], at: int, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        rows, x = _matrix(batch.column(at), dimension)
        if len(rows):
            yield batch, rows, x


def _partial(dimension: int):
    schema = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("products", pa.list_(pa.float64()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, [0] * dimension, np.zeros((dimension, dimension))
        for _, rows, x in _batches(batches, 0, dimension):
            k, s = len(rows), _exact_sums(x)
            d = _centred(x, k, s)
            products += d.T @ d
            if n:
                # The two means apart, exact before it is rounded.
                gap = np.array([(a * k - b * n) / (n * k) for a, b in zip(sums, s, strict=True)])
                products += np.outer(gap, gap) * (n / (n + k) * k)
            n, sums = n + k, [a + b for a, b in zip(sums, s, strict=True)]
        if n:
            row = {"n": n, "sums": [Decimal(s) for s in sums], "products": products.ravel()}
            yield pa.RecordBatch.from_pylist([row], schema)

    return of


def _together(total: int, sums: list[int]):
    """Parts' products about their own means, as products about the common one; one row per task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros(len(sums) ** 2)
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                gap = np.array([(int(a) * total - b * n) / (n * total) for a, b in zip(row["sums"], sums, strict=True)])
                products += row["products"] + np.outer(gap, gap).ravel() * n
        yield _vector(products)

    return of


def _vector(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"m": [values]}, pa.schema([("m", pa.list_(pa.float64()))]))


def _total(vectors: DataFrame, size: int) -> np.ndarray:
    """Sum of one array per task, entry by entry."""
    out = np.zeros(size)
    for r in vectors.select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("s")).collect():
        out[r["pos"]] = r["s"]
    return out


def dimension_of(vectors: DataFrame, vector: str) -> int:
    """The length of most vectors, 0 without any; the longer of two that are as frequent."""
    sizes = vectors.filter(col(vector).isNotNull()).groupBy(F.size(col(vector)).alias("d")).count()
    best = sizes.filter("d > 0").agg(F.max(F.struct("count", "d")).alias("best")).first()["best"]
    return best["d"] if best else 0


def fit(vectors: DataFrame, vector: str = "embedding") -> Fit | None:
    """Counts, sums and components of all vectors; None if there is no sound one."""
    dimension = dimension_of(vectors, vector)
    if not dimension:
        return None
    rows = vectors.select(col(vector).cast("array<double>").alias("v"))
    parts = settle(rows.mapInArrow(_partial(dimension), "n long, sums array<decimal(38,0)>, products array<double>"), "moments")
    total = parts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    summed = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(summed, key=lambda r: r["pos"])]
    covariance = _total(parts.mapInArrow(_together(total, sums), "m array<double>"), dimension**2)
    drop_settled(parts)
    covariance = covariance.reshape(dimension, dimension) / total
    values, found = refined(covariance)
    # Below this an eigenvalue is rounding.
    scaled = int((values > 16 * dimension * np.finfo(float).eps * max(values[0], 0)).sum())
    return Fit(total, sums, found, values, float(np.trace(covariance)), scaled)


def _projection(model: Fit, components: int) -> np.ndarray:
    k = min(components, model.scaled)
    return model.vectors[:, :k] / np.sqrt(model.values[:k])


def identity_error(vectors: DataFrame, model: Fit, vector: str = "embedding", components: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, by a pass over all vectors."""
    dimension, by = len(model.sums), _projection(model, components)
    k = by.shape[1]
    if not k:
        return None
    n, sums = model.n, model.sums

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for _, _, x in _batches(batches, 0, dimension):
            w = _centred(x, n, sums) @ by
            first += w.sum(0)
            second += w.T @ w
        yield _vector(np.concatenate([first, second.ravel()]))

    parts = vectors.select(col(vector).cast("array<double>").alias("v")).mapInArrow(of, "m array<double>")
    total = _total(parts, k + k * k)
    mean = total[:k] / n
    covariance = total[k:].reshape(k, k) / n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None where it is no long.

    Whole numbers of 64 bits wrap around, so that a sum that fits comes out right whatever its steps; a sum in floating
    numbers tells which fit, and those at the edge are taken again by whole numbers without a bound.
    """
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    off = x - whole
    rough = ((off * float(n) - rest) ** 2).sum(1)
    with np.errstate(over="ignore"):
        exact = ((off * np.int64(n) - rest) ** 2).sum(1).tolist()
    out: list[int | None] = []
    for i, (about, value) in enumerate(zip(rough.tolist(), exact, strict=True)):
        if abs(about / 2.0**63 - 1) < 1e-6:
            value = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums, strict=True))
            out.append(value if value < 2**63 else None)
        else:
            out.append(value if about < 2.0**63 else None)
    return out


def whiten(vectors: DataFrame, model: Fit, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(id, deviation, whitened): one row per sound vector, with an array of its first components."""
    dimension, by, n, sums = len(model.sums), _projection(model, components), model.n, model.sums
    schema = pa.schema([("id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, x in _batches(batches, 1, dimension):
            w = _centred(x, n, sums) @ by
            ends = np.arange(len(rows) + 1, dtype=np.int32) * w.shape[1]
            columns = [
                batch.column(0).take(pa.array(rows)),
                pa.array(_deviations(x, n, sums), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel(), pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(of, "id long, deviation long, whitened array<double>")


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per sound vector and component."""
    model = fit(vectors, vector)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(vectors, model, vector, components)
    k = min(components, len(model.sums))
    explained = (model.values[:k] / model.trace).tolist() if model.trace > 0 else [0.0] * k
    shares = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(e).alias("explained")) for i, e in enumerate(explained)])
    rows = whiten(vectors, model, vector, id_col, components)
    return rows.select("id", "deviation", "whitened", F.inline(shares)).select(
        F.col("id").alias("vec_id"), "component", F.lit(model.n).cast("long").alias("n"), "deviation",
        F.get("whitened", F.col("component") - 1).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"),
    )
