"""Whitening against a plain model in whole numbers and numpy's double precision."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tabflow.llm import whitening
from tabflow.llm.queries import QUERIES


def model(rows):
    rows = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    return [i for i, _ in rows], n, deviations, centred, centred.T @ centred / n


def check(got, rows):
    ids, n, deviations, centred, covariance = model(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(32, len(values))
    scaled = [c for c in range(k) if values[c] > 1e-10 * values[0]]
    found = {}
    for r in got:
        assert r["n"] == n
        found.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert sum(len(x) for by in found.values() for x in by.values()) == len(ids) * k
    expected = {}
    for j, i in enumerate(ids):
        expected.setdefault(i, []).append(j)
    white = np.zeros((len(ids), len(scaled)))
    for i, places in expected.items():
        assert sorted(found[i]) == list(range(1, k + 1))
        for c in range(k):
            rs = sorted(found[i][c + 1], key=lambda r: (r["deviation"], r["whitened"] or 0.0))
            assert [r["deviation"] for r in rs] == sorted(deviations[j] for j in places)
            assert all(r["explained"] == pytest.approx(max(values[c], 0) / np.trace(covariance), rel=1e-9, abs=1e-12) for r in rs)
            assert all((r["whitened"] is None) == (c not in scaled) for r in rs)
            if c in scaled and len(places) == 1:
                white[places[0], scaled.index(c)] = rs[0]["whitened"]
    return white, centred, values, vectors, scaled


def test_given_tables(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{small}/embeddings.parquet").to_pylist()]
    white, centred, values, vectors, scaled = check(QUERIES["op11_embedding_whitening"](spark, small).collect(), rows)
    plain = centred @ vectors[:, scaled] / np.sqrt(values[scaled])
    signs = np.sign((white * plain).sum(0))
    assert np.abs(white - plain * signs).max() < 1e-7
    assert np.abs(white.T @ white / len(white) - np.eye(len(scaled))).max() < 1e-9


def run(spark, folder, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, v int").repartition(5).write.parquet(f"{folder}/embeddings.parquet")
    return QUERIES["op11_embedding_whitening"](spark, str(folder)).collect()


def test_odd_rows(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1), rnd.gauss(3, 0.1), rnd.gauss(0, 50)]) for i in range(40)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [1.0, 2.0, 3.0]), (90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0])]
    odd = [(93, [float("inf"), 0.0, 0.0]), (94, []), (95, [1.0, 2.0]), (96, [1.0, 2.0, 3.0, 4.0]), (97, [1e30, 0.0, 0.0])]
    got = run(spark, tmp_path, rows + odd)
    check(got, rows)
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-9


def test_equal_vectors_have_no_scale(spark, tmp_path):
    got = run(spark, tmp_path, [(i, [0.5, -2.0]) for i in range(6)])
    assert len(got) == 12 and {r["whitened"] for r in got} == {None} and {r["identity_error"] for r in got} == {None}
    assert {r["deviation"] for r in got} == {0} and {r["explained"] for r in got} == {0.0}


def test_missing_rank(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, [a := rnd.gauss(0, 4), a, rnd.gauss(0, 2)]) for i in range(30)]
    got = run(spark, tmp_path, rows)
    check(got, rows)
    assert {r["component"] for r in got if r["whitened"] is None} == {3}


def test_no_vector(spark, empty, tmp_path):
    got = run(spark, tmp_path, [(1, None), (2, [])])
    assert got == []


def test_deviations_up_to_a_long():
    x = np.array([[1_000_000, 1_000_003], [1_000_000, 2_000_000], [1_000_000, 2_518_500_000]])
    n, sums = 3, x.sum(0).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    assert exact[2] > 2**63 > exact[1]
    assert whitening._deviations(x, n, sums) == [e if e < 2**63 else None for e in exact]
    edge = np.array([[0], [2 * 3_037_000_499]])  # n * x - S is just below and above the root of 2^63
    for top in (2 * 3_037_000_499, 2 * 3_037_000_500):
        edge[1] = top
        exact = [(2 * int(c) - top) ** 2 for c in edge[:, 0]]
        assert whitening._deviations(edge // 1, 2, [top]) == [e if e < 2**63 else None for e in exact]


@pytest.mark.parametrize("values", [
    [5.0] * 10 + [5 + 1e-9 * i for i in range(10)] + [5 + 1e-12 * i for i in range(4)] + [0.1 * i for i in range(40)],
    [1.0] * 8, [0.0] * 5 + [1.0], [1e-12, 1.0, 1.0 + 1e-7], [3.0],
])
def test_clusters(values):
    d = np.array(values)
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(len(d), len(d))))
    a = (q * d) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.refined(a)
    assert np.abs(found - np.sort(d)[::-1]).max() < 1e-14 * len(d) * d.max()
    assert np.abs(vectors.T @ vectors - np.eye(len(d))).max() < 1e-14
    assert np.abs(a @ vectors - vectors * found).max() < 1e-14 * len(d) * d.max()


def test_float32_start_is_corrected():
    rnd = np.random.default_rng(3)
    a = rnd.normal(size=(50, 50))
    a = a @ a.T
    plain = np.linalg.eigh(a.astype(np.float32))[1].astype(float)[:, ::-1]
    _, vectors = whitening.refined(a)
    exact = np.linalg.eigh(a)[1][:, ::-1]
    off = lambda v: np.abs(np.abs((v * exact).sum(0)) - 1).max()
    residual = lambda v: np.abs(v.T @ a @ v - np.diag(np.diag(v.T @ a @ v))).max()
    assert off(vectors) < 1e-12 and residual(vectors) < 1e-10 < residual(plain)
