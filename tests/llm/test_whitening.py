"""Whitening against direct exact sums and an independent eigensolver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from pagesieve.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def whole(vector):
    return [math.floor(1024 * float(np.float32(c))) + 100000 for c in vector]


def brute_force(rows):
    x = np.array([whole(v) for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    exact = [[Fraction(int(((n * x[:, i] - s[i]) * (n * x[:, j] - s[j])).sum()), n**3) for j in range(x.shape[1])] for i in range(x.shape[1])]
    cov = np.array([[float(c) for c in row] for row in exact])
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    return n, deviation, e[order], v[:, order], (x - np.array([Fraction(int(t), n) for t in s], object)).astype(float), cov


def check(spark, rows, kept):
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    n, deviation, e, v, centred, _ = brute_force(kept)
    count = min(8, len(e))
    assert len(found) == n * count
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in found) == sorted((i is None, i, k) for i, _ in kept for k in range(1, count + 1))
    of = {(r.vec_id, r.component): r for r in found}
    for (i, _), d, row in zip(kept, deviation, centred):
        for k in range(count):
            r = of[i, k + 1]
            assert (r.n, r.deviation) == (n, d)
            assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(row @ v[:, k]) / math.sqrt(e[k]), rel=1e-6, abs=1e-6)
            assert 0 <= r.identity_error <= 1e-10
    return found


def test_whitening_matches_exact_sums(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(12, 12))
    rows = [(k, (rng.normal(size=12) @ mix * 0.1 + 3).tolist()) for k in range(400)]
    check(spark, rows, rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(k if k != 4 else None, rng.normal(size=5).tolist()) for k in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0, 2.0]), (106, [3e38] * 5)]
    repeated = [good[3], good[3]]
    kept = good + repeated
    found = whitening.whiten(spark.createDataFrame(kept + bad, SCHEMA)).collect()
    n, deviation, e, _, _, _ = brute_force(kept)
    assert len(found) == 5 * n and {r.n for r in found} == {n}
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)
    assert {r.vec_id for r in found} == {i for i, _ in kept}
    clashing = spark.createDataFrame([(*r, 1, "x", 2) for r in good], SCHEMA + ", id int, x string, component int")
    assert whitening.whiten(clashing).count() == 5 * len(good)


def test_without_rows_or_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, None)] * 4
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], SCHEMA)).collect()
    assert {r.whitened is None for r in line if r.component == 2} == {True} and {r.whitened is None for r in line if r.component == 1} == {False}


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=3) * 10.0 ** rng.integers(0, 9)).tolist()) for k in range(50)]
    n, deviation, *_ = brute_force(rows)
    found = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: d if d < 1 << 63 else None for (i, _), d in zip(rows, deviation)}


@pytest.mark.parametrize("gap", [1e-3, 1e-6, 1e-9, 1e-12, 0.0])
def test_clustered_eigenvalues_are_told_apart(gap):
    rng = np.random.default_rng(4)
    size = 24
    values = np.concatenate([np.linspace(5, 9, size - 6), 2 + gap * np.arange(4), [1e-4, 1e-4 + gap * 1e-4]]).astype(np.longdouble)
    q = np.linalg.qr(rng.normal(size=(size, size)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (1.5 * np.eye(size, dtype=np.longdouble) - 0.5 * (q.T @ q))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigenpairs(a)
    assert np.abs(found - np.sort(values)[::-1].astype(float)).max() < 1e-14 * 9
    assert np.abs(x.T @ x - np.eye(size)).max() < 1e-14
    true = q[:, np.argsort(-values, kind="stable")]
    separate = [k for k in range(size) if gap >= 1e-9 or found[k] > 3]  # the others are one value in double precision or nearly so
    for k in separate:
        if found[k] < 1:
            continue
        angle = 1 - abs(float(true[:, k] @ x[:, k].astype(np.longdouble)))
        assert angle < 1e-12, (k, gap, angle)
    residual = np.abs(a @ x.astype(np.longdouble) - x.astype(np.longdouble) * found.astype(np.longdouble)).max()
    assert residual < 2e-14 * 9


def test_float32_alone_would_not_do():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(64, 64))
    a = m @ m.T
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    found, x = whitening.eigenpairs(a)
    exact = np.linalg.eigh(a)[1][:, ::-1]
    assert np.abs(np.abs(x) - np.abs(exact)).max() < 1e-11 < np.abs(np.abs(rough[:, ::-1]) - np.abs(exact)).max()
    assert np.abs(a @ x - x * found).max() < 1e-12
