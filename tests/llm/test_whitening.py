"""Operator 12 against numpy on whole matrices."""

import math
import random

import numpy as np
import pytest

from lexiloom.llm import whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, y string"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 0, "n", "y") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA)


def plain(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    off = x * n - total
    deviation = [int(sum(v * v for v in row)) for row in off]
    y = (off / n).astype(float)
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, deviation, y, values[::-1], axes.T[::-1]


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(300, 12)) * np.linspace(1, 3, 12)]
    bad = [None, [1.0, None] * 6, [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11, [1.0, 2.0], []]
    good = vectors + vectors[:3]
    rows = frame(spark, good + bad, [*range(300), 0, 0, None, *range(300, 306)])
    got = whiten.query(rows).collect()
    n, deviation, y, values, axes = plain(good)
    assert len(got) == 8 * n and {r.n for r in got} == {n} and sorted({r.component for r in got}) == list(range(1, 9))
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    by = {(r.vec_id, r.component): r for r in got if r.vec_id not in (0, None)}
    for k in range(8):
        want = y @ axes[k] / math.sqrt(values[k])
        mine = np.array([by[i, k + 1].whitened for i in range(1, 300)])
        sign = np.sign(mine @ want[1:300])
        assert np.abs(sign * mine - want[1:300]).max() < 1e-9
        assert by[5, k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_far_entries_are_exact(spark):
    """Sums and squares past a long: integers stay exact, what a long can't hold is null."""
    vectors = [[3e12, 1.0], [-3e12, 2.0], [1e30, 0.5], [0.25, -1e30]]
    got = {r.vec_id: r for r in whiten.query(frame(spark, vectors)).collect()}
    assert {r.deviation for r in got.values()} == {None} and all(math.isfinite(r.whitened) for r in got.values())
    rng = random.Random(2)
    off = whiten.off_mean(np.array([[2**61, 1], [-(2**61), 5]]), 3, (7, 9))
    assert off.tolist() == [[3 * 2**61 - 7, -6], [-3 * 2**61 - 7, 6]] and whiten.squares(off) == [None, None]
    x = np.array([[rng.randrange(200_000) for _ in range(4)] for _ in range(50)])
    off = whiten.off_mean(x, 50, tuple(int(v) for v in x.sum(axis=0)))
    assert whiten.squares(off) == [sum(int(v) ** 2 for v in row) for row in off]


def test_no_variance_and_no_rows(spark):
    for vectors in ([[1.0, 2.0, 3.0]] * 5, [[4.0, 5.0, 6.0]]):
        got = whiten.query(frame(spark, vectors)).collect()
        assert len(got) == 3 * len(vectors) and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in got} == {(0.0, 0.0, 0.0, 0)}
    line = whiten.query(frame(spark, [[float(i), 2.0 * i, 7.0] for i in range(20)])).collect()
    assert {r.whitened for r in line if r.component > 1} == {0.0} and {r.explained for r in line if r.component == 1}.pop() == pytest.approx(1.0)
    for vectors in ([], [None], [[]]):
        empty = whiten.query(frame(spark, vectors))
        assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
