import math

import numpy as np
import pytest

from wayline.llm import qd_solver, queries, whitening


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_axes_equal_a_dense_solver(d):
    rng = np.random.default_rng(d)
    m = np.linalg.qr(rng.standard_normal((400, d)) * np.logspace(0, -6, d))[1]
    squares, vectors = qd_solver.principal_axes(m)
    assert np.allclose(np.sqrt(squares), np.linalg.svd(m, compute_uv=False), rtol=1e-9, atol=0)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13 and np.abs(m.T @ m @ vectors - vectors * squares).max() < 1e-12 * squares[0]


def test_repeated_and_missing_singular_values():
    for m in (np.eye(9), np.diag([1, 1, 1, 2, 2, 3.0])):
        squares, vectors = qd_solver.principal_axes(m)
        assert np.abs(vectors.T @ vectors - np.eye(len(m))).max() < 1e-13 and np.abs(m.T @ m @ vectors - vectors * squares).max() < 1e-13
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 20))
    x[:, 3], x[:, 7] = x[:, 4], 0
    squares, vectors = qd_solver.principal_axes(np.linalg.qr(x)[1])
    assert vectors.shape[1] == 18 and np.allclose(squares[18:], 0, atol=1e-20)
    assert qd_solver.principal_axes(np.zeros((4, 4)))[1].shape == (4, 0)


def test_dqds_keeps_small_values_accurate():
    # A graded bidiagonal: singular values over thirty orders of magnitude, each to full relative accuracy.
    a, b = np.logspace(0, -30, 25), np.logspace(-1, -30, 24)
    import fractions

    squares = qd_solver.dqds(a, b)
    det = math.prod(fractions.Fraction(float(x)) ** 2 for x in a)
    assert math.isclose(float(math.prod(map(fractions.Fraction, map(float, squares))) / det), 1.0, rel_tol=1e-12)


def expected(vectors, components=8):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[n * a - s for a, s in zip(row, sums)] for row in x], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviations, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check(rows, vectors, ids):
    n, deviations, white, shares = expected(vectors)
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, []).append(r)
        assert r.n == n and r.identity_error < 1e-9 and math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-9)
    assert sorted(found) == sorted(ids)
    signs = np.sign([next(r.whitened for r in found[ids[0]] if r.component == c + 1) * white[0][c] for c in range(white.shape[1])])
    for i, vec_id in enumerate(ids):
        got = sorted(found[vec_id], key=lambda r: r.component)
        assert [r.component for r in got] == list(range(1, white.shape[1] + 1)) and {int(r.deviation) for r in got} == {deviations[i]}
        assert np.allclose([r.whitened for r in got] * signs, white[i], atol=1e-7)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((700, 12)) @ np.diag(np.linspace(2, 0.1, 12))).astype("f4").astype(float).tolist()
    odd = [(9001, None), (9002, [1.0] * 11 + [None]), (9003, [1.0] * 11 + [float("nan")]), (9004, [1.0] * 11 + [float("inf")]), (9005, [1.0]), (9006, [])]
    rows = [(i, v, 7) for i, v in enumerate(vectors)] + [(*o, 7) for o in odd]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int").repartition(7)
    frame = frame.withColumn("x", whitening.whole_numbers(frame.embedding))
    check(whitening.transform(frame, whitening.fit(frame)).collect(), vectors, list(range(700)))


def test_few_equal_repeated_and_no_vectors(spark):
    def run(rows):
        frame = spark.createDataFrame(rows, "vec_id long, x array<long>")
        return whitening.transform(frame, whitening.fit(frame)).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [5, 6]), (2, [5, 6])]) == []
    rows = run([(1, [0, 0]), (1, [0, 0]), (None, [4, 0])])
    assert sorted((r.vec_id or 0, r.component, int(r.deviation)) for r in rows) == [(0, 1, 64), (1, 1, 16), (1, 1, 16)]
    assert all(math.isclose(r.explained, 1.0) and math.isclose(abs(r.whitened), 2**0.5 if r.vec_id is None else 0.5**0.5) for r in rows)
    big = 2**52
    assert {int(r.deviation) for r in run([(1, [big, 0]), (2, [-big, 1])])} == {(2 * big) ** 2 + 1}


def test_query_on_the_tables(spark):
    table = [r for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(queries.op12_whitening(spark, "/root/testdata/sf0.001").collect(), [[float(c) for c in r.embedding] for r in table], [r.vec_id for r in table])
