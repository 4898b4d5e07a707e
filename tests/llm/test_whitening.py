"""Whitening: the eigenvalue steps against numpy's own, and results against a dense model of all rows."""

import math

import numpy as np
import pytest

from reelspark.llm import queries, whitening

SCHEMA = "shot_id long, hist array<double>"


def matrices(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    q, _ = np.linalg.qr(a)
    clustered = (q * np.array(([5, 5, 5 - 1e-9, 1] * n)[:n], float)) @ q.T
    return [a @ a.T, np.eye(n), np.diag(np.repeat([3.0, 2.0, 1.0, 0.0], n)[:n]), (clustered + clustered.T) / 2, np.ones((n, n)), np.zeros((n, n))]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 20, 64, 150])
def test_leading_pairs(n):
    for matrix in matrices(n):
        values, vectors = whitening.leading_pairs(matrix, 4)
        want = np.linalg.eigvalsh(matrix)[::-1][:4]
        scale = max(1.0, abs(want).max())
        assert np.abs(values - want).max() <= 1e-14 * n * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-13 * n
        assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * n * scale


def test_sturm_count():
    diagonal, off, _ = whitening.tridiagonal(matrices(12)[0])
    values = np.linalg.eigvalsh(matrices(12)[0])
    at = np.concatenate([values - 1e-6, values + 1e-6])
    assert whitening.below(diagonal, off, at).tolist() == [(values < x).sum() for x in at]


def model(rows, k=4):
    """The same results from one dense matrix, eigenvectors by numpy."""
    usable = [(i, [math.floor(256 * c) for c in h]) for i, h in rows if h is not None and all(c is not None and math.isfinite(c) for c in h)]
    exact = sorted({tuple(x) for _, x in usable})
    n, sums = len(exact), [sum(c) for c in zip(*exact)]

    def apart(x):
        return np.array([(n * c - s) / n for c, s in zip(x, sums)])

    centred = np.array([apart(x) for x in exact])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in usable:
        white = (apart(x) @ vectors) / np.sqrt(values)
        out.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(x, sums)), white))
    return n, out, values / np.trace(centred.T @ centred / n)


def check(got, rows, tolerance=1e-8):
    n, want, explained = model(rows)
    signs = {}
    seen = {}
    for r in got:
        seen.setdefault(r.shot_id, []).append(r)
    assert set(seen) == set(want)
    for i, some in seen.items():
        assert sorted(r.component for r in some) == sorted(list(range(1, len(explained) + 1)) * len(want[i]))
        for r in some:
            j = r.component - 1
            assert r.n == n and abs(r.explained - explained[j]) <= 1e-6 * explained[j] and 0 <= r.identity_error <= 1e-4
            assert r.deviation in [d for d, _ in want[i]]
            near = min((w[j] for _, w in want[i]), key=lambda w: abs(abs(w) - abs(r.whitened)))
            assert abs(abs(near) - abs(r.whitened)) <= tolerance * max(1.0, abs(near))
            if abs(near) > 1e-3 and len(want[i]) == 1:
                assert signs.setdefault(j, np.sign(near * r.whitened)) == np.sign(near * r.whitened)


@pytest.mark.parametrize("width,shift", [(4, 0.0), (7, 0.0), (64, 3.0), (9, 1e9)])
def test_equals_the_dense_model(spark, width, shift):
    rng = np.random.default_rng(width)
    scale = np.linspace(3, 0.5, width)
    base = rng.normal(size=(300, width)) * scale + shift
    rows = [(i, base[i % 250].tolist()) for i in range(300)]  # copies count once in the fit
    got = whitening.whiten_histograms(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    check(got, rows)


def test_small_variances_beside_a_huge_one(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 6)) * np.array([1e7, 9.0, 5.0, 2.0, 1.0, 0.5])
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    got = whitening.whiten_histograms(spark.createDataFrame(rows, SCHEMA)).collect()
    fit = np.floor(base * 256)
    centred = fit - fit.mean(axis=0)
    # Singular values of the centred rows keep what their squares lose.
    want = np.linalg.svd(centred, compute_uv=False) ** 2 / len(fit)
    for r in got:
        assert r.identity_error <= 1e-4
        assert abs(r.explained * want.sum() / want[r.component - 1] - 1) <= 1e-4
    assert {r.component for r in got} == {1, 2, 3, 4}


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 2.0], 2), (1, [0.0, 2.0], 2), (None, [0.5, -0.25], 3), (3, None, 4), (4, [nan, 1.0], 5), (5, [inf, 1.0], 6), (6, [None, 1.0], 7), (7, [1.0], 8), (8, [], 9), (9, [1e300, 0.0], 9)]
    df = spark.createDataFrame(rows, SCHEMA + ", n int")
    out = whitening.whiten_histograms(df)
    assert out.columns == ["shot_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert sorted((r.shot_id is None, r.shot_id, r.component) for r in got) == sorted((i is None, i, c) for i in (0, 1, 1, None) for c in (1, 2))
    assert {r.n for r in got} == {3} and max(r.identity_error for r in got) <= 1e-4
    x, s = [[256, 0], [0, 512], [128, -64]], [384, 448]
    want = {sum((3 * a - b) ** 2 for a, b in zip(v, s)) for v in x}
    assert {int(r.deviation) for r in got} == want
    assert whitening.whiten_histograms(df.limit(0)).count() == 0
    assert whitening.whiten_histograms(df.where("shot_id = 1")).count() == 0  # one vector has no variance
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], SCHEMA)
    assert {r.component for r in whitening.whiten_histograms(line).collect()} == {1}
    assert {r.component for r in whitening.whiten_histograms(line, 1).collect()} == {1}


def test_deviation_beyond_64_bits_is_exact(spark):
    rows = [(i, [float(10**11 * i), float(i % 3)]) for i in range(50)]
    got = {r.shot_id: int(r.deviation) for r in whitening.whiten_histograms(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    x = [[256 * 10**11 * i, 256 * (i % 3)] for i in range(50)]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: sum((50 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    if not __import__("pathlib").Path(folder).exists():
        pytest.skip("no test tables")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = queries.op13_embedding_whitening(spark, folder).withColumnRenamed("vec_id", "shot_id").collect()
    assert len(got) == 4 * len(rows)
    check(got, rows)
