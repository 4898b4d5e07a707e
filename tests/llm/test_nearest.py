"""Multi-index hashing: exact balls, recall against brute force, and edge cases."""

import numpy as np
import pytest

from reelspark.llm import nearest

SCHEMA = "shot_id long, hist array<double>"


@pytest.mark.parametrize("radius", [0, 1, 3, 7, 12, 20, 30, 64])
def test_ball_is_exact(radius):
    rng = np.random.default_rng(radius)
    code = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    code[:1500] = code[0] ^ (rng.integers(0, 1 << 16, (1500, 4)) & rng.integers(0, 1 << 16, (1500, 4)) & rng.integers(0, 1 << 16, (1500, 4))).astype(np.uint16)
    index = nearest.CodeIndex(code)
    for i in (0, 10, 2000):
        want = np.flatnonzero(np.bitwise_count(code ^ code[i]).sum(axis=1) <= radius)
        assert np.array_equal(index.within(code[i], radius), want)


@pytest.mark.parametrize("width,blocks", [(64, 1 << 16), (20, 300), (80, 500)])
def test_recall(spark, monkeypatch, width, blocks):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 16)
    rng = np.random.default_rng(width)
    rows = rng.normal(size=(2000, width)) + 2 * rng.normal(size=(8, width))[rng.integers(0, 8, 2000)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], SCHEMA)
    got = nearest.nearest_shots(df, df.where("shot_id % 50 = 0")).collect()
    hits = 0
    for q in range(0, 2000, 50):
        distance = np.sqrt(((rows - rows[q]) ** 2).sum(axis=1))
        mine = sorted((r.rank, r.shot_id, r.distance) for r in got if r.query_id == q)
        assert [r for r, *_ in mine] == list(range(1, 11)) and q not in [i for _, i, _ in mine]
        assert [d for *_, d in mine] == sorted(d for *_, d in mine)
        assert all(d == distance[i] for _, i, d in mine)
        distance[q] = np.inf
        hits += len({i for _, i, _ in mine} & set(np.argsort(distance)[:10].tolist()))
    assert hits / 400 >= 0.9


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.0, 2.0], 3), (3, None, 4), (4, [0.0, 0.0], 5), (5, [nan, 1.0], 6), (6, [inf, 1.0], 7), (7, [None, 1.0], 8), (None, [1.0, 1.0], 9)]
    df = spark.createDataFrame(rows, "shot_id long, hist array<double>, rank int")
    got = sorted(tuple(r) for r in nearest.nearest_shots(df, df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 5**0.5), (1, 1, 0, 0.0), (1, 2, 2, 5**0.5), (2, 1, 0, 5**0.5), (2, 2, 1, 5**0.5)]
    assert nearest.nearest_shots(df.limit(0), df.limit(0)).count() == 0
    assert nearest.nearest_shots(df.where("shot_id = 0"), df).where("query_id = 0").count() == 0
    assert nearest.nearest_shots(df, df.limit(0)).count() == 0
