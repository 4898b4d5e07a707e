"""Weighted fair queueing: totals against targets, repeat limits, and edge cases."""

import random
from collections import defaultdict

import pytest

from reelspark.llm import mixture

SCHEMA = "shot_id long, series string, frames long"


def levels(sizes, weights, share, passes):
    """Plain water filling: hand the excess of full series to the others until none is above."""
    left, target, open_ = share * sum(sizes.values()), {}, dict(weights)
    while open_:
        level = left / sum(open_.values())
        full = {s for s, w in open_.items() if w * level > passes * sizes[s]}
        if not full:
            return target | {s: w * level for s, w in open_.items()}
        for s in full:
            target[s] = passes * sizes[s]
            left -= target[s]
            del open_[s]
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_series_meet_their_targets(spark, seed):
    rng = random.Random(seed)
    names = ["é", "Z", "a", None, "b", "aa", "one"]
    rows = [(i, rng.choices(names, [30, 1, 5, 5, 2, 1, 0.01])[0], rng.randrange(0, 200)) for i in range(3000)]
    got = mixture.mix_series(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = levels(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    taken = defaultdict(int)
    for r in got:
        taken[r.series] += r.taken
        assert 0 <= r.taken <= 2 * r.frames and r.series_frames == sizes[r.series]
        assert r.target == pytest.approx(want[r.series])
    assert len(got) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert sorted(got) == sorted(mixture.mix_series(spark.createDataFrame(rows[::-1], SCHEMA)).collect())
    times = [r.finish_time for r in got if r.finish_time is not None]
    assert times == sorted(times)


def test_smaller_budget_cuts_all_series_alike(spark):
    rows = [(i, "ab"[i % 2], 10) for i in range(2000)]
    got = mixture.mix_series(spark.createDataFrame(rows, SCHEMA), budget=3000).collect()
    assert abs(sum(r.taken for r in got) - 3000) <= 2
    by = defaultdict(int)
    for r in got:
        by[r.series] += r.taken / r.target
    assert by["a"] == pytest.approx(by["b"], abs=1e-3)


def test_edge_rows(spark):
    assert mixture.mix_series(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a", None, 5), (2, "a", -3, 6), (3, None, 0, 7), (None, "a", 10, 8), (4, "a", 10, 9), (4, "a", 10, 9)]
    df = spark.createDataFrame(rows, "shot_id long, series string, frames long, target long")
    got = mixture.mix_series(df).collect()
    assert len(got) == 6 and sum(r.taken for r in got) == 45
    assert [r.finish_time for r in got if r.series is None] == [None]
    nothing = mixture.mix_series(spark.createDataFrame([(1, "a", 0)], SCHEMA)).collect()
    assert [(r.taken, r.target) for r in nothing] == [(0, 0.0)]
