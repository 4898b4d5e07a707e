"""Folds over pieces of a key against one pass over the whole key."""

import random

import pytest

from reelspark.operators import folds
from tests.conftest import rows

def straight(data, rule):
    out, kept = [], None
    for row in data:
        does = folds.FOLLOWS if kept is None else rule(kept, row)
        if does == folds.FOLLOWS and kept is not None:
            out.append(kept)
        if does != folds.DROPPED:
            kept = row
    return out + ([kept] if kept is not None else [])


@pytest.mark.parametrize("piece", [1, 3, 7, 50, 1 << 16])
def test_one_dense_key_over_many_pieces(spark, piece):
    rng = random.Random(piece)
    data = []
    # Track 1 holds nearly all rows, close together; track 2 has bursts at one instant; track 3 wide gaps.
    for track, n, span in ((1, 700, 25.0), (2, 120, 4.0), (3, 40, 400.0), (4, 1, 1.0)):
        for _ in range(n):
            sec = round(rng.random() * span, 1 if track == 2 else 3)
            data.append((track, sec, {1: 0.35, 2: 0.5, 3: 0.2, 4: 1.0}[track], rng.randint(0, 2), round(rng.random(), 2)))
    data = sorted(set(data))
    df = spark.createDataFrame([(*d, f"payload{i}") for i, d in enumerate(data)], "k int, sec double, gap double, rank int, strength double, note string")
    got = rows(folds.keep_by_rule(df, ["k"], "sec", ["sec", "gap", "rank", "strength"], folds.strongest, piece), "k", "sec")
    want = [(k, *row) for k in (1, 2, 3, 4) for row in straight([d[1:] for d in data if d[0] == k], folds.strongest)]
    assert [r[:5] for r in got] == sorted(want)


@pytest.mark.parametrize("piece", [1, 4, 1 << 16])
def test_wait_rule_over_many_pieces(spark, piece):
    rng = random.Random(piece)
    data = sorted({(k, rng.randrange(900 if k == 1 else 60)) for k in (1, 1, 1, 2) for _ in range(400)})
    df = spark.createDataFrame(data, "k int, i long")
    got = rows(folds.keep_by_rule(df, ["k"], "i", ["i"], folds.spaced(5), piece), "k", "i")
    assert got == [(k, *row) for k in (1, 2) for row in straight([(i,) for kk, i in data if kk == k], folds.spaced(5))]
    assert folds.keep_by_rule(df.limit(0), ["k"], "i", ["i"], folds.spaced(5), piece).count() == 0


def test_a_dense_key_is_spread_over_tasks(spark):
    df = spark.range(20_000).selectExpr("1 AS k", "id AS i")
    written = folds.pieces(df, ["k"], ["i"], 500)
    sizes = [r["count"] for r in written.groupBy("_piece").count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 500


@pytest.mark.parametrize("piece", [1, 5, 1 << 16])
def test_running_top(spark, piece):
    rng = random.Random(piece)
    data = [(rng.choice("aaab"), f"{i:03d}", round(rng.random(), 2)) for i in range(150)]
    got = rows(folds.running_top(spark.createDataFrame(data, "k string, id string, x double"), ["k"], ["id"], "x", 4, "top", piece), "id")
    for k, i, x, top in got:
        earlier = sorted((d[2] for d in data if d[0] == k and d[1] < i), reverse=True)
        assert top == (earlier[3] if len(earlier) >= 4 else 0.0)
    assert len(got) == len(data)
