"""Sliced computations must equal plain ones when a key is hot."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from reelspark.operators import ordered
from tests.conftest import rows

SMALL = 7  # rows per slice, so the hot key spans many slices


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    out = []
    for i in range(220):
        key = 1 if i % 3 else rng.randint(2, 6)
        out.append((key, round(rng.random() * 20, 1), i, rng.choice([None, rng.random(), float(i)]), rng.randint(0, 4)))
    return spark.createDataFrame(out, "k int, sec double, id int, v double, n int").cache()


def asks():
    v = F.col("v")
    return {
        "pos": ordered.position(), "run": ordered.running_sum(F.col("n")), "before": ordered.sum_before(F.col("n")), "prev": ordered.previous(v),
        "foll": ordered.following(v), "lagv": ordered.lag(v), "leadv": ordered.lead(v, F.lit(-1.0)), "total": ordered.key_total(F.col("n")),
        "high": ordered.max_before(F.col("n")),
    }


def test_sliced_equals_plain_and_brute_force(data):
    sliced = ordered.Sliced(data, ["k"], ["sec", "id"], SMALL)
    assert sliced.hot is not None
    a = rows(sliced.annotate(asks()).df().select("k", "id", *asks()), "k", "id")
    plain = ordered.Sliced(data, ["k"], ["sec", "id"])
    assert plain.hot is None
    b = rows(plain.annotate(asks()).df().select("k", "id", *asks()), "k", "id")
    assert a == b
    expected = []
    groups = {}
    for r in data.collect():
        groups.setdefault(r.k, []).append(r)
    for k, group in groups.items():
        group.sort(key=lambda r: (r.sec, r.id))
        vs, ns = [r.v for r in group], [r.n for r in group]
        for i, r in enumerate(group):
            known = [x for x in vs[:i] if x is not None]
            later = [x for x in vs[i + 1:] if x is not None]
            expected.append((k, r.id, i, sum(ns[: i + 1]), sum(ns[:i]), known[-1] if known else None, later[0] if later else None,
                             vs[i - 1] if i else None, vs[i + 1] if i + 1 < len(group) else -1.0, sum(ns), max(ns[:i], default=None)))
    assert a == sorted(expected)


def test_bursts_and_equal_times_are_cut_again(spark):
    """Most rows share one instant or a short burst, the rest stretch the range."""
    out = [(1, 5.0, i, float(i % 9), i % 3) for i in range(150)] + [(1, 5.0 + i / 1000, 200 + i, 1.0, 1) for i in range(60)]
    out += [(1, 1000.0, 300, 2.0, 2), (2, 1.0, 301, 3.0, 1)]
    df = spark.createDataFrame(out, "k int, sec double, id int, v double, n int").cache()
    sliced = ordered.Sliced(df, ["k"], ["sec", "id"], 20)
    assert sliced.rows.groupBy("k", "_slice").count().agg(F.max("count")).first()[0] <= 40
    a = rows(sliced.annotate(asks()).df().select("k", "id", *asks()), "k", "id")
    assert a == rows(ordered.annotate(df, ["k"], ["sec", "id"], asks()).select("k", "id", *asks()), "k", "id")


def test_attach_spreads_hot_keys(data):
    dims = data.groupBy("k").agg(F.max("n").alias("m"))
    a = rows(ordered.attach(data, dims, ["k"], "sec", rows_per_slice=SMALL).select("id", "m"), "id")
    assert a == rows(data.join(dims, "k").select("id", "m"), "id")


@pytest.mark.parametrize("size", [SMALL, 10_000])
def test_order_statistics_match_numpy(data, size):
    out = ordered.order_statistics(data, ["k"], "v", {"p05": 0.05, "mid": 0.5, "p96": 0.96, "upper": "upper_median"}, size)
    got = {r.k: r for r in out.collect()}
    values = {}
    for r in data.collect():
        if r.v is not None:
            values.setdefault(r.k, []).append(r.v)
    for k, vs in values.items():
        assert got[k].p05 == pytest.approx(np.percentile(vs, 5))
        assert got[k].mid == pytest.approx(np.median(vs))
        assert got[k].p96 == pytest.approx(np.percentile(vs, 96))
        assert got[k].upper == sorted(vs)[len(vs) // 2]


def test_order_statistics_with_one_dominant_value(spark):
    df = spark.createDataFrame([(1, 0.0)] * 40 + [(1, 5.0)] * 3, "k int, v double")
    assert ordered.order_statistics(df, ["k"], "v", {"m": 0.5, "p96": 0.96}, SMALL).first().asDict() == {"k": 1, "m": 0.0, "p96": 5.0}


def test_halo_windows_cross_slice_borders(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("i"), F.rand(3).alias("x"))
    df = df.cache()

    def columns(w):
        return {"s": F.sum("x").over(w.rowsBetween(-6, 5)), "p": F.lag("x").over(w)}

    a = rows(ordered.with_halo(df, ["k"], "i", 6, 5, columns, rows_per_slice=13).select("k", "i", "s", "p"), "k", "i")
    w = Window.partitionBy("k").orderBy("i")
    b = rows(df.select("k", "i", F.sum("x").over(w.rowsBetween(-6, 5)).alias("s"), F.lag("x").over(w).alias("p")), "k", "i")
    assert len(a) == 100
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and x[3] == y[3] and x[2] == pytest.approx(y[2])


def test_sums_of_doubles_do_not_depend_on_slices(spark):
    """Unrounded: the same bits whether a key is sliced or not, and the closest double to the exact sum."""
    from fractions import Fraction

    rng = random.Random(12)
    kinds = [lambda: rng.random() * 10, lambda: rng.uniform(-1e6, 1e6), lambda: None, lambda: 0.1, lambda: -1e-9, lambda: 1e12 + 0.3]
    data = [(1 if i % 4 else 2, i, rng.choice(kinds)()) for i in range(300)]
    df = spark.createDataFrame(data, "k int, id int, x double").repartition(3)
    asked = {"run": ordered.running_sum(F.col("x")), "before": ordered.sum_before(F.col("x")), "total": ordered.key_total(F.col("x"))}
    plain, *sliced = [rows(ordered.annotate(df, ["k"], ["id"], asked, size).select("k", "id", *asked), "k", "id") for size in (None, 7, 50)]
    assert all(other == plain for other in sliced)
    for k, i, run, before, _ in plain:
        exact = sum(Fraction(x) for kk, j, x in data if kk == k and j <= i and x is not None)
        assert run is None or abs(run - float(exact)) <= 2e-16 * max(1.0, abs(float(exact)))
    special = spark.createDataFrame([(1, 0, 1.0), (1, 1, float("inf")), (1, 2, 2.0), (2, 0, float("nan")), (2, 1, 1e300), (3, 0, None), (3, 1, 4.0)], "k int, id int, x double")
    got = rows(ordered.annotate(special, ["k"], ["id"], asked).select("k", "id", "run", "before"), "k", "id")
    assert [str(r[2]) for r in got] == ["1.0", "inf", "inf", "nan", "nan", "None", "4.0"] and [str(r[3]) for r in got][:3] == ["0.0", "1.0", "inf"]


def test_a_table_that_has_grown_is_counted_again(spark, tmp_path):
    path = str(tmp_path / "rows")
    write = lambda n, mode: spark.range(n).selectExpr("1 AS k", "id").write.mode(mode).parquet(path)
    write(5, "overwrite")
    assert ordered.Sliced(spark.read.parquet(path), ["k"], ["id"], 20).hot is None
    write(100, "append")
    assert ordered.Sliced(spark.read.parquet(path), ["k"], ["id"], 20).hot is not None
