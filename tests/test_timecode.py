import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from reelspark.functions import timecode as tc
from reelspark.operators import conform
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(*values):
    return [F.lit(v) for v in values]


def test_modes_and_negative(spark):
    assert [one(spark, tc.to_frames(*lit(1 / 16, 24, 1), mode=m)) for m in ("floor", "ceil", "round")] == [1, 2, 2]
    with pytest.raises(ValueError):
        tc.to_frames(*lit(1.0, 24, 1), mode="nope")
    with pytest.raises(Exception, match="negative"):
        one(spark, tc.to_frames(*lit(-0.1, 24, 1)))


def test_round_trip_is_exact(spark):
    df = spark.createDataFrame([(f,) for f in (0, 1, 24, 1000, 86_399, 86_314)], "f long")
    back = tc.to_frames(tc.to_seconds(F.col("f"), *lit(24000, 1001)), *lit(24000, 1001))
    assert all(r.f == r.b for r in df.select("f", back.alias("b")).collect())
    assert one(spark, tc.to_frames(*lit(3600.0, 24000, 1001))) == round(3600 * 24000 / 1001)


def test_rebased_durations(spark):
    cases = [((48, 30000, 1001, 24000, 1001), 60), ((48, 24000, 1001, 24000, 1001), 48), ((43, 24000, 1001, 30, 1), 35), ((8, 24000, 1001, 30, 1), 7)]
    for args, want in cases:
        assert one(spark, tc.rebased_duration(*lit(*args))) == want
    assert one(spark, tc.duration_frames(*lit(0.0, 0.001, 24000, 1001))) == 1
    assert one(spark, tc.duration_frames(*lit(10.0, 0.0, 24000, 1001))) == 1


@pytest.mark.parametrize("rate", [(24, 1), (24000, 1001), (30000, 1001), (60, 1)])
def test_neighbours_meet(spark, rate):
    cursor, clips = 0.0, []
    for i, d in enumerate([1.51, 0.42, 2.33, 0.07, 1.0] * 8):
        clips.append((1, i, 0.0, d, cursor, d, *rate, *rate))
        cursor += d
    df = spark.createDataFrame(clips, "project_id int, clip_index int, source_in_sec double, source_out_sec double, timeline_in_sec double,"
                                      "timeline_duration_sec double, src_num long, src_den long, tl_num long, tl_den long")
    gaps = conform.audit_joins(conform.place_clips(df)).select("gap_frames")
    assert {r.gap_frames for r in gaps.collect()} == {0}


def test_labels(spark):
    assert one(spark, tc.timecode(*lit(86400, 24, 1))) == "01:00:00:00"
    df = lambda n: one(spark, tc.timecode(F.lit(n), *lit(30000, 1001), F.lit(True)))
    assert [df(n) for n in (1799, 1800, 17982)] == ["00:00:59;29", "00:01:00;02", "00:10:00;00"]


def test_fractions_match_exact_arithmetic(spark):
    values = [23.976, 25.5, 12.345, 29.97, 14.985, 7.1, 119.88, 59.999, 100 / 3, 24.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", tc.best_fraction(F.col("v"), 1001).alias("f")).collect():
        want = Fraction(r.v).limit_denominator(1001)
        assert (r.f.num, r.f.den) == (want.numerator, want.denominator)
    fps = {r.v: (r.f.num, r.f.den) for r in df.select("v", tc.normalise_fps(F.col("v")).alias("f")).collect()}
    assert fps[23.976] == (24000, 1001) and fps[119.88] == (120000, 1001) and fps[24.0] == (24, 1) and fps[25.5] == (51, 2)
    missing = spark.createDataFrame([(None,), (0.0,)], "v double").select(tc.catalog_fps(F.col("v")).alias("f"))
    assert [tuple(r.f) for r in missing.collect()] == [(24000, 1001)] * 2


def exact_frames(sec, num, den, mode):
    value = Fraction(sec).limit_denominator(1_000_000_000) * Fraction(num, den)
    return {"round": math.floor(value + Fraction(1, 2)), "floor": math.floor(value), "ceil": math.ceil(value)}[mode]


@pytest.mark.parametrize("rate", [(24000, 1001), (30000, 1001), (60000, 1001), (25, 1)])
def test_half_frames_match_exact_fractions(spark, rate):
    num, den = rate
    secs = [n * den / (2 * num) for n in range(20_000)]
    secs += [0.0005 * n for n in range(4000)] + [n / 7 for n in range(500)] + [0.0, 1e-18, 1e-13, 1e-9, 1e-4, 86_399.5]
    secs += [s + e for s in secs[:400:7] for e in (1e-15, 1e-13, 3e-12, 1e-10, 4e-10, 1e-9, 1e-7)]
    df = spark.createDataFrame([(s,) for s in secs], "sec double")
    modes = ("round", "floor", "ceil")
    got = df.select("sec", *[tc.to_frames(F.col("sec"), *lit(num, den), mode=m).alias(m) for m in modes]).collect()
    wrong = [(r.sec, m, r[m], exact_frames(r.sec, num, den, m)) for r in got for m in modes if r[m] != exact_frames(r.sec, num, den, m)]
    assert not wrong, (len(wrong), wrong[:5])


def test_known_half_frames(spark):
    for sec, num, den, want in ((0.0625625, 24000, 1001, 2), (0.25025, 30000, 1001, 8), (0.58, 25, 1, 15)):
        assert one(spark, tc.to_frames(*lit(sec, num, den))) == want
