import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import intervals, joins
from tests.conftest import rows


def _points(spark, n, seed, names="k int, id int, sec double"):
    rng = random.Random(seed)
    data = [(1 if i % 3 else 2, i, round(rng.random() * 30, 2)) for i in range(n)]
    return data, spark.createDataFrame(data, names)


@pytest.mark.parametrize("size", [5, 10_000])
def test_nearest_matches_brute_force(spark, size):
    cuts, cut_df = _points(spark, 60, 1)
    events, event_df = _points(spark, 45, 2)
    got = {r.id: r.nearest_sec for r in joins.nearest(cut_df, event_df, ["k"], rows_per_slice=size).collect()}
    for k, i, sec in cuts:
        mine = sorted(e[2] for e in events if e[0] == k)
        assert got[i] == min(mine, key=lambda e: abs(e - sec))


def test_nearest_without_events_is_null_and_ties_go_early(spark):
    cut_df = spark.createDataFrame([(1, 0, 2.0), (9, 1, 2.0)], "k int, id int, sec double")
    event_df = spark.createDataFrame([(1, 1.0, "a"), (1, 3.0, "b")], "k int, sec double, kind string")
    out = {r.id: (r.nearest_sec, r.offset_sec, r.nearest_kind) for r in joins.nearest(cut_df, event_df, ["k"], carry=["kind"]).collect()}
    assert out == {0: (1.0, 1.0, "a"), 1: (None, None, None)}
    near = joins.nearest_within(cut_df, event_df, ["k"], 0.5)
    assert [r.nearest_sec for r in near.collect()] == [None, None]
    flagged = joins.near_any(cut_df, event_df, ["k"], F.lit(1.0), "hit")
    assert {r.id: r.hit for r in flagged.collect()} == {0: True, 1: False}


def test_window_counts_open_and_closed(spark):
    points, point_df = _points(spark, 80, 3)
    windows = [(1, 2.0, 9.5), (2, 0.0, 30.0), (1, points[1][2], points[4][2] + 5)]
    df = spark.createDataFrame(windows, "k int, start_sec double, end_sec double")
    for closed in (False, True):
        got = {(r.k, r.start_sec): r.n for r in joins.count_in_windows(df, {"n": point_df}, ["k"], closed=closed).collect()}
        for k, s, e in windows:
            want = sum(p[0] == k and s <= p[2] and (p[2] <= e if closed else p[2] < e) for p in points)
            assert got[(k, s)] == want


def test_overlaps_appear_once(spark):
    rng = random.Random(4)
    spans = [(1, i, round(a, 2), round(a + rng.random() * 4 + 0.05, 2)) for i, a in enumerate(rng.random() * 20 for _ in range(40))]
    df = spark.createDataFrame(spans, "k int, id int, start_sec double, end_sec double")
    got = rows(joins.overlapping(df, df, ["k"], 1.0).select("id", "id_r"), "id", "id_r")
    want = sorted((a[1], b[1]) for a in spans for b in spans if min(a[3], b[3]) > max(a[2], b[2]))
    assert got == want


def _mixed(rng, day=86_400.0):
    """Short intervals over a day, a day-long one, and lengths between."""
    spans = [(1, i, a, a + 0.1) for i, a in enumerate(round(rng.random() * day, 2) for _ in range(300))]
    spans += [(1, 300, 0.0, day), (1, 301, -5.0, 3.0), (2, 302, 0.0, 1.0), (1, 303, 7.0, 7.0), (1, 304, 100.0, 100.0 + 2**12), (1, 305, day - 700, day - 1)]
    return spans + [(1, 306 + i, a, a) for i, a in enumerate((50.0, 60.0))]


def test_long_and_short_intervals(spark):
    left, right = _mixed(random.Random(4)), _mixed(random.Random(5))
    a, b = (spark.createDataFrame(x, "k int, id int, start_sec double, end_sec double") for x in (left, right))
    for width in (0.1, 1.0):
        got = rows(joins.overlapping(a, b, ["k"], width).select("id", "id_r"), "id", "id_r")
        assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2]))


def test_a_long_interval_is_copied_a_few_times_per_level(spark):
    spans = _mixed(random.Random(4))
    df = spark.createDataFrame(spans, "k int, id int, start_sec double, end_sec double")
    leveled, levels = joins._levels(df, ["k"], "start_sec", "end_sec", 0.1)
    count = {r["_levels"] and r["k"]: len(r["_levels"]) for r in levels.collect()}
    copies = joins.dyadic_copies(leveled, levels, ["k"], "start_sec", "end_sec", 0.1, 1, 2).groupBy("id").count().collect()
    copies = {r["id"]: r["count"] for r in copies}
    # Up to three buckets at each level of the key, and twice at the interval's own.
    assert max(copies.values()) <= 3 * (count[1] + 1) and copies[300] <= 6


def _subtract_model(span, allowed):
    parts = [span]
    for lo, hi in allowed:
        parts = [p for left, right in parts for p in (
            [(left, right)] if hi <= left or lo >= right else [x for x in ((left, lo), (hi, right)) if x[0] < x[1]])]
    return parts


def test_subtract_matches_sequential_model(spark):
    rng = random.Random(8)
    seen = [(1, i, float(i * 3), i * 3 + round(rng.random() * 6 + 0.5, 2)) for i in range(12)]
    allowed = [(1, round(a, 2), round(a + rng.random() * 3 + 0.1, 2)) for a in (rng.random() * 40 for _ in range(15))]
    got = intervals.subtract(
        spark.createDataFrame(seen, "k int, item int, start_sec double, end_sec double"),
        spark.createDataFrame(allowed, "k int, start_sec double, end_sec double"), ["k"], "item")
    got = sorted((r.item, round(r.start_sec, 6), round(r.end_sec, 6)) for r in got.collect())
    want = sorted((i, round(a, 6), round(b, 6)) for _, i, s, e in seen for a, b in _subtract_model((s, e), [x[1:] for x in allowed]))
    assert got == want


def test_last_match_and_role_join(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 0.75)], "k int, s double")
    right = spark.createDataFrame([(1, 0.5, 1, "a"), (1, 0.5, 2, "b")], "k int, s double, o int, v string")
    assert rows(joins.last_match(left, right, ["k", "s"], ["o"], ["v"]), "s") == [(1, 0.5, "b"), (1, 0.75, None)]
    clips = spark.createDataFrame([(1, "c0"), (1, "c1")], "project_id int, clip_id string")
    pairs = spark.createDataFrame([(1, 1, "c0", "c1")], "project_id int, seq int, outgoing_clip_id string, incoming_clip_id string")
    wired = {r.clip_id: r for r in joins.neighbour_pairs(clips, pairs).collect()}
    assert wired["c0"].outgoing_pair.seq == 1 and wired["c0"].incoming_pair is None
    assert wired["c1"].incoming_pair.seq == 1 and wired["c1"].outgoing_pair is None
