"""Moving facts of windows against every window on its own."""

import random
import statistics

import pytest

from reelspark.operators import segments


@pytest.mark.parametrize("dense", [False, True])
def test_moving_facts(spark, dense):
    rng = random.Random(dense)
    d = 3.0
    beats = [(t, round(rng.random() * 120, 2 if dense else 1)) for t, n in ((1, 1500 if dense else 150), (2, 40), (3, 1)) for _ in range(n)]
    onsets = [(t, round(rng.random() * 120, 1)) for t in (1, 2, 4) for _ in range(60)]
    windows = sorted({(t, round(rng.random() * 117, 1)) for t in (1, 2, 3, 4) for _ in range(60)} | {(1, 0.0), (1, 48.0), (1, 45.0)})
    df = spark.createDataFrame([(t, s, s + d) for t, s in windows], "track_id int, start_sec double, end_sec double")
    out = segments.moving_facts(df, spark.createDataFrame(beats, "track_id int, sec double"), {"n": spark.createDataFrame(onsets, "track_id int, sec double")}, d)
    got = {(r.track_id, r.start_sec): r for r in out.collect()}
    assert sorted(got) == windows
    for t, start in windows:
        r, end = got[t, start], start + d
        inside = sorted(s for k, s in beats if k == t and start <= s < end)
        gaps = [b - a for a, b in zip(inside, inside[1:]) if b > a]
        assert (r.beat_count, r.n, r.end_sec) == (len(inside), sum(k == t and start <= s < end for k, s in onsets), end)
        assert r._last_beat == (inside[-1] if inside else None)
        if gaps:
            assert r._center == pytest.approx(statistics.median(gaps), abs=1e-12)
            assert r._error == pytest.approx(sum(abs(g - r._center) for g in gaps) / len(gaps), abs=1e-9)
        else:
            assert r._center is None and r._error is None


def test_shared_spans(spark):
    rng = random.Random(9)
    d = 3.0
    spans = [(t, a, a + rng.choice([0.2, 1.0, 7.0]), round(rng.random(), 2)) for t in (1, 2) for a in (round(rng.random() * 100, 1) for _ in range(40))] + [(1, -5.0, 300.0, 0.5), (1, 4.0, 4.0, 9.0)]
    windows = sorted({(t, round(rng.random() * 110, 1)) for t in (1, 2, 3) for _ in range(50)})
    df = spark.createDataFrame([(t, s, s + d) for t, s in windows], "track_id int, start_sec double, end_sec double")
    none = spark.createDataFrame([], "track_id int, sec double")
    rows = spark.createDataFrame(spans, "track_id int, start_sec double, end_sec double, value double")
    for r in segments.moving_facts(df, none, {}, d, {"loud": rows}).collect():
        parts = [(min(e, r.end_sec) - max(s, r.start_sec), v) for t, s, e, v in spans if t == r.track_id and min(e, r.end_sec) > max(s, r.start_sec)]
        if parts:
            assert r.loud_sec == pytest.approx(sum(x for x, _ in parts)) and r.loud_weighted == pytest.approx(sum(x * v for x, v in parts))
            assert (r.loud_low, r.loud_high) == (min(v for _, v in parts), max(v for _, v in parts))
        else:
            assert r.loud_sec is None and r.loud_low is None


def test_rows_written_are_linear_in_beats(spark):
    """Every beat is copied twice at most, however many windows hold it."""
    beats = spark.range(20_000).selectExpr("1 AS track_id", "id * 0.01D AS sec")
    windows = spark.range(2_000).selectExpr("1 AS track_id", "id * 0.05D AS start_sec", "id * 0.05D + 20 AS end_sec")
    out = segments.moving_facts(windows, beats, {}, 20.0)
    assert out.count() == 2_000
    read = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in read and "SortMergeJoin" not in read
    assert {r.beat_count for r in out.collect()} <= {2000, 1999, 2001}


def _greedy(data, d, limit):
    kept = []
    for start, score in sorted(data, key=lambda r: (-r[1], r[0])):
        if len(kept) < limit and all(max(0.0, min(start, o) + d - max(start, o)) <= d * 0.65 for o in kept):
            kept.append(start)
    return kept


def test_suppressed_top_over_many_slices(spark, monkeypatch):
    rng = random.Random(6)
    data = {1: [(round(i * 0.1, 1), round(rng.random(), 2)) for i in range(600)], 2: [(float(i), 1.0 - i / 100) for i in range(50)], 3: [(5.0, 0.5)]}
    # Scores that rise all along the track: each row waits for the next.
    data[4] = [(i * 0.5, i / 100) for i in range(100)]
    df = spark.createDataFrame([(k, s, x) for k, some in data.items() for s, x in some] + [(9, 1.0, None)], "track_id int, start_sec double, score double")
    for slices in (16, 2):
        monkeypatch.setattr(segments, "SLICE_WINDOWS", slices)
        for limit in (3, 20):
            got = {}
            for r in segments.suppressed_top(df, ["track_id"], 4.0, limit).collect():
                got.setdefault(r.track_id, []).append((r.rank, r.start_sec))
            assert {k: [s for _, s in sorted(v)] for k, v in got.items()} == {k: _greedy(v, 4.0, limit) for k, v in data.items()}


def test_jobs_do_not_depend_on_the_limit(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(1, round(i * 0.3, 1), round(rng.random(), 3)) for i in range(400)], "track_id int, start_sec double, score double")
    context, jobs = spark.sparkContext, []
    for limit in (3, 20):
        context.setJobGroup(f"picks-{limit}", "picks")
        assert segments.suppressed_top(df, ["track_id"], 4.0, limit).count() == limit
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"picks-{limit}")))
    context.setJobGroup("after", "after")
    assert jobs[0] == jobs[1]
