"""Literal cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from reelspark.functions import directions
from reelspark.operators import catalog, flow, frames, motion, music, qa, rhythm, segments, validate
from tests.conftest import rows


def test_direction_buckets(spark):
    cases = [(10.0, 0.0, "right"), (10.0, 10.0, "down-right"), (0.0, 10.0, "down"), (-10.0, 0.0, "left"), (0.0, -10.0, "up"), (10.0, -10.0, "up-right"), (1.0, 1.0, "none")]
    df = spark.createDataFrame(cases, "x double, y double, want string")
    assert all(r.want == r.got for r in df.select("want", directions.bucket(F.col("x"), F.col("y")).alias("got")).collect())


def test_recorded_flow_labels_and_entropy(spark):
    """Measured vectors keep the label they were recorded with."""
    cases = [(4.015, -0.0, "left"), (-0.817, -0.008, "right"), (-0.004, 0.3, "up"), (0.015, -0.543, "down"), (-0.31, 0.185, "up-right"), (0.545, -1.138, "down-left"), (0.019, 0.014, "up-left")]
    df = spark.createDataFrame(cases, "x double, y double, want string")
    assert all(r.want == r.got for r in df.select("want", directions.flow_label(F.col("x"), F.col("y")).alias("got")).collect())
    labels = ["up-right"] * 6 + ["down"] * 5 + ["right"] * 4 + ["up"] * 3 + ["down-right"] + ["left"] * 6 + ["up-left"] + ["down-left"]
    shots = spark.createDataFrame([(1, i, x, True) for i, x in enumerate(labels)], "video_id int, index int, direction string, directional boolean")
    assert flow.direction_entropy(shots).first().direction_entropy == pytest.approx(0.9012084515, abs=1e-6)


def _measure(spark, vectors, video=1):
    df = spark.createDataFrame([(video, i, float(i), float(x), float(y), math.hypot(x, y)) for i, (x, y) in enumerate(vectors)],
                               "video_id int, index int, start_sec double, vx double, vy double, magnitude double")
    return flow.measure(df).withColumn("pair_id", F.lit(1))


def test_flow_gate_rejects_pan_and_frozen(spark):
    varied = _measure(spark, [(2, 0), (-2, 0), (0, 2), (2, 0.2), (0, -2), (-2, 0), (2, 2), (-2, -2), (2, 0)])
    pan = _measure(spark, [(2, 0)] * 9)
    frozen = _measure(spark, [(0, 0)] * 9)

    def failures(subject):
        return flow.gate(flow.compare(subject, varied)).first().failures

    assert failures(varied) == []
    assert failures(pan) == ["carry_rate:above", "direction_entropy:below", "reversal_rate:below"]
    assert "directional_shot_frac:below" in failures(frozen) and "median_magnitude:ratio" in failures(frozen)


def test_relations_and_effects(spark):
    def side(value, vx, vy, conf=0.9):
        return F.struct(F.lit(value).alias("value"), F.lit(conf).alias("confidence"), F.lit(vx).alias("vx"), F.lit(vy).alias("vy"))

    def relation(a, b):
        return spark.range(1).select(frames.motion_relation(a, b).alias("r")).first().r

    assert relation(side(5.0, 5.0, 0.0), side(5.0, 5.0, 0.0)) == "carry"
    assert relation(side(5.0, 5.0, 0.0), side(5.0, -5.0, 0.0)) == "reverse"
    assert relation(side(5.0, 0.0, 0.0), side(5.0, 0.0, 0.0)) == "carry"
    assert relation(side(5.0, 5.0, 0.0), side(1.0, 1.0, 0.0)) == "reset"
    assert relation(side(5.0, 5.0, 0.0, 0.2), side(5.0, 5.0, 0.0)) == "unknown"
    df = spark.createDataFrame([([0.1, 0.2, 0.6, 0.3],), ([0.1, 0.2, 0.3],), ([],)], "b array<double>")
    assert [r.e for r in df.select(frames.classify_effect(F.col("b")).alias("e")).collect()] == ["flash", "none", "none"]


def test_relation_profile(spark):
    pairs = spark.createDataFrame(
        [(1, "carry", [10.0, 40.0], [20.0, 5.0], 0.3, 0.3, 10.0, 0.8, "flash"), (1, "carry", [10.0, 60.0], [20.0, 5.0], 0.3, 0.3, 14.0, 0.8, "none")],
        "video_id int, relation string, outgoing_envelope array<double>, incoming_envelope array<double>, anticipation_sec double, release_sec double, overshoot double, confidence double, effect_kind string")
    videos = spark.createDataFrame([(1, 640)], "video_id int, width int")
    out = {r.relation: r for r in motion.relation_profiles(videos, pairs).collect()}
    carry = out["carry"]
    assert (carry.anticipation_sec, carry.confidence) == (pytest.approx(0.3), pytest.approx(0.8))
    assert (carry.translation_unit, carry.overshoot, carry.effect_kind) == (pytest.approx(50 / 640), pytest.approx(12 / 640), "none")
    assert out["reset"].confidence == 0.0 and not out["reset"].usable and out["reset"].translation_unit == 0.1


def test_exact_slots_and_merge(spark):
    slots = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 0.01), (1, 2, 1.01, 1.0), (2, 0, 0.0, 0.01), (2, 1, 0.01, 2.0)], "project_id int, slot_index int, start_sec double, duration_sec double")
    got = rows(rhythm.merge_short(slots), "project_id", "slot_index")
    assert [(r[0], r[1], round(r[3], 6)) for r in got] == [(1, 0, 1.01), (1, 2, 1.0), (2, 0, 0.01), (2, 1, 2.0)]


MUSIC_BEATS = [0.5 * i for i in range(48)]


def _events(spark, values, extra=None):
    return spark.createDataFrame([(1, float(v)) for v in values], "track_id int, sec double")


def test_segment_ranking_prefers_energetic_window(spark):
    tracks = spark.createDataFrame([(1, 24.0, 120.0)], "track_id int, duration_sec double, bpm double")
    beats, bars = _events(spark, MUSIC_BEATS), _events(spark, MUSIC_BEATS[::4])
    sections = spark.createDataFrame([(1, 0.0, 8.0, 0.2), (1, 8.0, 24.0, 0.9)], "track_id int, start_sec double, end_sec double, energy double")
    quiet = spark.createDataFrame([(1, 1.0, 3.0)], "track_id int, start_sec double, end_sec double")
    scored = segments.score_windows(tracks, beats, bars, bars, _events(spark, [8 + 0.25 * i for i in range(60)]), _events(spark, range(8, 24, 2)), sections, quiet, 8.0)
    ranked = rows(segments.rank_segments(scored.withColumn("score", F.round("score", 9)), 8.0, 2).select("rank", "start_sec", "local_bpm", "beat_count", "score"), "rank")
    assert ranked[0][1:4] == (6.0, 120.0, 16)
    assert ranked[0][4] > ranked[1][4]
    with pytest.raises(ValueError):
        segments.suppressed_top(scored, ["track_id"], 8.0, 21)


def test_motion_accents_keep_structural_beats(spark):
    tracks = spark.createDataFrame([(1, 120.0, 3.0)], "track_id int, bpm double, duration_sec double")
    beats = spark.createDataFrame([(1, 0.5, 0.2), (1, 1.0, 0.1), (1, 1.5, 0.65), (1, 2.0, 0.8), (1, 2.5, 0.5)], "track_id int, sec double, energy double")
    out = music.merge_accents(music.motion_accents(tracks, beats, _events(spark, [1.02, 2.0]), _events(spark, [0.5, 2.5])))
    got = rows(out.select("sec", "kind", "strength", "anticipation_sec", "release_sec"), "sec")
    assert [r[0] for r in got] == [0.5, 1.0, 1.5, 2.0, 2.5]
    assert got[1][1] == "impact" and got[1][2] > got[2][2]
    assert all(0.14 <= r[3] <= 0.24 and 0.14 <= r[4] <= 0.4 for r in got)


def test_representative_interval(spark):
    projects = spark.createDataFrame([(1, 6.0), (2, 6.0)], "project_id int, duration_sec double")
    cuts = spark.createDataFrame([(1, 2.0, 0.6), (1, 4.0, 0.6), (2, 2.0, 0.6)], "project_id int, sec double, confidence double")
    accents = spark.createDataFrame([(1, 3.0), (2, 3.0)], "project_id int, sec double")
    clips = spark.createDataFrame([(p, 2.0 * i, 2.0 * i + 2, 2) for p in (1, 2) for i in range(3)], "project_id int, in_sec double, out_sec double, keyframes int")
    assert rows(qa.representative_interval(projects, cuts, accents, clips)) == [(1, 2.0, 5.0)]


def test_technical_gate_with_intended_freeze(spark):
    logs = spark.createDataFrame([(1, "freezedetect", 0, "freeze_start: 0.5"), (1, "freezedetect", 1, "freeze_end: 1.7"), (1, "ebur128", 2, "  I: -11.2 LUFS"), (1, "ebur128", 3, "  I: -11.0 LUFS")],
                                 "render_id int, filter string, line_no int, line string")
    allowed = spark.createDataFrame([(1, 0.45, 1.75)], "render_id int, start_sec double, end_sec double")
    none = allowed.limit(0)
    render = spark.createDataFrame(
        [(1, True, True, 2.0, 2.002, 1920, 1080, 1920, 1080, 24000, 1001, 24000, 1001, True, True, "h264", 0, 48)],
        "render_id int, file_exists boolean, has_video boolean, expected_duration double, duration_sec double, expected_width int, expected_height int, width int, height int,"
        "expected_fps_num int, expected_fps_den int, fps_num int, fps_den int, expected_audio boolean, has_audio boolean, codec string, decode_code int, read_frames long")
    events = qa.log_events(logs)
    good = qa.technical_gate(qa.technical_checks(render, qa.log_measures(events, allowed, none))).first()
    assert (good.check_count, good.passed) == (13, True)
    bad = qa.technical_checks(render, qa.log_measures(events, none, none))
    assert [r.name for r in bad.where(~F.col("passed")).collect()] == ["freeze_frames"]


def test_gain_advice_steps_and_floor(spark):
    rows_in = [(1, 4, "motion_coverage", 0.8, 0.2, 0.6, 0.25, False), (1, 0, "cut_density", 9.0, 1.0, 8.0, 0.35, False), (2, 5, "hold_ratio", 0.1, 0.9, 0.8, 0.25, False)]
    comparison = spark.createDataFrame(rows_in, "trial_id int, metric_rank int, metric string, reference double, actual double, difference double, tolerance double, passed boolean")
    params = spark.createDataFrame([(1, {"translation_gain": 1.0}), (2, {"hold_motion_gain": 0.2})], "trial_id int, params map<string,double>")
    got = {r.trial_id: (r.gain, round(r.new_value, 6), r.params) for r in qa.advise_gains(comparison, params).collect()}
    assert got[1][:2] == ("translation_gain", 1.15) and got[1][2]["translation_gain"] == pytest.approx(1.15)
    assert got[2][:2] == ("hold_motion_gain", 0.1)


def test_upsert_keeps_unset_columns(spark):
    old = spark.createDataFrame([("a", "/old", "prores", None), ("b", "/keep", "dnx", None)], "id string, path string, codec string, updated string")
    new = spark.createDataFrame([("a", "/first", 0), ("a", "/second", 1), ("c", "/new", 2)], "id string, path string, pos int")
    out = catalog.upsert(old, new, ["id"], ["path"], ["pos"], touched="updated", touched_value=F.lit("now"))
    assert rows(out, "id") == [("a", "/second", "prores", "now"), ("b", "/keep", "dnx", None), ("c", "/new", None, None)]


def test_validation_rows(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.2), (1, 3, 0.9)], "k int, i int, v double")
    assert rows(validate.unsorted_series(df, ["k"], "i", "v").select("i")) == [(1,)]
    assert rows(validate.index_gaps(df, ["k"], "i").select("i", "expected")) == [(3, 2)]
    broken = validate.violations(df, ["i"], {"range": validate.in_range("v", 0.3, 0.8)})
    assert rows(broken, "i") == [(1, "range"), (3, "range")]


def test_cache_key_needs_all_parts(spark):
    def key(model):
        return spark.range(1).select(catalog.analysis_key(F.lit("h"), F.lit(model), F.lit("1"), F.lit("p"), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("k")).first().k

    assert len(key("m")) == 64
    with pytest.raises(Exception, match="cache key"):
        key("")


def test_alias_expansion(spark):
    q = spark.createDataFrame([(1, "fight night")], "query_id int, text string")
    aliases = spark.createDataFrame([("fight", "action dynamic"), ("day", "light")], "term string, appended string")
    got = {r.term for r in catalog.expand_aliases(q, aliases).collect()}
    assert got == {"fight", "night", "action", "dynamic"}
