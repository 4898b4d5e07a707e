"""Quality gates: detector logs, technical checks, style comparison and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from reelspark.operators import intervals, joins, ordered
from reelspark.session import materialise

# What each detector prints and how its numbers are found.
LOG_PATTERNS = {
    "black_duration": ("blackdetect", r"black_duration:([\d.]+)"),
    "freeze_start": ("freezedetect", r"freeze_start: ([\d.]+)"),
    "freeze_end": ("freezedetect", r"freeze_end: ([\d.]+)"),
    "silence_start": ("silencedetect", r"silence_start: ([\d.]+)"),
    "silence_end": ("silencedetect", r"silence_end: ([\d.]+)"),
    "lufs": ("ebur128", r"\bI:\s*(-?[\d.]+)\s*LUFS"),
}
CORRUPTION = ("decode", r"(?i)(Invalid data|corrupt|Error while decoding|missing picture)")
# Limits of the technical gate.
LIMITS = {"black": 0.35, "freeze": 0.75, "silence": 1.0, "lufs": -11.0, "lufs_tolerance": 1.5, "fps": 0.002, "duration": 0.08, "frames": 2}
CODECS = ("h264", "hevc", "prores")
CHECK_COUNT = 13
# Allowed absolute differences of the style metrics, in report order.
STYLE_TOLERANCES = {
    "cut_density": 0.35,
    "shot_duration_mean": 0.6,
    "shot_duration_median": 0.6,
    "music_sync_ratio": 0.25,
    "motion_coverage": 0.25,
    "hold_ratio": 0.25,
    "reversal_ratio": 0.25,
    "scale_motion_ratio": 0.25,
    "blur_usage": 0.3,
}
STYLE_GATE = ("cut_density", "motion_coverage", "reversal_ratio")
# The gain that answers each tunable metric.
METRIC_GAINS = {
    "motion_coverage": "translation_gain",
    "hold_ratio": "hold_motion_gain",
    "reversal_ratio": "overshoot_gain",
    "scale_motion_ratio": "zoom_gain",
    "blur_usage": "directional_blur_gain",
}
GAINS = (
    "translation_gain", "zoom_gain", "rotation_gain", "motion_blur_gain", "directional_blur_gain", "anticipation_scale",
    "release_scale", "overshoot_gain", "hold_motion_gain",
)
GAIN_STEP = 0.15
MIN_GAIN = 0.1
REQUIRED_NODES = ("BaseTransform", "MotionTransform", "PostColor")


def log_events(logs: DataFrame) -> DataFrame:
    """Numbers and corruption markers found in detector logs: one row per match.

    logs(render_id, filter, line_no, line) -> (render_id, kind, line_no, pos, value, marker).
    """
    found = [
        F.when(F.col("filter") == tool, F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), _match(kind)))
        for kind, (tool, pattern) in LOG_PATTERNS.items()
    ]
    tool, pattern = CORRUPTION
    found.append(F.when(F.col("filter") == tool, F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), _match("corruption"))))
    events = F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))
    rows = logs.select("render_id", "line_no", F.posexplode(events).alias("pos", "e"))
    value = F.when(F.col("e.kind") != "corruption", F.col("e.text").try_cast("double"))
    return rows.select(
        "render_id", F.col("e.kind").alias("kind"), "line_no", "pos", value.alias("value"),
        F.when(F.col("e.kind") == "corruption", F.col("e.text")).alias("marker"),
    )


def _match(kind: str) -> Callable[[Column], Column]:
    return lambda text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def pair_ranges(events: DataFrame, start_kind: str, end_kind: str) -> DataFrame:
    """Join the i-th start of a render with its i-th end; what has no partner is dropped."""
    sides = []
    for kind, column in ((start_kind, "start_sec"), (end_kind, "end_sec")):
        rows = ordered.annotate(events.where(F.col("kind") == kind), ["render_id"], ["line_no", "pos"], {"item": ordered.position()})
        sides.append(rows.select("render_id", "item", F.col("value").alias(column)))
    return sides[0].join(sides[1], ["render_id", "item"])


def longest_unexpected(ranges: DataFrame, allowed: DataFrame, name: str) -> DataFrame:
    """Longest part of a render's ranges outside the allowed ranges."""
    left = intervals.subtract(ranges, allowed, ["render_id"], "item")
    return left.groupBy("render_id").agg(F.max(F.col("end_sec") - F.col("start_sec")).alias(name))


def last_loudness(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") == "lufs").groupBy("render_id").agg(F.max_by("value", F.struct("line_no", "pos")).alias("lufs"))


def log_measures(events: DataFrame, allowed_freezes: DataFrame, allowed_silences: DataFrame) -> DataFrame:
    """Per render: longest black run, longest unexpected freeze and silence, loudness, corruption count."""
    freezes = longest_unexpected(pair_ranges(events, "freeze_start", "freeze_end"), allowed_freezes, "freeze_sec")
    quiet = longest_unexpected(pair_ranges(events, "silence_start", "silence_end"), allowed_silences, "silence_sec")
    black = events.groupBy("render_id").agg(
        F.max(F.when(F.col("kind") == "black_duration", F.col("value"))).alias("black_sec"),
        F.count_if(F.col("kind") == "corruption").alias("corrupt_markers"),
    )
    out = black
    for side in (freezes, quiet, last_loudness(events)):
        out = out.join(side, "render_id", "full")
    return out


def technical_checks(renders: DataFrame, measures: DataFrame) -> DataFrame:
    """Long form of the technical gate: one row per render and check.

    renders(render_id, file_exists, expected_duration, expected_width, expected_height,
    expected_fps_num, expected_fps_den, expected_audio, decode_code) plus the probe columns. A
    missing file has one check; an unreadable one has two.
    """
    rows = renders.join(measures, "render_id", "left").na.fill(0.0, ["black_sec", "freeze_sec", "silence_sec"]).na.fill(0, ["corrupt_markers"])
    want = F.col("expected_fps_num") / F.col("expected_fps_den")
    fps = F.col("fps_num") / F.nullif(F.col("fps_den"), F.lit(0))
    frames = F.bround(F.col("duration_sec") * fps)
    listens = F.col("expected_audio") & F.col("has_audio")
    loud = F.coalesce(F.abs(F.col("lufs") - LIMITS["lufs"]) <= LIMITS["lufs_tolerance"], F.lit(False))
    checks = {
        "duration": F.abs(F.col("duration_sec") - F.col("expected_duration")) <= F.greatest(F.lit(LIMITS["duration"]), F.lit(2.0) / want),
        "resolution": (F.col("width") == F.col("expected_width")) & (F.col("height") == F.col("expected_height")),
        "fps": F.abs(fps - want) <= LIMITS["fps"],
        "codec": F.col("codec").isin(*CODECS),
        "audio_track": F.col("has_audio") == F.col("expected_audio"),
        "aspect_ratio": F.col("width") * F.col("expected_height") == F.col("height") * F.col("expected_width"),
        "black_frames": F.col("black_sec") <= LIMITS["black"],
        "freeze_frames": F.col("freeze_sec") <= F.lit(LIMITS["freeze"]) + F.lit(1.0) / want,
        "missing_frames": (F.col("read_frames") == 0) | (F.abs(F.col("read_frames") - frames) <= LIMITS["frames"]),
        "corruption": (F.col("decode_code") == 0) & (F.col("corrupt_markers") == 0),
        "loudness": F.when(listens, loud).otherwise(~F.col("expected_audio")),
        "unexpected_silence": F.when(listens, F.col("silence_sec") <= LIMITS["silence"]).otherwise(~F.col("expected_audio")),
    }

    def row(name: str, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"))

    exists = row("file_exists", F.col("file_exists"))
    readable = F.col("has_video") & (F.col("fps_den") > 0) & (F.col("fps_num") > 0)
    all_rows = (
        F.when(~F.col("file_exists"), F.array(exists))
        .when(~readable, F.array(exists, row("corruption", F.lit(False))))
        .otherwise(F.array(exists, *[row(n, c) for n, c in checks.items()]))
    )
    return rows.select("render_id", F.inline(all_rows))


def technical_gate(checks: DataFrame) -> DataFrame:
    """A render passes with exactly thirteen checks, all of them true."""
    return checks.groupBy("render_id").agg(
        F.count(F.lit(1)).alias("check_count"), F.count_if(~F.col("passed")).alias("failed_count")
    ).withColumn("passed", (F.col("check_count") == CHECK_COUNT) & (F.col("failed_count") == 0))


def compare_style(reference: DataFrame, actual: DataFrame, key: str, tolerances: Mapping[str, float] | None = None) -> DataFrame:
    """One row per key and style metric: both values, difference, tolerance and verdict."""
    limits = {**STYLE_TOLERANCES, **(tolerances or {})}
    r, a = reference.alias("r"), actual.alias("a")
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("metric_rank"), F.lit(m).alias("metric"), F.col(f"r.{m}").alias("reference"), F.col(f"a.{m}").alias("actual"),
                F.abs(F.col(f"a.{m}") - F.col(f"r.{m}")).alias("difference"), F.lit(float(limits[m])).alias("tolerance"),
            )
            for i, m in enumerate(STYLE_TOLERANCES)
        ]
    )
    joined = r.join(a, F.col(f"r.{key}") == F.col(f"a.{key}")).select(F.col(f"r.{key}").alias(key), F.inline(rows))
    return joined.withColumn("passed", F.col("difference") <= F.col("tolerance"))


def rendered_gate(technical: DataFrame, consistent: DataFrame, style: DataFrame, key: str = "render_id") -> DataFrame:
    """Release gate: technical pass, consistent graph, and the three gating style metrics."""
    gate = style.where(F.col("metric").isin(*STYLE_GATE)).groupBy(key).agg(F.every("passed").alias("style_passed"))
    rows = technical.select(key, F.col("passed").alias("technical_passed")).join(consistent.select(key, "consistent"), key, "left").join(gate, key, "left")
    rows = rows.withColumns({"consistent": F.coalesce("consistent", F.lit(False)), "style_passed": F.coalesce("style_passed", F.lit(True))})
    return rows.withColumn("passed", F.col("technical_passed") & F.col("consistent") & F.col("style_passed"))


def graph_consistency(programs: DataFrame, prefix: str, key: str = "project_id") -> DataFrame:
    """Whether every clip of a project has its own composition name (a prefix before its id) and the required nodes."""
    named = F.col("comp_name") == F.concat(F.lit(prefix), "clip_id")
    missing = F.array_except(F.array(*[F.lit(n) for n in REQUIRED_NODES]), F.col("nodes"))
    ok = F.coalesce(named & (F.size(missing) == 0), F.lit(False))
    return programs.groupBy(key).agg(F.every(ok).alias("consistent"))


def representative_interval(
    projects: DataFrame, cuts: DataFrame, accents: DataFrame, clips: DataFrame, durations: tuple[float, ...] = (3.0, 4.0, 5.0)
) -> DataFrame:
    """First window of each project that shows two cuts, an accent, a moving clip and a landing.

    projects(project_id, duration_sec), cuts(project_id, sec, confidence), accents(project_id, sec),
    clips(project_id, in_sec, out_sec, keyframes). Windows start at cuts; projects without one are
    absent.
    """
    key = ["project_id"]
    starts = cuts.select(*key, F.col("sec").alias("start_sec")).distinct()
    windows = starts.withColumn("length", F.explode(F.array(*[F.lit(float(d)) for d in durations])))
    windows = windows.withColumn("end_sec", F.col("start_sec") + F.col("length")).join(projects, key)
    windows = windows.where(F.col("end_sec") <= F.col("duration_sec"))
    moving = clips.where(F.col("keyframes") >= 2)
    series = {
        "cut": cuts.select(*key, "sec"),
        "accent": accents.select(*key, "sec"),
        "landing": cuts.where(F.col("confidence") >= 0.3).select(*key, "sec"),
        "begun": moving.select(*key, F.col("in_sec").alias("sec")),
        "over": moving.select(*key, F.col("out_sec").alias("sec")),
    }
    rows = joins.window_totals(materialise(windows, "windows"), series, key)

    def within(name: str) -> Column:
        return F.col(f"{name}_upto_end") - F.col(f"{name}_before_start")

    # Clips that begin before the end, less those already over at the start.
    shown = F.col("begun_before_end") > F.col("over_upto_start")
    good = (within("cut") >= 2) & (within("accent") >= 1) & shown & (within("landing") >= 1)
    return joins.first_row(rows.where(good), key, F.asc("start_sec"), F.asc("length")).select(*key, "start_sec", "end_sec")


def advise_gains(comparison: DataFrame, params: DataFrame, key: str = "trial_id") -> DataFrame:
    """Next gain of every trial that fails on a tunable metric.

    comparison as `compare_style` gives it, params(trial, params map). The metric furthest beyond
    its tolerance decides, the first in report order on ties.
    """
    gain = F.create_map(*[F.lit(x) for kv in METRIC_GAINS.items() for x in kv])
    failing = comparison.where(~F.col("passed") & F.col("metric").isin(*METRIC_GAINS))
    excess = F.col("difference") / F.greatest(F.col("tolerance"), F.lit(1e-6))
    worst = joins.first_row(failing.withColumn("_excess", excess), [key], F.desc("_excess"), F.asc("metric_rank"))
    rows = worst.withColumn("gain", F.element_at(gain, F.col("metric"))).join(params, key)
    old = F.coalesce(F.try_element_at("params", F.col("gain")), F.lit(1.0))
    step = F.when(F.col("actual") < F.col("reference"), GAIN_STEP).otherwise(-GAIN_STEP)
    new = F.greatest(F.lit(MIN_GAIN), old + step)
    merged = F.map_zip_with("params", F.create_map(F.col("gain"), new), lambda k, a, b: F.coalesce(b, a))
    return rows.select(key, "metric", "gain", old.alias("old_value"), new.alias("new_value"), merged.alias("params"))


def default_params() -> Column:
    return F.create_map(*[p for g in GAINS for p in (F.lit(g), F.lit(1.0))])


def evaluate(trials: DataFrame, render: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run caller-supplied table functions in turn: one renders all trials, one judges the results."""
    return trials.transform(render).transform(judge)


def releasable(previews: DataFrame, reports: DataFrame, key: str = "project_id") -> DataFrame:
    """Projects with a preview whose report passed."""
    return previews.where(F.col("preview_path").isNotNull()).join(reports.where("passed").select(key), key, "left_semi")
