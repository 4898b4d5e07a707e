"""Frame-signal operators: cut classification, shots, motion around cuts, style statistics.

Input tables: frames(video_id, frame_idx, brightness, sharpness, hist, edge, px, face columns) and
pairs(video_id, frame_a, tx, ty, log_scale, rotation, confidence), motion from frame_a to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reelspark.functions import directions, maths
from reelspark.operators import joins, ordered

# Fixed values of the measurement.
CUT_WINDOW_FRAMES = 8
MOTION_SAMPLE_SEC = 0.1
SYNC_TOLERANCE_SEC = 0.08
MOVING_THRESHOLD = 0.4
FLASH_BLUR_THRESHOLD = 0.55
MIN_MOTION_CONFIDENCE = 0.3


def histogram_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms of any scale."""
    zero = F.lit(0.0)
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), zero, lambda acc, v: acc + v)
    mass = F.aggregate(a, zero, lambda acc, v: acc + v) * F.aggregate(b, zero, lambda acc, v: acc + v)
    overlap = shared / F.sqrt(F.when(mass > 0, mass).otherwise(F.lit(1.0)))
    return F.sqrt(F.greatest(zero, F.lit(1.0) - overlap))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two 0..255 arrays, scaled to [0, 1]."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: acc + v)
    return total / F.size(a) / 255.0


def neighbourhood(cuts: DataFrame, frames: DataFrame, offsets: Sequence[int] = (-6, -2, 0, 2, 6)) -> DataFrame:
    """Frames at fixed offsets around every cut, one struct column `at_<k>` per offset.

    Indexes before the first frame read the first frame; a frame past the end is null.
    """
    wanted = cuts.withColumn("_off", F.explode(F.array(*[F.lit(o) for o in offsets])))
    wanted = wanted.withColumn("_at", F.greatest(F.lit(0), F.col("frame_idx") + F.col("_off")))
    body = F.struct(*[F.col(c) for c in frames.columns if c not in ("video_id", "frame_idx")])
    side = frames.select("video_id", F.col("frame_idx").alias("_at"), body.alias("_frame"))
    picks = [
        F.any_value(F.when(F.col("_off") == o, F.col("_frame")), ignoreNulls=True).alias(f"at_{k}")
        for k, o in enumerate(offsets)
    ]
    return wanted.join(side, ["video_id", "_at"]).groupBy(*cuts.columns).agg(*picks)


def cut_signals(cuts: DataFrame, frames: DataFrame) -> DataFrame:
    """Signals of every proposed cut; a cut without its two inner frames is dropped."""
    needed = frames.select("video_id", "frame_idx", "brightness", "sharpness", "hist", "edge", "px")
    rows = neighbourhood(cuts, needed).where(F.col("at_1").isNotNull() & F.col("at_2").isNotNull())
    before, after = F.col("at_1"), F.col("at_2")
    return rows.select(
        *cuts.columns,
        histogram_distance(before["hist"], after["hist"]).alias("hist_distance"),
        mean_difference(before["edge"], after["edge"]).alias("edge_distance"),
        mean_difference(before["px"], after["px"]).alias("mean_diff"),
        F.abs(after["sharpness"] - before["sharpness"]).alias("sharpness_delta"),
        before["brightness"].alias("brightness_before"),
        after["brightness"].alias("brightness_after"),
        F.coalesce(F.col("at_3.brightness"), after["brightness"]).alias("brightness_next"),
        F.coalesce(mean_difference(F.col("at_0.px"), before["px"]), F.lit(0.0)).alias("motion_before"),
        F.coalesce(mean_difference(after["px"], F.col("at_4.px")), F.lit(0.0)).alias("motion_after"),
    )


def classify_cuts(signals: DataFrame) -> DataFrame:
    """Add `cut_type` and `confidence` by ordered rules over the signals."""
    h, e, m = F.col("hist_distance"), F.col("edge_distance"), F.col("mean_diff")
    one = F.lit(1.0)
    signal = F.least(one, h * 2) * 0.4 + F.least(one, e * 3) * 0.35 + F.least(one, m * 3) * 0.25
    flash = (F.col("brightness_after") - F.col("brightness_before") > 0.35) & (
        F.col("brightness_after") - F.col("brightness_next") > 0.25
    )
    whip = (F.col("motion_before") > 0.55) & (F.col("motion_after") > 0.55)
    dissolve = (h > 0.15) & (h < 0.35) & (e < 0.12) & (F.col("sharpness_delta") < 40)

    def verdict(kind: str, confidence: Column) -> Column:
        return F.struct(F.lit(kind).alias("cut_type"), confidence.alias("confidence"))

    rule = (
        F.when(flash, verdict("flash_cut", F.least(one, signal + 0.2)))
        .when(whip, verdict("whip_hidden_cut", F.greatest(F.lit(0.25), signal * 0.7)))
        .when(dissolve, verdict("dissolve", F.greatest(F.lit(0.2), signal * 0.6)))
        .when(signal >= 0.35, verdict("hard_cut", signal))
        .otherwise(verdict("unknown", signal))
    )
    return signals.withColumn("_rule", rule).select(*signals.columns, "_rule.cut_type", "_rule.confidence")


def shots_from_cuts(cuts: DataFrame, videos: DataFrame) -> DataFrame:
    """Shots between consecutive cuts; pieces shorter than a frame vanish and indexes stay contiguous."""
    ends = videos.select("video_id", F.explode(F.array(F.lit(0.0), F.col("duration_sec"))).alias("sec"))
    edges = cuts.select("video_id", "sec").unionByName(ends)
    pieces = ordered.annotate(edges, ["video_id"], ["sec"], {"end_sec": ordered.lead(F.col("sec"))})
    pieces = pieces.join(videos.select("video_id", "fps"), "video_id")
    pieces = pieces.where(F.col("end_sec") - F.col("sec") >= F.lit(1.0) / F.col("fps"))
    pieces = pieces.select("video_id", F.col("sec").alias("start_sec"), "end_sec", "fps")
    return ordered.annotate(pieces, ["video_id"], ["start_sec"], {"index": ordered.position()})


def kind_probabilities(portrait: Column, action: Column, hold: Column) -> Column:
    """Portrait, action and hold weights scaled to sum 1, or {generic: 1} when there is no weight."""
    total = portrait + action + hold
    names = F.array(F.lit("portrait"), F.lit("action"), F.lit("hold"))
    share = F.map_from_arrays(names, F.transform(F.array(portrait, action, hold), lambda v: v / total))
    return F.when(total <= 1e-6, F.create_map(F.lit("generic"), F.lit(1.0))).otherwise(share)


def observe_shots(shots: DataFrame, frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """Measurements of each shot at its middle frame; a shot whose middle frame is missing is dropped."""
    mid = maths.half_even((F.col("start_sec") + F.col("end_sec")) / 2 * F.col("fps"))
    at = shots.withColumn("frame_idx", mid)
    look = frames.select(
        "video_id", "frame_idx", "sharpness", "brightness", "face_confidence", "frontal_probability", "eyes_visible_ratio"
    )
    motion = pairs.select("video_id", F.col("frame_a").alias("frame_idx"), "tx", "ty", "confidence")
    rows = at.join(look, ["video_id", "frame_idx"]).join(motion, ["video_id", "frame_idx"], "left")
    rows = rows.na.fill(0.0, ["tx", "ty", "confidence", "face_confidence", "frontal_probability", "eyes_visible_ratio"])
    move = F.hypot("tx", "ty")
    portrait = F.col("frontal_probability") * F.col("face_confidence")
    action = maths.clamp(F.col("confidence") * move / 30.0)
    stable = maths.clamp(F.lit(1.0) - move / 40.0)
    return rows.select(
        "video_id",
        "index",
        "start_sec",
        "end_sec",
        (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"),
        F.least(F.lit(1.0), F.col("sharpness") / 2000.0).alias("visual_energy"),
        "brightness",
        move.alias("translation"),
        F.col("confidence").alias("motion_confidence"),
        (F.col("confidence") * 0.7).alias("native_confidence"),
        F.when(F.col("face_confidence") > 0, 1).otherwise(0).alias("subject_count"),
        F.col("face_confidence").alias("face_visibility"),
        F.col("eyes_visible_ratio").alias("eye_visibility"),
        portrait.alias("portrait_probability"),
        action.alias("action_probability"),
        stable.alias("stable_ratio"),
        kind_probabilities(portrait, action, stable).alias("kind_probabilities"),
        directions.bucket(F.col("tx"), F.col("ty")).alias("motion_direction"),
    )


def pair_table(frames: DataFrame) -> DataFrame:
    """Consecutive frame pairs with the motion of the first and the sharpness of the second frame."""
    rows = ordered.with_halo(
        frames, ["video_id"], "frame_idx", 0, 1, lambda w: {"sharpness_b": F.lead("sharpness").over(w)}
    ).where(F.col("sharpness_b").isNotNull())
    return rows.select(
        "video_id", F.col("frame_idx").alias("frame_a"), "tx", "ty", "log_scale", "rotation", "confidence", "sharpness_b"
    )


def cut_motion(cuts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Motion in the eight frame pairs on either side of each cut.

    Per side: mean speed and confidence, the speed and blur envelopes in time order, and the mean
    vector of the confident pairs. A side without frames reads zero.
    """
    n = CUT_WINDOW_FRAMES
    wanted = cuts.select("video_id", "frame_idx").withColumn(
        "_side", F.explode(F.array(F.lit("outgoing"), F.lit("incoming")))
    )
    first = F.when(F.col("_side") == "outgoing", F.col("frame_idx") - (n + 1)).otherwise(F.col("frame_idx") + 1)
    wanted = wanted.withColumn("frame_a", F.explode(F.sequence(first, first + (n - 1))))
    rows = wanted.join(pairs, ["video_id", "frame_a"])
    sure = F.col("confidence") >= MIN_MOTION_CONFIDENCE
    blur = maths.clamp(F.lit(1.0) - F.col("sharpness_b") / 2000.0)
    step = F.struct(F.col("frame_a"), F.hypot("tx", "ty").alias("speed"), blur.alias("blur"))
    # At most eight rows per cut and side.
    sides = rows.groupBy("video_id", "frame_idx", "_side").agg(
        F.avg(F.hypot("tx", "ty")).alias("value"),
        F.avg("confidence").alias("confidence"),
        F.array_sort(F.collect_list(step)).alias("_steps"),
        maths.mean_or(F.when(sure, F.col("tx"))).alias("vx"),
        maths.mean_or(F.when(sure, F.col("ty"))).alias("vy"),
    )
    sides = sides.select(
        "video_id", "frame_idx", "_side",
        F.struct(
            "value", "confidence", "vx", "vy",
            F.transform("_steps", lambda s: s["speed"]).alias("envelope"),
            F.transform("_steps", lambda s: s["blur"]).alias("blur"),
        ).alias("_m"),
    )
    empty = F.array().cast("array<double>")
    still = F.struct(
        F.lit(0.0).alias("value"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"),
        empty.alias("envelope"), empty.alias("blur"),
    )
    both = sides.groupBy("video_id", "frame_idx").agg(
        *[F.any_value(F.when(F.col("_side") == s, F.col("_m")), ignoreNulls=True).alias(s) for s in ("outgoing", "incoming")]
    )
    return cuts.join(both, ["video_id", "frame_idx"], "left").withColumns(
        {s: F.coalesce(F.col(s), still) for s in ("outgoing", "incoming")}
    )


def motion_relation(out: Column, inc: Column) -> Column:
    """How motion continues over a cut: carry, reverse, reset or unknown."""
    out_size, in_size = F.hypot(out["vx"], out["vy"]), F.hypot(inc["vx"], inc["vy"])
    ratio = inc["value"] / F.greatest(out["value"], F.lit(1e-6))
    dot = out["vx"] * inc["vx"] + out["vy"] * inc["vy"]
    return (
        F.when((out["confidence"] < MIN_MOTION_CONFIDENCE) | (inc["confidence"] < MIN_MOTION_CONFIDENCE), "unknown")
        .when((out["value"] < MOVING_THRESHOLD) & (inc["value"] < MOVING_THRESHOLD), "unknown")
        .when(inc["value"] < out["value"] * 0.35, "reset")
        .when(
            (out_size < 1e-6) | (in_size < 1e-6),
            F.when((ratio >= 0.5) & (ratio <= 2.0), "carry").otherwise("reverse"),
        )
        .when(dot >= 0, "carry")
        .otherwise("reverse")
    )


def classify_effect(blur: Column) -> Column:
    """"flash" when the blur envelope reaches the threshold anywhere."""
    return F.when(F.coalesce(F.array_max(blur), F.lit(0.0)) >= FLASH_BLUR_THRESHOLD, "flash").otherwise("none")


def observe_cuts(cuts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cuts with motion on both sides, relation, direction and effect."""
    rows = cut_motion(cuts, pairs)
    sure = F.col("incoming.confidence") >= MIN_MOTION_CONFIDENCE
    return rows.withColumns(
        {
            "relation": motion_relation(F.col("outgoing"), F.col("incoming")),
            "direction": F.when(sure, directions.bucket(F.col("incoming.vx"), F.col("incoming.vy"))).otherwise("none"),
            "blur_envelope": F.concat("outgoing.blur", "incoming.blur"),
        }
    ).withColumn("effect_kind", classify_effect(F.col("blur_envelope")))


def transition_pairs(cuts: DataFrame) -> DataFrame:
    """Transitions worth repeating: every observed cut with a known relation."""
    window = F.lit(CUT_WINDOW_FRAMES / 24.0)
    return cuts.where(F.col("relation") != "unknown").select(
        "video_id",
        "frame_idx",
        F.col("sec").alias("cut_sec"),
        "relation",
        F.when(F.col("relation") == "reset", "none").otherwise(F.col("direction")).alias("direction"),
        "effect_kind",
        window.alias("anticipation_sec"),
        window.alias("release_sec"),
        F.col("outgoing.envelope").alias("outgoing_envelope"),
        F.col("incoming.envelope").alias("incoming_envelope"),
        "blur_envelope",
        F.greatest(F.lit(0.0), F.col("incoming.value") - F.col("outgoing.value")).alias("overshoot"),
        F.least("outgoing.confidence", "incoming.confidence").alias("confidence"),
    )


def motion_curve(videos: DataFrame, gap_motion: DataFrame, frames: DataFrame) -> DataFrame:
    """Speed and acceleration every tenth of a second, up to the first missing frame.

    gap_motion(video_id, frame_a, frame_b, tx, ty, log_scale, rotation, confidence).
    """
    step = F.lit(MOTION_SAMPLE_SEC)
    last = F.ceil(F.col("duration_sec") / step).cast("bigint")
    rows = videos.select("video_id", "fps", "duration_sec", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    sec = F.col("k") * step
    rows = rows.where(sec + step < F.col("duration_sec"))
    rows = rows.select(
        "video_id", "k", sec.alias("_sec"),
        maths.half_even(sec * F.col("fps")).alias("frame_a"), maths.half_even((sec + step) * F.col("fps")).alias("frame_b"),
    )
    have = frames.select("video_id", "frame_idx")
    for end in ("a", "b"):
        seen = have.select("video_id", F.col("frame_idx").alias(f"frame_{end}"), F.lit(1).alias(f"_has_{end}"))
        rows = rows.join(seen, ["video_id", f"frame_{end}"], "left")
    rows = rows.withColumn("_gone", F.when(F.col("_has_a").isNotNull() & F.col("_has_b").isNotNull(), 0).otherwise(1))
    rows = ordered.annotate(rows, ["video_id"], ["k"], {"_lost": ordered.running_sum(F.col("_gone"))}).where(F.col("_lost") == 0)
    rows = rows.join(gap_motion, ["video_id", "frame_a", "frame_b"], "left").na.fill(0.0, ["tx", "ty", "log_scale", "rotation", "confidence"])
    rows = rows.withColumn("velocity", F.hypot("tx", "ty"))
    rows = ordered.with_halo(rows, ["video_id"], "k", 1, 0, lambda w: {"_prior": F.lag("velocity", 1, 0.0).over(w)})
    return rows.select(
        "video_id", "k", (F.col("_sec") + step / 2).alias("sec"), "tx", "ty", "log_scale", "rotation", "velocity",
        ((F.col("velocity") - F.col("_prior")) / step).alias("acceleration"), "confidence",
    )


def sync_ratio(cuts: DataFrame) -> DataFrame:
    """Cut count and share of cuts within 80 ms of a music event, per video."""
    return cuts.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("cut_count"),
        maths.ratio_of(F.abs("music_offset_sec") <= SYNC_TOLERANCE_SEC).alias("synced_ratio"),
    )


def style_summary(videos: DataFrame, shots: DataFrame, cuts: DataFrame) -> DataFrame:
    """Edit statistics of each video.

    videos(video_id, duration_sec), shots(video_id, duration_sec, translation), cuts(video_id,
    relation, music_offset_sec, outgoing_confidence).
    """
    shot_side = shots.groupBy("video_id").agg(
        F.avg("duration_sec").alias("shot_duration_mean"),
        maths.ratio_of(F.col("translation") > MOVING_THRESHOLD).alias("motion_coverage"),
        maths.ratio_of(F.col("translation") < MOVING_THRESHOLD).alias("hold_ratio"),
    )
    median = ordered.order_statistics(shots, ["video_id"], "duration_sec", {"shot_duration_median": 0.5})
    cut_side = cuts.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_cuts"),
        maths.ratio_of(F.abs("music_offset_sec") <= SYNC_TOLERANCE_SEC).alias("music_sync_ratio"),
        maths.ratio_of(F.col("relation") == "reverse").alias("reversal_ratio"),
        maths.ratio_of(F.col("outgoing_confidence") > 0.5).alias("scale_motion_ratio"),
    )
    measured = (
        "cut_density", "shot_duration_mean", "shot_duration_median", "music_sync_ratio", "motion_coverage",
        "hold_ratio", "reversal_ratio", "scale_motion_ratio",
    )
    rows = videos.select("video_id", "duration_sec").join(shot_side, "video_id", "left").join(median, "video_id", "left")
    rows = rows.join(cut_side, "video_id", "left")
    rows = rows.withColumn("cut_density", F.coalesce("_cuts", F.lit(0)) / F.greatest(F.col("duration_sec"), F.lit(1e-6)))
    return rows.select("video_id", *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in measured], F.lit(0.0).alias("blur_usage"))


def dominant_palette(pixels: DataFrame, colours: int = 5) -> DataFrame:
    """Most frequent colours of each frame as #rrggbb bin centres; equal counts go to the higher bin."""
    bins = [F.floor(F.col(c) / 32).cast("int").alias(f"_{c}") for c in ("r", "g", "b")]
    counts = pixels.select("video_id", "frame_idx", *bins).groupBy("video_id", "frame_idx", "_r", "_g", "_b").agg(
        F.count(F.lit(1)).alias("n")
    )
    top = joins.top_rows(
        counts, ["video_id", "frame_idx"], colours, F.desc("n"), F.desc("_r"), F.desc("_g"), F.desc("_b")
    )
    hexed = F.format_string("#%02x%02x%02x", *[F.col(c) * 32 + 16 for c in ("_r", "_g", "_b")])
    return top.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("rank", hexed.alias("hex")))).alias("_top")).select(
        "video_id", "frame_idx", F.transform("_top", lambda t: t["hex"]).alias("palette")
    )


def edge_motion(shots: DataFrame, pairs: DataFrame, key: str = "video_id") -> DataFrame:
    """Entry and exit direction of each shot, measured once per shot near its two ends."""
    fps = F.col("fps")
    gap = F.greatest(F.lit(1), maths.half_even(fps * 0.2))
    late = F.greatest(F.col("start_sec"), F.col("end_sec") - gap / fps)
    at = shots.withColumns(
        {
            "_entry_at": F.greatest(F.lit(0), maths.half_even(F.col("start_sec") * fps)),
            "_exit_at": F.greatest(F.lit(0), maths.half_even(late * fps)),
        }
    )
    label = F.when(F.col("confidence") < MIN_MOTION_CONFIDENCE, "none").otherwise(directions.bucket(F.col("tx"), F.col("ty")))
    seen = pairs.select(key, "frame_a", label.alias("_label"))
    for end in ("entry", "exit"):
        side = seen.select(key, F.col("frame_a").alias(f"_{end}_at"), F.col("_label").alias(f"{end}_motion"))
        at = at.join(side, [key, f"_{end}_at"], "left")
    return at.select(*shots.columns, *[F.coalesce(f"{e}_motion", F.lit("none")).alias(f"{e}_motion") for e in ("entry", "exit")])
