"""Transition profiles, clip motion and transition keyframes."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from reelspark.functions import directions, maths

# Fixed values.
MIN_PROFILE_CONFIDENCE = 0.35
DEFAULT_WINDOW_SEC = 8 / 24
DEFAULT_TRANSLATION = 0.10
DEFAULT_OVERSHOOT = 0.04
TRANSLATION_RANGE = (0.02, 0.28)
MAX_OVERSHOOT = 0.15
RELATIONS = ("carry", "reverse", "reset")
SAFETY_MARGIN = 1.06
PUSH_SCALE = 0.06
REFERENCE_SEC = 0.6
MAX_TRANSITION_SHARE = 0.35
BASE_SHUTTER = 8.0
SHUTTER_GAIN = 220.0
MAX_SHUTTER = 90.0


def attack_fraction(envelope: Column) -> Column:
    """Place of the first peak within an envelope, 0 to 1; .5 for fewer than two samples."""
    return F.when(F.size(envelope) < 2, 0.5).otherwise(maths.first_peak(envelope) / (F.size(envelope) - 1))


def relation_profiles(videos: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean transition shape of each video and relation; defaults with confidence zero where none was seen.

    videos(video_id, width), pairs as `frames.transition_pairs` gives them.
    """
    whole = F.concat("outgoing_envelope", "incoming_envelope")
    means = pairs.where(F.col("relation").isin(*RELATIONS)).groupBy("video_id", "relation").agg(
        F.avg("anticipation_sec").alias("_ant"), F.avg("release_sec").alias("_rel"),
        F.avg(F.coalesce(F.array_max(whole), F.lit(0.0))).alias("_peak"), F.avg("overshoot").alias("_over"),
        F.avg("confidence").alias("_conf"), F.avg(attack_fraction(whole)).alias("_attack"),
        maths.majority(F.col("effect_kind") == "flash").alias("_flash"),
    )
    names = F.explode(F.array(*[F.lit(r) for r in RELATIONS])).alias("relation")
    rows = videos.select("video_id", "width", names).join(means, ["video_id", "relation"], "left")
    seen = F.col("_conf").isNotNull() & (F.col("width") > 0)

    def measured(value: Column, default) -> Column:
        return F.when(seen, value).otherwise(F.lit(default))

    confidence = measured(F.col("_conf"), 0.0)
    return rows.select(
        "video_id",
        "relation",
        measured(F.col("_ant"), DEFAULT_WINDOW_SEC).alias("anticipation_sec"),
        measured(F.col("_rel"), DEFAULT_WINDOW_SEC).alias("release_sec"),
        measured(maths.clamp(F.col("_peak") / F.col("width"), *TRANSLATION_RANGE), DEFAULT_TRANSLATION).alias("translation_unit"),
        measured(maths.clamp(F.col("_over") / F.col("width"), 0.0, MAX_OVERSHOOT), DEFAULT_OVERSHOOT).alias("overshoot"),
        confidence.alias("confidence"),
        measured(F.col("_attack"), 0.5).alias("attack_fraction"),
        F.when(seen & F.col("_flash"), "flash").otherwise("none").alias("effect_kind"),
        (confidence >= MIN_PROFILE_CONFIDENCE).alias("usable"),
    )


def damped(value: Column, duration: Column) -> Column:
    """Magnitudes shrink on clips shorter than the reference length."""
    return value * F.least(F.lit(1.0), duration / REFERENCE_SEC)


def safe_scale(dx: Column, dy: Column, aspect: Column | None = None, rotation_deg: Column | None = None) -> Column:
    """Smallest scale, with margin, at which a moved and turned frame shows no canvas edge."""
    base = F.greatest(F.lit(1.0) + F.abs(dx) * 2, F.lit(1.0) + F.abs(dy) * 2)
    if rotation_deg is not None:
        theta = F.radians(F.abs(rotation_deg))
        turned = F.abs(F.cos(theta)) + F.abs(F.sin(theta)) / aspect
        base = F.when(rotation_deg != 0, F.greatest(base, turned)).otherwise(base)
    return base * SAFETY_MARGIN


def _key(sec: Column, x: Column, y: Column, scale: Column) -> Column:
    return F.struct(sec.cast("double").alias("sec"), x.alias("center_x"), y.alias("center_y"), scale.alias("scale"))


def clip_motion(clips: DataFrame) -> DataFrame:
    """Add `transform_keyframes` and `shutter_keyframes` from each clip's own hold flag and entry motion.

    A held clip stays at one scale and has no shutter keyframes; any other pushes along its entry
    motion at constant speed.
    """
    half = F.lit(0.5)
    d = F.col("timeline_duration_sec")
    unit = damped(F.lit(DEFAULT_TRANSLATION), d)
    dx, dy = directions.vector_x(F.col("entry_motion")), directions.vector_y(F.col("entry_motion"))
    still = F.lit(1.0 + PUSH_SCALE * 0.3)
    held = F.array(_key(F.lit(0.0), half, half, still), _key(d, half, half, still))
    pushed = F.array(
        _key(F.lit(0.0), half, half, F.lit(1.0 + PUSH_SCALE * 0.2)),
        _key(d, half - dx * unit * 0.5, half - dy * unit * 0.5, safe_scale(dx * unit, dy * unit)),
    )
    shutter = F.least(F.lit(MAX_SHUTTER), F.lit(BASE_SHUTTER) + unit / F.greatest(d, F.lit(1e-6)) * SHUTTER_GAIN)
    blur = F.array(*[F.struct(s.cast("double").alias("sec"), shutter.alias("shutter_angle")) for s in (F.lit(0.0), d)])
    none = F.array().cast("array<struct<sec:double,shutter_angle:double>>")
    return clips.withColumns(
        {
            "transform_keyframes": F.when(F.col("hold"), held).otherwise(pushed),
            "shutter_keyframes": F.when(F.col("hold"), none).otherwise(blur),
        }
    )


def transition_keyframes(transitions: DataFrame) -> DataFrame:
    """Keyframes on both sides of every cut from one shared decision.

    transitions(cut_sec, relation, direction, confidence, outgoing_duration_sec,
    incoming_duration_sec, profile) where profile is a struct of `relation_profiles` or null. A
    profile that is not usable turns the cut into a plain reset.
    """
    p = F.col("profile")
    given = p.isNotNull()
    usable = given & p["usable"]
    demoted = given & ~p["usable"]
    relation = F.when(demoted, "reset").otherwise(F.col("relation"))
    direction = F.when(demoted, "none").otherwise(F.col("direction"))
    out_d, in_d = F.col("outgoing_duration_sec"), F.col("incoming_duration_sec")

    def of(field: str, default: float) -> Column:
        return F.when(given, p[field]).otherwise(F.lit(default))

    # `least` skips nulls, so an unknown clip length sets no cap.
    rows = transitions.withColumns(
        {
            "_rel": relation,
            "_dir": F.when(relation == "reset", "none").otherwise(direction),
            "direction": F.when(relation.isin("reset", "none"), "none").otherwise(direction),
            "effect_kind": F.when(usable, p["effect_kind"]).otherwise("none"),
            "_release": F.least(of("release_sec", DEFAULT_WINDOW_SEC), in_d * MAX_TRANSITION_SHARE),
            "_budget": F.least(of("anticipation_sec", DEFAULT_WINDOW_SEC), out_d * MAX_TRANSITION_SHARE),
            "_unit": damped(of("translation_unit", DEFAULT_TRANSLATION), F.coalesce(F.least(out_d, in_d), F.lit(REFERENCE_SEC))),
            "_attack": of("attack_fraction", 0.5),
            "overshoot": F.when(relation == "carry", of("overshoot", DEFAULT_OVERSHOOT)).otherwise(F.lit(0.0)),
        }
    )
    dx, dy = directions.vector_x(F.col("_dir")), directions.vector_y(F.col("_dir"))
    rows = rows.withColumns(
        {
            "_dx": dx,
            "_dy": dy,
            "safe_scale": safe_scale(dx * F.col("_unit"), dy * F.col("_unit")),
            "_lead": F.least("_budget", "cut_sec"),
        }
    )
    cut, unit, attack, safe = F.col("cut_sec"), F.col("_unit"), F.col("_attack"), F.col("safe_scale")
    begin = cut - F.col("_lead")
    half = F.lit(0.5)
    end_x, end_y = half - F.col("_dx") * unit * 0.5, half - F.col("_dy") * unit * 0.5
    outgoing = F.array(
        _key(begin, half, half, F.lit(1.0)),
        _key(begin + attack * F.col("_lead"), half + (end_x - half) * attack, half + (end_y - half) * attack, F.lit(1.0) + (safe - 1.0) * attack),
        _key(cut, end_x, end_y, safe),
    )
    side = F.when(F.col("_rel") == "carry", 0.5).otherwise(-0.5)
    start_x, start_y = half + F.col("_dx") * unit * side, half + F.col("_dy") * unit * side
    settle = safe * (F.lit(1.0) + F.col("overshoot"))
    rest = F.lit(1.0) - attack
    finish = cut + F.col("_release")
    incoming = F.array(
        _key(cut, start_x, start_y, settle),
        _key(cut + rest * F.col("_release"), start_x + (half - start_x) * rest, start_y + (half - start_y) * rest, settle + (F.lit(1.0) - settle) * rest),
        _key(finish, half, half, F.lit(1.0)),
    )
    strength = F.when(F.col("_rel") != "none", F.least(F.lit(1.0), F.col("confidence") * 0.5 + 0.3)).otherwise(F.lit(0.0))
    angle = F.when((F.col("_dx") != 0) | (F.col("_dy") != 0), F.degrees(F.atan2("_dy", "_dx"))).otherwise(F.lit(0.0))

    def blur_key(sec: Column, a: Column, s: Column) -> Column:
        return F.struct(sec.alias("sec"), a.alias("angle"), s.alias("strength"))

    zero = F.lit(0.0)
    blur = F.array(blur_key(begin, zero, zero), blur_key(cut, angle, strength), blur_key(finish, zero, zero))
    out = rows.withColumns({"outgoing_keyframes": outgoing, "incoming_keyframes": incoming, "blur_keyframes": blur})
    return out.drop("_rel", "_dir", "_release", "_budget", "_unit", "_attack", "_dx", "_dy", "_lead")


def aspect_text(width: Column, height: Column) -> Column:
    """"w:h" in lowest terms."""

    def euclid(s, _):
        return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b")))

    start = F.struct(width.cast("bigint").alias("a"), height.cast("bigint").alias("b"))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, euclid, lambda s: F.greatest(s["a"], F.lit(1)))
    return F.concat_ws(":", (width / gcd).cast("bigint"), (height / gcd).cast("bigint"))


def canvas(rows: DataFrame, wanted: str = "wanted_aspect") -> DataFrame:
    """Canvas of each project: the measured size, or its width with the height of a wanted "a:b"."""
    own = aspect_text(F.col("width"), F.col("height"))
    parts = F.split(F.coalesce(F.col(wanted), own), ":")
    a, b = F.element_at(parts, 1).cast("double"), F.element_at(parts, 2).cast("double")
    changed = F.col(wanted).isNotNull() & (F.col(wanted) != own)
    return rows.withColumns(
        {
            "aspect": F.coalesce(F.col(wanted), own),
            "canvas_width": F.col("width").cast("bigint"),
            "canvas_height": F.when(changed, maths.half_even(F.col("width") * b / a)).otherwise(F.col("height").cast("bigint")),
        }
    )


