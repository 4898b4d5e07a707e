"""From measured videos and music to timeline slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelspark.functions import maths
from reelspark.operators import joins, ordered

# Fixed values.
ACCENT_PRIORITY = {
    "section_boundary": 5,
    "downbeat": 4,
    "impact": 4,
    "break_exit": 3,
    "riser_peak": 3,
    "break_entry": 2,
    "beat": 1,
    "silence_hit": 1,
}
MIN_SLOT_SEC = 0.08
HOLD_MOTION = 0.4
HERO_ACTION = 0.6
MOTION_DRAWS = 20


def mapping_mode(music_ref: Column, music_hash: Column) -> Column:
    """"exact_replica" when the video was measured against this very music."""
    return F.when(F.coalesce(music_ref == music_hash, F.lit(False)), "exact_replica").otherwise("style_transfer")


def dominant_kind(probabilities: Column) -> Column:
    """Kind with the highest probability, the first one on ties; unknown kinds read "generic"."""
    entries = F.map_entries(probabilities)
    best = F.aggregate(
        entries,
        F.struct(F.lit("generic").alias("key"), F.lit(float("-inf")).alias("value")),
        lambda acc, e: F.when(e["value"] > acc["value"], F.struct(e["key"].alias("key"), e["value"].alias("value"))).otherwise(acc),
    )["key"]
    return F.when(best.isin("portrait", "action", "hold"), best).otherwise("generic")


def screen_language(shots: DataFrame) -> DataFrame:
    """What a slot takes over from its measured shot."""
    return shots.withColumns(
        {
            "slot_kind": F.coalesce(dominant_kind(F.col("kind_probabilities")), F.lit("generic")),
            "target_brightness": F.col("brightness"),
            "preferred_subject_count": F.nullif(F.col("subject_count"), F.lit(0)),
            "entry_direction": F.col("motion_direction"),
            "exit_direction": F.col("motion_direction"),
            "hero_frame_required": F.col("action_probability") >= HERO_ACTION,
            "reference_shot_index": F.col("index"),
        }
    )


def exact_slots(shots: DataFrame, cuts: DataFrame) -> DataFrame:
    """One slot per shot; its entry motion is the relation of the cut at its first instant.

    shots and cuts come from the same cut seconds, so equal doubles mean the same cut.
    """
    marks = cuts.select("video_id", F.col("sec").alias("start_sec"), "relation", F.col("frame_idx").alias("_at"))
    rows = joins.last_match(screen_language(shots), marks, ["video_id", "start_sec"], ["_at"], ["relation"])
    known = F.col("relation").isin("carry", "reverse", "reset")
    return rows.select(
        "video_id",
        F.col("index").alias("slot_index"),
        "start_sec",
        "duration_sec",
        F.col("visual_energy").alias("target_energy"),
        (F.col("translation") < HOLD_MOTION).alias("hold"),
        F.when(known, F.col("relation")).otherwise("none").alias("entry_motion"),
        "slot_kind", "target_brightness", "preferred_subject_count", "entry_direction", "exit_direction",
        "hero_frame_required", "reference_shot_index",
    )


def select_boundaries(projects: DataFrame, accents: DataFrame) -> DataFrame:
    """Boundaries of each project: the k most important distinct accents of its track.

    projects(project_id, track_id, duration_sec, cut_density); k is the target cut count, at least
    one. Equal priority goes by time, equal time by kind name. Second zero competes as a section
    boundary.
    """
    priority = F.create_map(*[F.lit(x) for kv in ACCENT_PRIORITY.items() for x in kv])
    names = F.array(*[F.lit(k) for k in sorted(ACCENT_PRIORITY)])
    wanted = F.greatest(
        F.lit(1).cast("bigint"),
        F.greatest(F.lit(1).cast("bigint"), maths.half_even(F.col("cut_density") * F.col("duration_sec"))),
    )
    zero = projects.select("track_id", F.lit(0.0).alias("sec"), F.lit("section_boundary").alias("kind"))
    marks = accents.select("track_id", "sec", "kind").unionByName(zero).distinct()
    per_track = marks.join(projects.select("project_id", "track_id", wanted.alias("_k")), "track_id")
    rows = per_track.withColumns(
        {"_minus": -F.coalesce(F.element_at(priority, F.col("kind")), F.lit(0)), "_name": F.array_position(names, F.col("kind"))}
    )
    rows = ordered.annotate(rows, ["project_id"], ["_minus", "sec", "_name"], {"_at": ordered.position()})
    return rows.where(F.col("_at") < F.col("_k")).select("project_id", "track_id", "sec", "kind")


def motion_draws(reversal_ratio: Column, hold_ratio: Column) -> Column:
    """Entry motions repeated by weight: the list a draw picks from."""
    weights = {
        "reverse": reversal_ratio,
        "carry": F.greatest(F.lit(0.0), F.lit(1.0) - reversal_ratio - hold_ratio),
        "reset": hold_ratio * 0.5,
        "none": hold_ratio * 0.5,
    }
    total = weights["reverse"] + weights["carry"] + weights["reset"] + weights["none"]
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    one = F.lit(1).cast("bigint")
    repeats = [
        F.array_repeat(F.lit(kind), F.greatest(one, maths.half_even(w / total * MOTION_DRAWS)).cast("int")) for kind, w in weights.items()
    ]
    return F.flatten(F.array(*repeats))


def plan_seed(source_hash: Column, music_hash: Column) -> Column:
    return maths.hash32(F.concat_ws(":", source_hash, music_hash))


def transfer_slots(projects: DataFrame, boundaries: DataFrame, shots: DataFrame) -> DataFrame:
    """Slots between chosen boundaries, with energy, hold and entry motion in the style of the video.

    projects(project_id, video_id, duration_sec, hold_ratio, reversal_ratio, seed). Hold and entry
    motion are draws from a hash of seed and slot number, so equal inputs give equal slots.
    """
    edges = projects.select("project_id", F.explode(F.array(F.lit(0.0), F.col("duration_sec"))).alias("sec"))
    kinds = boundaries.groupBy("project_id", "sec").agg(F.min("kind").alias("_kind"))
    marks = kinds.unionByName(edges.withColumn("_kind", F.lit(None).cast("string")))
    marks = marks.groupBy("project_id", "sec").agg(F.max("_kind").alias("_kind"))
    rows = ordered.annotate(
        marks, ["project_id"], ["sec"],
        {"_i": ordered.position(), "_end": ordered.lead(F.col("sec")), "_m": ordered.key_total(F.lit(1))},
    ).where(F.col("_end").isNotNull())
    counts = shots.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(projects.select("project_id", "video_id", "hold_ratio", "reversal_ratio", "seed"), "project_id")
    rows = rows.join(counts, "video_id", "left")
    share = F.col("_i") / F.greatest(F.lit(1), F.col("_m") - 2)
    rows = rows.withColumn("index", F.least(F.col("_n") - 1, F.floor(share * F.col("_n")).cast("bigint")))
    look = screen_language(shots).select(
        "video_id", "index", "visual_energy", "slot_kind", "target_brightness", "preferred_subject_count", "entry_direction",
        "exit_direction", "hero_frame_required", "reference_shot_index",
    )
    rows = rows.join(look, ["video_id", "index"], "left")
    draws = motion_draws(F.col("reversal_ratio"), F.col("hold_ratio"))
    pick = F.floor(maths.uniform(F.concat_ws(":", "seed", "_i", F.lit("motion"))) * F.size(draws)).cast("int") + 1
    return rows.select(
        "project_id",
        F.col("_i").alias("slot_index"),
        F.col("sec").alias("start_sec"),
        (F.col("_end") - F.col("sec")).alias("duration_sec"),
        F.coalesce("visual_energy", F.lit(0.5)).alias("target_energy"),
        (maths.uniform(F.concat_ws(":", "seed", "_i", F.lit("hold"))) < F.col("hold_ratio")).alias("hold"),
        F.when(F.col("_i") > 0, F.element_at(draws, pick)).otherwise("none").alias("entry_motion"),
        F.when(F.col("_kind").isNotNull(), F.col("sec")).alias("music_event_sec"),
        F.col("_kind").alias("music_event_kind"),
        F.coalesce("slot_kind", F.lit("generic")).alias("slot_kind"),
        "target_brightness", "preferred_subject_count",
        F.coalesce("entry_direction", F.lit("none")).alias("entry_direction"),
        F.coalesce("exit_direction", F.lit("none")).alias("exit_direction"),
        F.coalesce("hero_frame_required", F.lit(False)).alias("hero_frame_required"),
        "reference_shot_index",
    )


def merge_short(slots: DataFrame, key: str = "project_id", minimum_sec: float = MIN_SLOT_SEC) -> DataFrame:
    """Absorb slots shorter than the minimum into the slot before; a short first slot stays."""
    rows = ordered.annotate(slots, [key], ["slot_index"], {"_at": ordered.position()})
    kept = F.when((F.col("duration_sec") >= minimum_sec) | (F.col("_at") == 0), 1).otherwise(0)
    rows = ordered.annotate(rows.withColumn("_kept", kept), [key], ["slot_index"], {"_group": ordered.running_sum(F.col("_kept"))})
    others = [c for c in slots.columns if c not in (key, "duration_sec")]
    first = F.min_by(F.struct(*[F.col(c) for c in others]), F.col("slot_index")).alias("_first")
    merged = rows.groupBy(key, "_group").agg(first, F.sum("duration_sec").alias("duration_sec"))
    return merged.select(*[F.col(c) if c in (key, "duration_sec") else F.col(f"_first.{c}").alias(c) for c in slots.columns])
