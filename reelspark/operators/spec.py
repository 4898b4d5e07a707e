"""Assembly of clips and transitions from slots and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelspark.operators import joins, motion, ordered

# Fixed values.
SPEC_VERSION = "3.1.0"
TRANSITION_CONFIDENCE = 0.6


def lay_out(slots: DataFrame, choices: DataFrame) -> DataFrame:
    """Slots with their choice and timeline position; empty slots take up time but hold no clip.

    choices(project_id, slot_index, shot_id, asset_id, window_id, in_sec, out_sec, anchor_sec,
    entry_motion, exit_motion); a missing row or an empty shot id is an empty slot.
    """
    filled = choices.where(F.coalesce("shot_id", F.lit("")) != "").withColumnsRenamed(
        {"entry_motion": "clip_entry", "exit_motion": "clip_exit"}
    ).withColumn("filled", F.lit(True))
    keys, have = ["project_id", "slot_index"], F.coalesce("filled", F.lit(False))
    before = F.struct("slot_index", "filled", "clip_exit", F.col("duration_sec").alias("duration"))
    asks = {"timeline_in_sec": ordered.sum_before(F.col("duration_sec")), "_prev": ordered.lag(before)}
    rows = ordered.Sliced(slots, ["project_id"], ["slot_index"])
    if rows.hot is None:
        # Both sides are dealt by project, so the join and the ordered columns share one shuffle of each.
        rows.rows = joins.dealt_matches(slots, filled, keys, "project_id").withColumn("filled", have)
        return rows.annotate(asks).df()
    return ordered.annotate(slots.join(filled, keys, "left").withColumn("filled", have), ["project_id"], ["slot_index"], asks)


def clips(laid: DataFrame) -> DataFrame:
    """Clips with their own motion keyframes, and where they come from as far as `laid` tells."""
    source = {"shot_id": "shot_id", "asset_id": "asset_id", "window_id": "window_id", "in_sec": "source_in_sec", "out_sec": "source_out_sec", "anchor_sec": "anchor_sec"}
    rows = laid.where("filled").select(
        "project_id", F.concat(F.lit("c"), "slot_index").alias("clip_id"), "slot_index", *[F.col(c).alias(n) for c, n in source.items() if c in laid.columns], "timeline_in_sec",
        F.col("duration_sec").alias("timeline_duration_sec"), "hold", F.col("clip_entry").alias("entry_motion"),
    )
    return motion.clip_motion(rows)


def transitions(laid: DataFrame, profiles: DataFrame | None = None, by: str = "project_id") -> DataFrame:
    """Transitions between adjacent filled slots whose relation is not none, with keyframes.

    profiles(project_id, relation, ...) may give measured shapes per project, or per value of another column `by` of `laid`.
    """
    pairs = laid.where(F.col("filled") & (F.col("entry_motion") != "none") & F.coalesce("_prev.filled", F.lit(False)))
    rows = pairs.select(
        "project_id",
        *([by] if by != "project_id" else []),
        F.concat(F.lit("t"), "slot_index").alias("pair_id"),
        F.col("slot_index").alias("seq"),
        F.col("timeline_in_sec").alias("cut_sec"),
        F.concat(F.lit("c"), "_prev.slot_index").alias("outgoing_clip_id"),
        F.concat(F.lit("c"), "slot_index").alias("incoming_clip_id"),
        F.col("entry_motion").alias("relation"),
        F.when(F.col("_prev.clip_exit") != "none", F.col("_prev.clip_exit")).otherwise(F.col("clip_entry")).alias("direction"),
        F.lit(TRANSITION_CONFIDENCE).alias("confidence"),
        F.col("_prev.duration").alias("outgoing_duration_sec"),
        F.col("duration_sec").alias("incoming_duration_sec"),
    )
    fields = ("anticipation_sec", "release_sec", "translation_unit", "overshoot", "attack_fraction", "effect_kind", "usable")
    if profiles is None:
        kinds = "struct<" + ",".join(f"{f}:{'string' if f == 'effect_kind' else 'boolean' if f == 'usable' else 'double'}" for f in fields) + ">"
        rows = rows.withColumn("profile", F.lit(None).cast(kinds))
    else:
        side = profiles.select(by, "relation", F.struct(*fields).alias("profile"))
        rows = rows.join(side, [by, "relation"], "left")
    rows = motion.transition_keyframes(rows)
    return rows if by == "project_id" else rows.drop(by)


def mismatched_lengths(slots: DataFrame, choices: DataFrame) -> DataFrame:
    """Projects whose slot and choice counts differ; such a plan must not be assembled."""
    n = slots.groupBy("project_id").agg(F.count(F.lit(1)).alias("slots"))
    m = choices.groupBy("project_id").agg(F.count(F.lit(1)).alias("choices"))
    both = n.join(m, "project_id", "full").na.fill(0, ["slots", "choices"])
    return both.where(F.col("slots") != F.col("choices"))


def documents(projects: DataFrame, clip_rows: DataFrame, pair_rows: DataFrame) -> DataFrame:
    """One nested document per project as JSON text; its clips and transitions are fields of it."""
    def gather(rows: DataFrame, order: str, name: str) -> DataFrame:
        body = F.struct(F.col(order).alias("_o"), F.struct(*[F.col(c) for c in rows.columns if c not in ("project_id", order, "profile")]).alias("_b"))
        packed = rows.groupBy("project_id").agg(F.array_sort(F.collect_list(body)).alias("_all"))
        return packed.select("project_id", F.transform("_all", lambda x: x["_b"]).alias(name))

    rows = projects.join(gather(clip_rows, "slot_index", "clips"), "project_id", "left")
    rows = rows.join(gather(pair_rows, "seq", "transition_pairs"), "project_id", "left")
    fields = [F.lit(SPEC_VERSION).alias("version"), *[F.col(c) for c in projects.columns], F.col("clips"), F.col("transition_pairs")]
    return rows.select("project_id", F.to_json(F.struct(*fields)).alias("document"))
