"""Placement of clips on a timeline in whole frames, and the audit of their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelspark.functions import timecode as tc
from reelspark.operators import ordered


def place_clips(clips: DataFrame, origin_frames: int = 86400) -> DataFrame:
    """Source range and record frame of every clip.

    clips(project_id, clip_index, source_in_sec, source_out_sec, timeline_in_sec,
    timeline_duration_sec, src_num, src_den, tl_num, tl_den). The timeline duration decides the
    source frame count; without one the source duration does. `end_frame` is exclusive.
    """
    src, tl = (F.col("src_num"), F.col("src_den")), (F.col("tl_num"), F.col("tl_den"))
    timeline = tc.duration_frames(F.col("timeline_in_sec"), F.col("timeline_duration_sec"), *tl)
    own = tc.duration_frames(F.col("source_in_sec"), F.col("source_out_sec") - F.col("source_in_sec"), *src)
    count = F.when(F.col("timeline_duration_sec").isNotNull(), tc.rebased_duration(timeline, *src, *tl)).otherwise(own)
    start = tc.to_frames(F.col("source_in_sec"), *src)
    return clips.withColumns(
        {
            "start_frame": start,
            "end_frame": start + count,
            "record_frame": F.lit(origin_frames) + tc.to_frames(F.col("timeline_in_sec"), *tl),
            "timeline_frames": timeline,
        }
    )


def audit_joins(placed: DataFrame) -> DataFrame:
    """Frames between each clip's end and the next clip's record frame: positive gap, negative overlap."""
    rows = ordered.annotate(
        placed, ["project_id"], ["record_frame", "clip_index"], {"next_record": ordered.lead(F.col("record_frame"))}
    )
    return rows.where(F.col("next_record").isNotNull()).withColumn(
        "gap_frames", F.col("next_record") - F.col("record_frame") - F.col("timeline_frames")
    )
