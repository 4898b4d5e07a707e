"""Camera-flow statistics: per-shot vectors, what happens across cuts, and the comparison gate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from reelspark.functions import directions, maths
from reelspark.operators import ordered

# Fixed values of the measurement.
DIRECTIONAL_MIN_MAGNITUDE = 0.45
CARRY_ANGLE_DEG = 60.0
REVERSAL_ANGLE_DEG = 120.0

# Fixed values of the gate: lowest and highest allowed change against the reference measurement.
TOLERANCES = {
    "directional_shot_frac": (-0.15, None),
    "carry_rate": (-0.15, 0.20),
    "reversal_rate": (-0.12, None),
    "direction_entropy": (-0.15, None),
}
MIN_MAGNITUDE_RATIO = 0.65


def sample_shot_flow(shots: DataFrame, flow: DataFrame, samples: int = 3) -> DataFrame:
    """Mean flow of each shot over `samples` frame pairs strictly inside it.

    shots(video_id, index, start_sec, end_sec, fps) and flow(video_id, frame_idx, vx, vy, magnitude).
    """
    length = F.greatest(F.lit(1e-3), F.col("end_sec") - F.col("start_sec"))
    if samples > 1:
        at = F.col("start_sec") + length * (F.lit(0.2) + F.lit(0.6) * F.col("_k") / F.lit(float(samples - 1)))
    else:
        at = F.col("start_sec") + length * 0.5
    picks = (
        shots.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("_at", at)
        .where(F.col("_at") + F.lit(1.0) / F.col("fps") < F.col("end_sec"))
        .withColumn("frame_idx", F.floor(F.col("_at") * F.col("fps") + F.lit(1e-6)).cast("bigint"))
        .select("video_id", "index", "frame_idx")
    )
    means = (
        picks.join(flow, ["video_id", "frame_idx"])
        .groupBy("video_id", "index")
        .agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"), F.avg("magnitude").alias("magnitude"))
    )
    return shots.join(means, ["video_id", "index"], "left").na.fill(0.0, ["vx", "vy", "magnitude"])


def label_shots(shots: DataFrame) -> DataFrame:
    """Add `directional` and the recorded direction label of each measured shot."""
    moving = F.col("magnitude") >= DIRECTIONAL_MIN_MAGNITUDE
    return shots.withColumn("directional", moving).withColumn(
        "direction", F.when(moving, directions.flow_label(F.col("vx"), F.col("vy"))).otherwise(F.lit("static"))
    )


def cut_carry(shots: DataFrame) -> DataFrame:
    """One row per cut: angle between the vectors on its two sides, carried and reversed flags."""
    left = ordered.lag(F.struct("vx", "vy", "directional"))
    rows = ordered.annotate(shots, ["video_id"], ["index"], {"_left": left}).where(F.col("_left").isNotNull())
    both = F.col("_left.directional") & F.col("directional")
    angle = maths.cosine_angle(F.col("_left.vx"), F.col("_left.vy"), F.col("vx"), F.col("vy"))
    rows = rows.withColumn("_angle", F.when(both, angle))
    return rows.select(
        "video_id",
        "index",
        F.col("start_sec").alias("sec"),
        F.round("_angle", 3).alias("angle_delta_deg"),
        F.coalesce(F.col("_angle") <= CARRY_ANGLE_DEG, F.lit(False)).alias("carried"),
        F.coalesce(F.col("_angle") >= REVERSAL_ANGLE_DEG, F.lit(False)).alias("reversed"),
    )


def direction_entropy(shots: DataFrame) -> DataFrame:
    """Shannon entropy of the directional shots' labels over eight bins, scaled to [0, 1]."""
    bins = shots.where("directional").groupBy("video_id", "direction").agg(F.count(F.lit(1)).alias("n"))
    # At most eight rows per video remain here.
    totals = bins.groupBy("video_id").agg(F.sum("n").alias("total"), F.collect_list("n").alias("counts"))
    share = F.transform("counts", lambda n: n / F.col("total"))
    entropy = F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log(p))
    return totals.select("video_id", (entropy / F.lit(math.log(8))).alias("direction_entropy"))


def measure(shots: DataFrame) -> DataFrame:
    """One flow measurement per video from its measured shots (video_id, index, start_sec, vx, vy, magnitude)."""
    labelled = label_shots(shots)
    base = labelled.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("shot_count"),
        maths.ratio_of(F.col("directional")).alias("directional_shot_frac"),
        F.avg(F.abs("vx")).alias("mean_abs_vx"),
    )
    rates = cut_carry(labelled).groupBy("video_id").agg(
        maths.ratio_of(F.col("carried")).alias("carry_rate"), maths.ratio_of(F.col("reversed")).alias("reversal_rate")
    )
    middle = ordered.order_statistics(labelled, ["video_id"], "magnitude", {"median_magnitude": 0.5})
    return (
        base.join(rates, "video_id", "left")
        .join(direction_entropy(labelled), "video_id", "left")
        .join(middle, "video_id", "left")
        .na.fill(0.0, ["carry_rate", "reversal_rate", "direction_entropy", "median_magnitude"])
    )


def compare(subject: DataFrame, reference: DataFrame, on: str = "pair_id") -> DataFrame:
    """Gate each subject measurement against its reference; one row per pair and metric.

    `failure` is null for a metric that holds, otherwise "below", "above" or "ratio".
    """
    s, r = subject.alias("s"), reference.alias("r")
    joined = s.join(r, F.col(f"s.{on}") == F.col(f"r.{on}"))
    rows = []
    for name, (low, high) in TOLERANCES.items():
        delta = F.col(f"s.{name}") - F.col(f"r.{name}")
        failure = F.when(delta < low, "below")
        if high is not None:
            failure = failure.when(delta > high, "above")
        rows.append((name, F.col(f"s.{name}"), F.col(f"r.{name}"), delta, failure))
    want = F.col("r.median_magnitude")
    ratio = F.when(want > 1e-6, F.col("s.median_magnitude") / want).otherwise(F.lit(1.0))
    rows.append(("median_magnitude", F.col("s.median_magnitude"), want, ratio, F.when(ratio < MIN_MAGNITUDE_RATIO, "ratio")))
    packed = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"), got.cast("double").alias("subject"), ref.cast("double").alias("reference"),
                change.alias("change"), fail.cast("string").alias("failure"),
            )
            for n, got, ref, change, fail in rows
        ]
    )
    return joined.select(F.col(f"s.{on}").alias(on), F.inline(packed))


def gate(comparison: DataFrame, on: str = "pair_id") -> DataFrame:
    """Verdict per pair: passed, and the failing metrics in name order (at most five)."""
    failed = F.array_sort(F.collect_list(F.when(F.col("failure").isNotNull(), F.concat_ws(":", "metric", "failure"))))
    return comparison.groupBy(on).agg(F.count("failure").alias("failure_count"), failed.alias("failures")).withColumn(
        "passed", F.col("failure_count") == 0
    )
