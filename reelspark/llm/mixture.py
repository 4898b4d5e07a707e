"""Mixing shots of several series to target weights by weighted fair queueing. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelspark.session import materialise

WEIGHT_CYCLE = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
# Slices of a series in shuffled order: running sums go per slice, so no series is one task's work.
SLICES = 4096


def cycled_weights(totals: DataFrame, cycle: Sequence[int] = WEIGHT_CYCLE) -> DataFrame:
    """Weights for the series of `totals` (one row each): the cycle repeated in code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("series").asc_nulls_last())) - 1
    return totals.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), (place % len(cycle) + 1).cast("int")))


def water_levels(totals: DataFrame, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """Target of each series: its weight's part of `share` times all frames, at most `passes` times its own.

    What full series cannot take goes to the others by weight. Series fill up in the order of capacity
    by weight; the level that the rest shares is the largest of the levels that hold after each step.
    """
    capacity = (F.col("series_frames") * passes).alias("_capacity")
    rows = totals.select("series", "series_frames", "weight", capacity)
    order = Window.orderBy(F.col("_capacity") / F.col("weight"), F.col("series").asc_nulls_last())
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("_capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(float(share)) * F.sum("series_frames").over(everything)
    rows = rows.withColumn("_level", (budget - full.cast("double")) / open_weight.cast("double"))
    rows = rows.withColumn("_level", F.max("_level").over(everything))
    return rows.select("series", "series_frames", "weight", F.least(F.col("_capacity").cast("double"), F.col("weight") * F.col("_level")).alias("target"))


def shuffled(shot_id: Column, seed: int) -> Column:
    """Hexadecimal key that puts shots in a random order, the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), shot_id.cast("string")))


def mix_series(
    shots: DataFrame, cycle: Sequence[int] = WEIGHT_CYCLE, share: float = SHARE, passes: int = MOST_PASSES, budget: float | None = None, seed: int = 0
) -> DataFrame:
    """Frames to take of every shot so that the series meet their target weights.

    shots: shot_id (long), series (text), frames (long). Other columns are ignored. Each series serves
    its shots in a random order, up to `passes` times over. A shot's virtual finish time is the frames
    its series has served by then divided by the series' target. All shots are put in the order of their
    finish time and the queue is cut where the total budget is spent: at virtual time
    budget / sum of targets, which is 1 unless a smaller budget is given. The shot in service at the cut
    is taken in part.

    Returns, range-sorted by finish_time: shot_id, series, frames, series_frames, target, taken (frames
    taken, all passes) and finish_time (of the first pass; null where the target is zero). Null or
    negative frames count as zero. A null series is a series of its own, last in order. Shots without
    frames stay in the result with nothing taken. Repeated rows are shots of their own. Ties in the
    random order go by shot_id, then frames. An empty table gives an empty result.
    """
    frames = F.greatest(F.coalesce(F.col("frames").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    rows = materialise(shots.select(F.col("shot_id").cast("long").alias("shot_id"), "series", frames.alias("frames")), "sized")
    rows = rows.withColumn("_key", shuffled(F.col("shot_id"), seed))
    rows = rows.withColumn("_slice", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % SLICES).cast("int"))
    rows = rows.withColumn("_series", F.struct("series"))  # a struct that holds null still equals itself
    parts = materialise(rows.groupBy("_series", "_slice").agg(F.sum("frames").alias("_frames")), "slices")
    totals = parts.groupBy("_series").agg(F.sum("_frames").alias("series_frames"))
    targets = water_levels(cycled_weights(totals.select(F.col("_series.series").alias("series"), "series_frames"), cycle), share, passes)
    targets = materialise(targets.withColumn("_series", F.struct("series")).drop("series"), "targets")
    before = F.coalesce(F.sum("_frames").over(Window.partitionBy("_series").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_series", "_slice", before.alias("_before")).join(targets, "_series")
    cut = 1.0
    if budget is not None:
        whole = targets.agg(F.sum("target")).first()[0] or 0.0
        cut = min(1.0, float(budget) / whole) if whole else 0.0
    starts = starts.withColumn("_limit", F.floor(F.col("target") * F.lit(cut)).cast("long"))

    queue = Window.partitionBy("_series", "_slice").orderBy("_key", "shot_id", "frames").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_running", F.sum("frames").over(queue)).join(starts, ["_series", "_slice"])
    served = F.col("_before") + F.col("_running")
    taken = F.lit(0).cast("long")
    for turn in range(passes):
        begun = served - F.col("frames") + F.col("series_frames") * turn
        taken = taken + F.least(F.col("frames"), F.greatest(F.lit(0).cast("long"), F.col("_limit") - begun))
    out = rows.select(
        "shot_id", "series", "frames", "series_frames", "target", taken.alias("taken"),
        F.when(F.col("target") > 0, served.cast("double") / F.col("target")).alias("finish_time"),
    )
    return out.orderBy("finish_time", "shot_id")
