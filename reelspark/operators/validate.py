"""Integrity checks that return violations as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reelspark.operators import ordered

SHOT_BOUNDS_EPS = 1e-3


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def dangling_pairs(pairs: DataFrame, clips: DataFrame) -> DataFrame:
    """Transitions that name a clip the project does not have; one row per missing side."""
    sides = pairs.select(
        "project_id", "pair_id",
        F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_clip_id").alias("clip_id")) for s in ("outgoing", "incoming")])).alias("_s"),
    )
    return sides.select("project_id", "pair_id", "_s.side", "_s.clip_id").join(clips.select("project_id", "clip_id"), ["project_id", "clip_id"], "left_anti")


def source_outside_shot(choices: DataFrame, shots: DataFrame) -> DataFrame:
    """Choices whose source range leaves its shot by more than a millisecond, or whose shot is unknown."""
    bounds = shots.select("shot_id", F.col("start_sec").alias("shot_start"), F.col("end_sec").alias("shot_end"))
    rows = choices.join(bounds, "shot_id", "left")
    outside = (F.col("in_sec") < F.col("shot_start") - SHOT_BOUNDS_EPS) | (F.col("out_sec") > F.col("shot_end") + SHOT_BOUNDS_EPS)
    problem = F.when(F.col("shot_start").isNull(), "unknown_shot").when(outside, "outside_shot")
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull())


def in_range(column: str, low: float | None = None, high: float | None = None) -> Column:
    """True when a column is within closed bounds; null passes only where the column may be null."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(column) >= low)
    if high is not None:
        ok = ok & (F.col(column) <= high)
    return ok


def violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Rows of `df` against named rules: one output row per broken rule. A null verdict breaks a rule."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def unsorted_series(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """Rows whose value is below the one before it in index order."""
    rows = ordered.annotate(df, keys, [index], {"_prior": ordered.lag(F.col(value))})
    return rows.where(F.col(value) < F.col("_prior")).drop("_prior")


def index_gaps(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Rows whose index is not their place within the key, counted from zero."""
    rows = ordered.annotate(df, keys, [index], {"expected": ordered.position()})
    return rows.where(F.col(index) != F.col("expected"))
