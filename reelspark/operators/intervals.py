"""Interval algebra over (start_sec, end_sec) rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from reelspark.operators import joins, ordered


def merge(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of overlapping or touching ranges as disjoint ranges."""
    keys = list(keys)
    rows = ranges.where(F.col("end_sec") > F.col("start_sec")).select(*keys, "start_sec", "end_sec").distinct()
    sliced = ordered.Sliced(rows, keys, ["start_sec", "end_sec"]).annotate({"_reach": ordered.max_before(F.col("end_sec"))})
    fresh = F.when(F.col("_reach").isNull() | (F.col("start_sec") > F.col("_reach")), 1).otherwise(0)
    sliced = sliced.with_columns({"_fresh": fresh}).annotate({"_island": ordered.running_sum(F.col("_fresh"))})
    return sliced.df().groupBy(*keys, "_island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")).drop("_island")


def subtract(observed: DataFrame, allowed: DataFrame, keys: Sequence[str], item: str, width: float = 1.0) -> DataFrame:
    """Parts of each observed range outside every allowed range.

    `item` numbers the observed ranges within a key. `width` is the finest time bucket of the overlap join.
    """
    keys = list(keys)
    by = [*keys, item]
    obs = observed.select(*by, "start_sec", "end_sec")
    cover = joins.overlapping(obs, merge(allowed, keys), keys, width)
    pieces = cover.select(
        *by, F.col("start_sec").alias("_begin"), F.greatest("start_sec", "start_sec_r").alias("_s"), F.least("end_sec", "end_sec_r").alias("_e"), F.lit(0).alias("_tail")
    )
    tails = obs.select(*by, F.col("start_sec").alias("_begin"), F.col("end_sec").alias("_s"), F.col("end_sec").alias("_e"), F.lit(1).alias("_tail"))
    rows = ordered.annotate(pieces.unionByName(tails), by, ["_s", "_tail"], {"_done": ordered.lag(F.col("_e"))})
    start = F.coalesce("_done", "_begin")
    return rows.where(F.col("_s") > start).select(*by, start.alias("start_sec"), F.col("_s").alias("end_sec"))
