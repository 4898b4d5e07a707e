"""Joins on time and keys: nearest, tolerance, overlap, containment, lookup and missing keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelspark.functions.maths import overlap
from reelspark.operators import ordered
from reelspark.session import materialise


def nearest(
    points: DataFrame, events: DataFrame, keys: Sequence[str], sec: str = "sec", carry: Sequence[str] = (),
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Nearest event of the same key for every point: adds `nearest_sec`, `offset_sec` and `carry`.

    Equal distances go to the earlier event. Both sides are merged into one ordered pass, so the
    cost is one sort and no pair is formed. Columns of `carry` come from the chosen event; among
    events at one instant the smallest carried values win.
    """
    keys = list(keys)
    found = F.struct(F.col(sec).alias("sec"), *[F.col(c) for c in carry])
    marks = events.where(F.col(sec).isNotNull()).groupBy(*keys, sec).agg(F.min(found).alias("_event"))
    rows = points.withColumn("_role", F.lit(1)).unionByName(marks.withColumn("_role", F.lit(0)), allowMissingColumns=True)
    rows = ordered.annotate(
        rows,
        keys,
        [sec, "_role"],
        {"_before": ordered.previous(F.col("_event")), "_after": ordered.following(F.col("_event"))},
        rows_per_slice,
    ).where(F.col("_role") == 1)
    back = F.col(sec) - F.col("_before.sec")
    ahead = F.col("_after.sec") - F.col(sec)
    chosen = F.when(ahead.isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    chosen = F.when(back.isNull(), F.col("_after")).otherwise(chosen)
    rows = rows.withColumn("_hit", chosen)
    return rows.select(
        *points.columns,
        F.col("_hit.sec").alias("nearest_sec"),
        (F.col(sec) - F.col("_hit.sec")).alias("offset_sec"),
        *[F.col(f"_hit.{c}").alias(f"nearest_{c}") for c in carry],
    )


def event_label(sec: Column) -> Column:
    """Text form of an instant with three decimals."""
    return F.format_string("%.3f", sec)


def near_any(points: DataFrame, events: DataFrame, keys: Sequence[str], tolerance: Column, flag: str, sec: str = "sec") -> DataFrame:
    """Add a boolean: some event of the key lies within the tolerance of the point."""
    hit = nearest(points, events, keys, sec)
    within = F.coalesce(F.abs(F.col("offset_sec")) <= tolerance, F.lit(False))
    return hit.withColumn(flag, within).drop("nearest_sec", "offset_sec")


def nearest_within(
    points: DataFrame, events: DataFrame, keys: Sequence[str], tolerance: float, carry: Sequence[str] = (), sec: str = "sec"
) -> DataFrame:
    """Nearest event no further than the tolerance, null columns when there is none."""
    hit = nearest(points, events, keys, sec, carry)
    ok = F.abs(F.col("offset_sec")) <= tolerance
    added = ["nearest_sec", "offset_sec", *[f"nearest_{c}" for c in carry]]
    return hit.withColumns({c: F.when(ok, F.col(c)) for c in added})


# How two intervals meet at a level: both at their own, or one of them at the longer one's.
_BOTH, _LEFT_LONGER, _RIGHT_LONGER = 0, 1, 2


def _levels(df: DataFrame, keys: Sequence[str], start: str, end: str, width: float) -> tuple[DataFrame, DataFrame]:
    """Rows with `_own`, the level whose buckets are at least as long as the interval, and each key's levels."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(width))
    rows = df.withColumn("_own", F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(width)))).cast("int"))
    return rows, rows.groupBy(*keys).agg(F.collect_set("_own").alias("_levels"))


def dyadic_copies(rows: DataFrame, other_levels: DataFrame, keys: Sequence[str], start: str, end: str, width: float, longer: int, shorter: int) -> DataFrame:
    """Copies of intervals (with `_own`) for every level of the other side: `_role`, `_level` and bucket `_b`.

    An interval meets those of its own level and shorter ones at its own level, longer ones at each of theirs. A level's
    buckets are as long as its longest interval, so there are two or three copies a level, whatever the lengths.
    """
    own = F.col("_own")

    def at(role: int, level: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), level.alias("level"))

    rows = rows.join(other_levels, list(keys))
    home = F.array(
        F.when(F.array_contains("_levels", own), at(_BOTH, own)), F.when(F.exists("_levels", lambda x: x < own), at(longer, own))
    )
    guest = F.transform(F.filter("_levels", lambda x: x > own), lambda x: at(shorter, x))
    rows = rows.withColumn("_at", F.explode(F.concat(F.array_compact(home), guest))).withColumns({"_role": F.col("_at.role"), "_level": F.col("_at.level")})
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))
    buckets = F.sequence(F.floor(F.col(start) / size), F.floor(F.greatest(F.col(start), F.col(end)) / size))
    return rows.withColumn("_b", F.explode(buckets)).drop("_levels", "_at", "_own")


def overlapping(
    left: DataFrame, right: DataFrame, keys: Sequence[str], width: float,
    start: str = "start_sec", end: str = "end_sec",
) -> DataFrame:
    """Pairs of overlapping half-open intervals of one key, with shared length and ratio to the shorter.

    Both sides are copied into time buckets of `width` seconds times a power of two that fits their length, and joined on
    (key, level, bucket) at the level of the longer one; a pair is kept only in the bucket where the later of the two
    starts, so it appears once. A long interval among short ones is copied a few times per level that occurs, not per
    bucket it covers. Choose the width near the usual length. Right-hand columns get the suffix `_r`.
    """
    keys = list(keys)
    s, e, s_r, e_r = start, end, f"{start}_r", f"{end}_r"
    b = right.select(*keys, *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys])
    a, levels = _levels(left, keys, s, e, width)
    b, levels_r = _levels(b, keys, s_r, e_r, width)
    a = dyadic_copies(a, levels_r, keys, s, e, width, _LEFT_LONGER, _RIGHT_LONGER)
    b = dyadic_copies(b, levels, keys, s_r, e_r, width, _RIGHT_LONGER, _LEFT_LONGER)
    home = F.floor(F.greatest(s, s_r) / (F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))))
    shared = overlap(F.col(s), F.col(e), F.col(s_r), F.col(e_r))
    shortest = F.least(F.col(e) - F.col(s), F.col(e_r) - F.col(s_r))
    return (
        a.join(b, [*keys, "_role", "_level", "_b"])
        .where((F.col("_b") == home) & (shared > 0))
        .drop("_role", "_level", "_b")
        .withColumn("overlap_sec", shared)
        .withColumn("overlap_ratio", F.when(shortest > 0, shared / shortest).otherwise(F.lit(0.0)))
    )


def within_windows(
    windows: DataFrame, points: DataFrame, keys: Sequence[str], width: float, start: str = "start_sec", end: str = "end_sec",
    sec: str = "sec", closed: bool = False, how: str = "inner",
) -> DataFrame:
    """Points inside each window: start <= sec < end (or <= end when `closed`).

    Windows are copied into time buckets of `width` seconds; each point has exactly one bucket, so
    no pair repeats. With `width` at least the window length a window is copied two or three times.
    """
    keys = list(keys)
    first = F.floor(F.col(start) / F.lit(width)).cast("bigint")
    last = F.floor(F.col(end) / F.lit(width)).cast("bigint")
    w = windows.withColumn("_b", F.explode(F.sequence(first, last)))
    p = points.withColumnRenamed(sec, "_sec").withColumn("_b", F.floor(F.col("_sec") / F.lit(width)).cast("bigint"))
    inside = (F.col("_sec") >= F.col(start)) & ((F.col("_sec") <= F.col(end)) if closed else (F.col("_sec") < F.col(end)))
    pairs = w.alias("w").join(p.alias("p"), [*keys, "_b"]).where(inside)
    return pairs.drop("_b").withColumnRenamed("_sec", f"point_{sec}")


def window_totals(
    windows: DataFrame, series: Mapping[str, DataFrame], keys: Sequence[str], start: str = "start_sec", end: str = "end_sec", sec: str = "sec"
) -> DataFrame:
    """Running point counts of several series at both ends of every window.

    For each series the columns <name>_before_start, <name>_upto_start, <name>_before_end and
    <name>_upto_end count the points before, or up to and including, that instant. All series and
    ends go through one ordered pass, so dense keys cost a sort and no pair of point and window.
    """
    keys = list(keys)
    # At an instant "before" is read (0), then points add (1), then "up to" is read (2).
    rows = windows.select(*keys, F.explode(F.array(start, end)).alias("_at")).distinct()
    rows = rows.withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(2))))
    for name, points in series.items():
        marks = points.groupBy(*keys, F.col(sec).alias("_at")).agg(F.count(F.lit(1)).alias(f"_n_{name}"))
        rows = rows.unionByName(marks.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    sums = {f"_t_{n}": ordered.sum_before(F.coalesce(F.col(f"_n_{n}"), F.lit(0))) for n in series}
    rows = ordered.annotate(rows, keys, ["_at", "_turn"], sums).where(F.col("_turn") != 1)
    reads = {"before": 0, "upto": 2}
    read = rows.groupBy(*keys, "_at").agg(
        *[F.max(F.when(F.col("_turn") == t, F.col(f"_t_{n}"))).alias(f"{n}_{word}") for n in series for word, t in reads.items()]
    )
    read = materialise(read, "window-totals")
    out = windows
    for column, suffix in ((start, "start"), (end, "end")):
        names = {f"{n}_{word}": f"{n}_{word}_{suffix}" for n in series for word in reads}
        out = out.join(read.withColumnsRenamed({"_at": column, **names}), [*keys, column], "left")
    return out


def count_in_windows(
    windows: DataFrame, series: Mapping[str, DataFrame], keys: Sequence[str], start: str = "start_sec", end: str = "end_sec",
    sec: str = "sec", closed: bool = False,
) -> DataFrame:
    """Add one count per series: its points with start <= sec < end, or <= end when `closed`."""
    rows = window_totals(windows, series, keys, start, end, sec)
    word = "upto" if closed else "before"
    counts = [(F.col(f"{n}_{word}_end") - F.col(f"{n}_before_start")).alias(n) for n in series]
    return rows.select(*windows.columns, *counts)


def last_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left lookup where a later duplicate on the right wins.

    Keys may include doubles when both sides carry the same stored column.
    """
    stamp = F.struct(*[F.col(c) for c in order])
    newest = right.groupBy(*keys).agg(F.max_by(F.struct(*values), stamp).alias("_v"))
    return left.join(newest, list(keys), "left").select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def missing_keys(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `wanted` without a counterpart."""
    return wanted.join(present.select(*keys), list(keys), "left_anti")


def selected_rows(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in an id list (an IN filter over a table of ids)."""
    return rows.join(ids.select(key), key, "left_semi")


def neighbour_pairs(clips: DataFrame, transitions: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Attach to each clip the transition it leaves through and the one it enters through.

    `transitions` has outgoing_clip_id, incoming_clip_id, seq; a later one replaces an earlier one.
    """
    keys = [*keys, "clip_id"]
    body = F.struct(*[F.col(c) for c in transitions.columns if c not in keys])
    roles = {"outgoing_pair": "outgoing_clip_id", "incoming_pair": "incoming_clip_id"}
    rows = clips.withColumn("_clip", F.lit(True))
    for role, column in roles.items():
        ends = transitions.where(F.col(column).isNotNull()).select(*keys[:-1], F.col(column).alias("clip_id"), body.alias(role)).dropna(subset=keys)
        rows = rows.unionByName(ends, allowMissingColumns=True)
    # Clips and ends meet in a window, not in a join: rows dealt by a part of the keys stay where they are.
    window = Window.partitionBy(*keys)
    last = {role: F.max_by(role, F.col(f"{role}.seq")).over(window) for role in roles}
    return rows.withColumns(last).where("_clip").drop("_clip")


def dealt_matches(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Left join on `keys`, with both sides dealt by one of the keys: one shuffle of each, which later work per `by` can use."""
    keys, n = list(keys), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in right.columns if c not in keys]
    found = right.dropna(subset=keys).repartition(n, by).select(*keys, F.struct(*values).alias("_match"))
    rows = left.repartition(n, by).withColumn("_left", F.lit(True)).unionByName(found, allowMissingColumns=True)
    rows = rows.withColumn("_match", F.collect_list("_match").over(Window.partitionBy(*keys))).where("_left")
    rows = rows.withColumn("_match", F.explode_outer("_match"))
    return rows.select(*left.columns, *[F.col(f"_match.{c}").alias(c) for c in values])


def first_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key in the stated order; the limit is applied before rows are shuffled."""
    return top_rows(df, keys, 1, *order).drop("rank")


def top_rows(df: DataFrame, keys: Sequence[str], limit: int, *order: Column) -> DataFrame:
    """First `limit` rows per key with their 1-based `rank`; Spark prunes to the limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= limit)
