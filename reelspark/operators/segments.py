"""Ranking of musically editable windows, and the overlap-suppressed choice among them."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reelspark.functions import maths
from reelspark.operators import folds, joins, ordered
from reelspark.session import materialise

KEY = ["track_id"]
MAX_OVERLAP = 0.65
SLICE_WINDOWS = 16


def anchor_points(downbeats: DataFrame, bars: DataFrame, beats: DataFrame | None = None) -> DataFrame:
    """Downbeats of each track, bars of a track without downbeats, beats of a track without either."""
    out = downbeats.select(*KEY, "sec")
    for other in (bars, beats):
        if other is not None:
            out = out.unionByName(other.select(*KEY, "sec").join(out.select(*KEY).distinct(), KEY, "left_anti"))
    return out.distinct()


class MovingGaps:
    """Gaps in a moving window: their median, and how far they lie from it on average.

    Counts and sums of the gaps by rank, in a binary indexed tree, so that a gap comes, goes or is looked up in
    as many steps as the number of ranks has bits.
    """

    def __init__(self, gaps: np.ndarray):
        order = np.argsort(gaps, kind="stable")
        self.rank = np.empty(len(gaps), np.int64)
        self.rank[order] = np.arange(1, len(gaps) + 1)
        self.rank, self.gaps, self.by_rank = self.rank.tolist(), gaps.tolist(), gaps[order].tolist()
        self.counts, self.sums = [0] * (len(gaps) + 1), [0.0] * (len(gaps) + 1)
        self.n, self.top = 0, 1 << max(0, len(gaps).bit_length() - 1)

    def change(self, i: int, by: int) -> None:
        """Gap i comes (1) or goes (-1)."""
        at, amount = self.rank[i], by * self.gaps[i]
        self.n += by
        while at < len(self.counts):
            self.counts[at] += by
            self.sums[at] += amount
            at += at & -at

    def smallest(self, k: int) -> tuple[float, float]:
        """The k-th smallest gap (from zero), and the sum of those below it."""
        at, step, below = 0, self.top, 0.0
        while step:
            if at + step < len(self.counts) and self.counts[at + step] <= k:
                at += step
                k -= self.counts[at]
                below += self.sums[at]
            step >>= 1
        return self.by_rank[at], below

    def facts(self) -> tuple[float | None, float | None]:
        """Median, and mean distance to it; none without gaps."""
        if not self.n:
            return None, None
        k = (self.n - 1) // 2
        low, below = self.smallest(k)
        high = low if self.n % 2 else self.smallest(k + 1)[0]
        center = low + (high - low) * 0.5
        lower = below + low
        total, at = 0.0, len(self.counts) - 1
        while at:
            total += self.sums[at]
            at -= at & -at
        return center, (center * (k + 1) - lower + (total - lower) - center * (self.n - k - 1)) / self.n


def _shared(starts: np.ndarray, duration_sec: float, begins: np.ndarray, stops: np.ndarray, values: np.ndarray) -> list[list]:
    """Per window: seconds shared with intervals, those times their value, and the smallest and largest value."""
    order = np.argsort(begins, kind="stable")
    ahead = list(zip(begins[order].tolist(), stops[order].tolist(), values[order].tolist()))[::-1]
    open_: list[tuple[float, float, float]] = []
    out: list[list] = [[], [], [], []]
    for a in starts.tolist():
        b = a + duration_sec
        while ahead and ahead[-1][0] < b:
            open_.append(ahead.pop())
        open_ = [i for i in open_ if i[1] > a]
        parts = [(min(e, b) - max(s, a), v) for s, e, v in open_ if min(e, b) > max(s, a)]
        out[0].append(math.fsum(x for x, _ in parts) if parts else None)
        out[1].append(math.fsum(x * v for x, v in parts) if parts else None)
        out[2].append(min((v for _, v in parts), default=None))
        out[3].append(max((v for _, v in parts), default=None))
    return out


def _slice_facts(at: np.ndarray, stop: np.ndarray, value: np.ndarray, kind: np.ndarray, duration_sec: float, series: int, spans: int) -> tuple[list, ...]:
    """Facts of the windows of one slice (kind 0, by their start) over its beats (1), the series and the spans (2 and on)."""
    starts, beats = np.sort(at[kind == 0]), np.sort(at[kind == 1])
    ends = starts + duration_sec
    low, high = np.searchsorted(beats, starts), np.searchsorted(beats, ends)
    gaps = np.diff(beats, prepend=np.nan)
    moving = MovingGaps(np.where(gaps > 0, gaps, 0.0))
    counted = (gaps > 0).tolist()
    first, last, center, error = 1, 1, [], []
    # The gap of a beat lies inside if the beat before it does.
    for a, b in zip((low + 1).tolist(), high.tolist()):
        for i in range(last, b):
            if counted[i]:
                moving.change(i, 1)
        last = max(last, b)
        for i in range(first, min(a, last)):
            if counted[i]:
                moving.change(i, -1)
        first = max(first, a)
        if first > last:
            last = first
        c, e = moving.facts()
        center.append(c)
        error.append(e)
    final = [float(beats[b - 1]) if b > a else None for a, b in zip(low.tolist(), high.tolist())]
    counts = []
    for which in range(series):
        points = np.sort(at[kind == 2 + which])
        counts.append(np.searchsorted(points, ends) - np.searchsorted(points, starts))
    shared = []
    for which in range(series, series + spans):
        mine = kind == 2 + which
        shared += _shared(starts, duration_sec, at[mine], stop[mine], value[mine])
    return starts, high - low, final, center, error, *counts, *shared


def moving_facts(
    windows: DataFrame, beats: DataFrame, series: Mapping[str, DataFrame], duration_sec: float, spans: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Facts of windows of one length: beat_count, _last_beat, _center and _error of the beat gaps, counts of series, and
    what they share with spans (start_sec, end_sec, value): <name>_sec, <name>_weighted, <name>_low and <name>_high.

    A track is cut into slices of SLICE_WINDOWS window lengths. A beat or point is copied to its slice and, near its
    start, to the one before, where windows reach over, a span to those it touches; no pair of window and beat is
    written. `_center` is the median of the gaps between beats inside the window and `_error` the mean distance to it; null
    without gaps, as are the facts of spans without any.
    """
    spans = spans or {}
    size = duration_sec * SLICE_WINDOWS
    slice_of = lambda x: F.floor(x / F.lit(size)).cast("long")
    nothing = F.lit(None).cast("double")

    def placed(rows: DataFrame, kind: int, start: str, slices: Column, stop: Column = nothing, value: Column = nothing) -> DataFrame:
        return rows.select(*KEY, slices.alias("_slice"), F.lit(kind).alias("_kind"), F.col(start).cast("double").alias("_at"), stop.cast("double").alias("_stop"), value.cast("double").alias("_value"))

    rows = placed(windows, 0, "start_sec", slice_of(F.col("start_sec")))
    for kind, points in enumerate((beats, *series.values()), 1):
        near = F.sequence(slice_of(F.col("sec") - duration_sec), slice_of(F.col("sec")))
        rows = rows.unionByName(placed(points.where("sec is not null"), kind, "sec", F.explode(near)))
    for kind, ranges in enumerate(spans.values(), 2 + len(series)):
        near = F.sequence(slice_of(F.col("start_sec") - duration_sec), slice_of(F.col("end_sec")))
        rows = rows.unionByName(placed(ranges.where("end_sec > start_sec"), kind, "start_sec", F.explode(near), F.col("end_sec"), F.col("value")))
    fields = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    n_series, n_spans = len(series), len(spans)
    keys = ", ".join(f"{c} {fields[c]}" for c in KEY)
    told = ["start_sec double", "beat_count long", "_last_beat double", "_center double", "_error double", *(f"{c} long" for c in series)]
    told += [f"{c}_{part} double" for c in spans for part in ("sec", "weighted", "low", "high")]
    names = [t.split()[0] for t in told]
    kinds = [pa.int64() if t.endswith("long") else pa.float64() for t in told]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in folds.whole_groups(batches, [*KEY, "_slice"]):
            at, stop, value, kind = (table[c].to_numpy() for c in ("_at", "_stop", "_value", "_kind"))
            if not (kind == 0).any():
                continue
            columns = _slice_facts(at, stop, value, kind, duration_sec, n_series, n_spans)
            named = [table[c].take(pa.array([0] * len(columns[0]))).combine_chunks() for c in KEY]
            yield pa.record_batch([*named, *(pa.array(v, k) for v, k in zip(columns, kinds))], [*KEY, *names])

    facts = rows.repartition(*KEY, "_slice").sortWithinPartitions(*KEY, "_slice").mapInArrow(step, ", ".join([keys, *told]))
    return facts.withColumn("end_sec", F.col("start_sec") + F.lit(duration_sec))


def score_windows(
    tracks: DataFrame, beats: DataFrame, downbeats: DataFrame, bars: DataFrame, onsets: DataFrame, impacts: DataFrame,
    sections: DataFrame, silences: DataFrame, duration_sec: float,
) -> DataFrame:
    """Score every window of a fixed length that starts at zero or at an anchor.

    sections carry `energy`; tracks shorter than the window have no candidates.
    """
    d = F.lit(float(duration_sec))
    fits = tracks.where(F.col("duration_sec") >= d).select(*KEY, "duration_sec")
    starts = ordered.attach(anchor_points(downbeats, bars, beats), fits, KEY, "sec", "inner")
    starts = starts.where((F.col("sec") >= 0) & (F.col("sec") <= F.col("duration_sec") - d)).select(*KEY, "sec")
    starts = starts.union(fits.select(*KEY, F.lit(0.0))).distinct()
    windows = materialise(starts.select(*KEY, F.col("sec").alias("start_sec"), (F.col("sec") + d).alias("end_sec")))

    by = [*KEY, "start_sec"]
    spans = {
        "loud": sections.select(*KEY, "start_sec", "end_sec", F.col("energy").alias("value")),
        "quiet": silences.select(*KEY, "start_sec", "end_sec", F.lit(0.0).alias("value")),
    }
    rows = moving_facts(windows, beats, {"onset_count": onsets, "impact_count": impacts}, float(duration_sec), spans)

    named = anchor_points(downbeats, bars)
    ends = joins.nearest(windows.withColumnRenamed("end_sec", "sec"), named, KEY)
    ends = ends.select(*KEY, "start_sec", F.abs("offset_sec").alias("_end_gap"))

    rows = rows.join(ends, by, "left").withColumns(
        {
            "energy": F.coalesce(F.col("loud_weighted") / F.nullif(F.col("loud_sec"), F.lit(0.0)), F.lit(0.0)),
            "dynamic_arc": F.coalesce(F.least(F.lit(1.0), F.col("loud_high") - F.col("loud_low") + 0.35), F.lit(0.0)),
            "_silent": F.coalesce("quiet_sec", F.lit(0.0)),
        }
    )
    center = F.col("_center")
    period = F.coalesce(center, F.lit(0.5))
    nearest_end = F.coalesce(F.col("_end_gap"), F.col("end_sec") - F.col("_last_beat"), d)
    left_over = F.pmod("beat_count", F.lit(8))
    phrase = F.when(F.col("beat_count") > 0, F.lit(1.0) - F.least(left_over, F.lit(8) - left_over) / 8.0).otherwise(F.lit(0.0))
    fit = F.greatest(F.lit(0.0), F.lit(1.0) - nearest_end / F.greatest(period, F.lit(1e-6)))
    rows = rows.withColumns(
        {
            "local_bpm": F.coalesce(F.lit(60.0) / center, F.lit(0.0)),
            "beat_clarity": F.coalesce(maths.clamp(F.lit(1.0) - F.col("_error") / F.greatest(center, F.lit(1e-6))), F.lit(0.0)),
            "phrase_clarity": maths.clamp(fit * 0.65 + phrase * 0.35),
            "onset_variety": F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("onset_count") / d - 3.2) / 3.2),
            "silence_penalty": F.least(F.lit(1.0), F.col("_silent") / F.greatest(d * 0.12, F.lit(1e-6))),
            "_impact": F.least(F.lit(1.0), F.col("impact_count") / F.greatest(F.lit(2.0), d / 4.0)),
        }
    )
    score = (
        F.col("beat_clarity") * 0.25 + F.col("phrase_clarity") * 0.22 + F.col("onset_variety") * 0.14 + F.col("energy") * 0.16
        + F.col("dynamic_arc") * 0.10 + F.col("_impact") * 0.13 - F.col("silence_penalty") * 0.18
    )
    return rows.select(
        *KEY, "start_sec", "end_sec", "local_bpm", "beat_count", "impact_count", "beat_clarity", "phrase_clarity",
        "onset_variety", "energy", "dynamic_arc", "silence_penalty", maths.clamp(score).alias("score"),
    )


UNDECIDED, KEPT = 0, 1


def _resolve(starts: list[float], scores: list[float], states: list[int], inner: list[bool], duration_sec: float) -> list[int | None]:
    """States of one slice's rows after all that can be decided here: KEPT, UNDECIDED, or None for suppressed.

    Best rows first: a row goes if it overlaps a kept one too much, stays if all better ones it overlaps are gone,
    and waits if one of those waits or its surroundings lie outside the slice.
    """

    def clashes(some: list[float], at: float) -> bool:
        first = bisect.bisect_left(some, at - duration_sec)
        last = bisect.bisect_right(some, at + duration_sec)
        return any(max(0.0, min(at, s) + duration_sec - max(at, s)) > duration_sec * MAX_OVERLAP for s in some[first:last])

    kept = sorted(s for s, state in zip(starts, states) if state == KEPT)
    waiting: list[float] = []
    out: list[int | None] = list(states)
    for i in sorted((i for i, state in enumerate(states) if state == UNDECIDED), key=lambda i: (-scores[i], starts[i])):
        if clashes(kept, starts[i]):
            out[i] = None
        elif not inner[i] or clashes(waiting, starts[i]):
            bisect.insort(waiting, starts[i])
        else:
            out[i] = KEPT
            bisect.insort(kept, starts[i])
    return out


def suppressed_top(
    rows: DataFrame, keys: list[str], duration_sec: float, limit: int, score: str = "score", start: str = "start_sec"
) -> DataFrame:
    """Greedy best rows per key: highest score first, skipping one that overlaps a kept one too much.

    What is kept does not depend on the limit, so it is decided for all rows, in rounds over slices of time that see
    a window length beyond their borders. A round settles every row whose better neighbours are settled; only chains of
    ever better rows across borders wait for the next one. Rows without a score take no part.
    """
    if not 1 <= limit <= 20:
        raise ValueError("limit must be within 1..20")
    size = duration_sec * SLICE_WINDOWS
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in keys) + ", _score double, _start double, _state int"
    at, own = F.col("_start"), F.floor(F.col("_start") / F.lit(size)).cast("long")
    near = F.sequence(F.floor((at - duration_sec) / F.lit(size)).cast("long"), F.floor((at + duration_sec) / F.lit(size)).cast("long"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in folds.whole_groups(batches, [*keys, "_slice"]):
            inner = table["_inner"].to_pylist()
            states = _resolve(table["_start"].to_pylist(), table["_score"].to_pylist(), table["_state"].to_pylist(), inner, duration_sec)
            mine = [i for i, state in enumerate(states) if state is not None and inner[i]]
            told = table.take(pa.array(mine, pa.int64())).select([*keys, "_score", "_start"])
            told = told.append_column("_state", pa.array([states[i] for i in mine], pa.int32())).combine_chunks()
            yield from told.to_batches()

    left = rows.select(*keys, F.col(score).cast("double").alias("_score"), F.col(start).cast("double").alias("_start"), F.lit(UNDECIDED).alias("_state"))
    left = left.where("_score is not null and _start is not null")
    while True:
        placed = left.withColumn("_slice", F.explode(near)).withColumn("_inner", F.col("_slice") == own)
        left = materialise(placed.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice").mapInArrow(step, schema), "suppressed")
        if left.where(F.col("_state") == UNDECIDED).isEmpty():
            break
    best = joins.top_rows(left, keys, limit, F.desc("_score"), F.asc("_start"))
    return best.select(*keys, "rank", F.col("_start").cast(fields[start]).alias(start))


def rank_segments(scored: DataFrame, duration_sec: float, limit: int = 3) -> DataFrame:
    """Scored windows that survive overlap suppression, with their rank."""
    chosen = suppressed_top(scored, KEY, float(duration_sec), limit)
    return scored.join(chosen, [*KEY, "start_sec"])
