"""Music time series: normalised energy, ranges, sections, accents and motion accents.

audio(track_id, i, sec, rms, onset_strength, centroid) holds one row per analysis frame with a
dense index; beats and other events are (track_id, sec, ...) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelspark.functions import maths
from reelspark.operators import folds, joins, ordered
from reelspark.session import materialise

KEY = ["track_id"]


def normalise(df: DataFrame, value: str, out: str, index: str = "i") -> DataFrame:
    """Scale between the 5th and 95th percentile of each track, clipped to [0, 1]."""
    ends = ordered.order_statistics(df, KEY, value, {"_p05": 0.05, "_p95": 0.95})
    rows = ordered.attach(df, ends, KEY, index)
    scaled = (F.col(value) - F.col("_p05")) / F.greatest(F.col("_p95") - F.col("_p05"), F.lit(1e-8))
    return rows.withColumn(out, maths.clamp(scaled)).drop("_p05", "_p95")


def active_ranges(df: DataFrame, active: Column, minimum_sec: float, index: str = "i") -> DataFrame:
    """Maximal runs of active frames of at least a length.

    A run ends at the first inactive frame after it, or at the last frame of the track.
    """
    rows = df.select(*KEY, index, "sec", F.coalesce(active, F.lit(False)).alias("_on"))
    rows = ordered.with_halo(
        rows, KEY, index, 1, 1,
        lambda w: {"_was": F.lag("_on", 1, False).over(w), "_will": F.lead("_on", 1, False).over(w), "_next": F.lead("sec").over(w)},
    )
    starts, tails = F.col("_on") & ~F.col("_was"), F.col("_on") & ~F.col("_will")
    edges = rows.where(starts | tails).withColumns(
        {"_first": starts, "_stop": F.when(tails, F.coalesce("_next", F.col("sec")))}
    )
    edges = ordered.annotate(edges, KEY, [index], {"_later": ordered.following(F.col("_stop"))}).where("_first")
    end = F.coalesce("_stop", "_later")
    return edges.where(end - F.col("sec") >= minimum_sec).select(*KEY, F.col("sec").alias("start_sec"), end.alias("end_sec"))


def smoothed_slope(df: DataFrame, value: str = "energy", index: str = "i") -> DataFrame:
    """Gradient of the 12-frame box mean (six frames back, five ahead, zero beyond the ends)."""

    def smooth(w):
        return {"_smooth": F.sum(value).over(w.rowsBetween(-6, 5)) / 12.0}

    return ordered.with_halo(df, KEY, index, 7, 6, smooth, lambda w: {"slope": gradient(F.col("_smooth"), w)}).drop("_smooth")


def gradient(value: Column, window) -> Column:
    """Central difference over neighbouring rows, one-sided at the ends, null for a single row."""
    back, ahead = F.lag(value).over(window), F.lead(value).over(window)
    return F.when(back.isNull(), ahead - value).when(ahead.isNull(), value - back).otherwise((ahead - back) / 2.0)


def risers(audio: DataFrame) -> DataFrame:
    """Ranges where the smoothed slope exceeds its 78th percentile for a quarter second."""
    # Read twice: for the percentile and for the ranges.
    rows = materialise(smoothed_slope(audio).select(*KEY, "i", "sec", "slope"), "slope")
    bar = ordered.order_statistics(rows, KEY, "slope", {"_bar": 0.78})
    return active_ranges(ordered.attach(rows, bar, KEY, "i"), F.col("slope") > F.col("_bar"), 0.25)


def silences(audio: DataFrame) -> DataFrame:
    bar = ordered.order_statistics(audio, KEY, "rms", {"_p12": 0.12})
    limit = F.greatest(F.lit(0.01), F.col("_p12") * 0.7)
    return active_ranges(ordered.attach(audio, bar, KEY, "i"), F.col("rms") <= limit, 0.07)


def breaks(audio: DataFrame) -> DataFrame:
    return active_ranges(audio, F.col("energy") <= 0.18, 0.35)


def thin_boundaries(boundaries: DataFrame, minimum_gap: float = 0.35) -> DataFrame:
    """Distinct boundaries whose distance to the one before (kept or not) is at least a gap."""
    rows = ordered.annotate(boundaries.select(*KEY, "sec").distinct(), KEY, ["sec"], {"_prior": ordered.lag(F.col("sec"))})
    return rows.where(F.col("_prior").isNull() | (F.col("sec") - F.col("_prior") >= minimum_gap)).drop("_prior")


def intervals_between(boundaries: DataFrame) -> DataFrame:
    """Consecutive boundaries as (start_sec, end_sec, index)."""
    rows = ordered.annotate(boundaries, KEY, ["sec"], {"end_sec": ordered.lead(F.col("sec")), "index": ordered.position()})
    return rows.where(F.col("end_sec").isNotNull()).select(*KEY, "index", F.col("sec").alias("start_sec"), "end_sec")


def interval_means(intervals: DataFrame, points: DataFrame, value: str, out: str) -> DataFrame:
    """Mean of `value` over the points with start <= sec < end of disjoint intervals, zero when none."""
    marks = intervals.select(*KEY, F.col("start_sec").alias("sec"), F.struct("index", "end_sec").alias("_in")).withColumn("_role", F.lit(0))
    rows = points.select(*KEY, "sec", value).withColumn("_role", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    rows = ordered.annotate(rows, KEY, ["sec", "_role"], {"_own": ordered.previous(F.col("_in"))})
    rows = rows.where((F.col("_role") == 1) & (F.col("sec") < F.col("_own.end_sec")))
    means = rows.groupBy(*KEY, F.col("_own.index").alias("index")).agg(F.avg(value).alias(out))
    return intervals.join(means, [*KEY, "index"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def label_sections(intervals: DataFrame, audio: DataFrame) -> DataFrame:
    """Sections with mean energy and a label decided by ordered rules against the section before."""
    rows = interval_means(intervals, audio, "energy", "energy")
    rows = ordered.annotate(
        rows, KEY, ["index"], {"_prior": ordered.lag(F.col("energy")), "_next": ordered.lead(F.col("index"))}
    )
    e, gain = F.col("energy"), F.col("energy") - F.coalesce("_prior", "energy")
    label = (
        F.when(F.col("index") == 0, "intro")
        .when((e >= 0.72) & (gain >= 0.12), "drop")
        .when(e <= 0.2, "break")
        .when(gain >= 0.08, "build")
        .when(F.col("_next").isNull(), "outro")
        .when(-gain >= 0.1, "release")
        .otherwise("verse")
    )
    return rows.withColumn("label", label).drop("_prior", "_next")


def impact_points(onsets: DataFrame, strength: str = "onset_strength") -> DataFrame:
    """Onsets at or above the 82nd percentile of their track's onset strengths."""
    bar = ordered.order_statistics(onsets, KEY, strength, {"_bar": 0.82})
    return ordered.attach(onsets, bar, KEY, "sec").where(F.col(strength) >= F.col("_bar")).drop("_bar")


def beat_energy(beats: DataFrame, audio: DataFrame) -> DataFrame:
    """Energy of the frame of each beat (beats carry `frame`), the last frame beyond the end."""
    last = audio.groupBy(*KEY).agg(F.max("i").alias("_last"))
    at = ordered.attach(beats, last, KEY, "sec").withColumn("i", F.least("frame", "_last"))
    return at.join(audio.select(*KEY, "i", "energy"), [*KEY, "i"], "left").drop("_last", "i")


def bars(beats: DataFrame, every: int = 4) -> DataFrame:
    """Every fourth beat, starting with the first."""
    rows = ordered.annotate(beats, KEY, ["sec"], {"_k": ordered.position()})
    return rows.where(F.pmod("_k", F.lit(every)) == 0).withColumn("bar", (F.col("_k") / every).cast("bigint")).drop("_k")


def spectral_peaks(audio: DataFrame, wait: int = 5) -> DataFrame:
    """Frames where the spectrum changes most.

    The change is the absolute gradient of the normalised centroid. A peak is the maximum of frames
    -3..+2, reaches the mean of frames -6..+5 plus the 96th percentile, and lies more than `wait`
    frames after the peak kept before it.
    """
    rows = normalise(audio, "centroid", "_c")

    def change(w):
        return {"delta": F.coalesce(F.abs(gradient(F.col("_c"), w)), F.lit(0.0))}

    rows = ordered.with_halo(rows, KEY, "i", 1, 1, change)
    # Read twice: for the percentile and for the peaks.
    rows = materialise(rows.select(*KEY, "i", "sec", "delta"), "spectral-delta")
    bar = ordered.order_statistics(rows, KEY, "delta", {"_bar": 0.96})

    def peak(w):
        return {"_max": F.max("delta").over(w.rowsBetween(-3, 2)), "_mean": F.avg("delta").over(w.rowsBetween(-6, 5))}

    rows = ordered.with_halo(ordered.attach(rows, bar, KEY, "i"), KEY, "i", 6, 5, peak)
    found = rows.where((F.col("delta") == F.col("_max")) & (F.col("delta") >= F.col("_mean") + F.col("_bar")))
    return folds.keep_by_rule(found.select(*KEY, "i", "sec", "delta"), KEY, "i", ["i"], folds.spaced(wait))


def tempo_confidence(tracks: DataFrame, beats: DataFrame) -> DataFrame:
    """Steadiness of the beat gaps, between .2 and .95; .2 without tempo or with under four beats."""
    gaps = ordered.annotate(beats, KEY, ["sec"], {"_prior": ordered.lag(F.col("sec"))})
    gaps = gaps.withColumn("_gap", F.col("sec") - F.col("_prior"))
    agg = gaps.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_gap").alias("_mean"), F.stddev_pop("_gap").alias("_sd")
    )
    steady = maths.clamp(F.lit(1.0) - F.least(F.lit(1.0), F.col("_sd") / F.col("_mean")), 0.2, 0.95)
    value = (
        F.when((F.col("bpm") <= 0) | (F.coalesce("_n", F.lit(0)) < 4), 0.2).when(F.col("_mean") <= 0, 0.3).otherwise(steady)
    )
    return tracks.join(agg, KEY, "left").withColumn("tempo_confidence", value).drop("_n", "_mean", "_sd")


# Fixed values of each accent kind: strength, confidence, anticipation, release, place in the merge.
ACCENTS = {
    "beat": (0.4, 0.85, 0.0, 0.0, 0),
    "downbeat": (0.7, 0.85, 0.0, 0.0, 0),
    "impact": (0.85, 0.8, 0.0, 0.0, 1),
    "section_boundary": (0.9, 0.75, 0.15, 0.2, 2),
    "break_entry": (0.7, 0.6, 0.0, 0.0, 3),
    "break_exit": (0.8, 0.6, 0.0, 0.0, 4),
    "riser_peak": (0.85, 0.65, 0.1, 0.0, 5),
    "silence_hit": (0.6, 0.55, 0.0, 0.0, 6),
}


def _accent_rows(df: DataFrame, sec: str, kind: Column) -> DataFrame:
    return df.select(*KEY, F.col(sec).alias("sec"), kind.alias("kind"))


def accents(beats: DataFrame, downbeats: DataFrame, impacts: DataFrame, sections: DataFrame, intervals: DataFrame) -> DataFrame:
    """Typed accents of each track.

    A beat is a downbeat when it stands at a downbeat's exact second. Section starts and ends count
    once each. `intervals` holds kinds break, riser and silence.
    """
    marks = downbeats.select(*KEY, "sec").distinct().withColumn("_down", F.lit(True))
    pulse = beats.join(marks, [*KEY, "sec"], "left")
    edges = sections.select(*KEY, F.explode(F.array("start_sec", "end_sec")).alias("sec")).distinct()
    of_kind = {k: intervals.where(F.col("kind") == k) for k in ("break", "riser", "silence")}
    rows = (
        _accent_rows(pulse, "sec", F.when(F.col("_down"), "downbeat").otherwise("beat"))
        .unionByName(_accent_rows(impacts, "sec", F.lit("impact")))
        .unionByName(_accent_rows(edges, "sec", F.lit("section_boundary")))
        .unionByName(_accent_rows(of_kind["break"], "start_sec", F.lit("break_entry")))
        .unionByName(_accent_rows(of_kind["break"], "end_sec", F.lit("break_exit")))
        .unionByName(_accent_rows(of_kind["riser"], "end_sec", F.lit("riser_peak")))
        .unionByName(_accent_rows(of_kind["silence"], "end_sec", F.lit("silence_hit")))
    )
    names = ("strength", "confidence", "anticipation_sec", "release_sec", "merge_rank")
    table = F.create_map(
        *[p for k, v in ACCENTS.items() for p in (F.lit(k), F.struct(*[F.lit(x).alias(n) for x, n in zip(v, names)]))]
    )
    rows = rows.withColumn("_a", F.element_at(table, F.col("kind")))
    return rows.select(*KEY, "sec", "kind", *[F.col(f"_a.{n}") for n in names])


def order_accents(rows: DataFrame) -> DataFrame:
    """Number the accents of a track by time, equal times by their place in the merge."""
    return ordered.annotate(rows, KEY, ["sec", "merge_rank"], {"position": ordered.position()})


def motion_accents(tracks: DataFrame, beats: DataFrame, impacts: DataFrame, downbeats: DataFrame) -> DataFrame:
    """Beats that deserve camera motion, before merging.

    tracks(track_id, bpm, duration_sec), beats(track_id, sec, energy). A beat stays near an impact,
    near a downbeat, or when its energy reaches the larger of .3 and the upper median.
    """
    middle = ordered.order_statistics(beats, KEY, "energy", {"_median": "upper_median"})
    facts = tracks.join(middle, KEY, "left").select(
        *KEY, F.col("duration_sec").alias("_duration"), F.coalesce("_median", F.lit(0.5)).alias("_median"),
        F.when(F.col("bpm") > 0, F.lit(60.0) / F.col("bpm")).otherwise(F.lit(0.5)).alias("_period"),
    )
    rows = ordered.attach(beats, facts, KEY, "sec", "inner").where(F.col("sec") <= F.col("_duration"))
    rows = joins.near_any(rows, impacts, KEY, F.col("_period") * 0.24, "_impact")
    rows = joins.near_any(rows, downbeats, KEY, F.col("_period") * 0.12, "_downbeat")
    energy = F.coalesce("energy", "_median")
    rows = rows.where(F.col("_impact") | F.col("_downbeat") | (energy >= F.greatest(F.lit(0.3), F.col("_median"))))

    def by_kind(impact: float, downbeat: float, beat: float) -> Column:
        return F.when(F.col("_impact"), impact).when(F.col("_downbeat"), downbeat).otherwise(beat)

    strength = F.least(
        F.lit(1.0), F.greatest(by_kind(0.72, 0.55, 0.0), F.greatest(F.lit(0.0), energy) * 0.7 + by_kind(0.3, 0.18, 0.0))
    )
    rows = rows.withColumn("strength", strength)
    return rows.select(
        *KEY,
        "sec",
        F.when(F.col("_impact"), "impact").when(F.col("_downbeat"), "downbeat").otherwise("beat").alias("kind"),
        "strength",
        F.least(F.lit(0.24), F.greatest(F.lit(0.14), F.col("_period") * (F.col("strength") * 0.18 + 0.28))).alias("anticipation_sec"),
        F.least(F.lit(0.4), F.greatest(F.lit(0.14), F.col("_period") * (F.lit(0.55) - F.col("strength") * 0.2))).alias("release_sec"),
        (F.col("strength") * 0.24 + 0.08).alias("target_velocity"),
        F.greatest(F.lit(0.12), F.col("_period") * 0.35).alias("minimum_gap"),
    )


def merge_accents(rows: DataFrame) -> DataFrame:
    """Merge motion accents closer than `minimum_gap` to the one kept before, keeping the stronger kind.

    `minimum_gap` is one number per track.
    """
    rows = rows.withColumn("_rank", F.when(F.col("kind") == "impact", 2).when(F.col("kind") == "downbeat", 1).otherwise(0))
    kept = folds.keep_by_rule(rows, KEY, "sec", ["sec", "minimum_gap", "_rank", "strength"], folds.strongest)
    return kept.drop("_rank", "minimum_gap")


def timeline_document(tracks: DataFrame, sections: DataFrame, intervals: DataFrame, peaks: DataFrame) -> DataFrame:
    """Long form of the music timeline: renamed sections, plain intervals and unit-weight spectral points."""
    nothing = F.lit(None).cast("double")
    parts = (
        sections.select(*KEY, F.lit("section").alias("series"), "start_sec", "end_sec", "label", nothing.alias("value")),
        intervals.select(*KEY, F.col("kind").alias("series"), "start_sec", "end_sec", F.lit(None).cast("string").alias("label"), nothing.alias("value")),
        peaks.select(*KEY, F.lit("spectral_novelty").alias("series"), F.col("sec").alias("start_sec"), nothing.alias("end_sec"),
                     F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("value")),
    )
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.join(tracks.select(*KEY), KEY, "left_semi")
