"""Queries over music time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import joins, music, ordered, segments
from reelspark.plans import adapters as A
from reelspark.plans.check_views import with_views
from reelspark.plans.registry import query

WINDOW_SEC = 8.0


def _ranges_sql(source: str, condition: str, minimum: float) -> str:
    return f"""SELECT track_id, min(sec) AS start_sec, max(coalesce(next_sec, sec)) AS end_sec
        FROM (SELECT *, i - row_number() OVER (PARTITION BY track_id ORDER BY i) AS island
              FROM (SELECT *, lead(sec) OVER (PARTITION BY track_id ORDER BY i) AS next_sec FROM {source}) WHERE {condition})
        GROUP BY track_id, island HAVING max(coalesce(next_sec, sec)) - min(sec) >= {minimum}"""


MUSIC_VIEWS = {
    "v_audio": """
        SELECT a.*, least(1, greatest(0, (rms - p5) / greatest(p95 - p5, 1e-8))) AS energy
        FROM v_audio_frames a JOIN (SELECT track_id, quantile_cont(rms, 0.05) AS p5, quantile_cont(rms, 0.95) AS p95, quantile_cont(rms, 0.12) AS p12
                                    FROM v_audio_frames GROUP BY track_id) USING (track_id)""",
    "v_silence_bar": "SELECT track_id, greatest(0.01, 0.7::DOUBLE * quantile_cont(rms, 0.12)) AS bar FROM v_audio_frames GROUP BY track_id",
    "v_slope": """
        SELECT track_id, i, sec, CASE WHEN p IS NULL THEN n - s WHEN n IS NULL THEN s - p ELSE (n - p) / 2 END AS slope
        FROM (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS n
              FROM (SELECT *, sum(energy) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) / 12 AS s FROM v_audio)
              WINDOW w AS (PARTITION BY track_id ORDER BY i))""",
    "v_slope_bar": "SELECT s.*, bar FROM v_slope s JOIN (SELECT track_id, quantile_cont(slope, 0.78) AS bar FROM v_slope GROUP BY track_id) USING (track_id)",
    "v_boundaries": """
        SELECT track_id, sec FROM (SELECT *, lag(sec) OVER (PARTITION BY track_id ORDER BY sec) AS p
              FROM (SELECT track_id, sec FROM v_beats WHERE is_downbeat = 1 UNION SELECT track_id, 0 FROM v_tracks UNION SELECT track_id, duration_sec FROM v_tracks))
        WHERE p IS NULL OR sec - p >= 0.35""",
    "v_section_spans": """
        SELECT * FROM (SELECT track_id, row_number() OVER w - 1 AS "index", sec AS start_sec, lead(sec) OVER w AS end_sec
                       FROM v_boundaries WINDOW w AS (PARTITION BY track_id ORDER BY sec)) WHERE end_sec IS NOT NULL""",
    "v_sections": """
        SELECT track_id, "index", start_sec, end_sec, energy,
               CASE WHEN "index" = 0 THEN 'intro' WHEN energy >= 0.72 AND energy - prior >= 0.12 THEN 'drop' WHEN energy <= 0.2 THEN 'break'
                    WHEN energy - prior >= 0.08 THEN 'build' WHEN nxt IS NULL THEN 'outro' WHEN prior - energy >= 0.1 THEN 'release' ELSE 'verse' END AS label
        FROM (SELECT *, coalesce(lag(energy) OVER w, energy) AS prior, lead("index") OVER w AS nxt
              FROM (SELECT s.*, coalesce(m.energy, 0) AS energy FROM v_section_spans s
                    LEFT JOIN (SELECT s.track_id, s."index", avg(a.energy) AS energy FROM v_section_spans s
                               JOIN v_audio a ON a.track_id = s.track_id AND a.sec >= s.start_sec AND a.sec < s.end_sec GROUP BY ALL) m USING (track_id, "index"))
              WINDOW w AS (PARTITION BY track_id ORDER BY "index"))""",
    "v_impacts": """
        SELECT track_id, i, sec, onset_strength FROM (SELECT a.*, quantile_cont(onset_strength, 0.82) OVER (PARTITION BY track_id) AS bar
              FROM v_audio_frames a WHERE is_onset) WHERE onset_strength >= bar""",
    "v_accents": """
        SELECT b.track_id, b.sec, CASE WHEN is_downbeat = 1 THEN 'downbeat' ELSE 'beat' END AS kind, CASE WHEN is_downbeat = 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS strength,
               0.85::DOUBLE AS confidence, 0.0::DOUBLE AS anticipation_sec, 0.0::DOUBLE AS release_sec, 0 AS merge_rank FROM v_beats b
        UNION ALL SELECT track_id, sec, 'impact', 0.85, 0.8, 0, 0, 1 FROM v_impacts
        UNION ALL SELECT track_id, sec, 'section_boundary', 0.9, 0.75, 0.15, 0.2, 2
                  FROM (SELECT track_id, start_sec AS sec FROM v_section_spans UNION SELECT track_id, end_sec FROM v_section_spans)
        UNION ALL SELECT track_id, start_sec, 'break_entry', 0.7, 0.6, 0, 0, 3 FROM v_intervals WHERE kind = 'break'
        UNION ALL SELECT track_id, end_sec, 'break_exit', 0.8, 0.6, 0, 0, 4 FROM v_intervals WHERE kind = 'break'
        UNION ALL SELECT track_id, end_sec, 'riser_peak', 0.85, 0.65, 0.1, 0, 5 FROM v_intervals WHERE kind = 'riser'
        UNION ALL SELECT track_id, end_sec, 'silence_hit', 0.6, 0.55, 0, 0, 6 FROM v_intervals WHERE kind = 'silence'""",
    "v_motion_accents": """
        SELECT track_id, sec, kind, rank, strength, least(0.24, greatest(0.14, period * (0.28::DOUBLE + 0.18::DOUBLE * strength))) AS anticipation_sec,
               least(0.4, greatest(0.14, period * (0.55::DOUBLE - 0.2::DOUBLE * strength))) AS release_sec, 0.08::DOUBLE + 0.24::DOUBLE * strength AS target_velocity,
               greatest(0.12, 0.35::DOUBLE * period) AS gap
        FROM (SELECT *, CASE WHEN impact THEN 'impact' WHEN down THEN 'downbeat' ELSE 'beat' END AS kind, CASE WHEN impact THEN 2 WHEN down THEN 1 ELSE 0 END AS rank,
                     least(1, greatest(CASE WHEN impact THEN 0.72 WHEN down THEN 0.55 ELSE 0 END,
                                       energy * 0.7::DOUBLE + CASE WHEN impact THEN 0.3 WHEN down THEN 0.18 ELSE 0 END)) AS strength
              FROM (SELECT b.track_id, b.sec, b.energy, m.med, 60 / t.bpm AS period,
                           EXISTS (SELECT 1 FROM v_points i WHERE i.track_id = b.track_id AND i.kind = 'impact' AND abs(i.sec - b.sec) <= 60 / t.bpm * 0.24::DOUBLE) AS impact,
                           EXISTS (SELECT 1 FROM v_beats d WHERE d.track_id = b.track_id AND d.is_downbeat = 1 AND abs(d.sec - b.sec) <= 60 / t.bpm * 0.12::DOUBLE) AS down
                    FROM v_beats b JOIN v_tracks t USING (track_id)
                    JOIN (SELECT track_id, list_sort(list(energy))[count(*) // 2 + 1] AS med FROM v_beats GROUP BY track_id) m USING (track_id) WHERE b.sec <= t.duration_sec)
              WHERE impact OR down OR energy >= greatest(0.3, med))""",
}


def _sql(text: str) -> str:
    return with_views(text, MUSIC_VIEWS)


def _r(*names: str, places: int = 6):
    return [F.round(n, places).alias(n) for n in names]


def audio(spark, sf_dir):
    return music.normalise(A.audio_frames(spark, sf_dir), "rms", "energy")


def downbeats(spark, sf_dir):
    return A.beats(spark, sf_dir).where(F.col("is_downbeat") == 1).select("track_id", "sec")


def boundaries(spark, sf_dir):
    ends = A.tracks(spark, sf_dir).select("track_id", F.explode(F.array(F.lit(0.0), F.col("duration_sec"))).alias("sec"))
    return music.thin_boundaries(downbeats(spark, sf_dir).unionByName(ends))


def section_spans(spark, sf_dir):
    return music.intervals_between(boundaries(spark, sf_dir))


audio_t = A.staged(audio)
section_spans_t = A.staged(section_spans)


def sections(spark, sf_dir):
    return music.label_sections(section_spans_t(spark, sf_dir), audio_t(spark, sf_dir))


def impacts(spark, sf_dir):
    onsets = A.audio_frames(spark, sf_dir).where("is_onset").select("track_id", "i", "sec", "onset_strength")
    return music.impact_points(onsets)


sections_t = A.staged(sections)
impacts_t = A.staged(impacts)


def accents(spark, sf_dir):
    return music.accents(A.beats(spark, sf_dir), downbeats(spark, sf_dir), impacts_t(spark, sf_dir), section_spans_t(spark, sf_dir), A.intervals(spark, sf_dir))


accents_t = A.staged(accents)


@query("energy_normalise", _sql("SELECT track_id, i, round(energy, 6) AS energy FROM v_audio"))
def energy_normalise(spark, sf_dir):
    return audio(spark, sf_dir).select("track_id", "i", *_r("energy"))


@query("track_percentiles", _sql("""SELECT track_id, round(quantile_cont(rms, 0.05), 6) AS p05, round(quantile_cont(rms, 0.12), 6) AS p12, round(quantile_cont(rms, 0.5), 6) AS median,
       list_sort(list(rms))[count(*) // 2 + 1] AS upper_median, round(quantile_cont(rms, 0.96), 6) AS p96 FROM v_audio_frames GROUP BY track_id"""))
def track_percentiles(spark, sf_dir):
    out = ordered.order_statistics(A.audio_frames(spark, sf_dir), ["track_id"], "rms", {"p05": 0.05, "p12": 0.12, "median": 0.5, "upper_median": "upper_median", "p96": 0.96})
    return out.select("track_id", *_r("p05", "p12", "median", "upper_median", "p96"))


@query("riser_ranges", _sql(f"SELECT track_id, start_sec, end_sec FROM ({_ranges_sql('v_slope_bar', 'slope > bar', 0.25)})"))
def riser_ranges(spark, sf_dir):
    return music.risers(audio_t(spark, sf_dir))


@query("silence_ranges", _sql(f"SELECT track_id, start_sec, end_sec FROM ({_ranges_sql('(SELECT a.*, bar FROM v_audio_frames a JOIN v_silence_bar USING (track_id))', 'rms <= bar', 0.07)})"))
def silence_ranges(spark, sf_dir):
    return music.silences(A.audio_frames(spark, sf_dir))


@query("break_ranges", _sql(f"SELECT track_id, start_sec, end_sec FROM ({_ranges_sql('v_audio', 'energy <= 0.18', 0.35)})"))
def break_ranges(spark, sf_dir):
    return music.breaks(audio_t(spark, sf_dir))


@query("energy_slope", _sql("SELECT track_id, i, round(slope, 6) AS slope FROM v_slope"))
def energy_slope(spark, sf_dir):
    return music.smoothed_slope(audio_t(spark, sf_dir)).select("track_id", "i", *_r("slope"))


@query("section_boundaries", _sql("SELECT track_id, sec FROM v_boundaries"))
def section_boundaries(spark, sf_dir):
    return boundaries(spark, sf_dir)


@query("section_labels", _sql("""SELECT track_id, "index", start_sec, end_sec, round(energy, 6) AS energy, label FROM v_sections"""))
def section_labels(spark, sf_dir):
    return sections(spark, sf_dir).select("track_id", "index", "start_sec", "end_sec", *_r("energy"), "label")


@query("impact_points", _sql("SELECT track_id, i, sec, onset_strength FROM v_impacts"))
def impact_points(spark, sf_dir):
    return impacts(spark, sf_dir)


@query("beat_energy_lookup", _sql("""SELECT b.track_id, b.i AS beat_frame, round(a.energy, 6) AS energy FROM v_audio b
       JOIN (SELECT track_id, max(i) AS last FROM v_audio GROUP BY track_id) n USING (track_id) JOIN v_audio a ON a.track_id = b.track_id AND a.i = least(b.i + 2, n.last) WHERE b.is_beat"""))
def beat_energy_lookup(spark, sf_dir):
    frames = audio_t(spark, sf_dir)
    beats = frames.where("is_beat").select("track_id", "sec", F.col("i").alias("beat_frame"), (F.col("i") + 2).alias("frame"))
    return music.beat_energy(beats, frames).select("track_id", "beat_frame", *_r("energy"))


@query("bar_starts", _sql("""SELECT track_id, sec, k // 4 AS bar FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY sec) - 1 AS k FROM v_beats) WHERE k % 4 = 0"""))
def bar_starts(spark, sf_dir):
    return music.bars(A.beats(spark, sf_dir).select("track_id", "sec"))


@query("spectral_peaks", with_views("""WITH
    d AS (SELECT *, max(delta) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS mx,
                 avg(delta) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS av,
                 quantile_cont(delta, 0.96) OVER (PARTITION BY track_id) AS bar FROM v_delta),
    n AS (SELECT track_id, i, sec, row_number() OVER (PARTITION BY track_id ORDER BY i) AS rn FROM d WHERE delta = mx AND delta >= av + bar),
    walk AS (SELECT track_id, rn, i, sec, i AS last, true AS kept FROM n WHERE rn = 1
             UNION ALL SELECT n.track_id, n.rn, n.i, n.sec, CASE WHEN n.i - last > 5 THEN n.i ELSE last END, n.i - last > 5 FROM walk w JOIN n ON n.track_id = w.track_id AND n.rn = w.rn + 1)
    SELECT track_id, i, sec FROM walk WHERE kept""", {**MUSIC_VIEWS,
    "v_centroid": """SELECT a.*, least(1, greatest(0, (centroid - p5) / greatest(p95 - p5, 1e-8))) AS c FROM v_audio_frames a
        JOIN (SELECT track_id, quantile_cont(centroid, 0.05) AS p5, quantile_cont(centroid, 0.95) AS p95 FROM v_audio_frames GROUP BY track_id) USING (track_id)""",
    "v_delta": """SELECT track_id, i, sec, coalesce(abs(CASE WHEN p IS NULL THEN n - c WHEN n IS NULL THEN c - p ELSE (n - p) / 2 END), 0) AS delta
        FROM (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS n FROM v_centroid WINDOW w AS (PARTITION BY track_id ORDER BY i))"""}, recursive=True))
def spectral_peaks(spark, sf_dir):
    return music.spectral_peaks(A.audio_frames(spark, sf_dir)).select("track_id", "i", "sec")


@query("tempo_confidence", _sql("""
    SELECT t.track_id, round(CASE WHEN bpm <= 0 OR n < 4 THEN 0.2 WHEN mu <= 0 THEN 0.3 ELSE greatest(0.2, least(0.95, 1 - least(1, sd / mu))) END, 6) AS tempo_confidence
    FROM v_tracks t LEFT JOIN (SELECT track_id, count(*) AS n, avg(g) AS mu, stddev_pop(g) AS sd
          FROM (SELECT track_id, sec - lag(sec) OVER (PARTITION BY track_id ORDER BY sec) AS g FROM v_beats) GROUP BY track_id) USING (track_id)"""))
def tempo_confidence(spark, sf_dir):
    return music.tempo_confidence(A.tracks(spark, sf_dir), A.beats(spark, sf_dir)).select("track_id", *_r("tempo_confidence"))


@query("accent_curation", _sql("""SELECT track_id, sec, kind, strength, confidence, anticipation_sec, release_sec FROM v_accents"""))
def accent_curation(spark, sf_dir):
    return accents(spark, sf_dir).drop("merge_rank")


@query("accent_order", _sql("""SELECT track_id, sec, kind, row_number() OVER (PARTITION BY track_id ORDER BY sec, merge_rank, kind) - 1 AS position FROM v_accents"""))
def accent_order(spark, sf_dir):
    """Accents by time; equal instants follow the order in which the kinds are merged."""
    return music.order_accents(accents_t(spark, sf_dir)).select("track_id", "sec", "kind", "position")


@query("motion_accents", _sql("""SELECT track_id, sec, kind, round(strength, 6) AS strength, round(anticipation_sec, 6) AS anticipation_sec,
       round(release_sec, 6) AS release_sec, round(target_velocity, 6) AS target_velocity FROM v_motion_accents"""))
def motion_accents(spark, sf_dir):
    out = candidate_accents(spark, sf_dir)
    return out.select("track_id", "sec", "kind", *_r("strength", "anticipation_sec", "release_sec", "target_velocity"))


def candidate_accents(spark, sf_dir):
    hits = A.points(spark, sf_dir).where(F.col("kind") == "impact").select("track_id", "sec")
    return music.motion_accents(A.tracks(spark, sf_dir), A.beats(spark, sf_dir).drop("is_downbeat"), hits, downbeats(spark, sf_dir))


candidate_accents_t = A.staged(candidate_accents)

_MERGE = """
    n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY sec) AS rn FROM v_motion_accents),
    walk AS (SELECT track_id, rn, sec AS k_sec, rank AS k_rank, strength AS k_strength, kind AS k_kind, true AS fresh FROM n WHERE rn = 1
             UNION ALL
             SELECT n.track_id, n.rn, CASE WHEN swap THEN n.sec ELSE k_sec END, CASE WHEN swap THEN n.rank ELSE k_rank END,
                    CASE WHEN swap THEN n.strength ELSE k_strength END, CASE WHEN swap THEN n.kind ELSE k_kind END, far
             FROM (SELECT w.*, n.sec, n.rank, n.strength, n.kind, n.rn AS rn2, n.sec - w.k_sec >= n.gap AS far,
                          n.sec - w.k_sec >= n.gap OR n.rank > w.k_rank OR (n.rank = w.k_rank AND n.strength > w.k_strength) AS swap
                   FROM walk w JOIN n ON n.track_id = w.track_id AND n.rn = w.rn + 1) AS s
             JOIN n ON n.track_id = s.track_id AND n.rn = s.rn2)"""


@query("merged_accents", with_views(f"""WITH {_MERGE}
    SELECT track_id, k_sec AS sec, k_kind AS kind, round(k_strength, 6) AS strength FROM (SELECT *, lead(fresh) OVER (PARTITION BY track_id ORDER BY rn) AS next_fresh FROM walk)
    WHERE coalesce(next_fresh, true)""", MUSIC_VIEWS, recursive=True))
def merged_accents(spark, sf_dir):
    return music.merge_accents(candidate_accents_t(spark, sf_dir)).select("track_id", "sec", "kind", *_r("strength"))


@query("nearest_accent_within", _sql("""
    SELECT p.track_id, p.sec, a.sec AS nearest_sec, a.kind AS nearest_kind FROM (SELECT DISTINCT track_id, sec FROM v_points WHERE kind = 'silence_hit') p
    LEFT JOIN v_motion_accents a ON a.track_id = p.track_id AND abs(p.sec - a.sec) <= 0.3
    QUALIFY row_number() OVER (PARTITION BY p.track_id, p.sec ORDER BY abs(p.sec - a.sec), a.sec) = 1"""))
def nearest_accent_within(spark, sf_dir):
    """Nearest motion accent within .3 s of each silence hit."""
    points = A.points(spark, sf_dir).where(F.col("kind") == "silence_hit").select("track_id", "sec").distinct()
    hit = joins.nearest_within(points, candidate_accents_t(spark, sf_dir).select("track_id", "sec", "kind"), ["track_id"], 0.3, carry=["kind"])
    return hit.select("track_id", "sec", "nearest_sec", "nearest_kind")


@query("timeline_document", _sql("""
    SELECT track_id, 'section' AS series, start_sec, end_sec, label, NULL::DOUBLE AS value FROM v_sections
    UNION ALL SELECT track_id, kind, start_sec, end_sec, NULL, NULL FROM v_intervals
    UNION ALL SELECT track_id, 'spectral_novelty', sec, NULL, NULL, 1.0 FROM v_impacts"""))
def timeline_document(spark, sf_dir):
    return music.timeline_document(A.tracks(spark, sf_dir), sections_t(spark, sf_dir), A.intervals(spark, sf_dir), impacts_t(spark, sf_dir))


@query("interval_overlaps", _sql("""
    SELECT a.track_id, a.start_sec, a.kind, b.start_sec AS other_start, b.kind AS other_kind, round(least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec), 6) AS overlap_sec,
           round((least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec)) / least(a.end_sec - a.start_sec, b.end_sec - b.start_sec), 6) AS overlap_ratio
    FROM v_intervals a JOIN v_intervals b ON a.track_id = b.track_id AND a.start_sec < b.end_sec AND b.start_sec < a.end_sec"""))
def interval_overlaps(spark, sf_dir):
    rows = A.intervals(spark, sf_dir)
    out = joins.overlapping(rows, rows, ["track_id"], 0.5)
    return out.select("track_id", "start_sec", "kind", F.col("start_sec_r").alias("other_start"), F.col("kind_r").alias("other_kind"), *_r("overlap_sec", "overlap_ratio"))


SEGMENT_VIEWS = {
    **MUSIC_VIEWS,
    "v_anchors": """
        SELECT DISTINCT track_id, sec FROM v_beats WHERE is_downbeat = 1 UNION SELECT track_id, sec FROM v_beats
        WHERE track_id NOT IN (SELECT track_id FROM v_beats WHERE is_downbeat = 1)""",
    "v_windows": f"""
        SELECT DISTINCT track_id, sec AS start_sec, sec + {WINDOW_SEC} AS end_sec FROM (SELECT a.track_id, a.sec, t.duration_sec FROM v_anchors a JOIN v_tracks t USING (track_id)
              UNION SELECT track_id, 0, duration_sec FROM v_tracks) WHERE sec >= 0 AND sec <= duration_sec - {WINDOW_SEC}""",
    "v_window_beats": """
        SELECT w.track_id, w.start_sec, w.end_sec, count(b.sec) AS n, max(b.sec) AS last_beat, list(b.gap) FILTER (b.p >= w.start_sec AND b.gap > 0) AS gaps
        FROM v_windows w LEFT JOIN (SELECT track_id, sec, lag(sec) OVER (PARTITION BY track_id ORDER BY sec) AS p, sec - lag(sec) OVER (PARTITION BY track_id ORDER BY sec) AS gap FROM v_beats) b
             ON b.track_id = w.track_id AND b.sec >= w.start_sec AND b.sec < w.end_sec GROUP BY ALL""",
    "v_segment_parts": f"""
        SELECT w.*, list_median(gaps) AS center, list_avg(list_transform(gaps, lambda g: abs(g - list_median(gaps)))) AS err,
               (SELECT min(abs(w.end_sec - d.sec)) FROM v_beats d WHERE d.track_id = w.track_id AND d.is_downbeat = 1) AS end_gap,
               (SELECT count(*) FROM v_audio_frames o WHERE o.track_id = w.track_id AND o.is_onset AND o.sec >= w.start_sec AND o.sec < w.end_sec) AS onsets,
               (SELECT count(*) FROM v_impacts o WHERE o.track_id = w.track_id AND o.sec >= w.start_sec AND o.sec < w.end_sec) AS impacts,
               e.energy, e.arc, coalesce(q.silent, 0) AS silent
        FROM v_window_beats w
        LEFT JOIN (SELECT w.track_id, w.start_sec, sum(o * s.energy) / sum(o) AS energy, least(1, max(s.energy) - min(s.energy) + 0.35::DOUBLE) AS arc
                   FROM (SELECT w.*, s.energy, least(w.end_sec, s.end_sec) - greatest(w.start_sec, s.start_sec) AS o FROM v_windows w JOIN v_sections s ON s.track_id = w.track_id
                         AND s.start_sec < w.end_sec AND w.start_sec < s.end_sec) s JOIN v_windows w USING (track_id, start_sec) WHERE o > 0 GROUP BY ALL) e USING (track_id, start_sec)
        LEFT JOIN (SELECT w.track_id, w.start_sec, sum(least(w.end_sec, s.end_sec) - greatest(w.start_sec, s.start_sec)) AS silent FROM v_windows w
                   JOIN v_intervals s ON s.track_id = w.track_id AND s.kind = 'silence' AND s.start_sec < w.end_sec AND w.start_sec < s.end_sec GROUP BY ALL) q USING (track_id, start_sec)""",
    "v_segment_terms": f"""
        SELECT track_id, start_sec, n AS beat_count, impacts AS impact_count, coalesce(60 / center, 0) AS local_bpm,
               coalesce(least(1, greatest(0, 1 - err / greatest(center, 1e-6))), 0) AS beat_clarity,
               least(1, greatest(0, 0.65::DOUBLE * greatest(0, 1 - coalesce(end_gap, end_sec - last_beat, {WINDOW_SEC}) / greatest(coalesce(center, 0.5), 1e-6))
                     + 0.35::DOUBLE * CASE WHEN n > 0 THEN 1 - least(n % 8, 8 - n % 8) / 8.0::DOUBLE ELSE 0 END)) AS phrase_clarity,
               greatest(0, 1 - abs(onsets / {WINDOW_SEC} - 3.2::DOUBLE) / 3.2::DOUBLE) AS onset_variety, coalesce(energy, 0) AS energy, coalesce(arc, 0) AS dynamic_arc,
               least(1, silent / greatest({WINDOW_SEC} * 0.12::DOUBLE, 1e-6)) AS silence_penalty, least(1, impacts / greatest(2, {WINDOW_SEC} / 4)) AS impact_score FROM v_segment_parts""",
    "v_segments": """
        SELECT *, least(1, greatest(0, 0.25::DOUBLE * beat_clarity + 0.22::DOUBLE * phrase_clarity + 0.14::DOUBLE * onset_variety + 0.16::DOUBLE * energy + 0.10::DOUBLE * dynamic_arc
               + 0.13::DOUBLE * impact_score - 0.18::DOUBLE * silence_penalty)) AS score FROM v_segment_terms""",
}


def scored_segments(spark, sf_dir):
    beats = A.beats(spark, sf_dir)
    onsets = A.audio_frames(spark, sf_dir).where("is_onset").select("track_id", "sec")
    quiet = A.intervals(spark, sf_dir).where(F.col("kind") == "silence")
    no_bars = beats.select("track_id", "sec").where(F.lit(False))
    return segments.score_windows(
        A.tracks(spark, sf_dir), beats, downbeats(spark, sf_dir), no_bars, onsets, impacts_t(spark, sf_dir).select("track_id", "sec"), sections_t(spark, sf_dir), quiet, WINDOW_SEC)


scored_segments_t = A.staged(scored_segments)

_TERMS = ("local_bpm", "beat_clarity", "phrase_clarity", "onset_variety", "energy", "dynamic_arc", "silence_penalty", "score")


@query("segment_scores", with_views("SELECT track_id, start_sec, beat_count, impact_count, " + ", ".join(f"round({t}, 9) AS {t}" for t in _TERMS) + " FROM v_segments", SEGMENT_VIEWS))
def segment_scores(spark, sf_dir):
    return scored_segments(spark, sf_dir).select("track_id", "start_sec", "beat_count", "impact_count", *_r(*_TERMS, places=9))


@query("segment_ranking", with_views("""WITH n AS (SELECT track_id, start_sec, row_number() OVER (PARTITION BY track_id ORDER BY round(score, 9) DESC, start_sec) AS rk FROM v_segments),
    walk AS (SELECT track_id, rk, [start_sec] AS kept FROM n WHERE rk = 1
             UNION ALL SELECT n.track_id, n.rk, CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda k: 8 - abs(k - n.start_sec) > 8 * 0.65::DOUBLE)) = 0
                              THEN list_append(kept, n.start_sec) ELSE kept END FROM walk w JOIN n ON n.track_id = w.track_id AND n.rk = w.rk + 1)
    SELECT track_id, unnest(kept) AS start_sec, unnest(range(1, len(kept) + 1))::INT AS rank FROM walk QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY rk DESC) = 1""", SEGMENT_VIEWS, recursive=True))
def segment_ranking(spark, sf_dir):
    scored = scored_segments_t(spark, sf_dir).withColumn("score", F.round("score", 9))
    return segments.rank_segments(scored, WINDOW_SEC, 3).select("track_id", "start_sec", "rank")
