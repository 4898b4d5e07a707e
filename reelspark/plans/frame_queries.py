"""Queries over frame signals: cuts, shots, motion around cuts, style."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import flow, frames, joins
from reelspark.plans import adapters as A
from reelspark.plans.check_views import with_views
from reelspark.plans.registry import query


def _r(*names: str, places: int = 6):
    return [F.round(n, places).alias(n.split(".")[-1]) for n in names]


_BUCKET = """CASE WHEN sqrt({x}*{x} + {y}*{y}) < 2 THEN 'none' WHEN (degrees(atan2({y}, {x})) + 360) % 360 = 337.5 THEN 'right'
    ELSE ['right','down-right','down','down-left','left','up-left','up','up-right'][
         ((ceil((((degrees(atan2({y}, {x})) + 360) % 360) - 22.5) / 45)::INT + 8) % 8) + 1] END"""


def bucket_sql(x: str, y: str) -> str:
    return _BUCKET.format(x=x, y=y)


_ABS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) / len({a}) / 255.0::DOUBLE"

FRAME_VIEWS = {
    "v_cut_signals": f"""
        SELECT c.video_id, c.frame_idx, c.sec,
               sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(b.hist, a.hist), lambda z: sqrt(z[1] * z[2])))
                    / sqrt(list_sum(b.hist) * list_sum(a.hist)))) AS h,
               {_ABS.format(a='b.edge', b='a.edge')} AS e, {_ABS.format(a='b.px', b='a.px')} AS m,
               abs(a.sharpness - b.sharpness) AS ds, b.brightness AS bb, a.brightness AS ba,
               coalesce(n.brightness, a.brightness) AS bn,
               coalesce({_ABS.format(a='fb.px', b='b.px')}, 0) AS mb, coalesce({_ABS.format(a='a.px', b='fa.px')}, 0) AS ma
        FROM v_cut_candidates c
        JOIN v_frames b ON b.video_id = c.video_id AND b.frame_idx = greatest(0, c.frame_idx - 2)
        JOIN v_frames a ON a.video_id = c.video_id AND a.frame_idx = c.frame_idx
        LEFT JOIN v_frames n ON n.video_id = c.video_id AND n.frame_idx = c.frame_idx + 2
        LEFT JOIN v_frames fb ON fb.video_id = c.video_id AND fb.frame_idx = greatest(0, c.frame_idx - 6)
        LEFT JOIN v_frames fa ON fa.video_id = c.video_id AND fa.frame_idx = c.frame_idx + 6""",
    "v_cuts_classified": """
        SELECT *, CASE WHEN flash THEN 'flash_cut' WHEN whip THEN 'whip_hidden_cut' WHEN dis THEN 'dissolve'
                       WHEN sig >= 0.35 THEN 'hard_cut' ELSE 'unknown' END AS cut_type,
               CASE WHEN flash THEN least(1, sig + 0.2) WHEN whip THEN greatest(0.25, sig * 0.7)
                    WHEN dis THEN greatest(0.2, sig * 0.6) ELSE sig END AS confidence
        FROM (SELECT *, 0.4::DOUBLE * least(1, 2 * h) + 0.35::DOUBLE * least(1, 3 * e) + 0.25::DOUBLE * least(1, 3 * m) AS sig,
                     ba - bb > 0.35 AND ba - bn > 0.25 AS flash, mb > 0.55 AND ma > 0.55 AS whip,
                     h > 0.15 AND h < 0.35 AND e < 0.12 AND ds < 40 AS dis FROM v_cut_signals)""",
    "v_video_shots": """
        SELECT video_id, sec AS start_sec, end_sec, 24.0::DOUBLE AS fps,
               row_number() OVER (PARTITION BY video_id ORDER BY sec) - 1 AS "index"
        FROM (SELECT *, lead(sec) OVER (PARTITION BY video_id ORDER BY sec) AS end_sec
              FROM (SELECT video_id, sec FROM v_cut_candidates UNION ALL SELECT video_id, 0 FROM v_videos
                    UNION ALL SELECT video_id, duration_sec FROM v_videos))
        WHERE end_sec - sec >= 1.0::DOUBLE / 24""",
    "v_pairs": """
        SELECT * FROM (SELECT video_id, frame_idx AS frame_a, tx, ty, log_scale, rotation, confidence,
                       lead(sharpness) OVER (PARTITION BY video_id ORDER BY frame_idx) AS sharpness_b FROM v_frames)
        WHERE sharpness_b IS NOT NULL""",
    "v_observed_shots": f"""
        SELECT *, CASE WHEN portrait + action + stable <= 1e-6 THEN 0 ELSE portrait / (portrait + action + stable) END AS p_portrait,
               CASE WHEN portrait + action + stable <= 1e-6 THEN 0 ELSE action / (portrait + action + stable) END AS p_action,
               CASE WHEN portrait + action + stable <= 1e-6 THEN 0 ELSE stable / (portrait + action + stable) END AS p_hold
        FROM (SELECT s.video_id, s."index", s.start_sec, s.end_sec, s.end_sec - s.start_sec AS duration_sec,
                     least(1, f.sharpness / 2000) AS visual_energy, f.brightness,
                     sqrt(coalesce(p.tx, 0) ** 2 + coalesce(p.ty, 0) ** 2) AS translation, coalesce(p.confidence, 0) AS conf,
                     CASE WHEN f.face_confidence > 0 THEN 1 ELSE 0 END AS subject_count,
                     coalesce(f.frontal_probability, 0) * coalesce(f.face_confidence, 0) AS portrait,
                     least(1, greatest(0, coalesce(p.confidence, 0) * sqrt(coalesce(p.tx, 0) ** 2 + coalesce(p.ty, 0) ** 2) / 30)) AS action,
                     least(1, greatest(0, 1 - sqrt(coalesce(p.tx, 0) ** 2 + coalesce(p.ty, 0) ** 2) / 40)) AS stable,
                     {bucket_sql('coalesce(p.tx, 0)', 'coalesce(p.ty, 0)')} AS motion_direction
              FROM v_video_shots s
              JOIN v_frames f ON f.video_id = s.video_id AND f.frame_idx = round_even((s.start_sec + s.end_sec) / 2 * 24, 0)::BIGINT
              LEFT JOIN v_pairs p ON p.video_id = f.video_id AND p.frame_a = f.frame_idx)""",
    "v_cut_sides": """
        SELECT c.video_id, c.frame_idx, s.side, avg(sqrt(tx*tx + ty*ty)) AS value, avg(confidence) AS conf,
               coalesce(avg(tx) FILTER (confidence >= 0.3), 0) AS vx, coalesce(avg(ty) FILTER (confidence >= 0.3), 0) AS vy,
               list(sqrt(tx*tx + ty*ty) ORDER BY frame_a) AS env,
               list(least(1, greatest(0, 1 - sharpness_b / 2000)) ORDER BY frame_a) AS blur
        FROM v_cut_candidates c CROSS JOIN (VALUES ('o', -9, -2), ('i', 1, 8)) s(side, lo, hi)
        JOIN v_pairs p ON p.video_id = c.video_id AND p.frame_a BETWEEN c.frame_idx + s.lo AND c.frame_idx + s.hi
        GROUP BY c.video_id, c.frame_idx, s.side""",
    "v_observed_cuts": f"""
        SELECT *, CASE WHEN oc < 0.3 OR ic < 0.3 THEN 'unknown' WHEN ov < 0.4 AND iv < 0.4 THEN 'unknown'
                       WHEN iv < ov * 0.35 THEN 'reset'
                       WHEN sqrt(ox*ox + oy*oy) < 1e-6 OR sqrt(ix*ix + iy*iy) < 1e-6 THEN
                            CASE WHEN iv / greatest(ov, 1e-6) BETWEEN 0.5 AND 2 THEN 'carry' ELSE 'reverse' END
                       WHEN ox * ix + oy * iy >= 0 THEN 'carry' ELSE 'reverse' END AS relation,
               CASE WHEN ic >= 0.3 THEN {bucket_sql('ix', 'iy')} ELSE 'none' END AS direction,
               CASE WHEN coalesce(list_max(blur), 0) >= 0.55 THEN 'flash' ELSE 'none' END AS effect_kind
        FROM (SELECT c.video_id, c.frame_idx, c.sec, coalesce(o.value, 0) AS ov, coalesce(o.conf, 0) AS oc, coalesce(o.vx, 0) AS ox,
                     coalesce(o.vy, 0) AS oy, coalesce(i.value, 0) AS iv, coalesce(i.conf, 0) AS ic, coalesce(i.vx, 0) AS ix,
                     coalesce(i.vy, 0) AS iy, coalesce(o.env, []) AS oenv, coalesce(i.env, []) AS ienv,
                     list_concat(coalesce(o.blur, []), coalesce(i.blur, [])) AS blur
              FROM v_cut_candidates c
              LEFT JOIN v_cut_sides o ON o.video_id = c.video_id AND o.frame_idx = c.frame_idx AND o.side = 'o'
              LEFT JOIN v_cut_sides i ON i.video_id = c.video_id AND i.frame_idx = c.frame_idx AND i.side = 'i')""",
    "v_transition_pairs": """
        SELECT video_id, frame_idx, sec AS cut_sec, relation, CASE WHEN relation = 'reset' THEN 'none' ELSE direction END AS direction,
               effect_kind, oenv, ienv, greatest(0, iv - ov) AS overshoot, least(oc, ic) AS confidence
        FROM v_observed_cuts WHERE relation <> 'unknown'""",
    "v_style": """
        SELECT v.video_id, coalesce(c.n, 0) / greatest(v.duration_sec, 1e-6) AS cut_density,
               coalesce(s.mean, 0) AS shot_duration_mean, coalesce(s.med, 0) AS shot_duration_median,
               coalesce(c.synced, 0) AS music_sync_ratio, coalesce(s.cover, 0) AS motion_coverage, coalesce(s.hold, 0) AS hold_ratio,
               coalesce(c.rev, 0) AS reversal_ratio, coalesce(c.scale, 0) AS scale_motion_ratio, 0.0::DOUBLE AS blur_usage
        FROM v_videos v
        LEFT JOIN (SELECT video_id, avg(duration_sec) AS mean, quantile_cont(duration_sec, 0.5) AS med,
                          avg((translation > 0.4)::INT) AS cover, avg((translation < 0.4)::INT) AS hold
                   FROM v_observed_shots GROUP BY video_id) s USING (video_id)
        LEFT JOIN (SELECT video_id, count(*) AS n, avg((abs(off) <= 0.08)::INT) AS synced,
                          avg((relation = 'reverse')::INT) AS rev, avg((oc > 0.5)::INT) AS scale
                   FROM (SELECT *, round(sec, 4) - round(round(sec, 4) * 2) / 2 AS off FROM v_observed_cuts)
                   GROUP BY video_id) c USING (video_id)""",
}


def _sql(text: str) -> str:
    return with_views(text, FRAME_VIEWS)


def video_shots(spark, sf_dir):
    return frames.shots_from_cuts(A.cut_candidates(spark, sf_dir), A.videos(spark, sf_dir))


def pairs(spark, sf_dir):
    return frames.pair_table(A.frames(spark, sf_dir))


video_shots_t = A.staged(video_shots)
pairs_t = A.staged(pairs)


def observed_shots(spark, sf_dir):
    return frames.observe_shots(video_shots_t(spark, sf_dir), A.frames(spark, sf_dir), pairs_t(spark, sf_dir))


def observed_cuts(spark, sf_dir):
    return frames.observe_cuts(A.cut_candidates(spark, sf_dir), pairs_t(spark, sf_dir))


observed_shots_t = A.staged(observed_shots)
observed_cuts_t = A.staged(observed_cuts)


def transition_pairs(spark, sf_dir):
    return frames.transition_pairs(observed_cuts_t(spark, sf_dir))


def style(spark, sf_dir):
    """Style of each video; the music grid is a beat every half second."""
    at = F.round("sec", 4)
    cuts = observed_cuts_t(spark, sf_dir).select(
        "video_id", "relation", F.col("outgoing.confidence").alias("outgoing_confidence"),
        (at - F.round(at * 2) / 2).alias("music_offset_sec"),
    )
    return frames.style_summary(A.videos(spark, sf_dir), observed_shots_t(spark, sf_dir), cuts)


style_t = A.staged(style)


@query("cut_signals", _sql("""SELECT video_id, frame_idx, round(h, 6) AS hist_distance, round(e, 6) AS edge_distance,
       round(m, 6) AS mean_diff, round(ds, 6) AS sharpness_delta, round(mb, 6) AS motion_before, round(ma, 6) AS motion_after,
       round(bn, 6) AS brightness_next FROM v_cut_signals"""))
def cut_signals(spark, sf_dir):
    out = frames.cut_signals(A.cut_candidates(spark, sf_dir), A.frames(spark, sf_dir))
    return out.select("video_id", "frame_idx", *_r(
        "hist_distance", "edge_distance", "mean_diff", "sharpness_delta", "motion_before", "motion_after", "brightness_next"))


@query("cut_classification", _sql("SELECT video_id, frame_idx, cut_type, round(confidence, 6) AS confidence FROM v_cuts_classified"))
def cut_classification(spark, sf_dir):
    out = frames.classify_cuts(frames.cut_signals(A.cut_candidates(spark, sf_dir), A.frames(spark, sf_dir)))
    return out.select("video_id", "frame_idx", "cut_type", *_r("confidence"))


@query("shots_from_cuts", _sql("""SELECT video_id, "index", round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec FROM v_video_shots"""))
def shots_from_cuts(spark, sf_dir):
    return video_shots(spark, sf_dir).select("video_id", "index", *_r("start_sec", "end_sec"))


@query("shot_observation", _sql("""SELECT video_id, "index", round(visual_energy, 6) AS visual_energy, round(brightness, 6) AS brightness,
       round(translation, 6) AS translation, round(conf, 6) AS motion_confidence, round(conf * 0.7, 6) AS native_confidence, subject_count,
       round(portrait, 6) AS portrait_probability, round(action, 6) AS action_probability, round(stable, 6) AS stable_ratio,
       motion_direction FROM v_observed_shots"""))
def shot_observation(spark, sf_dir):
    return observed_shots(spark, sf_dir).select("video_id", "index", "subject_count", "motion_direction", *_r(
        "visual_energy", "brightness", "translation", "motion_confidence", "native_confidence", "portrait_probability",
        "action_probability", "stable_ratio"))


@query("shot_kind_probabilities", _sql("""SELECT video_id, "index", round(p_portrait, 6) AS portrait, round(p_action, 6) AS action,
       round(p_hold, 6) AS hold FROM v_observed_shots"""))
def shot_kind_probabilities(spark, sf_dir):
    rows = observed_shots(spark, sf_dir)
    return rows.select("video_id", "index", *[
        F.round(F.coalesce(F.try_element_at("kind_probabilities", F.lit(k)), F.lit(0.0)), 6).alias(k) for k in ("portrait", "action", "hold")])


@query("cut_motion_envelopes", _sql("""SELECT video_id, frame_idx, round(ov, 6) AS out_value, round(oc, 6) AS out_confidence, round(ox, 6) AS out_vx,
       round(iv, 6) AS in_value, round(ic, 6) AS in_confidence, round(iy, 6) AS in_vy, len(oenv)::INT AS out_pairs, len(ienv)::INT AS in_pairs,
       round(oenv[1], 6) AS out_first, round(ienv[-1], 6) AS in_last, round(list_max(blur), 6) AS blur_peak FROM v_observed_cuts"""))
def cut_motion_envelopes(spark, sf_dir):
    rows = observed_cuts(spark, sf_dir)
    one = {"out_value": "outgoing.value", "out_confidence": "outgoing.confidence", "out_vx": "outgoing.vx", "in_value": "incoming.value",
           "in_confidence": "incoming.confidence", "in_vy": "incoming.vy"}
    return rows.select(
        "video_id", "frame_idx", *[F.round(c, 6).alias(n) for n, c in one.items()],
        F.size("outgoing.envelope").alias("out_pairs"), F.size("incoming.envelope").alias("in_pairs"),
        F.round(F.try_element_at("outgoing.envelope", F.lit(1)), 6).alias("out_first"),
        F.round(F.try_element_at("incoming.envelope", F.lit(-1)), 6).alias("in_last"),
        F.round(F.array_max("blur_envelope"), 6).alias("blur_peak"))


@query("cut_motion_relation", _sql("SELECT video_id, frame_idx, relation, direction, effect_kind FROM v_observed_cuts"))
def cut_motion_relation(spark, sf_dir):
    return observed_cuts(spark, sf_dir).select("video_id", "frame_idx", "relation", "direction", "effect_kind")


@query("transition_pairs", _sql("""SELECT video_id, frame_idx, relation, direction, effect_kind, round(overshoot, 6) AS overshoot,
       round(confidence, 6) AS confidence, round(8 / 24.0::DOUBLE, 6) AS anticipation_sec FROM v_transition_pairs"""))
def transition_pair_rows(spark, sf_dir):
    return transition_pairs(spark, sf_dir).select(
        "video_id", "frame_idx", "relation", "direction", "effect_kind", *_r("overshoot", "confidence", "anticipation_sec"))


@query("motion_curve", _sql("""
    WITH s AS (SELECT video_id, k, round_even(k * 0.1::DOUBLE * 24, 0)::BIGINT AS a, round_even((k * 0.1::DOUBLE + 0.1::DOUBLE) * 24, 0)::BIGINT AS b
               FROM v_videos, unnest(range(0, ceil(duration_sec / 0.1::DOUBLE)::BIGINT + 1)) t(k)
               WHERE k * 0.1::DOUBLE + 0.1::DOUBLE < duration_sec),
         p AS (SELECT s.*, sqrt(coalesce(f.tx, 0) ** 2 + coalesce(f.ty, 0) ** 2) AS velocity FROM s
               JOIN v_frames f ON f.video_id = s.video_id AND f.frame_idx = a
               JOIN v_frames g ON g.video_id = s.video_id AND g.frame_idx = b)
    SELECT video_id, k, round(k * 0.1::DOUBLE + 0.05::DOUBLE, 4) AS sec, round(velocity, 6) AS velocity,
           round((velocity - coalesce(lag(velocity) OVER (PARTITION BY video_id ORDER BY k), 0)) / 0.1::DOUBLE, 6) AS acceleration FROM p"""))
def motion_curve(spark, sf_dir):
    measured = A.frames(spark, sf_dir)
    curve_pairs = measured.select(
        "video_id", F.col("frame_idx").alias("frame_a"), F.explode(F.array(F.lit(2), F.lit(3))).alias("_gap"), "tx", "ty", "log_scale", "rotation", "confidence"
    ).withColumn("frame_b", F.col("frame_a") + F.col("_gap")).drop("_gap")
    out = frames.motion_curve(A.videos(spark, sf_dir), curve_pairs, measured)
    return out.select("video_id", "k", F.round("sec", 4).alias("sec"), *_r("velocity", "acceleration"))


_STYLE = ("cut_density", "shot_duration_mean", "shot_duration_median", "music_sync_ratio", "motion_coverage", "hold_ratio",
          "reversal_ratio", "scale_motion_ratio", "blur_usage")


@query("style_summary", _sql("SELECT video_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in _STYLE) + " FROM v_style"))
def style_summary(spark, sf_dir):
    return style(spark, sf_dir).select("video_id", *_r(*_STYLE))


@query("dominant_palette", _sql("""
    WITH px AS (SELECT video_id, frame_idx, floor(px[3*t-2] / 32)::INT AS r, floor(px[3*t-1] / 32)::INT AS g, floor(px[3*t] / 32)::INT AS b
                FROM v_frames, unnest(range(1, 14)) u(t)),
         n AS (SELECT *, count(*) AS n FROM px GROUP BY ALL),
         k AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY n DESC, r DESC, g DESC, b DESC) AS rank FROM n)
    SELECT video_id, frame_idx, string_agg(printf('#%02x%02x%02x', r*32+16, g*32+16, b*32+16), ',' ORDER BY rank) AS palette
    FROM k WHERE rank <= 5 GROUP BY video_id, frame_idx"""))
def dominant_palette(spark, sf_dir):
    triples = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda t: F.struct(
        F.element_at("px", t * 3 + 1).alias("r"), F.element_at("px", t * 3 + 2).alias("g"), F.element_at("px", t * 3 + 3).alias("b")))
    pixels = A.frames(spark, sf_dir).select("video_id", "frame_idx", F.inline(triples))
    return frames.dominant_palette(pixels).select("video_id", "frame_idx", F.array_join("palette", ",").alias("palette"))


@query("shot_edge_motion", _sql(f"""
    WITH m AS (SELECT video_id, frame_a, CASE WHEN confidence < 0.3 THEN 'none' ELSE {bucket_sql('tx', 'ty')} END AS label FROM v_pairs)
    SELECT s.video_id, s."index", coalesce(a.label, 'none') AS entry_motion, coalesce(b.label, 'none') AS exit_motion
    FROM v_video_shots s
    LEFT JOIN m a ON a.video_id = s.video_id AND a.frame_a = round_even(start_sec * 24, 0)::BIGINT
    LEFT JOIN m b ON b.video_id = s.video_id AND b.frame_a = round_even(greatest(start_sec, end_sec - 5 / 24.0::DOUBLE) * 24, 0)::BIGINT"""))
def shot_edge_motion(spark, sf_dir):
    return frames.edge_motion(video_shots_t(spark, sf_dir), pairs_t(spark, sf_dir)).select("video_id", "index", "entry_motion", "exit_motion")


@query("sampled_shot_flow", _sql("""
    WITH k AS (SELECT video_id, "index", start_sec + greatest(1e-3, end_sec - start_sec) * (0.2::DOUBLE + 0.6::DOUBLE * k / 2) AS spot, end_sec
               FROM v_video_shots, unnest([0, 1, 2]) t(k)),
         m AS (SELECT k.video_id, k."index", avg(tx) AS vx, avg(ty) AS vy, avg(sqrt(tx*tx + ty*ty)) AS magnitude FROM k
               JOIN v_frames f ON f.video_id = k.video_id AND f.frame_idx = floor(spot * 24 + 1e-6)::BIGINT
               WHERE spot + 1.0::DOUBLE / 24 < end_sec GROUP BY ALL)
    SELECT s.video_id, s."index", round(coalesce(vx, 0), 6) AS vx, round(coalesce(vy, 0), 6) AS vy, round(coalesce(magnitude, 0), 6) AS magnitude
    FROM v_video_shots s LEFT JOIN m USING (video_id, "index")"""))
def sampled_shot_flow(spark, sf_dir):
    measured = A.frames(spark, sf_dir).select(
        "video_id", "frame_idx", F.col("tx").alias("vx"), F.col("ty").alias("vy"), F.hypot("tx", "ty").alias("magnitude"))
    return flow.sample_shot_flow(video_shots_t(spark, sf_dir), measured).select("video_id", "index", *_r("vx", "vy", "magnitude"))
