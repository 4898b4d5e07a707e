"""Nearest-event and camera-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import flow, frames, joins
from reelspark.plans import adapters as A
from reelspark.plans.check_views import with_views
from reelspark.plans.registry import query

_CUT_OFFSETS = """
    SELECT c.track_id, c.event_id, c.sec, e.sec AS nearest_sec, c.sec - e.sec AS offset_sec
    FROM (SELECT * FROM v_track_events WHERE kind = 'beat') c
    LEFT JOIN (SELECT DISTINCT track_id, sec FROM v_track_events WHERE kind <> 'beat') e ON c.track_id = e.track_id
    QUALIFY row_number() OVER (PARTITION BY c.track_id, c.event_id ORDER BY abs(c.sec - e.sec), e.sec) = 1"""


def cut_offsets(spark, sf_dir):
    rows = A.track_events(spark, sf_dir)
    cuts = rows.where(F.col("kind") == "beat").select("track_id", "event_id", "sec")
    return joins.nearest(cuts, rows.where(F.col("kind") != "beat").select("track_id", "sec"), ["track_id"])


@query(
    "nearest_event_offsets",
    with_views("""SELECT track_id, event_id, round(sec, 6) AS sec, round(nearest_sec, 6) AS nearest_sec,
                  round(offset_sec, 6) AS offset_sec, printf('%.3f', round(nearest_sec * 1000) / 1000) AS label FROM v_cut_offsets""", {"v_cut_offsets": _CUT_OFFSETS}),
)
def nearest_event_offsets(spark, sf_dir):
    label = joins.event_label(F.round(F.col("nearest_sec") * 1000) / 1000)
    return cut_offsets(spark, sf_dir).select(
        "track_id", "event_id", "sec", "nearest_sec", F.round("offset_sec", 6).alias("offset_sec"), label.alias("label")
    )


@query(
    "cut_sync_ratio",
    with_views("""SELECT track_id AS video_id, count(*) AS cut_count,
                  round(avg(CASE WHEN abs(round(offset_sec, 6)) <= 0.08 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS synced_ratio
                  FROM v_cut_offsets GROUP BY track_id""", {"v_cut_offsets": _CUT_OFFSETS}),
)
def cut_sync_ratio(spark, sf_dir):
    """Share of cuts within 80 ms of a music event, per video."""
    cuts = cut_offsets(spark, sf_dir).select(F.col("track_id").alias("video_id"), F.round("offset_sec", 6).alias("music_offset_sec"))
    return frames.sync_ratio(cuts).select("video_id", "cut_count", F.round("synced_ratio", 6).alias("synced_ratio"))


@query(
    "event_within_tolerance",
    with_views("""SELECT b.track_id, b.event_id, EXISTS (SELECT 1 FROM v_track_events i WHERE i.track_id = b.track_id
                  AND i.kind = 'impact' AND abs(i.sec - b.sec) <= 0.12) AS near_impact
                  FROM v_track_events b WHERE kind = 'beat'"""),
)
def event_within_tolerance(spark, sf_dir):
    rows = A.track_events(spark, sf_dir)
    beats = rows.where(F.col("kind") == "beat").select("track_id", "event_id", "sec")
    impacts = rows.where(F.col("kind") == "impact").select("track_id", "sec")
    return joins.near_any(beats, impacts, ["track_id"], F.lit(0.12), "near_impact").select("track_id", "event_id", "near_impact")


_FLOW = {
    "v_flow_shots": """
        SELECT *, magnitude >= 0.45 AS directional, CASE WHEN magnitude >= 0.45 THEN
               ['right','down-right','down','down-left','left','up-left','up','up-right'][
               floor(((degrees(atan2(vy, vx)) + 202.5 + 360) % 360) / 45)::INT + 1] ELSE 'static' END AS direction
        FROM v_event_flow""",
    "v_flow_cuts": """
        SELECT video_id, "index", start_sec AS sec, angle, coalesce(angle <= 60, false) AS carried,
               coalesce(angle >= 120, false) AS reversed
        FROM (SELECT *, CASE WHEN directional AND ldir THEN CASE WHEN norm <= 1e-9 THEN 180.0
                     ELSE degrees(acos(greatest(-1.0, least(1.0, dot / norm)))) END END AS angle
              FROM (SELECT *, lx * vx + ly * vy AS dot, sqrt(lx*lx + ly*ly) * sqrt(vx*vx + vy*vy) AS norm
                    FROM (SELECT *, lag(vx) OVER w AS lx, lag(vy) OVER w AS ly, lag(directional) OVER w AS ldir
                          FROM v_flow_shots WINDOW w AS (PARTITION BY video_id ORDER BY "index")) WHERE ldir IS NOT NULL))""",
    "v_flow_bins": """
        SELECT video_id, direction, count(*) AS n FROM v_flow_shots WHERE directional GROUP BY ALL""",
    "v_flow_entropy": """
        SELECT video_id, -sum(n / t * ln(n / t)) / ln(8) AS direction_entropy
        FROM (SELECT *, (sum(n) OVER (PARTITION BY video_id))::DOUBLE AS t FROM v_flow_bins) GROUP BY video_id""",
    "v_flow_measure": """
        SELECT s.video_id, s.shot_count, s.directional_shot_frac, s.mean_abs_vx, s.median_magnitude,
               coalesce(c.carry_rate, 0) AS carry_rate, coalesce(c.reversal_rate, 0) AS reversal_rate,
               coalesce(e.direction_entropy, 0) AS direction_entropy
        FROM (SELECT video_id, count(*) AS shot_count, avg(directional::INT) AS directional_shot_frac,
                     avg(abs(vx)) AS mean_abs_vx, quantile_cont(magnitude, 0.5) AS median_magnitude
              FROM v_flow_shots GROUP BY video_id) s
        LEFT JOIN (SELECT video_id, avg(carried::INT) AS carry_rate, avg(reversed::INT) AS reversal_rate
                   FROM v_flow_cuts GROUP BY video_id) c USING (video_id)
        LEFT JOIN v_flow_entropy e USING (video_id)""",
}


@query(
    "flow_shot_labels",
    with_views("""SELECT video_id, "index", directional, direction, round(magnitude, 6) AS magnitude FROM v_flow_shots""", _FLOW),
)
def flow_shot_labels(spark, sf_dir):
    return flow.label_shots(A.event_flow(spark, sf_dir)).select(
        "video_id", "index", "directional", "direction", F.round("magnitude", 6).alias("magnitude")
    )


@query(
    "flow_cut_carry",
    with_views("""SELECT video_id, "index", sec, round(angle, 3) AS angle_delta_deg, carried, reversed FROM v_flow_cuts""", _FLOW),
)
def flow_cut_carry(spark, sf_dir):
    return flow.cut_carry(flow.label_shots(A.event_flow(spark, sf_dir)))


@query(
    "flow_direction_entropy",
    with_views("SELECT video_id, round(direction_entropy, 6) AS direction_entropy FROM v_flow_entropy", _FLOW),
)
def flow_direction_entropy(spark, sf_dir):
    out = flow.direction_entropy(flow.label_shots(A.event_flow(spark, sf_dir)))
    return out.select("video_id", F.round("direction_entropy", 6).alias("direction_entropy"))


def measured_flow(spark, sf_dir):
    return flow.measure(A.event_flow(spark, sf_dir))


measured_flow_t = A.staged(measured_flow)

_MEASURES = ("directional_shot_frac", "carry_rate", "reversal_rate", "direction_entropy", "median_magnitude", "mean_abs_vx")


@query(
    "flow_measurement",
    with_views("SELECT video_id, shot_count, " + ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES) + " FROM v_flow_measure", _FLOW),
)
def flow_measurement(spark, sf_dir):
    out = measured_flow(spark, sf_dir)
    return out.select("video_id", "shot_count", *[F.round(m, 6).alias(m) for m in _MEASURES])


@query(
    "flow_comparison_gate",
    with_views("""
        WITH pairs AS (SELECT s.video_id AS pair_id, s.directional_shot_frac - r.directional_shot_frac AS f, s.carry_rate - r.carry_rate AS c,
               s.reversal_rate - r.reversal_rate AS v, s.direction_entropy - r.direction_entropy AS e,
               CASE WHEN r.median_magnitude > 1e-6 THEN s.median_magnitude / r.median_magnitude ELSE 1 END AS m
        FROM v_flow_measure s JOIN v_flow_measure r ON r.video_id = s.video_id + 1),
        marks AS (SELECT pair_id, unnest([CASE WHEN f < -0.15 THEN 'directional_shot_frac:below' END,
                  CASE WHEN c < -0.15 THEN 'carry_rate:below' WHEN c > 0.2 THEN 'carry_rate:above' END,
                  CASE WHEN v < -0.12 THEN 'reversal_rate:below' END, CASE WHEN e < -0.15 THEN 'direction_entropy:below' END,
                  CASE WHEN m < 0.65 THEN 'median_magnitude:ratio' END]) AS failure FROM pairs)
        SELECT pair_id, count(failure) AS failure_count, coalesce(string_agg(failure, ',' ORDER BY failure), '') AS failures,
               count(failure) = 0 AS passed FROM marks GROUP BY pair_id""", _FLOW),
)
def flow_comparison_gate(spark, sf_dir):
    """Every video against the one with the next id."""
    measured = measured_flow_t(spark, sf_dir)
    subject = measured.withColumn("pair_id", F.col("video_id"))
    reference = measured.withColumn("pair_id", F.col("video_id") - 1)
    verdict = flow.gate(flow.compare(subject, reference))
    return verdict.select("pair_id", "failure_count", F.array_join("failures", ",").alias("failures"), "passed")
