"""DuckDB text of the adapter views, and a helper that puts the needed ones in front of a query."""

from __future__ import annotations

import re

from reelspark.plans.adapters import EPOCH_MICROS, MICROS_PER_SEC, REQUEST_CYCLE

_LABELS = "['none','right','down-right','down','down-left','left','up-left','up','up-right']"
_CYCLE = "[" + ",".join(f"'{s}'" for s in REQUEST_CYCLE) + "]"

VIEWS: dict[str, str] = {
    "v_track_events": f"""
        SELECT user_id AS track_id, event_id,
               round((epoch_us(ts) - {EPOCH_MICROS})::DOUBLE / {MICROS_PER_SEC!r}, 4) AS sec,
               CASE event_type WHEN 'purchase' THEN 'impact' WHEN 'signup' THEN 'downbeat'
                    WHEN 'error' THEN 'silence_hit' ELSE 'beat' END AS kind,
               round(least(value / 100.0::DOUBLE, 1.0::DOUBLE), 4) AS energy, value
        FROM events""",
    "v_tracks": """
        SELECT track_id, (ceil(max(sec)) + 1)::DOUBLE AS duration_sec, (90 + track_id % 60)::DOUBLE AS bpm
        FROM v_track_events GROUP BY track_id""",
    "v_beats": """
        SELECT track_id, sec, max(energy) AS energy, max(CASE WHEN kind = 'downbeat' THEN 1 ELSE 0 END) AS is_downbeat
        FROM v_track_events WHERE kind IN ('beat', 'downbeat') GROUP BY track_id, sec""",
    "v_points": """
        SELECT DISTINCT track_id, sec, kind, energy FROM v_track_events WHERE kind IN ('impact', 'silence_hit')""",
    "v_intervals": """
        SELECT DISTINCT track_id, ['silence','break','riser'][event_id % 3 + 1] AS kind, sec AS start_sec,
               round(sec + 0.05::DOUBLE + energy * 0.5::DOUBLE, 6) AS end_sec, energy
        FROM v_track_events WHERE kind = 'silence_hit'""",
    "v_audio_frames": """
        SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY sec, event_id) - 1 AS i, sec,
               energy AS rms, value / 10.0::DOUBLE AS onset_strength,
               round(value * 40.0::DOUBLE + event_id % 97, 4) AS centroid,
               kind = 'impact' AS is_onset, kind IN ('beat', 'downbeat') AS is_beat
        FROM v_track_events""",
    "v_frames": """
        SELECT video_id, frame_idx, e[1] * 40 AS tx, e[2] * 40 AS ty, least(1.0::DOUBLE, abs(e[3]) * 5) AS confidence,
               0.5::DOUBLE + e[4] * 2 AS brightness, abs(e[5]) * 8000 AS sharpness,
               e[6] * 0.1::DOUBLE AS log_scale, e[7] * 3 AS rotation,
               CASE WHEN abs(e[8]) > 0.06 THEN least(1.0::DOUBLE, abs(e[8]) * 4) END AS face_confidence,
               least(1.0::DOUBLE, abs(e[9]) * 4) AS frontal_probability,
               least(1.0::DOUBLE, abs(e[10]) * 5) AS eyes_visible_ratio,
               list_transform(e[5:64], lambda x: x * x) AS hist,
               list_transform(e[6:25], lambda x: least(255.0::DOUBLE, abs(x) * 600)) AS edge,
               list_transform(e[26:64], lambda x: least(255.0::DOUBLE, abs(x) * 900)) AS px
        FROM (SELECT label::BIGINT AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
                     embedding::DOUBLE[] AS e FROM embeddings)""",
    "v_cut_candidates": """
        SELECT video_id, frame_idx, frame_idx / 24.0::DOUBLE AS sec FROM v_frames WHERE sharpness > 1500""",
    "v_videos": """
        SELECT video_id, count(*) AS frame_count, 24.0::DOUBLE AS fps, count(*) / 24.0::DOUBLE AS duration_sec,
               640 AS width, 360 AS height FROM v_frames GROUP BY video_id""",
    "v_event_flow": """
        SELECT track_id AS video_id, row_number() OVER (PARTITION BY track_id ORDER BY sec, event_id) - 1 AS "index",
               sec AS start_sec, (value - 50.0::DOUBLE) / 20.0::DOUBLE AS vx, (event_id % 17 - 8) / 4.0::DOUBLE AS vy,
               sqrt(pow((value - 50.0::DOUBLE) / 20.0::DOUBLE, 2) + pow((event_id % 17 - 8) / 4.0::DOUBLE, 2)) AS magnitude
        FROM v_track_events""",
    "v_order_lines": """
        SELECT l_orderkey, l_linenumber, sum(l_quantity) AS quantity, round(sum(l_discount), 4) AS discount,
               round(max(l_extendedprice), 2) AS price, min(l_returnflag) AS flag, min(l_linestatus) AS status,
               min(l_partkey) AS partkey
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_shots": f"""
        SELECT l_orderkey || '-' || l_linenumber AS shot_id, l_orderkey AS asset_id, start_sec,
               round(start_sec + d, 4) AS end_sec, CASE WHEN partkey % 5 <> 0 THEN flag END AS character,
               {_LABELS}[partkey % 9 + 1] AS entry_dir, {_LABELS}[floor(price)::BIGINT % 9 + 1] AS exit_dir
        FROM (SELECT *, round(coalesce(sum(d) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start_sec
              FROM (SELECT *, round(quantity * 0.05::DOUBLE, 4) AS d FROM v_order_lines))""",
    "v_assets": """
        SELECT o_orderkey AS asset_id, o_custkey AS pool_id, o_orderpriority AS series,
               '/media/' || o_orderkey || '.mov' AS path,
               CASE WHEN o_orderkey % 3 = 0 THEN '/proxy/' || o_orderkey || '.mp4' END AS proxy_path,
               (CASE o_orderkey % 4 WHEN 0 THEN 24000 WHEN 1 THEN 24 WHEN 2 THEN 30000 ELSE 60000 END)::BIGINT AS fps_num,
               (CASE o_orderkey % 4 WHEN 1 THEN 1 ELSE 1001 END)::BIGINT AS fps_den,
               o_orderstatus <> 'F' AS source_present, sha256('asset:' || o_orderkey) AS sha256
        FROM orders""",
    "v_pool_shots": """
        SELECT s.*, a.pool_id, a.series FROM v_shots s JOIN v_assets a USING (asset_id)""",
    "v_media_inventory": """
        SELECT path FROM v_assets WHERE source_present
        UNION ALL SELECT proxy_path FROM v_assets WHERE proxy_path IS NOT NULL AND series <> '5-LOW'
        UNION ALL SELECT '/archive/' || shot_id || '.mkv' FROM v_pool_shots
                  WHERE series IN ('1-URGENT','2-HIGH','3-MEDIUM')""",
    "v_present_media": """
        SELECT asset_id, min_by(path, place) AS media
        FROM (SELECT asset_id, 0 AS place, proxy_path AS path FROM v_assets WHERE proxy_path IS NOT NULL UNION ALL SELECT asset_id, 1, path FROM v_assets WHERE path IS NOT NULL)
        WHERE path IN (SELECT path FROM v_media_inventory) GROUP BY asset_id""",
    "v_tags": """
        SELECT l_orderkey || '-' || l_linenumber AS shot_id,
               CASE WHEN l_linestatus = 'F' THEN 'character' ELSE 'scene' END AS category,
               p_brand AS value, l_discount * 10 AS confidence
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_slots": f"""
        SELECT l_orderkey AS project_id, row_number() OVER w - 1 AS slot_index,
               round(coalesce(sum(d) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start_sec,
               d AS duration_sec,
               CASE WHEN l_linenumber = 1 THEN 'none' WHEN flag = 'A' THEN 'carry' WHEN flag = 'R' THEN 'reverse'
                    WHEN status = 'F' THEN 'reset' ELSE 'none' END AS entry_motion,
               quantity::BIGINT % 4 = 0 AS hold,
               {_LABELS}[partkey % 7 + 1] AS entry_direction, {_LABELS}[partkey % 5 + 1] AS exit_direction,
               CASE WHEN partkey % 3 = 0 THEN flag END AS required_identity,
               o_custkey AS pool_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS required_series
        FROM (SELECT *, round(0.02::DOUBLE + discount * 12, 4) AS d FROM v_order_lines)
        JOIN orders ON o_orderkey = l_orderkey
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""",
    "v_state_requests": f"""
        SELECT track_id AS project_id, seq, sec,
               CASE WHEN failing THEN 'fail' ELSE 'enter' END AS action,
               CASE WHEN NOT failing THEN {_CYCLE}[walked % {len(REQUEST_CYCLE)} + 1] END AS target,
               value > 5 AS technical_qa_passed
        FROM (SELECT *, kind = 'silence_hit' AND seq > 0 AS failing
              FROM (SELECT *, row_number() OVER w - 1 AS seq,
                           coalesce(sum(step) OVER (PARTITION BY track_id ORDER BY sec, event_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS walked
                    FROM (SELECT *, CASE WHEN kind IN ('impact','downbeat') THEN 1
                                         WHEN kind = 'beat' THEN event_id % 2 ELSE 0 END AS step FROM v_track_events)
                    WINDOW w AS (PARTITION BY track_id ORDER BY sec, event_id)))""",
    "v_media_logs": """
        SELECT track_id AS render_id,
               CASE WHEN s IN (0, 4) THEN 'silencedetect' WHEN s IN (1, 2) THEN 'freezedetect' WHEN s = 3 THEN 'blackdetect'
                    WHEN s = 5 THEN 'ebur128' ELSE 'decode' END AS filter, line_no,
               CASE s WHEN 0 THEN '[silencedetect] silence_start: ' || printf('%.6f', sec)
                      WHEN 1 THEN '[freezedetect] freeze_start: ' || printf('%.6f', sec)
                      WHEN 2 THEN '[freezedetect] freeze_end: ' || printf('%.6f', sec)
                      WHEN 3 THEN 'black_start:0 black_duration:' || printf('%.6f', round(energy * 0.36::DOUBLE, 4))
                      WHEN 4 THEN '[silencedetect] silence_end: ' || printf('%.6f', sec)
                      WHEN 5 THEN '  I:  -' || printf('%.6f', energy + 10) || ' LUFS'
                      ELSE CASE WHEN s = 6 AND event_id % 50 = 0 THEN 'Error while decoding MB 3 4; CORRUPT frame'
                                ELSE 'frame= 100 fps=24' END END AS line
        FROM (SELECT *, line_no % 8 AS s FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY sec, event_id) - 1 AS line_no
              FROM v_track_events))""",
}


def _needed(text: str, seen: dict[str, None], extra: dict[str, str]) -> None:
    pool = {**VIEWS, **extra}
    for name in re.findall(r"\bv_[a-z_]+\b", text):
        if name in pool and name not in seen:
            _needed(pool[name], seen, extra)
            seen[name] = None


def with_views(query: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix `query` with the views it names, directly or through other views."""
    extra = extra or {}
    seen: dict[str, None] = {}
    _needed(query, seen, extra)
    pool = {**VIEWS, **extra}
    head = ",\n".join(f"{name} AS MATERIALIZED ({pool[name]})" for name in seen)
    if not head:
        return query
    joined = query.strip()
    if re.match(r"WITH\s", joined):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{joined[4:]}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{joined}"
