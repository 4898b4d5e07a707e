"""Queries over rhythm slots, candidates and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import directions
from reelspark.operators import candidates, joins, rhythm, sequence
from reelspark.plans import adapters as A
from reelspark.plans import frame_queries as FQ
from reelspark.plans import music_queries as MQ
from reelspark.plans.check_views import with_views
from reelspark.plans.registry import query


def _r(*names: str, places: int = 6):
    return [F.round(n, places).alias(n) for n in names]


_PRIORITY = "CASE kind WHEN 'section_boundary' THEN 5 WHEN 'downbeat' THEN 4 WHEN 'impact' THEN 4 WHEN 'break_exit' THEN 3 WHEN 'riser_peak' THEN 3 WHEN 'break_entry' THEN 2 ELSE 1 END"
_UNIFORM = "('0x' || substr(sha256({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"

RHYTHM_VIEWS = {
    **FQ.FRAME_VIEWS,
    **MQ.MUSIC_VIEWS,
    "v_rhythm_projects": """
        SELECT t.track_id AS project_id, t.track_id, s.video_id, t.duration_sec, s.cut_density, s.hold_ratio, s.reversal_ratio,
               ('0x' || substr(sha256('v' || s.video_id || ':m' || t.track_id), 1, 8))::BIGINT AS seed
        FROM v_tracks t JOIN v_style s ON s.video_id = t.track_id % 10""",
    "v_chosen": f"""
        SELECT project_id, track_id, sec, kind FROM (
            SELECT p.project_id, p.track_id, a.sec, a.kind, greatest(1, round_even(p.cut_density * p.duration_sec, 0)) AS k,
                   row_number() OVER (PARTITION BY p.project_id ORDER BY {_PRIORITY} DESC, a.sec, a.kind) AS rn
            FROM v_rhythm_projects p JOIN (SELECT DISTINCT track_id, sec, kind FROM v_accents UNION SELECT track_id, 0, 'section_boundary' FROM v_tracks) a USING (track_id))
        WHERE rn <= k""",
    "v_transfer": f"""
        SELECT b.project_id, i AS slot_index, b.sec AS start_sec, b.nxt - b.sec AS duration_sec, b.kind AS music_event_kind,
               coalesce(o.visual_energy, 0.5) AS target_energy, {_UNIFORM.format(text="b.seed || ':' || i || ':hold'")} < b.hold_ratio AS hold,
               CASE WHEN i = 0 THEN 'none' ELSE draws[floor({_UNIFORM.format(text="b.seed || ':' || i || ':motion'")} * len(draws))::INT + 1] END AS entry_motion,
               coalesce(CASE WHEN p_portrait >= p_action AND p_portrait >= p_hold THEN 'portrait' WHEN p_action >= p_hold THEN 'action' ELSE 'hold' END, 'generic') AS slot_kind,
               coalesce(o.motion_direction, 'none') AS entry_direction
        FROM (SELECT e.*, p.video_id, p.hold_ratio, p.seed, n.n, least(n.n - 1, floor(i / greatest(1, m - 2)::DOUBLE * n.n)::BIGINT) AS pick,
                     list_concat(list_concat(list_resize([]::VARCHAR[], greatest(1, round_even(p.reversal_ratio / w * 20, 0))::BIGINT, 'reverse'),
                                             list_resize([]::VARCHAR[], greatest(1, round_even(greatest(0, 1 - p.reversal_ratio - p.hold_ratio) / w * 20, 0))::BIGINT, 'carry')),
                                 list_concat(list_resize([]::VARCHAR[], greatest(1, round_even(p.hold_ratio * 0.5::DOUBLE / w * 20, 0))::BIGINT, 'reset'),
                                             list_resize([]::VARCHAR[], greatest(1, round_even(p.hold_ratio * 0.5::DOUBLE / w * 20, 0))::BIGINT, 'none'))) AS draws
              FROM (SELECT *, row_number() OVER w1 - 1 AS i, lead(sec) OVER w1 AS nxt, count(*) OVER (PARTITION BY project_id) AS m
                    FROM (SELECT project_id, sec, max(kind) AS kind FROM (SELECT project_id, sec, min(kind) AS kind FROM v_chosen GROUP BY ALL
                          UNION ALL SELECT project_id, 0, NULL FROM v_rhythm_projects UNION ALL SELECT project_id, duration_sec, NULL FROM v_rhythm_projects) GROUP BY ALL)
                    WINDOW w1 AS (PARTITION BY project_id ORDER BY sec)) e
              JOIN (SELECT *, CASE WHEN s = 0 THEN 1 ELSE s END AS w FROM (SELECT *, reversal_ratio + greatest(0, 1 - reversal_ratio - hold_ratio) + hold_ratio AS s FROM v_rhythm_projects)) p USING (project_id)
              LEFT JOIN (SELECT video_id, count(*) AS n FROM v_observed_shots GROUP BY video_id) n ON n.video_id = p.video_id
              WHERE nxt IS NOT NULL) b
        LEFT JOIN v_observed_shots o ON o.video_id = b.video_id AND o."index" = b.pick""",
}


def _sql(text: str) -> str:
    return with_views(text, RHYTHM_VIEWS)


def rhythm_projects(spark, sf_dir):
    """Every track is paired with the video whose number is the last digit of its own."""
    tracks = A.tracks(spark, sf_dir).withColumn("video_id", F.pmod("track_id", F.lit(10)))
    style = FQ.style_t(spark, sf_dir).select("video_id", "cut_density", "hold_ratio", "reversal_ratio")
    seed = rhythm.plan_seed(F.concat(F.lit("v"), "video_id"), F.concat(F.lit("m"), "track_id"))
    return tracks.join(style, "video_id").select(
        F.col("track_id").alias("project_id"), "track_id", "video_id", "duration_sec", "cut_density", "hold_ratio", "reversal_ratio", seed.alias("seed"))


rhythm_projects_t = A.staged(rhythm_projects)


def boundaries(spark, sf_dir):
    return rhythm.select_boundaries(rhythm_projects_t(spark, sf_dir), MQ.accents_t(spark, sf_dir))


boundaries_t = A.staged(boundaries, "rhythm_boundaries")


def transfer_slots(spark, sf_dir):
    return rhythm.transfer_slots(rhythm_projects_t(spark, sf_dir), boundaries_t(spark, sf_dir), FQ.observed_shots_t(spark, sf_dir))


@query("mapping_mode", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey % 7 = o_orderkey % 7 THEN 'exact_replica' ELSE 'style_transfer' END AS mode FROM orders")
def mapping_mode(spark, sf_dir):
    ref = F.when(F.col("o_orderstatus") == "O", F.pmod("o_custkey", F.lit(7)).cast("string"))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", rhythm.mapping_mode(ref, F.pmod("o_orderkey", F.lit(7)).cast("string")).alias("mode"))


@query("exact_replica_slots", _sql("""
    SELECT s.video_id, s."index" AS slot_index, round(s.start_sec, 6) AS start_sec, round(s.duration_sec, 6) AS duration_sec, round(s.visual_energy, 6) AS target_energy, s.translation < 0.4 AS hold,
           CASE WHEN c.relation IN ('carry', 'reverse', 'reset') THEN c.relation ELSE 'none' END AS entry_motion,
           CASE WHEN p_portrait >= p_action AND p_portrait >= p_hold THEN 'portrait' WHEN p_action >= p_hold THEN 'action' ELSE 'hold' END AS slot_kind,
           s.action >= 0.6 AS hero_frame_required, nullif(s.subject_count, 0) AS preferred_subject_count
    FROM v_observed_shots s LEFT JOIN v_observed_cuts c ON c.video_id = s.video_id AND c.sec = s.start_sec"""))
def exact_replica_slots(spark, sf_dir):
    rows = rhythm.exact_slots(FQ.observed_shots_t(spark, sf_dir), FQ.observed_cuts_t(spark, sf_dir))
    return rows.select("video_id", "slot_index", *_r("start_sec", "duration_sec", "target_energy"), "hold", "entry_motion", "slot_kind", "hero_frame_required", "preferred_subject_count")


@query("boundary_selection", _sql("SELECT project_id, sec, kind FROM v_chosen"))
def boundary_selection(spark, sf_dir):
    return boundaries(spark, sf_dir).select("project_id", "sec", "kind")


@query("style_transfer_slots", _sql("""SELECT project_id, slot_index, start_sec, round(duration_sec, 6) AS duration_sec, music_event_kind, round(target_energy, 6) AS target_energy,
       hold, entry_motion, slot_kind, entry_direction FROM v_transfer"""))
def style_transfer_slots(spark, sf_dir):
    return transfer_slots(spark, sf_dir).select(
        "project_id", "slot_index", "start_sec", *_r("duration_sec", "target_energy"), "music_event_kind", "hold", "entry_motion", "slot_kind", "entry_direction")


@query("entry_motion_distribution", """
    SELECT DISTINCT l_discount AS hold_ratio, l_tax AS reversal_ratio, greatest(1, round_even(l_tax / w * 20, 0))::BIGINT AS reverse,
           greatest(1, round_even((1 - l_tax - l_discount) / w * 20, 0))::BIGINT AS carry, greatest(1, round_even(l_discount * 0.5::DOUBLE / w * 20, 0))::BIGINT AS reset
    FROM (SELECT l_discount, l_tax, l_tax + greatest(0, 1 - l_tax - l_discount) + l_discount * 0.5::DOUBLE + l_discount * 0.5::DOUBLE AS w FROM lineitem)""")
def entry_motion_distribution(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("hold_ratio"), F.col("l_tax").alias("reversal_ratio")).distinct()
    rows = rows.withColumn("_d", rhythm.motion_draws(F.col("reversal_ratio"), F.col("hold_ratio")))
    return rows.select("hold_ratio", "reversal_ratio", *[F.size(F.filter("_d", lambda d: d == k)).cast("bigint").alias(k) for k in ("reverse", "carry", "reset")])


@query("short_slot_merge", with_views("""
    SELECT project_id, min(slot_index) AS slot_index, min(start_sec) AS start_sec, round(sum(duration_sec), 4) AS duration_sec
    FROM (SELECT *, sum(CASE WHEN duration_sec >= 0.08 OR slot_index = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY slot_index) AS g FROM v_slots) GROUP BY project_id, g"""))
def short_slot_merge(spark, sf_dir):
    rows = rhythm.merge_short(A.slots(spark, sf_dir).select("project_id", "slot_index", "start_sec", "duration_sec"))
    return rows.withColumn("duration_sec", F.round("duration_sec", 4))


# ---- candidates ------------------------------------------------------------------------------

_VECTORS = ", ".join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE)" for n, (x, y) in directions.VECTORS.items())

CANDIDATE_VIEWS = {
    "v_vectors": f"SELECT * FROM (VALUES {_VECTORS}) t(name, x, y)",
    "v_dirs": """SELECT a.name AS a, b.name AS b, CASE WHEN a.name = 'none' OR b.name = 'none' THEN 0.75 ELSE greatest(0, least(1, (a.x * b.x + a.y * b.y + 1) / 2)) END AS sim,
                 CASE WHEN a.name = 'none' OR b.name = 'none' THEN 0 ELSE a.x * b.x + a.y * b.y END AS cosine FROM v_vectors a CROSS JOIN v_vectors b""",
    "v_scored": """
        SELECT s.project_id, s.slot_index, h.shot_id, h.asset_id, h.character, h.series, h.entry_dir, h.exit_dir, s.duration_sec,
               h.start_sec + (h.end_sec - h.start_sec - s.duration_sec) / 2 AS in_sec, h.start_sec + (h.end_sec - h.start_sec - s.duration_sec) / 2 + s.duration_sec AS out_sec,
               round(0.35::DOUBLE * 0.7::DOUBLE + 0.35::DOUBLE + 0.15::DOUBLE * (0.5::DOUBLE * e.sim + 0.5::DOUBLE * x.sim)
                     + 0.075::DOUBLE * CASE WHEN s.required_identity IS NULL OR h.character IS NULL OR s.required_identity = h.character THEN 1 ELSE 0 END
                     + 0.075::DOUBLE * CASE WHEN s.required_series IS NULL OR h.series IS NULL OR s.required_series = h.series THEN 1 ELSE 0 END, 12) AS score
        FROM v_slots s JOIN v_pool_shots h ON h.pool_id = s.pool_id AND h.end_sec - h.start_sec >= s.duration_sec
        JOIN v_dirs e ON e.a = h.entry_dir AND e.b = s.entry_direction JOIN v_dirs x ON x.a = h.exit_dir AND x.b = s.exit_direction""",
    "v_ranked": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, slot_index ORDER BY score DESC, shot_id || ':') AS rank FROM v_scored) WHERE rank <= 30""",
}


def top_candidates(spark, sf_dir, columns=candidates.COLUMNS, first=None):
    return candidates.top_candidates(A.slots(spark, sf_dir), A.pool_shots(spark, sf_dir), columns=columns, first=first)


def pools(spark, sf_dir):
    """The same candidates, ranked where a sequence reads them."""
    return candidates.Pools(A.slots(spark, sf_dir), A.pool_shots(spark, sf_dir))


@query("top_candidates", with_views("SELECT project_id, slot_index, rank::INT AS rank, shot_id, round(in_sec, 6) AS in_sec, round(out_sec, 6) AS out_sec, score FROM v_ranked", CANDIDATE_VIEWS))
def top_candidate_rows(spark, sf_dir):
    """Thirty best windows per slot from the customer's shots."""
    columns = ("project_id", "slot_index", "rank", "shot_id", "in_sec", "out_sec", "score")
    return top_candidates(spark, sf_dir, columns).select(*columns[:4], *_r("in_sec", "out_sec"), "score")


@query("candidate_counts", with_views("SELECT project_id, slot_index, least(30, count(*)) AS candidates, max(score) AS best_score FROM v_scored GROUP BY ALL", CANDIDATE_VIEWS))
def candidate_counts(spark, sf_dir):
    rows = top_candidates(spark, sf_dir, ("project_id", "slot_index", "score"))
    return rows.groupBy("project_id", "slot_index").agg(F.count(F.lit(1)).alias("candidates"), F.max("score").alias("best_score"))


@query("available_candidates", with_views("""SELECT shot_id, asset_id, media FROM v_shots JOIN v_present_media USING (asset_id)"""))
def available_candidates(spark, sf_dir):
    assets = A.assets(spark, sf_dir).select("asset_id", "path", "proxy_path")
    return candidates.available_shots(A.shots(spark, sf_dir), assets, A.media_inventory(spark, sf_dir)).select("shot_id", "asset_id", "media")


@query("centred_trims", with_views("""SELECT s.project_id, s.slot_index, h.shot_id, round(h.start_sec + (h.end_sec - h.start_sec - s.duration_sec) / 2, 6) AS in_sec
       FROM v_slots s JOIN v_shots h ON h.shot_id = s.project_id || '-' || (s.slot_index + 1) AND h.end_sec - h.start_sec >= s.duration_sec""", CANDIDATE_VIEWS))
def centred_trims(spark, sf_dir):
    slots = A.slots(spark, sf_dir).withColumn("shot_id", F.concat_ws("-", "project_id", F.col("slot_index") + 1))
    rows = slots.select("project_id", "slot_index", "duration_sec", "shot_id").join(A.shots(spark, sf_dir).select("shot_id", F.col("start_sec").alias("s"), "end_sec"), "shot_id")
    rows = rows.where(F.col("end_sec") - F.col("s") >= F.col("duration_sec"))
    return rows.select("project_id", "slot_index", "shot_id", F.round(candidates.trim_start(F.col("s"), F.col("end_sec"), F.col("duration_sec")), 6).alias("in_sec"))


@query("direction_agreement", with_views("""SELECT h.shot_id, e.sim AS similarity, round(e.cosine, 8) AS cosine FROM v_shots h JOIN v_dirs e ON e.a = h.entry_dir AND e.b = h.exit_dir""", CANDIDATE_VIEWS))
def direction_agreement(spark, sf_dir):
    a, b = F.col("entry_dir"), F.col("exit_dir")
    return A.shots(spark, sf_dir).select("shot_id", directions.similarity(a, b).alias("similarity"), F.round(directions.cosine(a, b), 8).alias("cosine"))


@query("continuity_bonus", with_views("""
    WITH n AS (SELECT *, lag(exit_dir) OVER w AS px, lag(character) OVER w AS pc, lag(series) OVER w AS ps, lag(asset_id) OVER w AS pa
               FROM (SELECT r.*, s.entry_motion AS relation FROM v_ranked r JOIN v_slots s USING (project_id, slot_index) WHERE rank = 1) WINDOW w AS (PARTITION BY project_id ORDER BY slot_index))
    SELECT project_id, slot_index, round(CASE WHEN pc IS NULL OR character IS NULL THEN 0 WHEN pc = character THEN 0.05 ELSE -0.1 END::DOUBLE
           + CASE WHEN ps <> series THEN -0.2 ELSE 0 END::DOUBLE
           + CASE WHEN relation = 'reset' THEN CASE WHEN entry_dir = 'none' THEN 0 ELSE -0.1 END WHEN relation = 'none' THEN 0 WHEN relation = 'carry' THEN 0.25 * d.cosine ELSE -0.25 * d.cosine END::DOUBLE
           + CASE WHEN pa = asset_id THEN -0.15 ELSE 0 END::DOUBLE, 9) AS bonus
    FROM n JOIN v_dirs d ON d.a = px AND d.b = entry_dir WHERE pa IS NOT NULL""", CANDIDATE_VIEWS))
def continuity_bonus(spark, sf_dir):
    """Bonus of each slot's best candidate against the best candidate of the slot before."""
    from pyspark.sql import Window

    best = top_candidates(spark, sf_dir, ("project_id", "slot_index", "asset_id", "character", "series", "entry_motion", "exit_motion"), first=1)
    relations = A.slots(spark, sf_dir).select("project_id", "slot_index", F.col("entry_motion").alias("relation"))
    best = joins.dealt_matches(best, relations, ["project_id", "slot_index"], "project_id")
    # One row per slot of an order: its line numbers, a small fixed domain.
    w = Window.partitionBy("project_id").orderBy("slot_index")
    rows = best.withColumns({f"_{c}": F.lag(c).over(w) for c in ("exit_motion", "character", "series", "asset_id")}).where(F.col("_asset_id").isNotNull())
    nothing = F.lit(None).cast("double")
    bonus = sequence.continuity_bonus(
        F.col("character"), F.col("_character"), F.col("series"), F.col("_series"), nothing, nothing, F.col("asset_id"), F.array("_asset_id"),
        sequence.motion_bonus(F.col("_exit_motion"), F.col("entry_motion"), F.col("relation")))
    return rows.select("project_id", "slot_index", F.round(bonus, 9).alias("bonus"))


def _beam_sql(width: int) -> str:
    """Beam search as a recursion over steps that keeps the best rows of every project."""
    clash = "(k.a = c.a AND (k.id = c.id OR greatest(0, least(k.e, c.e) - greatest(k.s, c.s)) / nullif(least(k.e - k.s, c.e - c.s), 0) > 0.5))"
    offer = "id := printf('%s:trim:%.3f-%.3f', shot_id, in_sec, out_sec), shot := shot_id, a := asset_id, s := in_sec, e := out_sec, score := score, ch := character, se := series, en := entry_dir, ex := exit_dir"
    fresh = f"list_filter(o.cands, lambda c: len(list_filter(w.chosen, lambda k: coalesce({clash}, false))) = 0)[1:{width}]"
    bonus = """(CASE WHEN w.who IS NULL OR c.ch IS NULL THEN 0 WHEN w.who = c.ch THEN 0.05 ELSE -0.1 END::DOUBLE
             + CASE WHEN w.se <> c.se THEN -0.2 ELSE 0 END::DOUBLE
             + CASE WHEN o.relation = 'reset' THEN CASE WHEN c.en = 'none' THEN 0 ELSE -0.25::DOUBLE * 0.4::DOUBLE END WHEN o.relation = 'none' OR w.ex = 'none' OR c.en = 'none' THEN 0
                    WHEN o.relation = 'carry' THEN d.cosine * 0.25::DOUBLE ELSE -d.cosine * 0.25::DOUBLE END::DOUBLE
             + CASE WHEN list_contains(list_transform(w.chosen[-3:], lambda k: k.a), c.a) THEN -0.15 ELSE 0 END::DOUBLE)"""
    return f"""
    WITH o AS (SELECT s.project_id, s.slot_index, s.entry_motion AS relation, row_number() OVER (PARTITION BY s.project_id ORDER BY s.slot_index) AS step, r.cands FROM v_slots s
               LEFT JOIN (SELECT project_id, slot_index, list(struct_pack({offer}) ORDER BY rank) AS cands FROM v_ranked GROUP BY ALL) r USING (project_id, slot_index)),
    seed AS (SELECT DISTINCT project_id, 0::BIGINT AS step, 0::DOUBLE AS total, [] AS ids, NULL::VARCHAR AS who, NULL::VARCHAR AS se, 'none' AS ex FROM o),
    walk AS (SELECT project_id, step, total, (SELECT list(struct_pack(slot := 0::BIGINT, id := '', shot := '', a := 0::BIGINT, s := 0::DOUBLE, e := 0::DOUBLE, gain := 0::DOUBLE)) FROM range(0)) AS chosen,
                    ids::VARCHAR[] AS ids, who, se, ex FROM seed
             UNION ALL
             SELECT project_id, step, total, chosen, ids, who, se, ex FROM (
               SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY total DESC, ids) AS place FROM (
                 SELECT project_id, step, CASE WHEN c IS NULL THEN total ELSE total + gain END AS total,
                        CASE WHEN c IS NULL THEN chosen ELSE list_append(coalesce(chosen, []), struct_pack(slot := slot_index, id := c.id, shot := c.shot, a := c.a, s := c.s, e := c.e, gain := gain)) END AS chosen,
                        CASE WHEN c IS NULL THEN ids ELSE list_append(ids, c.id) END AS ids, coalesce(c.ch, who) AS who, coalesce(c.se, se) AS se, coalesce(c.ex, ex) AS ex
                 FROM (SELECT w.project_id, o.step, o.slot_index, w.total, w.chosen, w.ids, w.who, w.se, w.ex, c, c.score + CASE WHEN o.step = 1 THEN 0::DOUBLE ELSE {bonus} END AS gain
                       FROM (SELECT w.*, o.slot_index AS o_slot, unnest(CASE WHEN o.cands IS NULL THEN [NULL] WHEN len({fresh}) > 0 THEN {fresh} ELSE o.cands[1:{width}] END) AS c
                             FROM walk w JOIN o ON o.project_id = w.project_id AND o.step = w.step + 1) w
                       JOIN o ON o.project_id = w.project_id AND o.slot_index = w.o_slot
                       LEFT JOIN v_dirs d ON d.a = w.ex AND d.b = c.en)))
             WHERE place <= {width}),
    best AS (SELECT project_id, total, chosen FROM walk JOIN (SELECT project_id, max(step) AS step FROM o GROUP BY ALL) USING (project_id, step)
             QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY total DESC, ids) = 1),
    picks AS (SELECT project_id, unnest(chosen) AS k FROM best)
    SELECT o.project_id, o.slot_index, coalesce(k.shot, '') AS shot_id, round(coalesce(k.s, 0), 6) AS in_sec, round(coalesce(k.e, 0), 6) AS out_sec,
           round(coalesce(k.gain, 0)::VARCHAR::DECIMAL(38, 18), 9)::DOUBLE AS score, round(total::VARCHAR::DECIMAL(38, 18), 9)::DOUBLE AS total_score
    FROM o JOIN best USING (project_id) LEFT JOIN picks p ON p.project_id = o.project_id AND p.k.slot = o.slot_index"""


@query("beam_sequence", with_views(_beam_sql(6), CANDIDATE_VIEWS, recursive=True))
def beam_sequence(spark, sf_dir):
    """Beam of six over every project's slots."""
    out = sequence.plan_sequence(A.slots(spark, sf_dir), pools(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return out.select("project_id", "slot_index", "shot_id", *_r("in_sec", "out_sec"), "score", "total_score")


@query("greedy_sequence", with_views("""
    WITH o AS (SELECT s.project_id, s.slot_index, row_number() OVER (PARTITION BY s.project_id ORDER BY s.slot_index) AS step, r.cands FROM v_slots s
               LEFT JOIN (SELECT project_id, slot_index, list(struct_pack(id := shot_id, a := asset_id, s := in_sec, e := out_sec) ORDER BY rank) AS cands FROM v_ranked GROUP BY ALL) r USING (project_id, slot_index)),
    walk AS (SELECT project_id, slot_index, step, CASE WHEN cands IS NULL THEN [] ELSE [cands[1]] END AS chosen, cands[1].id AS shot_id FROM o WHERE step = 1
             UNION ALL SELECT project_id, slot_index, step, CASE WHEN pick IS NULL THEN chosen ELSE list_append(chosen, pick) END, pick.id
             FROM (SELECT o.project_id, o.slot_index, o.step, w.chosen, coalesce(list_filter(o.cands, lambda c: len(list_filter(w.chosen, lambda k: k.a = c.a
                          AND greatest(0, least(k.e, c.e) - greatest(k.s, c.s)) / least(k.e - k.s, c.e - c.s) > 0.5)) = 0)[1], o.cands[1]) AS pick
                   FROM walk w JOIN o ON o.project_id = w.project_id AND o.step = w.step + 1))
    SELECT project_id, slot_index, coalesce(shot_id, '') AS shot_id FROM walk""", CANDIDATE_VIEWS, recursive=True))
def greedy_sequence(spark, sf_dir):
    """Beam of one: the first candidate not yet used."""
    out = sequence.plan_sequence(A.slots(spark, sf_dir), pools(spark, sf_dir), beam_width=1)
    return out.select("project_id", "slot_index", "shot_id")


@query("plan_seed", with_views("""SELECT project_id, ('0x' || substr(sha256(project_id || '|' || string_agg(printf('%.3f:%.3f', start_sec, d), '|' ORDER BY slot_index)), 1, 8))::BIGINT AS seed
       FROM (SELECT project_id, slot_index, round(start_sec, 2) AS start_sec, round(duration_sec, 2) AS d FROM v_slots) GROUP BY project_id"""))
def plan_seed(spark, sf_dir):
    rows = A.slots(spark, sf_dir).select("project_id", "slot_index", F.round("start_sec", 2).alias("start_sec"), F.round("duration_sec", 2).alias("duration_sec"))
    return sequence.plan_seed(rows)
