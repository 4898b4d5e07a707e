"""Queries over logs, gates, validation and the workflow log."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import curves, intervals, ordered, qa, statelog, validate
from reelspark.plans import adapters as A
from reelspark.plans import frame_queries as FQ
from reelspark.plans import motion_queries as GQ
from reelspark.plans.check_views import with_views
from reelspark.plans.registry import query


def _r(*names: str, places: int = 6):
    return [F.round(n, places).alias(n) for n in names]


_KINDS = (("black_duration", "blackdetect", r"black_duration:([\d.]+)"), ("freeze_start", "freezedetect", r"freeze_start: ([\d.]+)"),
          ("freeze_end", "freezedetect", r"freeze_end: ([\d.]+)"), ("silence_start", "silencedetect", r"silence_start: ([\d.]+)"),
          ("silence_end", "silencedetect", r"silence_end: ([\d.]+)"), ("lufs", "ebur128", r"\bI:\s*(-?[\d.]+)\s*LUFS"))
_FRAGMENTS = """
    SELECT render_id, item, CASE WHEN i = 1 THEN s ELSE cover[i - 1].e END AS fs, CASE WHEN i > len(cover) THEN e ELSE cover[i].s END AS fe
    FROM (SELECT *, coalesce(cov, []) AS cover FROM (SELECT r.*, (SELECT list(struct_pack(s := greatest(r.s, a.start_sec), e := least(r.e, a.end_sec)) ORDER BY a.start_sec)
                FROM v_allowed_merged a WHERE a.render_id = r.render_id AND a.start_sec < r.e AND a.end_sec > r.s) AS cov FROM {source} r)), unnest(range(1, len(coalesce(cov, [])) + 2)) t(i)
    WHERE CASE WHEN i > len(cover) THEN e ELSE cover[i].s END > CASE WHEN i = 1 THEN s ELSE cover[i - 1].e END"""

GATE_VIEWS = {
    "v_log_events": " UNION ALL ".join(
        f"SELECT render_id, '{k}' AS kind, line_no, v::DOUBLE AS value, NULL AS marker FROM v_media_logs, unnest(regexp_extract_all(line, '{p}', 1)) t(v) WHERE filter = '{f}'" for k, f, p in _KINDS)
        + " UNION ALL SELECT render_id, 'corruption', line_no, NULL, v FROM v_media_logs, unnest(regexp_extract_all(line, '(Invalid data|corrupt|Error while decoding|missing picture)', 1, 'i')) t(v) WHERE filter = 'decode'",
    "v_positions": "SELECT *, row_number() OVER (PARTITION BY render_id, kind ORDER BY line_no) - 1 AS item FROM v_log_events WHERE kind <> 'corruption'",
    "v_freezes": "SELECT a.render_id, a.item, a.value AS s, b.value AS e FROM v_positions a JOIN v_positions b ON a.render_id = b.render_id AND a.item = b.item WHERE a.kind = 'freeze_start' AND b.kind = 'freeze_end'",
    "v_quiet": "SELECT a.render_id, a.item, a.value AS s, b.value AS e FROM v_positions a JOIN v_positions b ON a.render_id = b.render_id AND a.item = b.item WHERE a.kind = 'silence_start' AND b.kind = 'silence_end'",
    "v_allowed": "SELECT track_id AS render_id, start_sec - 1 AS start_sec, end_sec + 1 AS end_sec FROM v_intervals",
    "v_allowed_merged": """
        SELECT render_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM (SELECT *, sum(f) OVER (PARTITION BY render_id ORDER BY start_sec, end_sec) AS g
            FROM (SELECT *, CASE WHEN start_sec > max(end_sec) OVER (PARTITION BY render_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS f
                  FROM (SELECT DISTINCT * FROM v_allowed WHERE end_sec > start_sec))) GROUP BY render_id, g""",
    "v_freeze_left": _FRAGMENTS.format(source="v_freezes"),
    "v_quiet_left": _FRAGMENTS.format(source="v_quiet"),
    "v_renders": """
        SELECT track_id AS render_id, track_id % 13 <> 0 AS file_exists, track_id % 11 <> 0 AS has_video, duration_sec AS expected_duration, duration_sec + (track_id % 5) * 0.025::DOUBLE AS duration_sec,
               1920 AS expected_width, CASE WHEN track_id % 7 = 0 THEN 1280 ELSE 1920 END AS width, CASE WHEN track_id % 7 = 0 THEN 720 ELSE 1080 END AS height, 1080 AS expected_height,
               24000 AS fps_num, CASE WHEN track_id % 9 = 0 THEN 1000 ELSE 1001 END AS fps_den, track_id % 4 <> 0 AS expected_audio, track_id % 4 <> 0 AND track_id % 9 <> 1 AS has_audio,
               CASE WHEN track_id % 17 = 0 THEN 'vp9' ELSE 'h264' END AS codec, CASE WHEN track_id % 6 = 0 THEN 0 ELSE round_even(duration_sec * 24000 / 1001.0::DOUBLE, 0)::BIGINT + track_id % 5 END AS read_frames FROM v_tracks""",
    "v_measures": """
        SELECT t.track_id AS render_id, coalesce((SELECT max(value) FROM v_log_events WHERE kind = 'black_duration' AND render_id = t.track_id), 0) AS black_sec,
               coalesce((SELECT max(fe - fs) FROM v_freeze_left WHERE render_id = t.track_id), 0) AS freeze_sec, coalesce((SELECT max(fe - fs) FROM v_quiet_left WHERE render_id = t.track_id), 0) AS silence_sec,
               (SELECT arg_max(value, line_no) FROM v_log_events WHERE kind = 'lufs' AND render_id = t.track_id) AS lufs,
               (SELECT count(*) FROM v_log_events WHERE kind = 'corruption' AND render_id = t.track_id) AS corrupt FROM v_tracks t""",
    "v_checks": """
        WITH c AS (SELECT *, 24000 / 1001.0::DOUBLE AS want, fps_num / fps_den::DOUBLE AS fps, expected_audio AND has_audio AS listens FROM v_renders JOIN v_measures USING (render_id)),
        p AS (SELECT render_id, file_exists, has_video, unnest([struct_pack(n := 'file_exists', p := file_exists),
            struct_pack(n := 'duration', p := abs(duration_sec - expected_duration) <= greatest(0.08, 2 / want)), struct_pack(n := 'resolution', p := width = expected_width AND height = expected_height),
            struct_pack(n := 'fps', p := abs(fps - want) <= 0.002), struct_pack(n := 'codec', p := codec IN ('h264', 'hevc', 'prores')), struct_pack(n := 'audio_track', p := has_audio = expected_audio),
            struct_pack(n := 'aspect_ratio', p := width * expected_height = height * expected_width), struct_pack(n := 'black_frames', p := black_sec <= 0.35),
            struct_pack(n := 'freeze_frames', p := freeze_sec <= 0.75 + 1 / want), struct_pack(n := 'missing_frames', p := read_frames = 0 OR abs(read_frames - round_even(duration_sec * fps, 0)) <= 2),
            struct_pack(n := 'corruption', p := corrupt = 0), struct_pack(n := 'loudness', p := CASE WHEN listens THEN coalesce(abs(lufs + 11) <= 1.5, false) ELSE NOT expected_audio END),
            struct_pack(n := 'unexpected_silence', p := CASE WHEN listens THEN silence_sec <= 1 ELSE NOT expected_audio END)]) AS c FROM c)
        SELECT render_id, c.n AS name, CASE WHEN file_exists AND NOT has_video AND c.n = 'corruption' THEN false ELSE c.p END AS passed FROM p
        WHERE c.n = 'file_exists' OR (file_exists AND (has_video OR c.n = 'corruption'))""",
    "v_gate": "SELECT render_id, count(*) AS check_count, count(*) FILTER (NOT passed) AS failed_count, count(*) = 13 AND bool_and(passed) AS passed FROM v_checks GROUP BY render_id",
    **GQ.MOTION_VIEWS,
    "v_style_rows": "SELECT video_id, unnest([" + ", ".join(f"struct_pack(i := {i}, m := '{m}', v := {m}, t := {t}::DOUBLE)" for i, (m, t) in enumerate(qa.STYLE_TOLERANCES.items())) + "]) AS c FROM v_style",
    "v_compared": """
        SELECT r.video_id, r.c.i AS metric_rank, r.c.m AS metric, r.c.v AS reference, a.c.v AS actual, abs(a.c.v - r.c.v) AS difference, r.c.t / 4 AS tolerance, abs(a.c.v - r.c.v) <= r.c.t / 4 AS passed
        FROM v_style_rows r JOIN v_style_rows a ON a.video_id = (r.video_id + 1) % 10 AND a.c.i = r.c.i""",
}


def _sql(text: str) -> str:
    return with_views(text, GATE_VIEWS)


def log_events(spark, sf_dir):
    return qa.log_events(A.media_logs(spark, sf_dir))


log_events_t = A.staged(log_events)


def allowed(spark, sf_dir):
    """Ranges where stillness is meant: a second around every interval of the track."""
    return A.intervals(spark, sf_dir).select(
        F.col("track_id").alias("render_id"), (F.col("start_sec") - 1).alias("start_sec"), (F.col("end_sec") + 1).alias("end_sec"))


def renders(spark, sf_dir):
    """One render per track: what was asked for and what a probe found."""
    k = F.col("track_id")
    mod = lambda n: F.pmod(k, F.lit(n))
    small = mod(7) == 0
    return A.tracks(spark, sf_dir).select(
        k.alias("render_id"), (mod(13) != 0).alias("file_exists"), (mod(11) != 0).alias("has_video"), F.col("duration_sec").alias("expected_duration"),
        (F.col("duration_sec") + mod(5) * 0.025).alias("duration_sec"), F.lit(1920).alias("expected_width"), F.lit(1080).alias("expected_height"),
        F.when(small, 1280).otherwise(1920).alias("width"), F.when(small, 720).otherwise(1080).alias("height"), F.lit(24000).alias("expected_fps_num"), F.lit(1001).alias("expected_fps_den"),
        F.lit(24000).alias("fps_num"), F.when(mod(9) == 0, 1000).otherwise(1001).alias("fps_den"), (mod(4) != 0).alias("expected_audio"), ((mod(4) != 0) & (mod(9) != 1)).alias("has_audio"),
        F.when(mod(17) == 0, "vp9").otherwise("h264").alias("codec"), F.lit(0).alias("decode_code"),
        F.when(mod(6) == 0, F.lit(0)).otherwise(F.bround(F.col("duration_sec") * 24000 / 1001.0).cast("bigint") + mod(5)).alias("read_frames"))


def technical_checks(spark, sf_dir):
    measures = qa.log_measures(log_events_t(spark, sf_dir), allowed(spark, sf_dir), allowed(spark, sf_dir))
    return qa.technical_checks(renders(spark, sf_dir), measures)


technical_checks_t = A.staged(technical_checks)


@query("log_events", _sql("SELECT render_id, kind, line_no, round(value, 6) AS value, marker FROM v_log_events"))
def log_event_rows(spark, sf_dir):
    return log_events(spark, sf_dir).select("render_id", "kind", "line_no", *_r("value"), "marker")


@query("integrated_loudness", _sql("SELECT render_id, arg_max(value, line_no) AS lufs FROM v_log_events WHERE kind = 'lufs' GROUP BY render_id"))
def integrated_loudness(spark, sf_dir):
    return qa.last_loudness(log_events_t(spark, sf_dir))


@query("paired_freezes", _sql("SELECT render_id, item, s AS start_sec, e AS end_sec FROM v_freezes"))
def paired_freezes(spark, sf_dir):
    return qa.pair_ranges(log_events_t(spark, sf_dir), "freeze_start", "freeze_end")


@query("merged_allowed_ranges", _sql("SELECT render_id, start_sec, end_sec FROM v_allowed_merged"))
def merged_allowed_ranges(spark, sf_dir):
    return intervals.merge(allowed(spark, sf_dir), ["render_id"])


@query("unexpected_silence_fragments", _sql("SELECT render_id, item, round(fs, 6) AS start_sec, round(fe, 6) AS end_sec FROM v_quiet_left"))
def unexpected_silence_fragments(spark, sf_dir):
    """Observed silences with every allowed range taken out."""
    quiet = qa.pair_ranges(log_events_t(spark, sf_dir), "silence_start", "silence_end")
    return intervals.subtract(quiet, allowed(spark, sf_dir), ["render_id"], "item").select("render_id", "item", *_r("start_sec", "end_sec"))


@query("technical_checks", _sql("SELECT render_id, name, passed FROM v_checks"))
def technical_check_rows(spark, sf_dir):
    return technical_checks(spark, sf_dir)


@query("technical_gate", _sql("SELECT render_id, check_count, failed_count, passed FROM v_gate"))
def technical_gate(spark, sf_dir):
    return qa.technical_gate(technical_checks_t(spark, sf_dir))


def compared_styles(spark, sf_dir):
    """Every video's style against the next one's, at a quarter of the default tolerances."""
    style = FQ.style_t(spark, sf_dir)
    actual = style.withColumn("video_id", F.pmod(F.col("video_id") + 9, F.lit(10)))
    return qa.compare_style(style, actual, "video_id", {m: t / 4 for m, t in qa.STYLE_TOLERANCES.items()})


@query("style_comparison", _sql("""SELECT video_id, metric, round(reference, 6) AS reference, round(actual, 6) AS actual, round(difference, 6) AS difference, round(tolerance, 6) AS tolerance, passed FROM v_compared"""))
def style_comparison(spark, sf_dir):
    return compared_styles(spark, sf_dir).select("video_id", "metric", *_r("reference", "actual", "difference", "tolerance"), "passed")


COMPOSITION_PREFIX = "clip:"


def programs(spark, sf_dir):
    """Compositions read back from the renderer; those of projects ending in 7 have lost their colour node."""
    rows = curves.node_names(GQ.wired(spark, sf_dir, "blur_keyframes"), COMPOSITION_PREFIX)
    lost = F.pmod("project_id", F.lit(10)) == 7
    return rows.withColumn("nodes", F.when(lost, F.array_remove("nodes", "PostColor")).otherwise(F.col("nodes")))


@query("graph_consistency", _sql("""
    WITH n AS (SELECT project_id, list_concat(['BaseTransform', 'MotionTransform'], CASE WHEN project_id % 10 = 7 THEN [] ELSE ['PostColor'] END) AS nodes FROM v_spec_clips)
    SELECT project_id, bool_and(list_has_all(nodes, ['BaseTransform', 'MotionTransform', 'PostColor'])) AS consistent FROM n GROUP BY project_id"""))
def graph_consistency(spark, sf_dir):
    return qa.graph_consistency(programs(spark, sf_dir), COMPOSITION_PREFIX)


@query("rendered_gate", _sql("""
    SELECT g.render_id, g.passed AS technical_passed, coalesce(c.consistent, false) AS consistent, s.ok AS style_passed, g.passed AND coalesce(c.consistent, false) AND s.ok AS passed
    FROM v_gate g LEFT JOIN (SELECT project_id, project_id % 10 <> 7 AS consistent FROM v_spec_clips GROUP BY project_id) c ON c.project_id = g.render_id
    JOIN (SELECT video_id, bool_and(passed) AS ok FROM v_compared WHERE metric IN ('cut_density', 'motion_coverage', 'reversal_ratio') GROUP BY video_id) s ON s.video_id = g.render_id % 10"""))
def rendered_gate(spark, sf_dir):
    technical = qa.technical_gate(technical_checks_t(spark, sf_dir))
    consistent = qa.graph_consistency(programs(spark, sf_dir), COMPOSITION_PREFIX).withColumnRenamed("project_id", "render_id")
    style = technical.select("render_id", F.pmod("render_id", F.lit(10)).alias("video_id")).join(compared_styles(spark, sf_dir), "video_id")
    return qa.rendered_gate(technical, consistent, style).select("render_id", "technical_passed", "consistent", "style_passed", "passed")


@query("representative_interval", _sql("""
    WITH cuts AS (SELECT project_id, cut AS sec, CASE WHEN seq % 5 = 0 THEN 0.2 ELSE 0.6 END AS conf FROM v_spec_pairs),
         acc AS (SELECT project_id, tl_in + 0.01::DOUBLE AS sec FROM v_laid WHERE hold),
         clips AS (SELECT project_id, tl_in AS a, tl_in + d AS b FROM v_spec_clips), dur AS (SELECT project_id, sum(duration_sec) AS d FROM v_slots GROUP BY ALL),
         w AS (SELECT DISTINCT c.project_id, c.sec AS s, l, c.sec + l AS e FROM cuts c JOIN dur USING (project_id), unnest([3.0::DOUBLE, 4.0, 5.0]) t(l) WHERE c.sec + l <= dur.d)
    SELECT project_id, round(s, 6) AS start_sec, round(e, 6) AS end_sec FROM w
    WHERE (SELECT count(*) FROM cuts c WHERE c.project_id = w.project_id AND c.sec BETWEEN s AND e) >= 2 AND EXISTS (SELECT 1 FROM acc a WHERE a.project_id = w.project_id AND a.sec BETWEEN s AND e)
      AND EXISTS (SELECT 1 FROM clips k WHERE k.project_id = w.project_id AND k.a < e AND k.b > s) AND EXISTS (SELECT 1 FROM cuts c WHERE c.project_id = w.project_id AND c.sec BETWEEN s AND e AND conf >= 0.3)
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY s, l) = 1"""))
def representative_interval(spark, sf_dir):
    laid = GQ.placed_t(spark, sf_dir)
    cuts = GQ.transitions(spark, sf_dir).select("project_id", F.col("cut_sec").alias("sec"), F.when(F.pmod("seq", F.lit(5)) == 0, 0.2).otherwise(0.6).alias("confidence"))
    accents = laid.where("hold").select("project_id", (F.col("timeline_in_sec") + 0.01).alias("sec"))
    clips = laid.where("filled").select("project_id", F.col("timeline_in_sec").alias("in_sec"), (F.col("timeline_in_sec") + F.col("duration_sec")).alias("out_sec"), F.lit(2).alias("keyframes"))
    projects = A.slots(spark, sf_dir).groupBy("project_id").agg(F.sum("duration_sec").alias("duration_sec"))
    return qa.representative_interval(projects, cuts, accents, clips).select("project_id", *_r("start_sec", "end_sec"))


@query("gain_advice", _sql("""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY difference / greatest(tolerance, 1e-6) DESC, metric_rank) AS rn FROM v_compared
               WHERE NOT passed AND metric IN ('motion_coverage', 'hold_ratio', 'reversal_ratio', 'scale_motion_ratio', 'blur_usage'))
    SELECT video_id AS trial_id, metric, CASE metric WHEN 'motion_coverage' THEN 'translation_gain' WHEN 'hold_ratio' THEN 'hold_motion_gain' WHEN 'reversal_ratio' THEN 'overshoot_gain'
           WHEN 'scale_motion_ratio' THEN 'zoom_gain' ELSE 'directional_blur_gain' END AS gain, round(CASE WHEN actual < reference THEN 1.15 ELSE 0.85 END::DOUBLE, 6) AS new_value FROM f WHERE rn = 1"""))
def gain_advice(spark, sf_dir):
    rows = compared_styles(spark, sf_dir).withColumnRenamed("video_id", "trial_id")
    params = A.videos(spark, sf_dir).select(F.col("video_id").alias("trial_id"), qa.default_params().alias("params"))
    return qa.advise_gains(rows, params).select("trial_id", "metric", "gain", *_r("new_value"))


@query("trial_evaluation", _sql("SELECT video_id AS trial_id, round(cut_density * 1.1::DOUBLE, 6) AS rendered_density, cut_density * 1.1::DOUBLE <= 6 AS passed FROM v_style"))
def trial_evaluation(spark, sf_dir):
    """Caller-supplied render and judge functions over all trials at once."""
    return qa.evaluate(
        FQ.style_t(spark, sf_dir).select(F.col("video_id").alias("trial_id"), "cut_density"),
        lambda t: t.withColumn("_d", F.col("cut_density") * 1.1),
        lambda t: t.select("trial_id", F.round("_d", 6).alias("rendered_density"), (F.col("_d") <= 6).alias("passed")))


@query("releasable_projects", _sql("SELECT render_id AS project_id, '/out/' || render_id || '.mov' AS preview_path FROM v_gate WHERE render_id % 3 <> 0 AND passed"))
def releasable_projects(spark, sf_dir):
    reports = qa.technical_gate(technical_checks_t(spark, sf_dir)).select(F.col("render_id").alias("project_id"), "passed")
    path = F.when(F.pmod("track_id", F.lit(3)) != 0, F.concat(F.lit("/out/"), "track_id", F.lit(".mov")))
    previews = A.tracks(spark, sf_dir).select(F.col("track_id").alias("project_id"), path.alias("preview_path"))
    return qa.releasable(previews, reports)


# ---- validation ------------------------------------------------------------------------------


@query("duplicate_clip_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_clip_keys(spark, sf_dir):
    return validate.duplicate_keys(A.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dangling_transitions", """
    WITH p AS (SELECT l_orderkey AS project_id, l_orderkey || '-' || n AS pair_id, l_orderkey || '-' || n AS outgoing, l_orderkey || '-' || (n + 1) AS incoming
               FROM (SELECT l_orderkey, unnest(range(0, max(l_linenumber) + 2)) AS n FROM lineitem GROUP BY l_orderkey))
    SELECT project_id, pair_id, side, clip_id FROM (SELECT project_id, pair_id, 'outgoing' AS side, outgoing AS clip_id FROM p
                                                    UNION ALL SELECT project_id, pair_id, 'incoming', incoming FROM p) s
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.project_id AND l.l_orderkey || '-' || l.l_linenumber = s.clip_id)""")
def dangling_transitions(spark, sf_dir):
    """Transitions between all neighbouring lines of an order, from the one before the first to the one after the last."""
    lines = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("_n"))
    rows = lines.select(F.col("l_orderkey").alias("project_id"), F.explode(F.sequence(F.lit(0), F.col("_n") + 1)).alias("n"))
    clip = lambda n: F.concat_ws("-", "project_id", n.cast("string"))
    pairs = rows.select("project_id", clip(F.col("n")).alias("pair_id"), clip(F.col("n")).alias("outgoing_clip_id"), clip(F.col("n") + 1).alias("incoming_clip_id"))
    clips = A.shots(spark, sf_dir).select(F.col("asset_id").alias("project_id"), F.col("shot_id").alias("clip_id"))
    return validate.dangling_pairs(pairs, clips).select("project_id", "pair_id", "side", "clip_id")


@query("source_range_violations", with_views("""
    SELECT i.shot_id, CASE WHEN s.shot_id IS NULL THEN 'unknown_shot' ELSE 'outside_shot' END AS problem
    FROM (SELECT l_orderkey || '-' || l_linenumber AS shot_id, 0.0::DOUBLE AS a, round(l_extendedprice / 10000, 4) AS b FROM lineitem
          UNION ALL SELECT o_orderkey || '-0', 0.0, round(o_totalprice / 300000, 4) FROM orders) i LEFT JOIN v_shots s USING (shot_id)
    WHERE s.shot_id IS NULL OR a < s.start_sec - 1e-3 OR b > s.end_sec + 1e-3"""))
def source_range_violations(spark, sf_dir):
    """Every line asks for a range of its shot; every order also for a shot that does not exist."""
    lines = A.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("shot_id"), F.round(F.col("l_extendedprice") / 10000, 4).alias("out_sec"))
    none = A.table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("-0")).alias("shot_id"), F.round(F.col("o_totalprice") / 300000, 4).alias("out_sec"))
    choices = lines.unionByName(none).withColumn("in_sec", F.lit(0.0))
    return validate.source_outside_shot(choices, A.shots(spark, sf_dir)).select("shot_id", "problem")


@query("rule_violations", """
    SELECT l_orderkey, l_linenumber, l_partkey, rule FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest(list_filter([CASE WHEN NOT (l_discount >= 0.02 AND l_discount <= 0.08) THEN 'discount_range' END,
           CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'flag_enum' END, CASE WHEN NOT l_quantity < l_extendedprice / 1000 THEN 'ordered_bounds' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem)""")
def rule_violations(spark, sf_dir):
    rules = {
        "discount_range": validate.in_range("l_discount", 0.02, 0.08),
        "flag_enum": F.col("l_returnflag").isin("A", "R"),
        "ordered_bounds": F.col("l_quantity") < F.col("l_extendedprice") / 1000,
    }
    return validate.violations(A.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], rules)


@query("series_order_violations", with_views("""SELECT track_id, event_id FROM (SELECT *, lag(energy) OVER (PARTITION BY track_id ORDER BY sec, event_id) AS p FROM v_track_events) WHERE energy < p"""))
def series_order_violations(spark, sf_dir):
    rows = ordered.annotate(A.track_events(spark, sf_dir), ["track_id"], ["sec", "event_id"], {"k": ordered.position()})
    return validate.unsorted_series(rows, ["track_id"], "k", "energy").select("track_id", "event_id")


@query("index_gaps", """SELECT l_orderkey, l_linenumber, expected FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS expected
       FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE expected <> l_linenumber""")
def index_gaps(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("_i", F.col("l_linenumber") - 1)
    return validate.index_gaps(rows, ["l_orderkey"], "_i").select("l_orderkey", "l_linenumber", (F.col("expected") + 1).alias("expected"))


# ---- workflow log ----------------------------------------------------------------------------

_EDGES = ", ".join(f"('{a}', '{b}')" for a, targets in statelog.NEXT.items() for b in targets)
_WALK = f"""
    edges AS (SELECT * FROM (VALUES {_EDGES}) t(a, b)),
    walk AS (SELECT project_id, seq, target = 'CREATED' AND action = 'enter' AS accepted, CASE WHEN action = 'enter' AND target = 'CREATED' THEN target END AS state, CASE WHEN action = 'enter' AND target = 'CREATED' THEN 1 ELSE 0 END AS attempt,
                    CASE WHEN action = 'fail' THEN 'no_state' WHEN target <> 'CREATED' THEN 'must_start_created' END AS reason FROM v_state_requests WHERE seq = 0
             UNION ALL
             SELECT project_id, seq, reason IS NULL, CASE WHEN reason IS NOT NULL THEN state WHEN action = 'fail' THEN 'FAILED_' || base ELSE target END,
                    CASE WHEN reason IS NOT NULL OR action = 'fail' THEN attempt WHEN target = base THEN attempt + 1 ELSE 1 END, reason
             FROM (SELECT r.project_id, r.seq, r.action, r.target, w.state, w.attempt, replace(w.state, 'FAILED_', '') AS base,
                          CASE WHEN r.action = 'fail' THEN CASE WHEN w.state IS NULL THEN 'no_state' END WHEN w.state IS NULL AND r.target <> 'CREATED' THEN 'must_start_created'
                               WHEN w.state IS NOT NULL AND r.target <> replace(w.state, 'FAILED_', '') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = replace(w.state, 'FAILED_', '') AND e.b = r.target) THEN 'illegal_transition'
                               WHEN r.target = 'DELIVERED' AND NOT r.technical_qa_passed THEN 'qa_not_passed' END AS reason
                   FROM walk w JOIN v_state_requests r ON r.project_id = w.project_id AND r.seq = w.seq + 1))"""


@query("state_verdicts", with_views(f"WITH {_WALK} SELECT project_id, seq, accepted, reason, state, attempt::BIGINT AS attempt FROM walk", recursive=True))
def state_verdicts(spark, sf_dir):
    return statelog.validate_log(A.state_requests(spark, sf_dir))


@query("current_states", with_views(f"WITH {_WALK} SELECT project_id, arg_max(state, seq) AS state, arg_max(attempt, seq)::BIGINT AS attempt, max(seq) AS seq FROM walk WHERE accepted GROUP BY project_id", recursive=True))
def current_states(spark, sf_dir):
    log = statelog.accepted_log(statelog.validate_log(A.state_requests(spark, sf_dir)))
    return statelog.current_state(log.select("project_id", "seq", "state", "attempt"))


@query("payload_documents", with_views("""SELECT project_id, seq, '{"action":"' || action || '","seq":' || seq || ',"technical_qa_passed":' || technical_qa_passed || '}' AS payload FROM v_state_requests"""))
def payload_documents(spark, sf_dir):
    payload = statelog.encode_payload({"technical_qa_passed": F.col("technical_qa_passed"), "action": F.col("action"), "seq": F.col("seq")})
    return A.state_requests(spark, sf_dir).select("project_id", "seq", payload.alias("payload"))


_RUNS = "SELECT event_id, ['analyze_reference','plan','compile','qa'][user_id % 4 + 1] AS stage, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END AS status, ts, value FROM events"


def runs(spark, sf_dir):
    """events as stage runs that last `value` seconds."""
    stage = F.element_at(F.array(*[F.lit(s) for s in ("analyze_reference", "plan", "compile", "qa")]), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    started = F.col("ts").cast("timestamp")
    return A.table(spark, sf_dir, "events").select(
        "event_id", stage.alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("status"), started.alias("started_at"),
        F.timestamp_micros(F.unix_micros(started) + F.round(F.col("value") * 1e6).cast("bigint")).alias("finished_at"))


@query("run_stage_rollup", f"SELECT stage, status, count(*) AS runs, round(avg(round(value * 1e6) / 1e6), 6) AS mean_sec, round(max(value), 6) AS longest_sec FROM ({_RUNS}) GROUP BY stage, status")
def run_stage_rollup(spark, sf_dir):
    return statelog.stage_rollup(runs(spark, sf_dir)).select("stage", "status", "runs", *_r("mean_sec", "longest_sec"))


@query("run_stage_daily", f"SELECT epoch_us(date_trunc('day', ts)) AS day_us, stage, status, count(*) AS runs FROM ({_RUNS}) GROUP BY ALL")
def run_stage_daily(spark, sf_dir):
    rows = runs(spark, sf_dir).groupBy(F.window("started_at", "1 day").alias("w"), "stage", "status").agg(F.count(F.lit(1)).alias("runs"))
    return rows.select(F.unix_micros("w.start").alias("day_us"), "stage", "status", "runs")
