"""Queries over the catalog: resolution, upserts, identities, frame conform, probe documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelspark.functions import timecode as tc
from reelspark.operators import catalog, conform, joins
from reelspark.plans import adapters as A
from reelspark.plans.check_views import with_views
from reelspark.plans.registry import query
from reelspark.session import shared_folder
from reelspark.sources import readers, writers


# ---- frame conform ---------------------------------------------------------------------------

def frames_sql(sec: str, num: str, den: str, mode: str = "round") -> str:
    """Exact frame number in integers, independent of the column expressions.

    A double is 2**-(e) times an integer. The closest half frame counts as met when no fraction with a
    denominator up to 10**9 lies nearer: |gap| * d * 10**9 < 2**e * num, d the half frame's reduced denominator.
    """
    h, two = f"floor(({sec}) * 2 * {num} / {den} + 0.5)::HUGEINT", f"(2 * {num})::HUGEINT"
    # Doubles from 64 up are whole in units of 2**-46, from 1 up of 2**-52, from 2**-14 up of 2**-66.
    e = f"(CASE WHEN ({sec}) >= 64 THEN 46 WHEN ({sec}) >= 1 THEN 52 ELSE 66 END)"
    gap = f"((({sec}) * pow(2, {e}))::HUGEINT * {two} - {h} * {den} * pow(2, {e})::HUGEINT)"
    reach = f"(abs({gap}) * ({two} // gcd({h} * {den}, {two})) * 1000000000 < pow(2, {e})::HUGEINT * {num})"
    near = f"(abs(({sec}) * 2 * {num} / {den} - {h}) < 1e-5)"
    side = f"(CASE WHEN ({sec}) = 0 THEN 0 WHEN NOT {near} THEN sign(({sec}) * 2 * {num} / {den} - {h}) WHEN {reach} THEN 0 ELSE sign({gap}) END)"
    odd = f"({h} % 2 = 1)"
    up = {"round": f"{odd} AND {side} >= 0", "ceil": f"{odd} OR {side} > 0", "floor": "FALSE"}[mode]
    down = f"NOT {odd} AND {side} < 0" if mode == "floor" else "FALSE"
    return f"({h} // 2 + CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END)::BIGINT"


CONFORM_VIEWS = {
    "v_clips": """
        SELECT s.project_id, s.slot_index AS clip_index, h.start_sec AS source_in_sec,
               round(h.start_sec + s.duration_sec, 4) AS source_out_sec,
               CASE WHEN s.slot_index % 3 = 0 THEN (floor(s.start_sec * 24) * 2 + 1) * s.tl_den / (2 * s.tl_num)::DOUBLE ELSE s.start_sec END AS timeline_in_sec,
               s.duration_sec AS timeline_duration_sec, a.fps_num AS src_num, a.fps_den AS src_den, s.tl_num, s.tl_den
        FROM (SELECT *, (CASE pool_id % 2 WHEN 0 THEN 24000 ELSE 30000 END)::BIGINT AS tl_num, 1001::BIGINT AS tl_den FROM v_slots) s
        JOIN v_assets a ON a.asset_id = s.project_id
        JOIN (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY start_sec, shot_id) - 1 AS k FROM v_shots) h
             ON h.asset_id = s.project_id AND h.k = s.slot_index""",
    "v_placed": f"""
        SELECT *, start_frame + greatest(1, (tlf * src_num * tl_den + src_den * tl_num - 1) // (src_den * tl_num)) AS end_frame
        FROM (SELECT *, {frames_sql('source_in_sec', 'src_num', 'src_den')} AS start_frame,
                     86400 + {frames_sql('timeline_in_sec', 'tl_num', 'tl_den')} AS record_frame,
                     greatest(1, {frames_sql('timeline_in_sec + timeline_duration_sec', 'tl_num', 'tl_den')}
                                 - {frames_sql('timeline_in_sec', 'tl_num', 'tl_den')}) AS tlf FROM v_clips)""",
}


def clips(spark, sf_dir):
    slots = A.slots(spark, sf_dir)
    from pyspark.sql import Window

    # Shots of an asset are one row per line number, a small fixed domain.
    order = Window.partitionBy("asset_id").orderBy("start_sec", "shot_id")
    shots = A.shots(spark, sf_dir).withColumn("slot_index", (F.row_number().over(order) - 1).cast("bigint")).select(
        F.col("asset_id").alias("project_id"), "slot_index", F.col("start_sec").alias("source_in_sec"))
    rates = A.assets(spark, sf_dir).select(F.col("asset_id").alias("project_id"), F.col("fps_num").alias("src_num"), F.col("fps_den").alias("src_den"))
    rows = slots.join(shots, ["project_id", "slot_index"]).join(rates, "project_id").withColumns(
        {"tl_num": F.when(F.pmod("pool_id", F.lit(2)) == 0, 24000).otherwise(30000).cast("bigint"), "tl_den": F.lit(1001).cast("bigint")})
    # Every third slot starts half way between two frames of its timeline.
    half = (F.floor(F.col("start_sec") * 24) * 2 + 1) * F.col("tl_den") / (F.col("tl_num") * 2).cast("double")
    return rows.select(
        "project_id", F.col("slot_index").alias("clip_index"), "source_in_sec",
        F.round(F.col("source_in_sec") + F.col("duration_sec"), 4).alias("source_out_sec"),
        F.when(F.pmod("slot_index", F.lit(3)) == 0, half).otherwise(F.col("start_sec")).alias("timeline_in_sec"),
        F.col("duration_sec").alias("timeline_duration_sec"), "src_num", "src_den", "tl_num", "tl_den")


@query("placement_conform", with_views("""SELECT project_id, clip_index, start_frame, end_frame, record_frame, tlf AS timeline_frames FROM v_placed""", CONFORM_VIEWS))
def placement_conform(spark, sf_dir):
    return conform.place_clips(clips(spark, sf_dir)).select("project_id", "clip_index", "start_frame", "end_frame", "record_frame", "timeline_frames")


@query("conform_audit", with_views("""SELECT project_id, clip_index, nr - record_frame - tlf AS gap_frames
    FROM (SELECT *, lead(record_frame) OVER (PARTITION BY project_id ORDER BY record_frame, clip_index) AS nr FROM v_placed) WHERE nr IS NOT NULL""", CONFORM_VIEWS))
def conform_audit(spark, sf_dir):
    placed = conform.place_clips(clips(spark, sf_dir))
    return conform.audit_joins(placed).select("project_id", "clip_index", "gap_frames")


@query("frame_rounding_modes", with_views(f"""SELECT project_id, clip_index, {frames_sql('timeline_in_sec', 'src_num', 'src_den')} AS nearest,
    {frames_sql('timeline_in_sec', 'src_num', 'src_den', 'floor')} AS floor_frame, {frames_sql('timeline_in_sec', 'src_num', 'src_den', 'ceil')} AS ceil_frame,
    round({frames_sql('timeline_in_sec', 'src_num', 'src_den')} * src_den / src_num::DOUBLE, 6) AS back_sec FROM v_clips""", CONFORM_VIEWS))
def frame_rounding_modes(spark, sf_dir):
    rate = (F.col("src_num"), F.col("src_den"))
    sec = F.col("timeline_in_sec")
    near = tc.to_frames(sec, *rate)
    return clips(spark, sf_dir).select(
        "project_id", "clip_index", near.alias("nearest"), tc.to_frames(sec, *rate, "floor").alias("floor_frame"),
        tc.to_frames(sec, *rate, "ceil").alias("ceil_frame"), F.round(tc.to_seconds(near, *rate), 6).alias("back_sec"))


@query("frame_durations", with_views(f"""SELECT project_id, clip_index, tlf AS duration_frames,
    greatest(1, (tlf * src_num * tl_den + src_den * tl_num - 1) // (src_den * tl_num)) AS rebased_frames,
    (2 * tlf * tl_den * src_num + tl_num * src_den) // (2 * tl_num * src_den) AS rebased_position FROM v_placed""", CONFORM_VIEWS))
def frame_durations(spark, sf_dir):
    src, tl = (F.col("src_num"), F.col("src_den")), (F.col("tl_num"), F.col("tl_den"))
    frames = tc.duration_frames(F.col("timeline_in_sec"), F.col("timeline_duration_sec"), *tl)
    return clips(spark, sf_dir).select(
        "project_id", "clip_index", frames.alias("duration_frames"), tc.rebased_duration(frames, *src, *tl).alias("rebased_frames"),
        tc.rebase(frames, *tl, *src).alias("rebased_position"))


@query("timecode_labels", """
    SELECT o_orderkey, printf('%02d:%02d:%02d', t // 3600, (t // 60) % 60, t % 60) || CASE WHEN df THEN ';' ELSE ':' END || printf('%02d', label % fps) AS timecode
    FROM (SELECT *, label // fps AS t FROM (SELECT *, CASE WHEN df THEN n + drop * 9 * tens + drop * ((rest - drop) // (fps * 60 - drop)) ELSE n END AS label
          FROM (SELECT *, CASE WHEN n % (fps * 600 - drop * 9) < drop THEN n % (fps * 600 - drop * 9) + drop ELSE n % (fps * 600 - drop * 9) END AS rest,
                       n // (fps * 600 - drop * 9) AS tens
                FROM (SELECT o_orderkey, o_orderkey % 4 >= 2 AS df, [24, 24, 30, 60][o_orderkey % 4 + 1] AS fps,
                             CASE WHEN o_orderkey % 4 = 2 THEN 2 ELSE 4 END AS drop, floor(o_totalprice * 10)::BIGINT AS n FROM orders))))""")
def timecode_labels(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 10).cast("bigint").alias("n"))
    rates = A.assets(spark, sf_dir).select(F.col("asset_id").alias("o_orderkey"), "fps_num", "fps_den")
    num, den = F.col("fps_num"), F.col("fps_den")
    return rows.join(rates, "o_orderkey").select("o_orderkey", tc.timecode(F.col("n"), num, den, tc.is_drop_rate(num, den)).alias("timecode"))


_FPS = "round(24 + l_tax * 50 + (l_quantity % 7) * 0.125 + CASE WHEN l_linenumber = 1 THEN 5.97 - l_tax * 50 - (l_quantity % 7) * 0.125 ELSE 0 END, 3)"


def _fractions_sql(max_den: int) -> str:
    return f"""SELECT fps, unnest(list_sort(list_transform(range(1, {max_den + 1}), lambda d: struct_pack(e := round(abs(fps - round(fps * d) / d), 12), d := d)))[1:1]) AS best FROM d"""


@query("fps_rationals", f"""
    WITH d AS (SELECT DISTINCT {_FPS} AS fps FROM lineitem),
         f AS ({_fractions_sql(1001)})
    SELECT fps, round(fps * best.d)::BIGINT AS catalog_num, best.d::BIGINT AS catalog_den,
           (CASE WHEN fps = floor(fps) THEN fps WHEN fps = 29.97 THEN 30000 WHEN fps IN (23.976, 23.98) THEN 24000 ELSE round(fps * best.d) END)::BIGINT AS num,
           (CASE WHEN fps = floor(fps) THEN 1 WHEN fps IN (29.97, 23.976, 23.98) THEN 1001 ELSE best.d END)::BIGINT AS den FROM f""")
def fps_rationals(spark, sf_dir):
    """Rational forms of every distinct decimal rate."""
    base = F.lit(24) + F.col("l_tax") * 50 + F.pmod(F.col("l_quantity"), F.lit(7)) * 0.125
    base = base + F.when(F.col("l_linenumber") == 1, F.lit(5.97) - F.col("l_tax") * 50 - F.pmod(F.col("l_quantity"), F.lit(7)) * 0.125).otherwise(0)
    rows = A.table(spark, sf_dir, "lineitem").select(F.round(base, 3).alias("fps")).distinct()
    rows = rows.withColumns({"_c": tc.catalog_fps(F.col("fps")), "_n": tc.normalise_fps(F.col("fps"))})
    return rows.select("fps", F.col("_c.num").alias("catalog_num"), F.col("_c.den").alias("catalog_den"), F.col("_n.num").alias("num"), F.col("_n.den").alias("den"))


# ---- catalog ---------------------------------------------------------------------------------

CATALOG_VIEWS = {
    "v_ids": """SELECT o_orderkey AS list_id, p AS pos, o_orderkey || '-' || (p + 1) AS shot_id
        FROM (SELECT o_orderkey, unnest(range(coalesce(n, 0) + 1)) AS p FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)""",
    "v_cat_shots": """SELECT shot_id, asset_id, start_sec, end_sec, '/archive/' || shot_id || '.mkv' AS archive_path, sha256('archive:' || shot_id) AS archive_checksum FROM v_shots""",
    "v_cat_assets": """SELECT a.asset_id, a.path, a.sha256, 1920 AS width, 1080 AS height, CASE WHEN a.asset_id % 5 <> 0 THEN a.fps_num / a.fps_den::DOUBLE END AS fps, 60.0::DOUBLE AS duration_sec, a.series FROM v_assets a""",
    "v_ranked_tags": """SELECT shot_id, list(value ORDER BY confidence DESC, value)[1] AS character, string_agg(value, ',' ORDER BY confidence DESC, value) AS tags
        FROM v_tags WHERE category = 'character' GROUP BY shot_id""",
    "v_resolved": """
        SELECT i.list_id, i.pos, i.shot_id, s.asset_id IS NOT NULL AS known, src.path IS NOT NULL AS has_source, arc.path IS NOT NULL AS has_archive,
               CASE WHEN src.path IS NOT NULL THEN a.path ELSE s.archive_path END AS media_path,
               CASE WHEN src.path IS NOT NULL THEN s.start_sec ELSE 0 END AS in_sec,
               CASE WHEN src.path IS NOT NULL THEN s.end_sec ELSE s.end_sec - s.start_sec END AS out_sec,
               CASE WHEN src.path IS NOT NULL THEN 60.0::DOUBLE ELSE s.end_sec - s.start_sec END AS media_duration_sec,
               CASE WHEN src.path IS NOT NULL THEN a.sha256 ELSE s.archive_checksum END AS media_sha256, a.fps, a.series, t.character
        FROM v_ids i LEFT JOIN v_cat_shots s USING (shot_id) LEFT JOIN v_cat_assets a ON a.asset_id = s.asset_id
        LEFT JOIN v_media_inventory src ON src.path = a.path LEFT JOIN v_media_inventory arc ON arc.path = s.archive_path
        LEFT JOIN v_ranked_tags t ON t.shot_id = i.shot_id""",
}


def _sql(text: str) -> str:
    return with_views(text, CATALOG_VIEWS)


def wanted_ids(spark, sf_dir):
    """Every order asks for all its line numbers and for one more, which does not exist."""
    lines = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("_n"))
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return orders.select(
        F.col("o_orderkey").alias("list_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_n", F.lit(0)).cast("bigint"))).alias("pos")
    ).withColumn("shot_id", F.concat_ws("-", "list_id", F.col("pos") + 1))


def catalog_shots(spark, sf_dir):
    return A.shots(spark, sf_dir).select(
        "shot_id", "asset_id", "start_sec", "end_sec", F.concat(F.lit("/archive/"), "shot_id", F.lit(".mkv")).alias("archive_path"),
        F.sha2(F.concat(F.lit("archive:"), "shot_id"), 256).alias("archive_checksum"))


def catalog_assets(spark, sf_dir):
    return A.assets(spark, sf_dir).select(
        "asset_id", "path", "sha256", F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        F.when(F.pmod("asset_id", F.lit(5)) != 0, F.col("fps_num") / F.col("fps_den")).alias("fps"), F.lit(60.0).alias("duration_sec"), "series")


def resolution(spark, sf_dir):
    return catalog.resolve_shots(
        wanted_ids(spark, sf_dir), catalog_shots(spark, sf_dir), catalog_assets(spark, sf_dir), A.media_inventory(spark, sf_dir), A.catalog_tags(spark, sf_dir))


@query("manifest_resolution", _sql("""SELECT list_id, pos, shot_id, media_path, round(in_sec, 4) AS in_sec, round(out_sec, 4) AS out_sec,
       round(media_duration_sec, 4) AS media_duration_sec, media_sha256, series, character FROM v_resolved WHERE known AND (has_source OR has_archive)"""))
def manifest_resolution(spark, sf_dir):
    return resolution(spark, sf_dir).manifest.select(
        "list_id", "pos", "shot_id", "media_path", *[F.round(c, 4).alias(c) for c in ("in_sec", "out_sec", "media_duration_sec")], "media_sha256", "series", "character")


@query("manifest_missing", _sql("SELECT list_id, pos, shot_id FROM v_resolved WHERE NOT known"))
def manifest_missing(spark, sf_dir):
    return resolution(spark, sf_dir).missing


@query("manifest_unreadable", _sql("SELECT list_id, pos, shot_id FROM v_resolved WHERE known AND NOT has_source AND NOT has_archive"))
def manifest_unreadable(spark, sf_dir):
    return resolution(spark, sf_dir).unreadable


@query("missing_shot_ids", _sql("SELECT list_id, pos, shot_id FROM v_ids i WHERE NOT EXISTS (SELECT 1 FROM v_shots s WHERE s.shot_id = i.shot_id)"))
def missing_shot_ids(spark, sf_dir):
    return joins.missing_keys(wanted_ids(spark, sf_dir), A.shots(spark, sf_dir), ["shot_id"])


@query("selected_shots_with_assets", _sql("""SELECT s.shot_id, s.start_sec, s.end_sec, a.path FROM v_shots s JOIN v_assets a USING (asset_id)
       WHERE s.shot_id IN (SELECT shot_id FROM v_ids)"""))
def selected_shots_with_assets(spark, sf_dir):
    rows = joins.selected_rows(A.shots(spark, sf_dir), wanted_ids(spark, sf_dir), "shot_id")
    return rows.join(A.assets(spark, sf_dir), "asset_id").select("shot_id", "start_sec", "end_sec", "path")


@query("ranked_character_tags", _sql("SELECT shot_id, character, tags FROM v_ranked_tags"))
def ranked_character_tags(spark, sf_dir):
    return catalog.ranked_tags(A.catalog_tags(spark, sf_dir)).select("shot_id", "character", F.array_join("tags", ",").alias("tags"))


@query("asset_upsert", _sql("""
    WITH n AS (SELECT *, substr(media_sha256, 1, 12) AS id FROM v_resolved WHERE known AND (has_source OR has_archive)
               QUALIFY row_number() OVER (PARTITION BY substr(media_sha256, 1, 12) ORDER BY list_id DESC, pos DESC) = 1),
         e AS (SELECT substr(sha256, 1, 12) AS id, '/old/' || asset_id AS path, 10.0::DOUBLE AS duration_sec, 'prores' AS codec, proxy_path FROM v_assets)
    SELECT coalesce(n.id, e.id) AS id, coalesce(n.media_path, e.path) AS path, round(coalesce(n.media_duration_sec, e.duration_sec), 4) AS duration_sec,
           e.codec, e.proxy_path FROM e FULL JOIN n ON n.id = e.id"""))
def asset_upsert(spark, sf_dir):
    """Manifest assets into an existing table; codec and proxy of existing rows survive."""
    old = A.assets(spark, sf_dir).select(
        F.substring("sha256", 1, 12).alias("id"), F.concat(F.lit("/old/"), "asset_id").alias("path"), F.lit(10.0).alias("duration_sec"),
        F.lit("prores").alias("codec"), "proxy_path")
    new = catalog.manifest_assets(resolution(spark, sf_dir).manifest)
    out = catalog.upsert(old, new, ["id"], ["path", "duration_sec"], ["list_id", "pos"])
    return out.withColumn("duration_sec", F.round("duration_sec", 4))


@query("project_upsert", """
    SELECT o_orderkey AS project_id, CASE WHEN o_orderstatus <> 'P' THEN 'new' ELSE 'old' END AS focus,
           CASE WHEN o_orderstatus = 'O' THEN 'touched' END AS updated FROM orders""")
def project_upsert(spark, sf_dir):
    """Finished orders arrive as new projects, open ones update, pending ones only exist already."""
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), "o_orderstatus", F.col("o_orderdate").alias("at"))
    old = orders.where(F.col("o_orderstatus") != "F").select("project_id", F.lit("old").alias("focus"), F.lit(None).cast("string").alias("updated"))
    new = orders.where(F.col("o_orderstatus") != "P").select("project_id", F.lit("new").alias("focus"), "at")
    return catalog.upsert(old, new, ["project_id"], ["focus"], ["at"], touched="updated", touched_value=F.lit("touched"))


_CACHE = {
    "v_wanted": "SELECT sha256(o_orderkey::VARCHAR) AS source_hash, CASE WHEN o_orderkey % 4 <> 0 THEN 'm' || o_custkey END AS music_ref FROM orders",
    "v_cache": """SELECT sha256(o_orderkey::VARCHAR) AS source_hash, CASE WHEN o_orderstatus = 'O' THEN '3.1.0' ELSE '3.0.0' END AS version,
                  CASE WHEN o_orderkey % 4 <> 0 AND o_orderpriority <> '5-LOW' THEN 'm' || o_custkey END AS music_ref, o_totalprice AS document FROM orders WHERE o_totalprice > 50000""",
}


def wanted_documents(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders")
    return orders.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("source_hash"),
                         F.when(F.pmod("o_orderkey", F.lit(4)) != 0, F.concat(F.lit("m"), "o_custkey")).alias("music_ref"))


def document_cache(spark, sf_dir):
    """What is already cached: the dearer orders. The wanted documents are all orders."""
    orders = A.table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 50000)
    own = (F.pmod("o_orderkey", F.lit(4)) != 0) & (F.col("o_orderpriority") != "5-LOW")
    return orders.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("source_hash"),
                         F.when(F.col("o_orderstatus") == "O", "3.1.0").otherwise("3.0.0").alias("version"),
                         F.when(own, F.concat(F.lit("m"), "o_custkey")).alias("music_ref"), F.col("o_totalprice").alias("document"))


@query("stale_documents", with_views("""SELECT source_hash, music_ref FROM v_wanted w WHERE NOT EXISTS (SELECT 1 FROM v_cache c
       WHERE c.source_hash = w.source_hash AND c.version = '3.1.0' AND c.music_ref IS NOT DISTINCT FROM w.music_ref)""", _CACHE))
def stale_documents(spark, sf_dir):
    return catalog.stale_documents(wanted_documents(spark, sf_dir), document_cache(spark, sf_dir), "3.1.0")


@query("reusable_documents", with_views("""SELECT source_hash, w.music_ref, version, document FROM v_wanted w JOIN v_cache c USING (source_hash)
       WHERE c.version = '3.1.0' AND c.music_ref IS NOT DISTINCT FROM w.music_ref""", _CACHE))
def reusable_documents(spark, sf_dir):
    return catalog.fresh_documents(wanted_documents(spark, sf_dir), document_cache(spark, sf_dir), "3.1.0")


@query("document_cache_refresh", with_views("""
    WITH s AS (SELECT source_hash, '3.1.0' AS version, music_ref, 1.0::DOUBLE AS document FROM v_wanted w WHERE NOT EXISTS (SELECT 1 FROM v_cache c
               WHERE c.source_hash = w.source_hash AND c.version = '3.1.0' AND c.music_ref IS NOT DISTINCT FROM w.music_ref))
    SELECT * FROM s UNION ALL SELECT source_hash, version, music_ref, document FROM v_cache WHERE source_hash NOT IN (SELECT source_hash FROM s)""", _CACHE))
def document_cache_refresh(spark, sf_dir):
    cache = document_cache(spark, sf_dir)
    stale = catalog.stale_documents(wanted_documents(spark, sf_dir), cache, "3.1.0")
    computed = stale.select("source_hash", F.lit("3.1.0").alias("version"), "music_ref", F.lit(1.0).alias("document"))
    return catalog.refresh_cache(cache, computed)


@query("media_preference", _sql("""SELECT asset_id, coalesce(proxy_path, path) AS preview_media, coalesce(path, proxy_path) AS master_media, media AS available
       FROM v_assets LEFT JOIN v_present_media USING (asset_id)"""))
def media_preference(spark, sf_dir):
    assets = A.assets(spark, sf_dir).select("asset_id", "path", "proxy_path")
    out = catalog.media_path(assets).withColumnRenamed("media", "preview_media")
    out = catalog.media_path(out, prefer_proxy=False).withColumnRenamed("media", "master_media")
    out = catalog.media_path(out, A.media_inventory(spark, sf_dir)).withColumnRenamed("media", "available")
    return out.select("asset_id", "preview_media", "master_media", "available")


@query("shot_lookup", _sql("""SELECT i.list_id, i.pos, i.shot_id, s.asset_id, s.start_sec, s.end_sec, s.shot_id IS NOT NULL AS known FROM v_ids i LEFT JOIN v_shots s USING (shot_id)"""))
def shot_lookup(spark, sf_dir):
    return catalog.lookup(wanted_ids(spark, sf_dir), A.shots(spark, sf_dir), "shot_id", ["asset_id", "start_sec", "end_sec"])


@query("asset_prefix_resolution", """
    WITH f AS (SELECT o_orderkey % 2 AS dir_rank, CASE WHEN o_orderpriority < '3' THEN substr(sha256(o_orderkey::VARCHAR), 1, 12) ELSE sha256(o_orderkey::VARCHAR) END AS stem,
                      CASE WHEN o_orderstatus = 'F' THEN '.mp4' ELSE '.mov' END AS suffix FROM orders),
         p AS (SELECT *, '/d' || dir_rank || '/' || stem || suffix AS path FROM f),
         i AS (SELECT DISTINCT substr(sha256(l_orderkey::VARCHAR), 1, 12) AS asset_id FROM lineitem),
         k AS (SELECT i.asset_id, p.path, dir_rank, CASE WHEN stem = i.asset_id THEN 0 ELSE 1 END AS m, CASE WHEN stem <> i.asset_id THEN 0 WHEN suffix = '.mov' THEN 1 ELSE 2 END AS s
               FROM i JOIN p ON substr(p.stem, 1, 12) = i.asset_id)
    SELECT i.asset_id, k.path FROM i LEFT JOIN (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY dir_rank, m, s, path) = 1) k USING (asset_id)""")
def asset_prefix_resolution(spark, sf_dir):
    full = F.sha2(F.col("o_orderkey").cast("string"), 256)
    files = A.table(spark, sf_dir, "orders").select(
        F.pmod("o_orderkey", F.lit(2)).alias("dir_rank"),
        F.when(F.col("o_orderpriority") < "3", F.substring(full, 1, 12)).otherwise(full).alias("stem"),
        F.when(F.col("o_orderstatus") == "F", ".mp4").otherwise(".mov").alias("suffix"))
    files = files.withColumn("path", F.concat(F.lit("/d"), "dir_rank", F.lit("/"), "stem", "suffix"))
    ids = A.table(spark, sf_dir, "lineitem").select(F.substring(F.sha2(F.col("l_orderkey").cast("string"), 256), 1, 12).alias("asset_id")).distinct()
    return catalog.resolve_prefixes(ids, files)


@query("content_identity", """
    SELECT l_orderkey, l_linenumber, l_partkey, sha256('{"asset_hash":"' || sha256(l_orderkey::VARCHAR) || '","model":"' || l_shipmode || '","model_version":"v' || l_linenumber
           || '","parameters":{"hop_length":"' || l_partkey || '","sample_rate":"22050"},"pipeline_version":"music-map-1"}') AS cache_key
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag AS l_shipmode FROM lineitem)""")
def content_identity(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").distinct()
    key = catalog.analysis_key(
        F.sha2(F.col("l_orderkey").cast("string"), 256), F.col("l_returnflag"), F.concat(F.lit("v"), "l_linenumber"), F.lit("music-map-1"),
        F.create_map(F.lit("sample_rate"), F.lit("22050"), F.lit("hop_length"), F.col("l_partkey").cast("string")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", key.alias("cache_key"))


@query("shot_set_hash", """SELECT l_orderkey AS project_id, sha256(string_agg(l_orderkey || '-' || l_linenumber, '|' ORDER BY l_orderkey || '-' || l_linenumber)) AS shot_set_hash
       FROM lineitem GROUP BY l_orderkey""")
def shot_set_hash(spark, sf_dir):
    ids = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("shot_id"))
    return catalog.shot_set_hash(ids, "project_id")


@query("query_alias_expansion", """
    WITH q AS (SELECT DISTINCT p_partkey AS query_id, unnest(string_split(p_name, ' ')) AS term FROM part),
         a AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS term, p_type AS appended FROM part)
    SELECT query_id, term FROM q UNION SELECT query_id, appended FROM q JOIN a USING (term)""")
def query_alias_expansion(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")
    aliases = part.select(F.element_at(F.split("p_name", " "), 2).alias("term"), F.col("p_type").alias("appended")).distinct()
    return catalog.expand_aliases(part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text")), aliases)


@query("ready_media_stems", """
    SELECT DISTINCT regexp_replace(name, '\\.[^.]*$', '') AS stem FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN '.' ELSE '' END || 'a' || o_custkey
           || CASE WHEN o_orderpriority = '5-LOW' THEN '.partial' ELSE '' END || CASE WHEN o_orderpriority = '1-URGENT' THEN '.wav' ELSE '.MOV' END AS name, o_orderstatus, o_orderpriority FROM orders)
    WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('5-LOW', '1-URGENT')""")
def ready_media_stems(spark, sf_dir):
    name = F.concat(F.when(F.col("o_orderstatus") == "P", ".").otherwise(""), F.lit("a"), "o_custkey",
                    F.when(F.col("o_orderpriority") == "5-LOW", ".partial").otherwise(""), F.when(F.col("o_orderpriority") == "1-URGENT", ".wav").otherwise(".MOV"))
    return catalog.ready_stems(A.table(spark, sf_dir, "orders").select(F.concat(F.lit("file:/m/"), name).alias("path")))


@query("id_list_parse", """
    SELECT o_custkey AS list_id, p AS pos, ids[p + 1] AS shot_id FROM (SELECT o_custkey, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey), unnest(range(0, len(ids))) t(p)""")
def id_list_parse(spark, sf_dir):
    """Each customer's order ids written as a list file, JSON for even customers and lines for odd ones, then parsed."""
    # The list text is one file of the fixture, so its ids belong to one row.
    ids = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("_k"))
    words = F.transform("_k", lambda k: k.cast("string"))
    text = F.when(F.pmod("o_custkey", F.lit(2)) == 0, F.concat(F.lit("\n "), F.to_json(words))).otherwise(F.concat(F.array_join(words, " \n\n"), F.lit("\n")))
    rows = ids.select(F.col("o_custkey").alias("list_id"), F.posexplode(readers.parse_id_list(text)).alias("pos", "shot_id"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("probe_documents", """
    SELECT o_orderkey AS render_id, o_orderstatus <> 'P' AS has_video, CASE WHEN o_orderstatus <> 'P' THEN 1920 ELSE 0 END AS width,
           (CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderkey % 2 = 0 THEN 24000 ELSE 25 END)::BIGINT AS fps_num,
           (CASE WHEN o_orderstatus = 'P' THEN 1 WHEN o_orderkey % 2 = 0 THEN 1001 ELSE 1 END)::BIGINT AS fps_den,
           round(o_totalprice / 1000, 6) AS import_duration, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority < '3' THEN 7.5::DOUBLE ELSE round(o_totalprice / 1000, 6) END AS qa_duration,
           o_orderstatus = 'O' AS has_audio FROM orders""")
def probe_documents(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders")
    video = F.struct(
        F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "24000/1001").alias("avg_frame_rate"), F.lit("50/2").alias("r_frame_rate"),
        F.when(F.col("o_orderpriority") < "3", "7.5").alias("duration"))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("48000").alias("sample_rate"))
    parts = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "O", F.to_json(audio)), F.when(F.col("o_orderstatus") != "P", F.to_json(video))))
    doc = F.concat(F.lit('{"streams":['), F.array_join(parts, ","), F.lit('],"format":{"duration":"'), F.round(F.col("o_totalprice") / 1000, 6).cast("decimal(18,6)").cast("string"), F.lit('"}}'))
    rows = orders.select(F.col("o_orderkey").alias("render_id"), doc.alias("probe_json"))
    imported = readers.parse_probe(rows).withColumnRenamed("duration_sec", "import_duration")
    qa = readers.parse_probe(rows, "video").select("render_id", F.col("duration_sec").alias("qa_duration"))
    return imported.join(qa, "render_id").select("render_id", "has_video", "width", "fps_num", "fps_den", "import_duration", "qa_duration", "has_audio")


def _own_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("file_hashes", """
    SELECT c_nationkey AS nation, sum(octet_length(encode(line)) + 1)::BIGINT AS length, sha256(string_agg(line || chr(10), '' ORDER BY c_custkey)) AS sha256
    FROM (SELECT *, c_custkey || '|' || c_name AS line FROM customer) GROUP BY c_nationkey""")
def file_hashes(spark, sf_dir):
    """Customers written as one list per nation, and the hash of every file."""
    line = F.concat_ws("|", "c_custkey", "c_name").alias("line")
    rows = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", line)
    folder = _own_folder(spark, "lists")
    rows = rows.repartition("nation").sortWithinPartitions("nation", "c_custkey")
    rows.select("nation", "line").write.partitionBy("nation").text(folder)
    nation = F.regexp_extract("path", r"nation=(-?\d+)", 1).cast("int")
    return readers.hash_files(spark, folder).select(nation.alias("nation"), "length", "sha256")


@query("document_rewrite", """
    SELECT o_orderkey AS project_id, '{"project_id":' || o_orderkey || ',"state":"' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'revised' ELSE o_orderstatus END || '"}' AS document FROM orders""")
def document_rewrite(spark, sf_dir):
    """Documents of all projects, those of urgent ones written again."""
    orders = A.table(spark, sf_dir, "orders")
    folder = _own_folder(spark, "project-documents")
    project = F.col("o_orderkey").alias("project_id")
    writers.write_documents(orders.select(project, F.col("o_orderstatus").alias("state")), folder, buckets=8)
    writers.write_documents(orders.where("o_orderpriority = '1-URGENT'").select(project, F.lit("revised").alias("state")), folder, buckets=8)
    return spark.read.parquet(folder).select("project_id", "document")


@query("result_tables", """
    SELECT 'appended' AS sink, o_orderkey AS project_id, o_orderstatus AS state FROM orders
    UNION ALL SELECT 'appended', o_orderkey, 'again' FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'replaced', o_orderkey, 'again' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def result_tables(spark, sf_dir):
    """Result rows appended to one table, and written over another."""
    orders = A.table(spark, sf_dir, "orders")
    first = orders.select(F.col("o_orderkey").alias("project_id"), F.col("o_orderstatus").alias("state"))
    again = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("project_id"), F.lit("again").alias("state"))
    appended, replaced = _own_folder(spark, "appended"), _own_folder(spark, "replaced")
    for rows in (first, again):
        writers.append_rows(rows, appended)
        writers.replace_table(rows, replaced)
    both = {"appended": appended, "replaced": replaced}
    parts = [spark.read.parquet(path).select(F.lit(name).alias("sink"), "project_id", "state") for name, path in both.items()]
    return parts[0].unionByName(parts[1])
