"""Catalog resolution, media lookup, upserts and content identities."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from reelspark.functions import timecode as tc
from reelspark.operators import joins

# Suffixes of usable videos in lookup order.
VIDEO_SUFFIXES = (".mov", ".mp4", ".mkv", ".m4v")


class Resolution(NamedTuple):
    manifest: DataFrame
    missing: DataFrame
    unreadable: DataFrame


def ranked_tags(tags: DataFrame, category: str = "character") -> DataFrame:
    """Best value and ordered value list of each shot's tags; equal confidence goes by value.

    The list is one field of the shot's own row.
    """
    pair = F.struct((-F.col("confidence")).alias("c"), F.col("value"))
    rows = tags.where(F.col("category") == category).groupBy("shot_id").agg(F.array_sort(F.collect_list(pair)).alias("_t"))
    values = F.transform("_t", lambda t: t["value"])
    return rows.select("shot_id", F.element_at(values, 1).alias("character"), values.alias("tags"))


def resolve_shots(ids: DataFrame, shots: DataFrame, assets: DataFrame, inventory: DataFrame, tags: DataFrame | None = None) -> Resolution:
    """Resolve ordered id lists against the catalog.

    ids(list_id, pos, shot_id) keep their order and duplicates. A present source file keeps the
    shot's own range; otherwise a present archive file starts at zero; a shot with neither lands in
    `unreadable`, an unknown id in `missing`.
    """
    known = ids.join(shots, "shot_id", "left")
    missing = known.where(F.col("asset_id").isNull()).select("list_id", "pos", "shot_id")
    files = inventory.select("path").distinct()
    found = known.where(F.col("asset_id").isNotNull())
    # Whole rows are shuffled by shot and by asset only: archives are looked up in a narrow table, tags by the same key.
    present = shots.select("shot_id", F.col("archive_path").alias("path")).join(files, "path", "left_semi")
    found = found.join(present.groupBy("shot_id").agg(F.collect_set("path").alias("_files")), "shot_id", "left")
    found = found.withColumn("_archive", F.coalesce(F.array_contains("_files", F.col("archive_path")), F.lit(False))).drop("_files")
    if tags is not None:
        found = found.join(ranked_tags(tags), "shot_id", "left")
    found = found.join(with_existing(assets.withColumnRenamed("path", "source_path"), files, "source_path", "_source"), "asset_id")
    source, archive = F.col("_source"), F.col("_archive")
    length = F.col("end_sec") - F.col("start_sec")

    def either(from_source: Column, from_archive: Column) -> Column:
        return F.when(source, from_source).otherwise(from_archive)

    picked = found.withColumns(
        {
            "_readable": source | archive,
            "media_path": either(F.col("source_path"), F.col("archive_path")),
            "in_sec": either(F.col("start_sec"), F.lit(0.0)),
            "out_sec": either(F.col("end_sec"), length),
            "media_duration_sec": either(F.col("duration_sec"), length),
            "media_sha256": either(F.col("sha256"), F.col("archive_checksum")),
        }
    )
    extra = ["character", "tags"] if tags is not None else []
    kept = ["list_id", "pos", "shot_id", "media_path", "in_sec", "out_sec", "media_duration_sec", "media_sha256", "width", "height", "fps", "series"]
    manifest = picked.where("_readable").select(*kept, *extra)
    unreadable = picked.where(~F.col("_readable")).select("list_id", "pos", "shot_id")
    return Resolution(manifest, missing, unreadable)


def manifest_assets(manifest: DataFrame) -> DataFrame:
    """Asset rows of a manifest; the id is the first twelve digits of the hash, or the shot id."""
    has_hash = F.length(F.coalesce("media_sha256", F.lit(""))) > 0
    rate = tc.catalog_fps(F.col("fps"))
    return manifest.select(
        F.when(has_hash, F.substring("media_sha256", 1, 12)).otherwise(F.col("shot_id")).alias("id"),
        F.col("media_path").alias("path"),
        F.coalesce("media_sha256", F.lit("")).alias("sha256"),
        "width", "height",
        rate["num"].alias("fps_num"), rate["den"].alias("fps_den"),
        F.col("media_duration_sec").alias("duration_sec"),
        "list_id", "pos",
    )


def upsert(
    existing: DataFrame, incoming: DataFrame, key: Sequence[str], set_columns: Sequence[str], order: Sequence[str],
    touched: str | None = None, touched_value: Column | None = None,
) -> DataFrame:
    """Insert or update by key; the last incoming row per key wins.

    Only `set_columns` are overwritten, every other column of an existing row survives. `touched`
    is set on updated rows only.
    """
    keys = list(key)
    stamp = F.struct(*[F.col(c) for c in order])
    newest = incoming.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in set_columns]), stamp).alias("_new"))
    rows = existing.withColumn("_old", F.lit(True)).join(newest, keys, "full")
    out = []
    for name in existing.columns:
        column = F.col(name)
        if name in set_columns:
            column = F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(column)
        elif name == touched:
            both = F.col("_new").isNotNull() & F.coalesce("_old", F.lit(False))
            column = F.when(both, touched_value if touched_value is not None else F.current_timestamp()).otherwise(column)
        out.append(column.alias(name))
    return rows.select(*out)


def stale_documents(wanted: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Wanted documents without a cached row of this version measured against the same music.

    wanted(source_hash, music_ref), cache(source_hash, version, music_ref).
    """
    fresh = cache.where(F.col("version") == version).select(
        F.col("source_hash").alias("_h"), F.col("music_ref").alias("_m")
    )
    return wanted.join(fresh, (F.col("source_hash") == F.col("_h")) & F.col("music_ref").eqNullSafe(F.col("_m")), "left_anti")


def fresh_documents(wanted: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Cached documents that may be reused as they are."""
    fresh = cache.where(F.col("version") == version).withColumnRenamed("music_ref", "_m")
    same = F.col("music_ref").eqNullSafe(F.col("_m"))
    return wanted.join(fresh, "source_hash").where(same).drop("_m")


def refresh_cache(cache: DataFrame, computed: DataFrame) -> DataFrame:
    """Cache after an upsert of newly computed documents by source hash."""
    kept = cache.join(computed.select("source_hash"), "source_hash", "left_anti")
    return kept.unionByName(computed)


def with_existing(rows: DataFrame, files: DataFrame, path: str, flag: str) -> DataFrame:
    """Add whether a row's path is among `files` (distinct path).

    Rows without a path get a text of their own that is no path, so that they do not all meet in one partition.
    """
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*rows.columns).cast("string"))
    have = files.select(F.col("path").alias("_path"), F.lit(True).alias(flag))
    out = rows.withColumn("_path", F.coalesce(path, spread)).join(have, "_path", "left").drop("_path")
    return out.withColumn(flag, F.coalesce(flag, F.lit(False)))


def media_path(assets: DataFrame, inventory: DataFrame | None = None, prefer_proxy: bool = True) -> DataFrame:
    """Add `media`: the preferred of proxy and master path; with an inventory the first that exists."""
    order = ("proxy_path", "path") if prefer_proxy else ("path", "proxy_path")
    if inventory is None:
        return assets.withColumn("media", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in order]))
    files = inventory.select("path").distinct()
    out = assets
    for name in order:
        out = with_existing(out, files, name, f"_have_{name}")
    return out.withColumn("media", F.coalesce(*[F.when(F.col(f"_have_{c}"), F.col(c)) for c in order])).select(*assets.columns, "media")


def lookup(wanted: DataFrame, table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Bulk point lookup; `known` tells unknown ids apart from null values."""
    side = table.select(key, *values, F.lit(True).alias("known"))
    return wanted.join(side, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def resolve_prefixes(ids: DataFrame, files: DataFrame) -> DataFrame:
    """File of each asset id: exact stem first, else the first stem that starts with the id.

    ids(asset_id), files(dir_rank, stem, suffix, path). Within a directory an exact stem beats a
    prefix and suffixes follow the lookup order; the first directory with a match wins. Stems are
    expanded into their prefixes of those lengths that ids have, and joined by equality, so no pattern
    join is needed.
    """
    suffix_rank = F.array_position(F.array(*[F.lit(s) for s in VIDEO_SUFFIXES]), F.col("suffix"))
    # The distinct lengths of ids are a few small numbers.
    lengths = sorted(r[0] for r in ids.select(F.length("asset_id").alias("_l")).where("_l > 0").distinct().collect())
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("stem"))
    rows = files.withColumn("_n", F.explode(fitting))
    rows = rows.withColumn("asset_id", F.substring(F.col("stem"), F.lit(1), F.col("_n")))
    exact = F.col("_n") == F.length("stem")
    # An exact stem goes by suffix order; a prefix match by file name.
    choice = F.struct(
        F.col("dir_rank"), F.when(exact, 0).otherwise(1).alias("m"), F.when(exact, suffix_rank).otherwise(F.lit(0)).alias("s"), F.col("path"),
    )
    hits = rows.join(ids.select("asset_id").distinct(), "asset_id").groupBy("asset_id").agg(F.min(choice).alias("_best"))
    return ids.join(hits, "asset_id", "left").select(*ids.columns, F.col("_best.path").alias("path"))


def shot_set_hash(ids: DataFrame, key: str, shot: str = "shot_id") -> DataFrame:
    """SHA-256 of each list's sorted ids joined by a bar; duplicates count."""
    rows = ids.groupBy(key).agg(F.array_sort(F.collect_list(shot)).alias("_ids"))
    return rows.select(key, F.sha2(F.array_join("_ids", chr(124)), 256).alias("shot_set_hash"))


def stable_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the compact JSON object with its keys sorted."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def analysis_key(asset_hash: Column, model: Column, model_version: Column, pipeline_version: Column, parameters: Column) -> Column:
    """Cache identity of an analysis; parameters is a map. An empty component is an error."""
    parts = {"asset_hash": asset_hash, "model": model, "model_version": model_version, "pipeline_version": pipeline_version}
    complete = F.lit(True)
    for part in parts.values():
        complete = complete & (F.length(F.coalesce(part, F.lit(""))) > 0)
    ordered_map = F.map_from_entries(F.array_sort(F.map_entries(parameters)))
    identity = stable_hash({**parts, "parameters": ordered_map})
    return F.when(complete, identity).otherwise(F.raise_error(F.lit("cache key needs asset, model, model version and pipeline version")).cast("string"))


# Queries with one term that one task brings together with the term's aliases.
TERM_ROWS = 1 << 16


def expand_aliases(queries: DataFrame, aliases: DataFrame, term_rows: int = TERM_ROWS) -> DataFrame:
    """Distinct search terms of each query, with the terms its aliases append.

    queries(query_id, text), aliases(term, appended). A term's frequency is counted first, among the terms that have aliases:
    its queries are dealt to one group per `term_rows` of them, and its aliases copied to each group.
    """
    own = queries.select("query_id", F.explode(F.split(F.trim("text"), "\\s+")).alias("term")).where(F.length("term") > 0)
    groups = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(term_rows)).cast("int"))
    counted = own.join(aliases.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_n")).select("term", groups.alias("_groups"))
    # Only frequent terms are dealt out; there are at most rows / term_rows of them, so the table is bounded.
    frequent = F.broadcast(counted.where(F.col("_groups") > 1))
    dealt = own.join(frequent, "term", "left")
    dealt = dealt.withColumn("_group", F.coalesce(F.pmod(F.xxhash64("query_id"), F.col("_groups")), F.lit(0).cast("long"))).drop("_groups")
    copies = aliases.join(frequent, "term", "left").withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_groups"), F.lit(1)).cast("long") - 1)))
    added = dealt.join(copies.drop("_groups"), ["term", "_group"]).select("query_id", F.explode(F.split("appended", "\\s+")).alias("term"))
    return own.union(added.where(F.length("term") > 0)).distinct()


def ready_stems(files: DataFrame) -> DataFrame:
    """Distinct stems of usable videos: not hidden, not partial, with a video suffix."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    ok = ~name.startswith(".") & ~stem.contains(".partial") & suffix.isin(*VIDEO_SUFFIXES)
    return files.where(ok).select(stem.alias("stem")).distinct()
