"""Queries that show the shared primitives alone, and the streaming forms of the logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from reelspark.functions import maths
from reelspark.operators import joins, ordered
from reelspark.plans import adapters as A
from reelspark.plans import gate_queries as Q
from reelspark.plans.check_views import with_views
from reelspark.plans.registry import CHECKS, query
from reelspark.session import shared_folder
from reelspark.streaming import jobs


@query("group_measures", with_views("""
    SELECT track_id, round(coalesce(avg(energy) FILTER (kind = 'impact'), 0), 6) AS impact_mean, round(avg((energy > 0.4)::INT), 6) AS loud_ratio, round(stddev_pop(energy), 6) AS spread,
           count(*) FILTER (energy > 0.4) * 2 > count(*) AS mostly_loud, round(coalesce(sum(energy * value) / nullif(sum(energy), 0), 0), 6) AS weighted_value FROM v_track_events GROUP BY track_id"""))
def group_measures(spark, sf_dir):
    loud = F.col("energy") > 0.4
    return A.track_events(spark, sf_dir).groupBy("track_id").agg(
        F.round(maths.mean_or(F.when(F.col("kind") == "impact", F.col("energy"))), 6).alias("impact_mean"), F.round(maths.ratio_of(loud), 6).alias("loud_ratio"),
        F.round(F.stddev_pop("energy"), 6).alias("spread"), maths.majority(loud).alias("mostly_loud"),
        F.round(maths.weighted_mean(F.col("energy"), F.col("value")), 6).alias("weighted_value"))


@query("ordered_columns", with_views("""
    SELECT track_id, event_id, row_number() OVER w - 1 AS position, round(sum(value) OVER w, 6) AS running, lag(energy) OVER w AS prior, lead(energy) OVER w AS next,
           last_value(CASE WHEN kind = 'impact' THEN sec END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS impact_before,
           first_value(CASE WHEN kind = 'impact' THEN sec END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY sec, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS impact_after
    FROM v_track_events WINDOW w AS (PARTITION BY track_id ORDER BY sec, event_id)"""))
def ordered_columns(spark, sf_dir):
    hit = F.when(F.col("kind") == "impact", F.col("sec"))
    asks = {
        "position": ordered.position(), "running": ordered.running_sum(F.col("value")), "prior": ordered.lag(F.col("energy")),
        "next": ordered.lead(F.col("energy")), "impact_before": ordered.previous(hit), "impact_after": ordered.following(hit),
    }
    rows = ordered.annotate(A.track_events(spark, sf_dir), ["track_id"], ["sec", "event_id"], asks)
    return rows.withColumn("running", F.round("running", 6)).select("track_id", "event_id", *asks)


@query("top_events_per_track", with_views("""SELECT track_id, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY value DESC, event_id) AS rank FROM v_track_events) WHERE rank <= 5"""))
def top_events_per_track(spark, sf_dir):
    """Five strongest events of every track."""
    return joins.top_rows(A.track_events(spark, sf_dir), ["track_id"], 5, F.desc("value"), F.asc("event_id")).select("track_id", "event_id", "rank")


@query("window_point_counts", with_views("""
    SELECT i.track_id, i.kind, i.start_sec, (SELECT count(*) FROM v_beats b WHERE b.track_id = i.track_id AND b.sec >= i.start_sec AND b.sec < i.end_sec) AS beats,
           (SELECT count(*) FROM v_points p WHERE p.track_id = i.track_id AND p.sec >= i.start_sec AND p.sec < i.end_sec) AS points FROM v_intervals i"""))
def window_point_counts(spark, sf_dir):
    rows = joins.count_in_windows(A.intervals(spark, sf_dir), {"beats": A.beats(spark, sf_dir), "points": A.points(spark, sf_dir)}, ["track_id"])
    return rows.select("track_id", "kind", "start_sec", "beats", "points")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all data at hand and read what it wrote."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("state_verdicts_stream", CHECKS["state_verdicts"])
def state_verdicts_stream(spark, sf_dir):
    """The request log read as a stream."""
    source = A.state_requests(spark, sf_dir)
    return drain(jobs.validate_stream(jobs.read_log(spark, source.inputFiles()[0].rsplit("/", 1)[0], source.schema)), "verdicts")


@query("first_seen_stream", "SELECT DISTINCT sha256(l_orderkey || '-' || l_partkey) AS content_key FROM lineitem")
def first_seen_stream(spark, sf_dir):
    """Content keys of a stream, each let through once."""
    schema = A.table(spark, sf_dir, "lineitem").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    keyed = rows.select(F.sha2(F.concat_ws("-", "l_orderkey", "l_partkey"), 256).alias("content_key"), F.col("l_shipdate").cast("timestamp").alias("entered_at"))
    return drain(jobs.first_seen(keyed, "content_key", keep="20000 days").select("content_key"), "first-seen")


@query("sightings_stream", """
    WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, epoch_us(ts) AS at_us FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_us) AS rn FROM e),
    walk AS (SELECT key, rn, at_us, at_us AS last, true AS passed FROM n WHERE rn = 1
             UNION ALL SELECT n.key, n.rn, n.at_us, CASE WHEN n.at_us - last >= 86400000000 THEN n.at_us ELSE last END, n.at_us - last >= 86400000000
             FROM walk w JOIN n ON n.key = w.key AND n.rn = w.rn + 1)
    SELECT key, at_us FROM walk WHERE passed""")
def sightings_stream(spark, sf_dir):
    """Kinds of events of every user, each let through once a day; state of older ones expires."""
    schema = A.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    keyed = raw.select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("entered_at"))
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/sightings-{uuid.uuid4().hex}"
    jobs.write_routed(jobs.sightings(keyed, "key"), folder).awaitTermination()
    return spark.read.schema("key string, at_us long").parquet(f"{folder}/rows").select("key", "at_us")


@query("daily_stage_stream", f"""
    SELECT epoch_us(date_trunc('day', ts)) AS day_us, stage, status, count(*) AS runs FROM ({Q._RUNS}) GROUP BY ALL
    HAVING date_trunc('day', max(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def daily_stage_stream(spark, sf_dir):
    """Stage counts of every day that the watermark (one day behind the newest run) has closed."""
    runs = Q.runs(spark, sf_dir)
    schema = A.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stage = F.element_at(F.array(*[F.lit(s) for s in ("analyze_reference", "plan", "compile", "qa")]), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    stream = raw.select(stage.alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("status"), F.col("ts").cast(runs.schema["started_at"].dataType).alias("started_at"))
    return drain(jobs.stage_counts(stream), "stage-days").select(F.unix_micros("window_start").alias("day_us"), "stage", "status", "runs")
