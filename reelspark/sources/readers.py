"""Readers for id lists, catalogs, media listings, probe documents and detector logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reelspark.operators import catalog

STREAM_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("codec_type", "codec_name", "avg_frame_rate", "r_frame_rate", "duration", "nb_read_frames", "nb_frames", "sample_rate")
    ]
    + [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]
)
PROBE_SCHEMA = T.StructType(
    [
        T.StructField("streams", T.ArrayType(STREAM_SCHEMA)),
        T.StructField("format", T.StructType([T.StructField("duration", T.StringType())])),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Columnar table with a declared schema."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def parse_id_list(text: Column) -> Column:
    """Ids of one list file: a JSON array when it starts with '[', else one per non-blank line."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    trimmed = F.transform(F.split(body, r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.filter(trimmed, lambda x: F.length(x) > 0)
    return F.when(body.startswith("["), F.from_json(body, "array<string>")).otherwise(lines)


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """Id lists of every file below a path: (list_path, pos, shot_id) in file order."""
    rows = spark.read.text(path, wholetext=True).withColumn("list_path", F.col("_metadata.file_path"))
    return rows.select("list_path", F.posexplode(parse_id_list(F.col("value"))).alias("pos", "shot_id"))


def list_media(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path without reading their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def ready_media(spark: SparkSession, path: str) -> DataFrame:
    return catalog.ready_stems(list_media(spark, path))


def hash_files(spark: SparkSession, path: str, piece_bytes: int = 1 << 20) -> DataFrame:
    """SHA-256 of every file below a path: (path, length, sha256). A file of any size is read in pieces;
    Spark's listing leaves out empty files.

    Files are listed without their content and dealt out by path. Each task opens its files through the
    file system of their URL and keeps one piece in memory, since a hash needs its bytes in order.
    """
    files = list_media(spark, path).repartition("path")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("path").to_pylist()
            done = []
            for name in names:
                system, inner = pa_fs.FileSystem.from_uri(_uri(name))
                digest = hashlib.sha256()
                with system.open_input_stream(inner) as file:
                    while piece := file.read(piece_bytes):
                        digest.update(piece)
                done.append(digest.hexdigest())
            yield pa.record_batch([batch.column("path"), batch.column("length"), pa.array(done, pa.string())], ["path", "length", "sha256"])

    return files.mapInArrow(step, "path string, length long, sha256 string")


def _uri(name: str) -> str:
    """A listed path as the URL that file systems open: Spark writes file:/x for file:///x."""
    return "file://" + name[len("file:") :] if name.startswith("file:/") and not name.startswith("file://") else name


def parse_rate(text: Column) -> Column:
    """"n/d" or "n" as struct(num, den) in lowest terms."""
    parts = F.split(text, "/")
    num = F.element_at(parts, 1).cast("bigint")
    den = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("bigint"), F.lit(1).cast("bigint"))

    def euclid(s, _):
        return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b")))

    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(num.alias("a"), den.alias("b")), euclid, lambda s: F.greatest(s["a"], F.lit(1)))
    return F.struct((num / gcd).cast("bigint").alias("num"), (den / gcd).cast("bigint").alias("den"))


def parse_probe(rows: DataFrame, duration_from: str = "format", text: str = "probe_json") -> DataFrame:
    """Media facts from probe documents: first video stream, first audio stream, rate and duration.

    `duration_from` is "format" for imports and "video" for quality checks. Documents without a
    video stream come back with `has_video` false.
    """
    doc = rows.withColumn("_p", F.from_json(text, PROBE_SCHEMA))

    def first(kind: str) -> Column:
        return F.try_element_at(F.filter("_p.streams", lambda s: s["codec_type"] == kind), F.lit(1))

    doc = doc.withColumns({"_v": first("video"), "_a": first("audio")})
    stream, container = F.nullif(F.col("_v.duration"), F.lit("")), F.nullif(F.col("_p.format.duration"), F.lit(""))
    duration = F.coalesce(stream, container) if duration_from == "video" else F.coalesce(container, stream)
    rate = parse_rate(F.coalesce(F.nullif(F.col("_v.avg_frame_rate"), F.lit("")), F.nullif(F.col("_v.r_frame_rate"), F.lit("")), F.lit("0/1")))
    return doc.select(
        *rows.columns,
        F.col("_v").isNotNull().alias("has_video"),
        F.coalesce("_v.width", F.lit(0)).alias("width"),
        F.coalesce("_v.height", F.lit(0)).alias("height"),
        rate["num"].alias("fps_num"),
        rate["den"].alias("fps_den"),
        F.coalesce(duration.cast("double"), F.lit(0.0)).alias("duration_sec"),
        F.coalesce("_v.codec_name", F.lit("")).alias("codec"),
        F.col("_a").isNotNull().alias("has_audio"),
        F.col("_a.sample_rate").cast("int").alias("sample_rate"),
        F.coalesce(F.nullif(F.col("_v.nb_read_frames"), F.lit("")), F.col("_v.nb_frames"), F.lit("0")).cast("bigint").alias("read_frames"),
    )
