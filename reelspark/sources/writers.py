"""Sinks: documents, append-only result rows and overwritten tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelspark.session import folder_exists, materialise


def write_documents(df: DataFrame, path: str, key: str = "project_id", buckets: int = 256) -> None:
    """One JSON document per row; earlier documents of the same keys are replaced, all others stay.

    Rows lie in bucket folders by a hash of their key. Only buckets that receive a row are rewritten: their
    other documents are read first and written to the shared folder together with the new ones.
    Several rows of one key are all kept. The bucket number of a path must not change.
    """
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    fresh = materialise(df.select(F.col(key), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), text.alias("document")), "documents")
    rows = fresh
    if folder_exists(df.sparkSession, path):
        stored = df.sparkSession.read.schema(fresh.schema).parquet(path)
        touched = stored.join(fresh.select("bucket").distinct(), "bucket", "left_semi")
        kept = touched.join(fresh.select(key).distinct(), key, "left_anti").select(*fresh.columns)
        rows = materialise(fresh.unionByName(kept), "documents")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append long-form result rows."""
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
