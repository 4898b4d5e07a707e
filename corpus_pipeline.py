"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

Every row is a document, also without a doc_id or under one that another row has; stages join by a key of the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelspark.llm import leaks, mixture, queries, repeats, similar, toxicity
from reelspark.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Near duplicates: word shingles and the share of them, in percent, that two documents have in common.
SHINGLE_WORDS, PERCENT = 5, 80


def keyed(docs: DataFrame, distinct: bool = False) -> DataFrame:
    """Documents with a key of each row, `_row`: never null, and of one row only.

    It is the doc_id, for one row of each. Further rows under a doc_id, and rows without one, get keys behind all
    doc_ids, so they come after the others wherever the order of documents counts. Those keys are written, not
    computed again. distinct: of equal rows one is kept.
    """
    docs = docs.select(*COLUMNS)
    repeated = materialise(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    ids = repeated.select(F.col("doc_id").alias("_id"))
    others = docs.join(ids.where("_id is not null"), F.col("doc_id") == F.col("_id"), "left_anti").where("doc_id is not null")
    rows = docs.where("doc_id is null").unionByName(docs.join(ids, F.col("doc_id") == F.col("_id"), "left_semi"))
    rows = rows.distinct() if distinct else rows
    rows = materialise(rows.withColumn("_n", F.monotonically_increasing_id()), "repeated-rows")
    low, high, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first() + rows.agg(F.max("_n")).first()
    if high is None or high + 1 + most < 1 << 63:
        key = F.lit((high if high is not None else 0) + 1) + F.col("_n")
    elif low - 1 - most >= -(1 << 63):
        key = F.lit(low - 1) - F.col("_n")
    else:
        raise ValueError("doc_ids leave no room for keys of repeated rows")
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("_n").alias("_n")).select("_n", F.col("doc_id").cast("long").alias("_first"))
    rows = rows.join(materialise(first, "first-rows"), "_n", "left").select(*COLUMNS, F.coalesce("_first", key).alias("_row"))
    return others.withColumn("_row", F.col("doc_id").cast("long")).unionByName(rows)


def row_documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_row").alias("project_id"), F.col("text").alias("document"))


def without_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts. It is fitted on labelled documents of the input."""
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(*COLUMNS).withColumnRenamed("text", "document")
    return toxicity.without_toxic(rows, model).withColumnRenamed("document", "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-duplicate links, the one with the smallest key; of equal rows, one."""
    rows = keyed(docs, distinct=True)
    found = similar.similar_projects(row_documents(rows), SHINGLE_WORDS, PERCENT)
    kept = found.where("component_id = project_id").select(F.col("project_id").alias("_row"))
    return rows.join(materialise(kept, "kept"), "_row", "left_semi").select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of fifty words or more that an earlier one holds; the others keep their text as it is."""
    rows = keyed(docs).select(F.col("_row").alias("project_id"), F.col("text").alias("document"), "doc_id", "lang", "source", "n_chars")
    out = repeats.remove_repeats(rows, carry=["doc_id", "lang", "source", "n_chars"], respace=False)
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", chars.alias("n_chars"))


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("source_hash"), F.col("text").alias("document"))
    rows = keyed(docs)
    found = leaks.blueprint_leaks(row_documents(rows), items)
    found = materialise(found.select(F.col("project_id").alias("_row")).distinct(), "leaks")
    return rows.join(found, "_row", "left_anti").select(*COLUMNS)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix: how many words of each are taken, and its place in the queue. Those that get no words are not in it."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    rows = keyed(docs)
    out = mixture.mix_series(rows.select(F.col("_row").alias("shot_id"), F.col("source").alias("series"), words.alias("frames")))
    out = out.where("taken > 0").select(
        F.col("shot_id").alias("_row"), F.col("frames").alias("size"), F.col("series_frames").alias("source_size"), "target", "taken", "finish_time"
    )
    return rows.join(materialise(out, "mix"), "_row").drop("_row")


STAGES = [
    ("toxicity", without_toxic_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark_passages),
    ("mixing sources to target weights", mixed_to_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


# Toxicity and benchmark matches have no SQL form; tests compare the stages with plain models.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
CHECKS: dict[str, str] = {}
