"""Connected components of an edge table, in rounds of joins and contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reelspark.session import materialise

# Links that a task contracts at once; fewer are not dealt to several tasks.
HELD_EDGES = 1 << 17


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def star_forest(child: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that the edges join to a smaller one, and the smallest node they join it to."""
    nodes, place = np.unique(np.concatenate((child, parent)), return_inverse=True)
    a, b = place[: len(child)], place[len(child) :]
    label = np.arange(len(nodes))
    while True:
        # Roots hang on the smallest root they have an edge to; then every node takes its root again.
        ends = label[a], label[b]
        low = label.copy()
        np.minimum.at(low, np.maximum(*ends), np.minimum(*ends))
        while not np.array_equal(low, after := low[low]):
            low = after
        if np.array_equal(low, label):
            break
        label = low
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contracted(links: DataFrame) -> DataFrame:
    """Links replaced, about HELD_EDGES of a task at a time, by the stars of what they connect."""
    most = HELD_EDGES

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(batch)
            if size >= most:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        forest = star_forest(*(np.concatenate(x) for x in zip(*held)))
        return pa.record_batch([pa.array(x) for x in forest], ["child", "parent"])

    return links.mapInArrow(step, "child long, parent long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Alternates two steps until nothing changes: every node ties its larger neighbours to its smallest
    neighbour, then ties its smaller neighbours to it. Before that, links read by one task are contracted
    there, which makes rounds fewer: at most in the order of the logarithm of the longest path. It also leaves a
    node one smaller neighbour for each HELD_EDGES links that a task reads, so only those are ordered by node;
    larger neighbours, of which there may be any number, are only aggregated or joined. Once no more than
    HELD_EDGES links are left, one task contracts them and nothing remains to be tied.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("child"), F.least(a, b).cast("long").alias("parent")).distinct()
    links = materialise(links, "links")
    before = _state(links)
    upwards = Window.partitionBy("child").orderBy("parent")
    while before[0]:
        tasks = -(-before[0] // HELD_EDGES)
        stars = materialise(_contracted(links.coalesce(tasks)), "stars")
        if tasks == 1:
            links = stars
            break
        low = stars.groupBy(F.col("child").alias("_node")).agg(F.min("parent").alias("_low"))
        large = stars.join(low, F.col("parent") == F.col("_node"), "left").select("child", F.coalesce("_low", "parent").alias("parent"))
        small = large.select("child", "parent", F.first("parent").over(upwards).alias("_low"), F.row_number().over(upwards).alias("_place"))
        small = small.where("_place = 1 or parent > _low").select(F.when(F.col("_place") == 1, F.col("child")).otherwise(F.col("parent")).alias("child"), F.col("_low").alias("parent"))
        links = materialise(small, "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(
        links.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    )
