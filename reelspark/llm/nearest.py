"""Nearest frame histograms by multi-index hashing of learned binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reelspark.session import materialise

BITS = 64
PARTS = 4
ITERATIONS = 30
# Rows that the rotation is fitted on, picked by a hash of their id: the bound of the sample.
SAMPLE_ROWS = 20_000
# Share of the sample's nearest neighbours that the Hamming radius must reach.
REACH = 0.98
SAMPLE_QUERIES = 200
# Histograms of one block, and queries that meet it at once.
BLOCK_ROWS = 1 << 16
QUERY_ROWS = 1 << 11

FOUND_SCHEMA = "query_id long, shot_id long, distance double"


@dataclass
class Codes:
    """Rotation to binary codes, and the Hamming radius that is searched."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Codes as PARTS 16-bit substrings per row."""
        signs = (rows - self.mean) @ self.rotation > 0
        return np.packbits(signs, axis=1).view(">u2").astype(np.uint16)


def fit_codes(rows: np.ndarray, k: int, reach: float = REACH, seed: int = 0) -> Codes:
    """Principal directions, rotated until the signs lose least (iterative quantisation).

    Vectors of fewer than BITS numbers get further random rotations of the same directions. The radius
    is the smallest that reaches `reach` of the k nearest neighbours of some sample rows.
    """
    rng = np.random.default_rng(seed)
    mean = rows.mean(axis=0)
    centred = rows - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    width = min(BITS, rows.shape[1])
    directions = vectors[:, ::-1][:, :width]
    projected = centred @ directions
    parts, have = [], 0
    while have < BITS:
        rotation, _ = np.linalg.qr(rng.normal(size=(width, width)))
        for _ in range(ITERATIONS):
            signs = np.where(projected @ rotation > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ projected)
            rotation = (left @ right).T
        take = min(width, BITS - have)
        parts.append(directions @ rotation[:, :take])
        have += take
    codes = Codes(mean, np.concatenate(parts, axis=1), BITS)
    some = rng.permutation(len(rows))[:SAMPLE_QUERIES]
    code = codes.of(rows)
    needed = []
    for i in some:
        distance = ((rows - rows[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        near = np.argsort(distance, kind="stable")[: min(k, len(rows) - 1)]
        needed.append(np.bitwise_count(code[near] ^ code[i]).sum(axis=1))
    if needed and sum(map(len, needed)):
        flat = np.sort(np.concatenate(needed))
        codes.radius = int(flat[min(len(flat) - 1, int(np.ceil(reach * len(flat))) - 1)])
    return codes


class CodeIndex:
    """Tables from each substring's value to the rows that have it."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.tables = []
        for part in range(code.shape[1]):
            values, inverse = np.unique(code[:, part], return_inverse=True)
            self.tables.append((values, inverse))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within the radius of one code.

        With a radius r over m substrings, a row within it has one of the first r % m + 1 substrings
        within r // m, or one of the others within r // m - 1: only those values are probed.
        """
        parts = len(self.tables)
        each, extra = divmod(radius, parts)
        hit = np.zeros(len(self.code), bool)
        for part, (values, inverse) in enumerate(self.tables):
            limit = each if part <= extra else each - 1
            if limit < 0:
                continue
            probed = np.bitwise_count(values ^ code[part]) <= limit
            hit |= probed[inverse]
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.code[rows] ^ code).sum(axis=1) <= radius]


def _usable(histograms: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite numbers, not all zero."""
    value = F.col("hist").cast("array<double>")
    finite = F.forall("hist", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = histograms.select(F.col("shot_id").cast("long").alias("shot_id"), value.alias("hist")).where("shot_id is not null and hist is not null")
    return rows.where(finite & F.exists("hist", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def learn_codes(histograms: DataFrame, k: int, sample: int = SAMPLE_ROWS, reach: float = REACH) -> Codes | None:
    """Codes fitted on at most `sample` rows; none for an empty table."""
    rows = _usable(histograms)
    chosen = rows.orderBy(F.xxhash64("shot_id"), "shot_id").limit(sample).select("hist").toArrow()
    if not chosen.num_rows:
        return None
    return fit_codes(_matrix(chosen["hist"].combine_chunks()), k, reach)


def nearest_shots(histograms: DataFrame, queries: DataFrame, k: int = 10, codes: Codes | None = None) -> DataFrame:
    """The k nearest shots of each query shot by the Euclidean distance of their histograms.

    histograms and queries: shot_id (unique long), hist (array of numbers, of one length). Other columns
    are ignored. The codes are learned from a bounded sample (`learn_codes`); every row is indexed. Blocks
    of rows and blocks of queries meet in one task each: the rows of a block are indexed by the substrings
    of their codes, the values within the pigeonhole distances are probed, and all rows within the Hamming
    radius are ranked by exact distances in double precision. A query that finds fewer than k rows in the
    radius in some block widens it there, up to all rows of the block.

    Returns query_id, rank (from 1), shot_id and distance, nearest first, ties by shot_id, the query's own
    row left out; fewer rows if there are fewer candidates. Null vectors, all-zero vectors and those with
    null or non-finite numbers take no part. Empty tables give an empty result. Rows that share a shot_id
    are ranked each.
    """
    codes = codes or learn_codes(histograms, k)
    if codes is None:
        return histograms.sparkSession.createDataFrame([], "query_id long, rank int, shot_id long, distance double")
    told = histograms.sparkSession.sparkContext.broadcast(codes)
    rows, asks = materialise(_usable(histograms), "histograms"), materialise(_usable(queries), "queries")
    n, m = rows.count(), asks.count()
    blocks, groups = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // QUERY_ROWS))
    parts = int(histograms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(blocks, min(parts, -(-n // 2048)))
    block = F.pmod(F.xxhash64("shot_id"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("shot_id"), F.lit(groups)).cast("int")
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    placed = rows.select(block.alias("block"), numbers(groups).alias("group"), F.lit(False).alias("asks"), "shot_id", "hist")
    placed = placed.unionByName(asks.select(numbers(blocks).alias("block"), group.alias("group"), F.lit(True).alias("asks"), "shot_id", "hist"))

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        asking = table["asks"].to_numpy(zero_copy_only=False)
        ids, vectors = table["shot_id"].to_numpy(), _matrix(table["hist"].combine_chunks())
        here, there = np.flatnonzero(~asking), np.flatnonzero(asking)
        order = here[np.argsort(ids[here], kind="stable")]
        row_ids, row_vectors = ids[order], vectors[order]
        out_query, out_id, out_distance = [], [], []
        if len(order):
            index = CodeIndex(told.value.of(row_vectors))
            for q, code in zip(there, told.value.of(vectors[there])):
                radius = told.value.radius
                others = len(row_ids) - int(np.searchsorted(row_ids, ids[q], "right") - np.searchsorted(row_ids, ids[q]))
                while True:
                    found = index.within(code, radius)
                    found = found[row_ids[found] != ids[q]]
                    if len(found) >= min(k, others) or radius >= BITS:
                        break
                    radius = min(BITS, radius + PARTS)
                distance = np.sqrt(((row_vectors[found] - vectors[q]) ** 2).sum(axis=1))
                best = np.argsort(distance, kind="stable")[:k]
                out_query += [ids[q]] * len(best)
                out_id.append(row_ids[found[best]])
                out_distance.append(distance[best])
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.record_batch(
            [pa.array(np.array(out_query, np.int64)), pa.array(flat(out_id, np.int64)), pa.array(flat(out_distance, np.float64))], ["query_id", "shot_id", "distance"]
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("block", "group")]
            change = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
            at = 0
            for edge in [*change.tolist(), len(batch)]:
                key = (int(keys[0][at]), int(keys[1][at]))
                if held and key != now:
                    yield solve(held)
                    held = []
                now = key
                held.append(batch.slice(at, edge - at))
                at = edge
        if held:
            yield solve(held)

    found = placed.repartition("block", "group").sortWithinPartitions("block", "group").mapInArrow(step, FOUND_SCHEMA)
    # Of one query at most k rows a block: merge them, so that the last ranking sees few.
    order = Window.partitionBy("query_id").orderBy("distance", "shot_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "shot_id", "distance")
