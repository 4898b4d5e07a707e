"""Rows dealt by a key as compressed columns, for work that needs all rows of a key at once.

A shuffle of rows takes several times the space of the same rows as columns. Here every task cuts its rows by bucket of the
key, and what is shuffled is one block of compressed columns per task and bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Rows that a task cuts at once, and bytes of input that one bucket is made for.
BLOCK_ROWS = 1 << 19
BUCKET_BYTES = 16 << 20
_MOST = 1 << 14
# Sizes above this are Spark's stand-in for an unknown one.
_UNKNOWN = 1 << 50


def _size(df: DataFrame) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < _UNKNOWN else 0


def buckets(*frames: DataFrame) -> int:
    """How many buckets the rows of these tables are dealt into."""
    parts = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, min(_MOST, sum(map(_size, frames)) // BUCKET_BYTES))


def _blocks(role: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        bucket = table["_bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        table = table.drop_columns(["_bucket"]).take(pa.array(order)).combine_chunks()
        found, first = np.unique(bucket[order], return_index=True)
        for b, i, j in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), table.num_rows]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as file:
                file.write_table(table.slice(i, j - i))
            yield pa.record_batch({"_bucket": pa.array([b], pa.int32()), "_role": pa.array([role], pa.int32()), "_block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from cut(held)
                held, rows = [], 0
        if rows:
            yield from cut(held)

    return step


def dealt(sides: list[tuple[DataFrame, Column]], work: Callable[[list[pa.Table | None]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """What `work` makes of each bucket's rows: one table per side, with all its rows whose key falls into the bucket, or None.

    sides: tables and their keys. A key's rows are in one task together, so keys that may be large have to go another way.
    """
    n = buckets(*[df for df, _ in sides])
    packs = None
    for role, (df, key) in enumerate(sides):
        pack = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).mapInArrow(_blocks(role), "_bucket int, _role int, _block binary")
        packs = pack if packs is None else packs.unionByName(pack)
    roles = range(len(sides))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list[pa.Table]]] = {}
        for batch in batches:
            for bucket, role, block in zip(*(batch.column(c) for c in ("_bucket", "_role", "_block"))):
                table = pa.ipc.open_stream(block.as_buffer()).read_all()
                held.setdefault(bucket.as_py(), {}).setdefault(role.as_py(), []).append(table)
        for bucket in sorted(held):
            found = held.pop(bucket)
            for out in work([pa.concat_tables(found[r]).combine_chunks() if r in found else None for r in roles]):
                yield from out.to_batches(max_chunksize=20_000)

    return packs.repartitionById(n, F.col("_bucket")).mapInArrow(step, schema)
