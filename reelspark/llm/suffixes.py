"""Removal of byte strings that occur twice, by sorting suffixes column by column.

Candidates come from `winnow`: bytes whose windows nominate a repeated gram. Stretches that occur
twice as a whole need no sorting. The rest, one copy of each distinct stretch, form one small
collection per gram. Equal windows nominate the same gram at the same place, so stretches are aligned
on it and equal windows always begin in the same column. The collection's transform is then built
column by column from the right: every round puts one more symbol in front of each stretch, reorders
the suffixes that begin in that column by (symbol, order of the column before) and updates the common
prefix of each neighbouring pair. Column files are read once, in order; a round keeps only its own
column, so memory is one collection of bounded size. The columns of the transform stay apart because
no equal windows lie in different columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelspark.llm import units, winnow
from reelspark.session import materialise

WINDOW_BYTES = 200
GRAM_BYTES = 50
# Distinct stretches of one gram that one task sorts together. Beyond it, windows are counted by hash.
MOST_VARIANTS = 4096
# Bytes that one round of sorting handles together: whole grams, many small ones at once.
COLLECTION_BYTES = 1 << 22

STRETCH_SCHEMA = "project_id long, anchor long, content long, first int, windows int, lead int, symbols binary"
HIT_SCHEMA = "project_id long, first int"
CUT_SCHEMA = "project_id long, n_bytes long, n_removed long, spans array<struct<first:int,stop:int>>, kept binary"


def _asked(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    asks = wanted.groupBy("project_id").agg(F.collect_list(F.struct("anchor", "content", "first", "windows", "lead")).alias("asks"))
    return documents.join(asks, "project_id").select("project_id", "document", "asks")


def _asks_of(part: pa.RecordBatch, offsets: np.ndarray, window: int):
    """The asked runs of a slice as arrays, without those that do not fit their text."""
    listed = part.column("asks")
    flat = listed.flatten()
    owner = np.repeat(np.arange(len(part)), np.diff(listed.offsets.to_numpy()))
    first, count = flat.field("first").to_numpy().astype(np.int64), flat.field("windows").to_numpy()
    fits = np.flatnonzero(first + count + window - 1 <= np.diff(offsets)[owner])
    return flat.take(pa.array(fits)), owner[fits], first[fits] + offsets[owner[fits]], count[fits].astype(np.int64)


def stretches(documents: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of the wanted runs."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in units.slices(batch, "document"):
                flat, owner, at, count = _asks_of(part, offsets, window)
                if not len(owner):
                    continue
                whole = data.tobytes()
                symbols = [whole[a : a + n] for a, n in zip(at.tolist(), (count + window - 1).tolist())]
                ids = part.column("project_id").cast(pa.int64()).take(pa.array(owner))
                fields = [flat.field(c) for c in ("anchor", "content", "first", "windows", "lead")]
                yield pa.record_batch([ids, *fields, pa.array(symbols, pa.binary())], ["project_id", "anchor", "content", "first", "windows", "lead", "symbols"])

    return _asked(documents, wanted).mapInArrow(step, STRETCH_SCHEMA)


def window_hashes(documents: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Two hashes of every window of the wanted runs."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in units.slices(batch, "document"):
                flat, owner, at, count = _asks_of(part, offsets, window)
                if not len(owner):
                    continue
                run = np.repeat(np.arange(len(at)), count)
                offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
                place = at[run] + offset
                values = units.BYTE_VALUES[data]
                hashes = [pa.array(units.signed(units.Rolling(values, k).of(place, place + window))) for k in (2, 3)]
                ids = part.column("project_id").cast(pa.int64()).take(pa.array(owner[run]))
                start = pa.array((place - offsets[owner[run]]).astype(np.int32))
                yield pa.record_batch([ids, flat.field("anchor").take(pa.array(run)), *hashes, start], ["project_id", "anchor", "hash_a", "hash_b", "first"])

    return _asked(documents, wanted).mapInArrow(step, "project_id long, anchor long, hash_a long, hash_b long, first int")


def shared_starts(group: np.ndarray, lead: np.ndarray, size: np.ndarray, symbols: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that two stretches of one group share: stretch numbers and starts within the stretch.

    group: collection of each stretch, ascending; lead: place of the gram in it; symbols: all bytes joined.
    """
    base = np.concatenate(([0], np.cumsum(size)))[:-1]
    margin = lead.max() - lead  # columns before the stretch once grams are aligned
    last = margin + size - 1
    begins = np.argsort(-last, kind="stable")
    sorted_last = last[begins]
    order = np.zeros(0, np.int64)  # stretches by (group, suffix), of the column to the right
    common = np.zeros(0, np.int32)  # shared prefix with the entry before
    out_run, out_start = [], []
    came = 0
    for column in range(int(last.max()), -1, -1):
        stop = came
        while stop < len(begins) and sorted_last[stop] == column:
            stop += 1
        alive = margin[order] <= column
        if not alive.all():
            # Common prefixes of those that stay take the minimum over those that leave between them.
            where = np.flatnonzero(alive)
            common = np.minimum.reduceat(common[: where[-1] + 1], np.concatenate(([0], where[:-1] + 1))) if len(where) else common[:0]
            order = order[where]
        if stop > came:
            # Stretches that end here have the empty suffix, which sorts first.
            order = np.concatenate((begins[came:stop], order))
            common = np.concatenate((np.zeros(stop - came, np.int32), common))
            if stop - came < len(common):
                common[stop - came] = 0
            came = stop
        if not len(order):
            continue
        key = group[order] * 256 + symbols[base[order] + column - margin[order]]
        rank = np.argsort(key, kind="stable")
        sorted_key = key[rank]
        fresh = np.zeros(len(rank), np.int32)
        same = np.flatnonzero(sorted_key[1:] == sorted_key[:-1]) + 1
        if len(same):
            left, right = rank[same - 1] + 1, rank[same] + 1
            pairs = np.empty(2 * len(same), np.int64)
            pairs[0::2], pairs[1::2] = left, right
            fresh[same] = np.minimum.reduceat(np.append(common, np.int32(0)), pairs)[::2] + 1
        order, common = order[rank], fresh
        hit = np.flatnonzero(common >= window)
        if len(hit):
            both = np.unique(np.concatenate((order[hit], order[hit - 1])))
            out_run.append(both)
            out_start.append(column - margin[both])
    if not out_run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_run), np.concatenate(out_start)


def sorted_hits(found: DataFrame, window: int) -> DataFrame:
    """Starts of the windows that stretches of one gram share, from their sorted suffixes."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows).combine_chunks()
        anchor = table["anchor"].to_numpy()
        group = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
        column = table["symbols"].combine_chunks()
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
        symbols = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        run, start = shared_starts(group, table["lead"].to_numpy().astype(np.int64), np.diff(offsets), symbols, window)
        if not len(run):
            return None
        return pa.record_batch(
            [pa.array(table["project_id"].to_numpy()[run]), pa.array((table["first"].to_numpy()[run] + start).astype(np.int32))], ["project_id", "first"]
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            edges = np.flatnonzero(np.diff(anchor)) + 1
            at = 0
            for edge in [*edges.tolist(), len(anchor)]:
                part = batch.slice(at, edge - at)
                if held and size > COLLECTION_BYTES and held[-1].column("anchor")[-1].as_py() != anchor[at]:
                    out = solve(held)
                    if out is not None:
                        yield out
                    held, size = [], 0
                held.append(part)
                size += part.column("symbols").nbytes
                at = edge
        if held:
            out = solve(held)
            if out is not None:
                yield out

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(step, HIT_SCHEMA)


def repeated_spans(documents: DataFrame, window: int = WINDOW_BYTES, gram: int = GRAM_BYTES, most_variants: int = MOST_VARIANTS) -> DataFrame:
    """Byte stretches (project_id, first, bytes) covered by windows that occur at least twice."""
    runs = winnow.repeated_runs(documents, "byte", window, gram)
    classes = materialise(winnow.classes_of(runs), "run-classes")
    key = ["anchor", "content", "windows", "lead"]
    twice = classes.where("occurrences > 1").select(*key)
    whole = runs.join(twice, key, "left_semi").select("project_id", "first", (F.col("windows") + window - 1).alias("bytes"))

    several = winnow.contested(classes)
    found = stretches(documents, several.where(F.col("variants") <= most_variants), window)
    hits = sorted_hits(found, window)
    # Grams with very many contents: the same windows, counted by two 64-bit hashes instead of sorted.
    many = several.where(F.col("variants") > most_variants)
    hashed = materialise(window_hashes(documents, many, window), "windows")
    again = hashed.groupBy("anchor", "hash_a", "hash_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    counted = hashed.join(again, ["anchor", "hash_a", "hash_b"], "left_semi").select("project_id", "first")
    return whole.unionByName(hits.unionByName(counted).select("project_id", "first", F.lit(window).alias("bytes")))


_CUT_ARROW = pa.schema(
    [("project_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.binary())]
)


def cut(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents without the bytes of their spans."""
    listed = spans.groupBy("project_id").agg(F.collect_list(F.struct("first", "bytes")).alias("asks"))
    rows = documents.join(listed, "project_id", "left").select("project_id", "document", "asks")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in units.slices(batch, "document", 1 << 22):
                out: dict[str, list] = {c: [] for c in _CUT_ARROW.names}
                for i, (project, asks) in enumerate(zip(part.column("project_id").to_pylist(), part.column("asks"))):
                    text = data[offsets[i] : offsets[i + 1]]
                    merged, kept = [], text
                    if asks.is_valid:
                        gone = np.zeros(len(text) + 1, np.int32)
                        first, n = asks.values.field("first").to_numpy(), asks.values.field("bytes").to_numpy()
                        np.add.at(gone, np.minimum(first, len(text)), 1)
                        np.add.at(gone, np.minimum(first + n, len(text)), -1)
                        mask = np.cumsum(gone[:-1]) > 0
                        edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                        merged = [{"first": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
                        kept = text[~mask]
                    for name, value in zip(out, (project, len(text), len(text) - len(kept), merged, kept.tobytes())):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=_CUT_ARROW)

    return rows.mapInArrow(step, CUT_SCHEMA)


def remove_repeated_bytes(documents: DataFrame, window: int = WINDOW_BYTES, most_variants: int = MOST_VARIANTS) -> DataFrame:
    """Project documents without the byte strings that occur more than once.

    documents: project_id (unique long), document (text, read as UTF-8). Other columns are ignored. A byte
    goes when a string of `window` bytes that covers it also starts anywhere else, in the same document
    too; strings are judged on the input and never cross documents. Returns project_id, n_bytes,
    n_removed, spans (removed byte ranges, first to stop) and kept (the other bytes, which may begin or
    end inside a character).

    A null or empty document has no bytes and keeps none. Texts shorter than the window lose nothing.
    Rows with a null project_id are dropped. Rows that share a project_id are taken for copies of one
    document that repeat each other. An empty table gives an empty result.
    """
    documents = documents.select(F.col("project_id").cast("long").alias("project_id"), "document").where("project_id is not null")
    return cut(documents, repeated_spans(documents, window, min(GRAM_BYTES, window), most_variants))
