"""Removal of word passages that an earlier project document already holds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelspark.llm import units, winnow
from reelspark.session import materialise

WINDOW_WORDS = 50
KEPT_SCHEMA = "n_words long, n_removed long, spans array<struct<first:int,stop:int>>, kept string"
KEPT_NAMES = ("n_words", "n_removed", "spans", "kept")


def _window_hashes(documents: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Hash of every window of the wanted runs: (anchor, content, lead, offset, window, project_id)."""
    asks = wanted.groupBy("project_id").agg(F.collect_list(F.struct("anchor", "content", "first", "windows", "lead")).alias("asks"))
    rows = documents.join(asks, "project_id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in units.slices(batch, "document"):
                starts, stops, bounds = units.words(data, offsets)
                rolling = units.Rolling(units.word_hashes(data, starts, stops), 3)
                listed = part.column("asks")
                flat = listed.flatten()
                owner = np.repeat(np.arange(len(part)), np.diff(listed.offsets.to_numpy()))
                first = flat.field("first").to_numpy() + bounds[owner]
                count = flat.field("windows").to_numpy()
                run = np.repeat(np.arange(len(first)), count)
                offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
                at = first[run] + offset
                fits = at + window <= bounds[owner[run] + 1]
                run, offset, at = run[fits], offset[fits], at[fits]
                yield pa.record_batch(
                    [
                        flat.field("anchor").take(pa.array(run)), flat.field("content").take(pa.array(run)), flat.field("lead").take(pa.array(run)),
                        pa.array(offset.astype(np.int32)), pa.array(units.signed(rolling.of(at, at + window))),
                        part.column("project_id").cast(pa.int64()).take(pa.array(owner[run])),
                    ],
                    ["anchor", "content", "lead", "offset", "window", "project_id"],
                )

    schema = "anchor long, content long, lead int, offset int, window long, project_id long"
    return rows.select("project_id", "document", "asks").mapInArrow(step, schema)


def repeated_spans(documents: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Word stretches (project_id, first, words) covered by windows that a document with a smaller id also holds.

    Level-wise doubling: level one looks at grams of half the window length (one nominated per window)
    and drops all that occur once. Only windows around a repeated gram are extended to the full, doubled
    length and compared again. Runs of windows with equal content are compared as a whole; single windows
    are hashed only where contents around one gram differ, once per distinct content. A window counts
    as equal when both its level-one and level-two hashes are (two independent 64-bit values).
    """
    runs = winnow.repeated_runs(documents, "word", window, -(-window // 2))
    classes = materialise(winnow.classes_of(runs), "run-classes")
    key = ["anchor", "content", "windows", "lead"]
    first_of = classes.select(*key, F.col("project_id").alias("_first_id"))
    located = runs.join(first_of, key)
    whole = located.where("project_id > _first_id").select("project_id", "first", (F.col("windows") + window - 1).alias("words"))

    hashed = materialise(_window_hashes(documents, winnow.contested(classes), window), "windows")
    lead = (F.col("lead") - F.col("offset")).alias("_lead")
    least = hashed.groupBy("anchor", lead, "window").agg(F.min("project_id").alias("_least"))
    early = hashed.withColumn("_lead", F.col("lead") - F.col("offset")).join(least, ["anchor", "_lead", "window"]).where("project_id > _least")
    # Later members of a class go as a whole; only its first document needs the single windows.
    single = early.select("anchor", "content", "lead", "offset", "project_id").join(runs, ["anchor", "content", "lead", "project_id"])
    single = single.select("project_id", (F.col("first") + F.col("offset")).alias("first"), F.lit(window).alias("words"))
    return whole.unionByName(single)


def cut(documents: DataFrame, spans: DataFrame, carry: Sequence[str] = (), respace: bool = True) -> DataFrame:
    """Documents without the words of their spans: counts, merged spans and the kept words joined by one space."""
    listed = spans.groupBy("project_id").agg(F.collect_list(F.struct("first", "words")).alias("_asks"))
    own = ["project_id", *carry]
    rows = documents.select(*own, F.col("document").alias("_text")).join(listed, "project_id", "left").select(*own, "_text", "_asks")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, len(whole), 512)):
                out: list[tuple] = []
                for text, asks in zip(batch.column("_text").to_pylist(), batch.column("_asks")):
                    found = (text or "").encode().split()
                    merged: list[dict] = []
                    if asks.is_valid:
                        gone = np.zeros(len(found) + 1, np.int64)
                        first, n = asks.values.field("first").to_numpy(), asks.values.field("words").to_numpy()
                        np.add.at(gone, np.minimum(first, len(found)), 1)
                        np.add.at(gone, np.minimum(first + n, len(found)), -1)
                        mask = np.cumsum(gone[:-1]) > 0
                        edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                        merged = [{"first": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
                    kept, at = [], 0
                    for span in merged:
                        kept += found[at : span["first"]]
                        at = span["stop"]
                    kept += found[at:]
                    same = not respace and not merged
                    out.append((len(found), len(found) - len(kept), merged, text if same else b" ".join(kept).decode()))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())])), pa.string())
                made = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *made], [*own, *KEPT_NAMES])

    return rows.mapInArrow(step, f"{fields}, {KEPT_SCHEMA}")


def remove_repeats(documents: DataFrame, window: int = WINDOW_WORDS, carry: Sequence[str] = (), respace: bool = True) -> DataFrame:
    """Project documents without the passages that an earlier document holds.

    documents: project_id (unique long), document (text), and the columns named in `carry`, which the result
    keeps between project_id and its own; others are ignored. Words are runs of anything but ASCII white
    space, compared unchanged. A word goes when a window of `window` words
    that covers it also starts in a document with a smaller project_id; windows are judged on the
    input. Returns project_id, n_words, n_removed, spans (removed word ranges, first to stop) and kept
    (the other words joined by one space). Without `respace`, documents that lose nothing keep their text as
    it is.

    A null or empty document has no words and keeps the empty text. Documents shorter than the window
    lose nothing. Repeats within one document alone stay. Rows with a null project_id are dropped. Rows
    that share a project_id are taken for copies of one document; each is returned. An empty table
    gives an empty result.
    """
    documents = documents.select(F.col("project_id").cast("long").alias("project_id"), "document", *carry).where("project_id is not null")
    return cut(documents, repeated_spans(documents.select("project_id", "document"), window), carry, respace)
