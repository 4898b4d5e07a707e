"""Candidates for repeated windows: every window nominates one short gram, and only repeated grams stay.

A window of `window` units nominates the gram of `gram` units with the smallest hash in it (the
leftmost of equals). The nomination depends on the window's content alone, so equal windows nominate
equal grams at the same place, and no repeated window is lost. Neighbouring windows mostly nominate
the same gram: a *run* is a maximal stretch of windows of one document with the same nominated gram.
Runs are about 2 / (window - gram + 2) of all windows, which is what gets shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelspark.llm import units
from reelspark.session import materialise

RUN_SCHEMA = "project_id long, anchor long, content long, first int, windows int, lead int"
_PLACE = np.uint64(31)
_PLACE_MASK = np.uint64((1 << 31) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = len(x) - width + 1
    size = -(-len(x) // width) * width
    padded = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def runs_of(values: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray] | None:
    """Runs of the texts whose units are `values`; positions count from the text's own start."""
    n = len(values)
    if n < window:
        return None
    grams = units.Rolling(values, 1).of(np.arange(n - gram + 1), np.arange(gram, n + 1))
    ranked = ((grams >> _PLACE) << _PLACE) | np.arange(len(grams), dtype=np.uint64)
    low = _sliding_min(ranked, window - gram + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(np.arange(n - window + 1) + window <= bounds[1:][text[: n - window + 1]])
    if not len(start):
        return None
    place = (low[start] & _PLACE_MASK).astype(np.int64)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 1) | (np.diff(text[start]) != 0)) + 1
    head = np.concatenate(([0], cut))
    tail = np.concatenate((cut, [len(start)])) - 1
    first, last, place = start[head], start[tail], place[head]
    content = units.Rolling(values, 2).of(first, last + window)
    owner = text[first]
    return {
        "owner": owner, "anchor": units.signed(grams[place]),
        "content": units.signed(units.mix(content + (place - first).astype(np.uint64), 3)),
        "first": (first - bounds[owner]).astype(np.int32), "windows": (last - first + 1).astype(np.int32), "lead": (place - first).astype(np.int32),
    }


def units_of(kind: str) -> Callable:
    """Function from a slice's bytes and offsets to unit values, unit bounds per text and byte places of the units."""

    def words(data, offsets):
        starts, stops, bounds = units.words(data, offsets)
        return units.word_hashes(data, starts, stops), bounds, (starts, stops)

    def plain(data, offsets):
        return units.BYTE_VALUES[data], offsets, None

    return {"word": words, "byte": plain}[kind]


def find_runs(documents: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """Runs of every document (project_id, document)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = units_of(kind)
        for batch in batches:
            for part, data, offsets in units.slices(batch, "document"):
                values, bounds, _ = read(data, offsets)
                found = runs_of(values, bounds, window, gram)
                if found is None:
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False)[found["owner"]]
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), *(pa.array(found[c]) for c in ("anchor", "content", "first", "windows", "lead"))],
                    ["project_id", "anchor", "content", "first", "windows", "lead"],
                )

    return documents.select("project_id", "document").mapInArrow(step, RUN_SCHEMA)


def repeated_runs(documents: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """Runs whose nominated gram is nominated by another run too, written once."""
    runs = materialise(find_runs(documents, kind, window, gram), "runs")
    again = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor")
    # Written first, so that both sides of the join are plain exchanges and a frequent gram's runs are split.
    return materialise(runs.join(materialise(again, "repeated-grams"), "anchor", "left_semi"), "repeated-runs")


def classes_of(runs: DataFrame) -> DataFrame:
    """One row per distinct run content: occurrences, smallest document, and a place in it."""
    place = F.min(F.struct("project_id", "first")).alias("_at")
    out = runs.groupBy("anchor", "content", "windows", "lead").agg(F.count(F.lit(1)).alias("occurrences"), place)
    return out.select("anchor", "content", "windows", "lead", "occurrences", F.col("_at.project_id").alias("project_id"), F.col("_at.first").alias("first"))


def contested(classes: DataFrame) -> DataFrame:
    """Classes whose gram has several contents: only they can share some windows and not others."""
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    return classes.join(several, "anchor")
