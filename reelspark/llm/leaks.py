"""Project documents that hold passages of reference blueprints, by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelspark.llm import units
from reelspark.session import materialise

SEED_WORDS = 4
COVERAGE = 0.6
# Blueprint seeds that are sent to every task to thin out the documents' seeds. With more of them
# nothing is sent, and all document seeds are joined.
MOST_SENT_SEEDS = 1 << 20

STRETCH_SCHEMA = "project_id long, stretch int, first int, words binary, seeds array<long>"
TILE_SCHEMA = "project_id long, source_hash string, n_words int, n_covered int, n_tiles int, tiles array<struct<first:int,at:int,words:int>>"


def _tokens(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, seed: int):
    """Word hashes (case and ASCII punctuation ignored), their bounds per text, seed hashes and seed places."""
    starts, stops, bounds = units.words(data, offsets, units.NOT_ALNUM)
    hashes = units.word_hashes(data, starts, stops)
    seeds, place = units.shingles(hashes, bounds, seed, 1)
    return hashes, bounds, seeds, place


def _folded(texts: DataFrame, column: str) -> DataFrame:
    return texts.withColumn(column, F.lower(column))


def blueprint_tokens(blueprints: DataFrame, seed: int) -> DataFrame:
    """Words (as hashes) and seeds of every blueprint: (source_hash, words, seeds). A text of fewer than `seed` words has no seed."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in units.slices(batch, "document"):
                hashes, bounds, seeds, place = _tokens(part, data, offsets, seed)
                owner = np.searchsorted(bounds, place, "right") - 1
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                words = [hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                listed = [np.unique(units.signed(seeds[a:b])) for a, b in zip(cuts, cuts[1:])]
                yield pa.record_batch([part.column("source_hash"), pa.array(words, pa.binary()), pa.array(listed, pa.list_(pa.int64()))], ["source_hash", "words", "seeds"])

    return _folded(blueprints.select("source_hash", "document"), "document").mapInArrow(step, "source_hash string, words binary, seeds array<long>")


def matching_stretches(documents: DataFrame, seed: int, sent: np.ndarray | None) -> DataFrame:
    """Word stretches of documents that consist of blueprint seeds (of all seeds when none were sent)."""
    told = None if sent is None else documents.sparkSession.sparkContext.broadcast(np.sort(sent.view(np.uint64)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if told is None else told.value
        if wanted is not None:
            low = np.zeros(1 << 22, bool)
            low[(wanted & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            for part, data, offsets in units.slices(batch, "document"):
                hashes, bounds, seeds, place = _tokens(part, data, offsets, seed)
                if wanted is not None:
                    keep = np.flatnonzero(low[(seeds & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(wanted, seeds[keep]), max(0, len(wanted) - 1))
                    keep = keep[wanted[at] == seeds[keep]] if len(wanted) else keep[:0]
                    seeds, place = seeds[keep], place[keep]
                if not len(place):
                    continue
                owner = np.searchsorted(bounds, place, "right") - 1
                head = np.flatnonzero(np.concatenate(([True], (place[1:] > place[:-1] + seed) | (owner[1:] != owner[:-1]))))
                tail = np.append(head[1:], len(place))
                first = place[head]
                words = [hashes[a:b].tobytes() for a, b in zip(first, place[tail - 1] + seed)]
                listed = [np.unique(units.signed(seeds[a:b])) for a, b in zip(head, tail)]
                ids = part.column("project_id").cast(pa.int64()).take(pa.array(owner[head]))
                own = (first - bounds[owner[head]]).astype(np.int32)
                yield pa.record_batch(
                    [ids, pa.array(own), pa.array(own), pa.array(words, pa.binary()), pa.array(listed, pa.list_(pa.int64()))],
                    ["project_id", "stretch", "first", "words", "seeds"],
                )

    return _folded(documents.select("project_id", "document"), "document").mapInArrow(step, STRETCH_SCHEMA)


def tile(text: np.ndarray, breaks: np.ndarray, pattern: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in text, start in pattern, words), longest matches first, none overlapping.

    Each round looks for unmarked matches of one length by Karp-Rabin: rolling hashes of the pattern's
    unmarked stretches, looked up for those of the text, and compared word by word. It starts at the
    longest possible length and goes down to `least`; matches longer than the length looked for cannot
    exist any more. breaks: places in `text` at which a new stretch begins.
    """
    tiles: list[tuple[int, int, int]] = []
    free_text, free_pattern = np.ones(len(text), bool), np.ones(len(pattern), bool)
    cut = np.zeros(len(text) + 1, bool)
    cut[breaks] = True
    roll_text, roll_pattern = units.Rolling(text, 1), units.Rolling(pattern, 1)

    def unmarked(free: np.ndarray, size: int, ends: np.ndarray | None) -> np.ndarray:
        used = np.concatenate(([0], np.cumsum(~free)))
        ok = used[size:] == used[:-size]
        if ends is not None:
            crossed = np.cumsum(ends)
            ok &= crossed[size - 1 : -1] == crossed[: -size]
        return np.flatnonzero(ok)

    def longest(top: int) -> int:
        """Longest unmarked match up to `top`, by halving: a match of some length holds one of each shorter length."""
        low, high = least - 1, top
        while low < high:
            middle = (low + high + 1) // 2
            a, b = unmarked(free_pattern, middle, None), unmarked(free_text, middle, cut)
            if len(a) and len(b) and np.isin(roll_text.of(b, b + middle), roll_pattern.of(a, a + middle)).any():
                low = middle
            else:
                high = middle - 1
        return low

    size = min(len(text), len(pattern))
    while size >= least:
        size = longest(size)
        if size < least:
            break
        a, b = unmarked(free_pattern, size, None), unmarked(free_text, size, cut)
        of_pattern = roll_pattern.of(a, a + size)
        order = np.argsort(of_pattern, kind="stable")
        ranked = of_pattern[order]
        of_text = roll_text.of(b, b + size)
        low, high = np.searchsorted(ranked, of_text), np.searchsorted(ranked, of_text, "right")
        marked = False
        for i in np.flatnonzero(low < high).tolist():
            at = int(b[i])
            if not free_text[at : at + size].all():
                continue
            for j in range(int(low[i]), int(high[i])):
                p = int(a[order[j]])
                if free_pattern[p : p + size].all() and np.array_equal(text[at : at + size], pattern[p : p + size]):
                    tiles.append((at, p, size))
                    free_text[at : at + size] = False
                    free_pattern[p : p + size] = False
                    marked = True
                    break
        if not marked:
            size -= 1
    return tiles


def tiled_pairs(pairs: DataFrame, least: int) -> DataFrame:
    """Tiles of every pair (project_id, source_hash, stretches array of (first, words), pattern)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("project_id", pa.int64()), ("source_hash", pa.string()), ("n_words", pa.int32()), ("n_covered", pa.int32()), ("n_tiles", pa.int32()),
                ("tiles", pa.list_(pa.struct([("first", pa.int32()), ("at", pa.int32()), ("words", pa.int32())]))),
            ]
        )
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                listed = sorted(row["stretches"], key=lambda s: s["first"])
                parts = [np.frombuffer(s["words"], np.uint64) for s in listed]
                breaks = np.cumsum([0, *(len(p) for p in parts)])
                firsts = np.array([s["first"] for s in listed])
                pattern = np.frombuffer(row["pattern"], np.uint64)
                found = tile(np.concatenate(parts), breaks[1:-1], pattern, least)
                tiles = []
                for at, p, size in sorted(found):
                    k = int(np.searchsorted(breaks, at, "right")) - 1
                    tiles.append({"first": int(firsts[k] + at - breaks[k]), "at": p, "words": size})
                rows.append(
                    {
                        "project_id": row["project_id"], "source_hash": row["source_hash"], "n_words": len(pattern),
                        "n_covered": sum(t["words"] for t in tiles), "n_tiles": len(tiles), "tiles": tiles,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pairs.select("project_id", "source_hash", "stretches", "pattern").mapInArrow(step, TILE_SCHEMA)


def blueprint_leaks(
    documents: DataFrame, blueprints: DataFrame, seed: int = SEED_WORDS, coverage: float = COVERAGE, most_sent: int = MOST_SENT_SEEDS
) -> DataFrame:
    """Pairs of project document and reference blueprint where the document holds much of the blueprint's text.

    documents: project_id (long), document. blueprints: source_hash (text), document. Other columns are
    ignored. Words are runs of letters, digits and non-ASCII characters in lower case. Pairs that share
    a run of `seed` words are candidates. Each is tiled: the longest common runs that overlap no earlier
    one are marked again and again, down to `seed` words, so passages in another order count too. A pair
    is returned when the tiles cover at least `coverage` of the blueprint's words.

    Returns project_id, source_hash, n_words (of the blueprint), n_covered, coverage, n_tiles and tiles
    (first word in the document, first word in the blueprint, words). Documents without such a blueprint
    have no row. Null and empty texts, and blueprints of fewer than `seed` words, match nothing. Repeated
    documents and blueprints under one id count as one each. Null ids are dropped. Equal matches are marked
    in order of place. Empty tables give an empty result.

    The blueprints' seeds are counted first. Up to `most_sent` of them are sent to the tasks that read
    documents; with more, the documents' seeds are all joined. A document's stretches and one blueprint
    are the largest things in a task.
    """
    documents = documents.select(F.col("project_id").cast("long").alias("project_id"), "document").where("project_id is not null")
    blueprints = blueprints.select(F.col("source_hash").cast("string").alias("source_hash"), "document").where("source_hash is not null")
    tokens = materialise(blueprint_tokens(blueprints, seed).dropDuplicates(["source_hash"]), "blueprint-tokens")
    pattern_seeds = tokens.select("source_hash", F.explode("seeds").alias("seed"))
    distinct = pattern_seeds.select("seed").distinct()
    few = distinct.limit(most_sent + 1).toArrow()["seed"].to_numpy()
    stretches = materialise(matching_stretches(documents, seed, few if len(few) <= most_sent else None), "stretches")
    if len(few) > most_sent:
        # Stretches were whole texts: keep those that hold some seed.
        holders = stretches.select("project_id", F.explode("seeds").alias("seed")).join(distinct, "seed", "left_semi").select("project_id").distinct()
        stretches = stretches.join(holders, "project_id", "left_semi")
    stretches = stretches.dropDuplicates(["project_id", "first"])
    seeds = stretches.select("project_id", F.explode("seeds").alias("seed")).distinct()
    pairs = seeds.join(pattern_seeds, "seed").select("project_id", "source_hash").distinct()
    listed = stretches.groupBy("project_id").agg(F.collect_list(F.struct("first", "words")).alias("stretches"))
    pairs = pairs.join(listed, "project_id").join(tokens.select("source_hash", F.col("words").alias("pattern")), "source_hash")
    out = tiled_pairs(pairs, seed).withColumn("coverage", F.col("n_covered") / F.col("n_words"))
    return out.where(F.col("coverage") >= coverage)
