"""Scored candidate windows per slot without forming every slot and shot pair.

Pools of ordinary size are dealt out whole (`packed.dealt`): a task has all slots and shots of its pools, scores their pairs
block by block in columns and keeps the best, so pairs are neither shuffled nor sorted by rows. The rest of this module is for
pools too large for one task, and for projects that draw on several pools.

A shot can back a slot when it is at least as long. Beyond that its score depends only on its directions and on
whether its character and series suit the slot, and equal scores go by id. So of the shots of one pool and one pair
of directions a slot needs only the first `limit` ids that are long enough, of each way to suit: any, the character, the
series, or both. For each shot the range of slot lengths for which it is among those is found once; slots
then meet exactly the shots whose range holds their length, however many names a pool has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from reelspark.functions import directions, maths
from reelspark.operators import folds, joins, packed
from reelspark.session import materialise

LIMIT = 30
# Most shots and slots of a pool that one task scores directly, pairs that it holds at once, and slots among these.
POOL_SHOTS = 1 << 12
POOLSLOTS = 1 << 16
PAIRS = 1 << 21
BLOCKSLOTS = 1 << 16
INTRINSIC = 0.7
# Weights of intrinsic quality, duration fit, motion, identity and series.
WEIGHTS = (0.35, 0.35, 0.15, 0.075, 0.075)
GROUP = ["pool_id", "entry_dir", "exit_dir"]
# How a listed shot suits a slot: listed whole, or among all shots, those of a character, of a series, or of both.
WHOLE, ANY, CHARACTER, SERIES, BOTH = 0, 1, 2, 3, 4


def available_shots(shots: DataFrame, assets: DataFrame, inventory: DataFrame) -> DataFrame:
    """Shots whose asset has a proxy or master file, with that file as `media`."""
    from reelspark.operators import catalog

    media = catalog.media_path(assets, inventory).where(F.col("media").isNotNull()).select("asset_id", "media")
    return shots.join(media, "asset_id")


def trim_start(start: Column, end: Column, target: Column) -> Column:
    """Start of the centred window of a target length."""
    return F.when(end - start == target, start).otherwise(start + (end - start - target) / 2.0)


def score(slot_entry: Column, slot_exit: Column, identity: Column, series: Column) -> Column:
    """Score components of a candidate row that holds both slot and shot columns."""
    fit = F.lit(1.0) - F.least(F.lit(1.0), F.abs(F.col("window_sec") - F.col("duration_sec")) / F.greatest(F.col("duration_sec"), F.lit(1e-6)))
    motion = directions.similarity(F.col("entry_dir"), slot_entry) * 0.5 + directions.similarity(F.col("exit_dir"), slot_exit) * 0.5

    def same(wanted: Column, have: Column) -> Column:
        return F.when(wanted.isNull() | have.isNull() | (wanted == have), 1.0).otherwise(0.0)

    return F.struct(
        F.lit(INTRINSIC).alias("intrinsic"), fit.alias("duration_fit"), motion.alias("motion_compatibility"),
        same(identity, F.col("character")).alias("identity_fit"), same(series, F.col("series")).alias("series_scope_fit"),
    )


def total(components: Column) -> Column:
    parts = ("intrinsic", "duration_fit", "motion_compatibility", "identity_fit", "series_scope_fit")
    out = F.lit(0.0)
    for weight, part in zip(WEIGHTS, parts):
        out = out + components[part] * weight
    # Twelve places keep every digit the weights can produce and drop double error.
    return F.round(maths.clamp(out), 12)


def _name(value: Column) -> Column:
    """A name as a join key; empty for null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _hashed(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[_name(c) for c in columns]), 256)


def usable_ranges(shots: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Shots with the slot lengths they may serve: `_floor` < length <= `_len`, and how they are listed (`_via`).

    A group (pool and directions) within the limit is listed whole. A shot of a larger one is listed four
    ways, by the names in `_who` and `_work`; in each it needs fewer than `limit` earlier ids at least as long.
    """
    rows = shots.withColumns({"_len": F.col("end_sec") - F.col("start_sec"), "_id": F.concat("shot_id", F.lit(":"))})
    rows = rows.withColumn("_group", _hashed(*[F.col(c) for c in GROUP]))
    large = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > limit).select("_group")
    whole = rows.join(large, "_group", "left_anti").withColumns({"_via": F.lit(WHOLE), "_who": F.lit(""), "_work": F.lit(""), "_floor": F.lit(0.0)})
    who, work, nothing = _name(F.col("character")), _name(F.col("series")), F.lit("")

    def listed(via: int, who: Column, work: Column) -> Column:
        return F.struct(F.lit(via).alias("via"), who.alias("who"), work.alias("work"))

    ways = F.array(listed(ANY, nothing, nothing), listed(CHARACTER, who, nothing), listed(SERIES, nothing, work), listed(BOTH, who, work))
    many = rows.join(large, "_group", "left_semi").withColumn("_w", F.explode(ways))
    many = many.withColumns({"_via": F.col("_w.via"), "_who": F.col("_w.who"), "_work": F.col("_w.work")}).drop("_w")
    many = many.withColumn("_list", _hashed(F.col("_group"), F.col("_via"), F.col("_who"), F.col("_work")))
    first = folds.running_top(many, ["_list"], ["_id"], "_len", limit, "_floor").where(F.col("_len") > F.col("_floor"))
    return whole.unionByName(first.select(*whole.columns)).drop("_group")


def _octave(length: Column) -> Column:
    return F.greatest(F.lit(-10), F.floor(F.log2(F.greatest(length, F.lit(1e-6)))).cast("int"))


def _lookups() -> Column:
    """Lists that a slot reads in large groups, by the names it asks for."""
    who, work = F.col("required_identity"), F.col("required_series")

    def read(via: int, who: Column, work: Column) -> Column:
        return F.struct(F.lit(via).alias("via"), who.alias("who"), work.alias("work"))

    # A shot without a name suits every name.
    names, works, nothing = [_name(who), F.lit("")], [_name(work), F.lit("")], F.lit("")
    out = [read(ANY, nothing, nothing)]
    out += [F.when(who.isNotNull(), read(CHARACTER, n, nothing)) for n in names]
    out += [F.when(work.isNotNull(), read(SERIES, nothing, w)) for w in works]
    out += [F.when(who.isNotNull() & work.isNotNull(), read(BOTH, n, w)) for n in names for w in works]
    return F.array_compact(F.array(*out))


def slot_windows(slots: DataFrame, shots: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Candidate windows of every slot before the final cut to `limit`.

    slots(project_id, slot_index, pool_id, duration_sec, required_identity, required_series, ...), shots(pool_id,
    shot_id, asset_id, start_sec, end_sec, character, series, entry_dir, exit_dir). Both meet on pool, on the octave
    of the slot length and, in large groups, on the list. A shot comes through the one list that states how it suits
    the slot, so it comes once, and a slot meets at most `limit` shots of a list.
    """
    ranges = usable_ranges(shots, limit)
    copies = ranges.withColumn("_octave", F.explode(F.sequence(_octave(F.col("_floor")), _octave(F.col("_len")))))
    names = ["_via", "_who", "_work"]
    copies = copies.select(
        "pool_id", "_octave", *names, "shot_id", "asset_id", F.col("start_sec").alias("_s"), F.col("end_sec").alias("_e"), "character",
        "series", "entry_dir", "exit_dir", "_floor", "_len", "_id",
    )
    asked = slots.withColumn("_octave", _octave(F.col("duration_sec")))
    fits = (F.col("duration_sec") > F.col("_floor")) & (F.col("duration_sec") <= F.col("_len"))
    whole, many = copies.where(F.col("_via") == WHOLE).drop(*names), copies.where(F.col("_via") != WHOLE)
    pairs = asked.join(whole, ["pool_id", "_octave"]).where(fits)
    reads = asked.join(many.select("pool_id").distinct(), "pool_id", "left_semi").withColumn("_read", F.explode(_lookups()))
    reads = reads.withColumns({"_via": F.col("_read.via"), "_who": F.col("_read.who"), "_work": F.col("_read.work")}).drop("_read")

    def unsuited(wanted: str, have: str) -> Column:
        return F.col(wanted).isNull() | F.coalesce(F.col(wanted) != F.col(have), F.lit(False))

    listed = reads.join(many, ["pool_id", "_octave", *names]).where(
        fits
        & (F.col("_via").isin(CHARACTER, BOTH) | unsuited("required_identity", "character"))
        & (F.col("_via").isin(SERIES, BOTH) | unsuited("required_series", "series"))
    )
    pairs = pairs.unionByName(listed.drop(*names))
    start = trim_start(F.col("_s"), F.col("_e"), F.col("duration_sec"))
    # A trimmed window is exactly as long as its slot.
    pairs = pairs.withColumns({"in_sec": start, "window_sec": F.col("duration_sec")})
    return pairs.withColumn("out_sec", F.col("in_sec") + F.col("window_sec")).drop("_octave", "_s", "_e", "_floor", "_len")


def window_id(shot: Column, start: Column, end: Column) -> Column:
    start, end = (x.cast("decimal(18,3)").cast("string") for x in (start, end))
    return F.concat(shot, F.lit(":trim:"), start, F.lit("-"), end)


def _joined(slots: DataFrame, shots: DataFrame, limit: int) -> DataFrame:
    """Ranked windows by joins, for pools of any size."""
    rows = slot_windows(slots, shots, limit)
    rows = rows.withColumn(
        "components", score(F.col("entry_direction"), F.col("exit_direction"), F.col("required_identity"), F.col("required_series"))
    )
    rows = rows.withColumn("score", total(F.col("components")))
    best = joins.top_rows(rows, ["project_id", "slot_index"], limit, F.desc("score"), F.asc("_id"))
    return best.withColumns({f"_{c}": F.col(f"components.{c}") for c in _PARTS})


_PARTS = ("motion_compatibility", "identity_fit", "series_scope_fit")
SLOT = ("project_id", "slot_index", "pool_id", "duration_sec", "entry_direction", "exit_direction", "required_identity", "required_series")
SHOT = ("pool_id", "shot_id", "asset_id", "start_sec", "end_sec", "character", "series", "entry_dir", "exit_dir")


def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers of the distinct values of columns together, from 1; 0 for null."""
    kinds = {c.type for c in columns}
    if len(kinds) > 1:
        columns = [c.cast(pa.string()) for c in columns]
    whole = pa.chunked_array([chunk for c in columns for chunk in c.chunks], columns[0].type).combine_chunks()
    found = whole.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return np.split(found, np.cumsum([len(c) for c in columns])[:-1])


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)


def _direction_codes(column: pa.ChunkedArray) -> np.ndarray:
    """Number of a label; the last one for null and unknown labels."""
    found = pc.index_in(column, pa.array(list(directions.VECTORS))).combine_chunks()
    return found.fill_null(len(directions.VECTORS)).to_numpy(zero_copy_only=False)


def _similarities() -> np.ndarray:
    """`directions.similarity` of any two labels, the last row and column being unknown ones."""
    names = list(directions.VECTORS)
    vectors = np.array([*directions.VECTORS.values(), (np.nan, np.nan)])
    dot = vectors[:, :1] * vectors[:, 0] + vectors[:, 1:] * vectors[:, 1]
    out = np.clip(np.where(np.isnan(dot), 0.0, (dot + 1.0) / 2.0), 0.0, 1.0)
    out[names.index("none"), :] = out[:, names.index("none")] = 0.75
    return out


def _rounded(value: float) -> float:
    return float(Decimal(repr(min(1.0, max(0.0, value)))).quantize(Decimal("1e-12"), ROUND_HALF_UP))


class Scores:
    """Score of every combination of similarities and names, and its place among all scores, best first."""

    def __init__(self) -> None:
        self.values, place = np.unique(_similarities(), return_inverse=True)
        self.similar = place.reshape(_similarities().shape).astype(np.int64)
        n = len(self.values)
        self.motion = self.values[:, None] * 0.5 + self.values[None, :] * 0.5
        parts = [np.float64(INTRINSIC), np.float64(1.0), self.motion[:, :, None, None], np.array([0.0, 1.0])[None, None, :, None], np.array([0.0, 1.0])[None, None, None, :]]
        total = np.zeros((n, n, 2, 2))
        for weight, part in zip(WEIGHTS, parts):
            total = total + part * weight
        self.total = np.array([_rounded(float(x)) for x in total.ravel()])
        self.sorted, place = np.unique(-self.total, return_inverse=True)
        self.place = place.astype(np.int64)

    def at(self, entry: np.ndarray, exit_: np.ndarray, who: np.ndarray, work: np.ndarray) -> np.ndarray:
        return ((entry * len(self.values) + exit_) * 2 + who) * 2 + work


def ranked(slots: pa.Table, shots: pa.Table, limit: int) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Scores]]:
    """Best `limit` windows of every slot of a bucket, some slots at a time.

    Yields the block's slots in order of pool, project and index, the shots, and per window the row of its slot, of its shot, its rank from
    1 and the place of its score in the table of `Scores`. A project's slots may go on in the next block.
    """
    known = Scores()
    pool, their = codes(slots["pool_id"], shots["pool_id"])
    project, index = codes(slots["project_id"])[0], codes(slots["slot_index"])[0]
    at = slots["slot_index"].combine_chunks()
    by_index = np.empty(slots.num_rows, np.int64)
    by_index[pc.sort_indices(at, null_placement="at_start").to_numpy()] = np.arange(slots.num_rows)
    order = np.lexsort((by_index, project, pool))
    slots = slots.take(pa.array(order)).combine_chunks()
    pool, project, index = pool[order], project[order], index[order]
    name = pc.binary_join_element_wise(shots["shot_id"].cast(pa.string()), "", ":").combine_chunks()
    by_name = np.empty(shots.num_rows, np.int64)
    by_name[pc.sort_indices(name, null_placement="at_start").to_numpy()] = np.arange(shots.num_rows)
    order = np.lexsort((by_name, their))
    shots = shots.take(pa.array(order)).combine_chunks()
    their = their[order]

    begin, end = np.searchsorted(their, pool, "left"), np.searchsorted(their, pool, "right")
    count = np.where(pool > 0, end - begin, 0)
    length = _doubles(shots["end_sec"]) - _doubles(shots["start_sec"])
    duration = _doubles(slots["duration_sec"])
    wanted_entry, wanted_exit = _direction_codes(slots["entry_direction"]), _direction_codes(slots["exit_direction"])
    entry, exit_ = _direction_codes(shots["entry_dir"]), _direction_codes(shots["exit_dir"])
    (who, have), (work, of) = codes(slots["required_identity"], shots["character"]), codes(slots["required_series"], shots["series"])

    fresh = np.ones(slots.num_rows, bool)
    fresh[1:] = (pool[1:] != pool[:-1]) | (project[1:] != project[:-1]) | (index[1:] != index[:-1])
    heads = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    behind = np.cumsum(count)
    a = 0
    while a < len(heads):
        first = heads[a]
        done = behind[first] - count[first]
        last = min(np.searchsorted(behind, done + PAIRS, "right"), first + BLOCKSLOTS)
        b = max(a + 1, np.searchsorted(heads, last, "right") - 1) if last < slots.num_rows else len(heads)
        stop = heads[b] if b < len(heads) else slots.num_rows
        n = count[first:stop]
        slot = np.repeat(np.arange(first, stop), n)
        place = np.arange(len(slot)) - np.repeat(np.cumsum(n) - n, n)
        shot = begin[slot] + place
        fits = (duration[slot] > 0) & (duration[slot] <= length[shot])
        slot, shot, place = slot[fits], shot[fits], place[fits]
        same = (who[slot] == 0) | (have[shot] == 0) | (who[slot] == have[shot])
        alike = (work[slot] == 0) | (of[shot] == 0) | (work[slot] == of[shot])
        combo = known.at(known.similar[entry[shot], wanted_entry[slot]], known.similar[exit_[shot], wanted_exit[slot]], same, alike)
        # One number per pair: its slot, the place of its score, its shot by id, and which of equal slots it is of.
        number = ((((group[slot] - a) << 12 | known.place[combo]) << 12 | place) << 16) | (slot - first)
        number.sort()
        key = number >> 40
        mine = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        rank = np.arange(len(key)) - np.repeat(mine, np.diff(np.append(mine, len(key)))) + 1
        kept = rank <= limit
        number, rank = number[kept], rank[kept]
        slot = (number & 0xFFFF) + first
        shot = begin[slot] + (number >> 16 & 0xFFF)
        same = (who[slot] == 0) | (have[shot] == 0) | (who[slot] == have[shot])
        alike = (work[slot] == 0) | (of[shot] == 0) | (work[slot] == of[shot])
        combo = known.at(known.similar[entry[shot], wanted_entry[slot]], known.similar[exit_[shot], wanted_exit[slot]], same, alike)
        yield slots.slice(first, stop - first), shots, slot - first, shot, rank, combo, known
        a = b


def windows(slots: pa.Table, shots: pa.Table, slot: np.ndarray, shot: np.ndarray, rank: np.ndarray, combo: np.ndarray, known: Scores, names: Sequence[str]) -> pa.Table:
    """Columns of ranked windows."""
    start, end = _doubles(shots["start_sec"])[shot], _doubles(shots["end_sec"])[shot]
    duration = _doubles(slots["duration_sec"])[slot]
    begin = np.where(end - start == duration, start, start + (end - start - duration) / 2.0)
    made = {
        "rank": lambda: pa.array(rank.astype(np.int32)), "in_sec": lambda: pa.array(begin), "out_sec": lambda: pa.array(begin + duration), "score": lambda: pa.array(known.total[combo]),
        "_motion_compatibility": lambda: pa.array(known.motion.ravel()[combo >> 2]), "_identity_fit": lambda: pa.array((combo >> 1 & 1).astype(float)), "_series_scope_fit": lambda: pa.array((combo & 1).astype(float)),
    }
    slot_at, shot_at = pa.array(slot), pa.array(shot)
    return pa.table({c: made[c]() if c in made else (slots if c in ("project_id", "slot_index") else shots)[c].take(slot_at if c in ("project_id", "slot_index") else shot_at) for c in names})


def _by_pools(slots: DataFrame, shots: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Slots whose pool one task can take, and the others, if any: those of large pools, and of projects with several."""
    one = F.lit(1)
    counts = slots.select("pool_id", one.alias("_s"), F.lit(0).alias("_h")).unionByName(shots.select("pool_id", F.lit(0).alias("_s"), one.alias("_h")))
    counts = counts.groupBy(F.col("pool_id").alias("_large")).agg(F.sum("_s").alias("_s"), F.sum("_h").alias("_h"))
    large = materialise(counts.where((F.col("_s") > POOLSLOTS) | (F.col("_h") > POOL_SHOTS)).select("_large").where("_large is not null"), "large-pools")
    told = slots.groupBy(F.col("project_id").alias("_project")).agg(F.min("pool_id").alias("_lo"), F.max("pool_id").alias("_hi"), F.count("pool_id").alias("_n"), F.count(one).alias("_all"))
    several = materialise(told.where((F.col("_lo") != F.col("_hi")) | ((F.col("_n") > 0) & (F.col("_n") < F.col("_all")))).select("_project"), "pools-of-projects")
    rest, apart = slots, []
    for side, key, name in ((several, "project_id", "_project"), (large, "pool_id", "_large")):
        if not side.isEmpty():
            match = F.col(key).eqNullSafe(F.col(name))
            apart.append(rest.join(side, match, "left_semi"))
            rest = rest.join(side, match, "left_anti")
    if not apart:
        return slots, None
    return rest, apart[0] if len(apart) == 1 else apart[0].unionByName(apart[1])


COLUMNS = (
    "project_id", "slot_index", "rank", "window_id", "shot_id", "asset_id", "in_sec", "out_sec", "anchor_sec", "score", "components", "character", "series", "entry_motion", "exit_motion",
)
_SOURCES = {
    "window_id": ("shot_id", "in_sec", "out_sec"), "anchor_sec": ("in_sec", "out_sec"), "components": tuple(f"_{c}" for c in _PARTS), "entry_motion": ("entry_dir",), "exit_motion": ("exit_dir",),
}


def top_candidates(slots: DataFrame, shots: DataFrame, limit: int = LIMIT, columns: Sequence[str] = COLUMNS, first: int | None = None) -> DataFrame:
    """Best `limit` candidates of every slot by (score descending, window id), with 1-based rank.

    columns: those wanted; the others are not formed. first: of the ranked candidates, only so many of the first are given out.
    """
    kinds = {**dict(shots.dtypes), **dict(slots.select("project_id", "slot_index").dtypes), "rank": "int", **dict.fromkeys(("in_sec", "out_sec", "score", *(f"_{c}" for c in _PARTS)), "double")}
    names = list(dict.fromkeys(n for c in columns for n in _SOURCES.get(c, (c,))))
    given = limit if first is None else first

    def work(sides: list[pa.Table | None]) -> Iterator[pa.Table]:
        mine, theirs = sides
        if mine is not None and theirs is not None:
            for block, rows, slot, shot, rank, combo, known in ranked(mine, theirs, limit):
                told = rank <= given
                yield windows(block, rows, slot[told], shot[told], rank[told], combo[told], known, names)

    ordinary, apart = _by_pools(slots, shots)
    here, there = ordinary.select(*SLOT).where("pool_id is not null"), shots.select(*SHOT).where("pool_id is not null")
    out = packed.dealt([(here, F.col("pool_id").cast("string")), (there, F.col("pool_id").cast("string"))], work, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    if apart is not None:
        out = out.unionByName(_joined(apart.select(*SLOT), shots.select(*SHOT), limit).where(F.col("rank") <= given).select(*names))
    made = {
        "window_id": lambda: window_id(F.col("shot_id"), F.col("in_sec"), F.col("out_sec")), "anchor_sec": lambda: (F.col("in_sec") + F.col("out_sec")) / 2.0,
        "components": lambda: F.struct(F.lit(INTRINSIC).alias("intrinsic"), F.lit(1.0).alias("duration_fit"), *[F.col(f"_{c}").alias(c) for c in _PARTS]),
        "entry_motion": lambda: F.col("entry_dir"), "exit_motion": lambda: F.col("exit_dir"),
    }
    return out.select(*[made[c]().alias(c) if c in made else F.col(c) for c in columns])


@dataclass(frozen=True)
class Pools:
    """Candidates that are ranked where they are read: those `top_candidates` gives of these slots and shots."""

    slots: DataFrame
    shots: DataFrame
    limit: int = LIMIT

    def apart(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Slots of pools that one task can take, the other slots, and the candidates of these."""
        ordinary, rest = _by_pools(self.slots, self.shots)
        return ordinary, rest, None if rest is None else top_candidates(rest, self.shots, self.limit)


def _milli(values: np.ndarray) -> pa.Array:
    """Text of numbers rounded half up to three places, as a cast to decimal(18, 3) gives it."""
    scaled = values * 1000.0
    whole = np.floor(scaled + 0.5)
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)  # the text of the double decides
    if len(near):
        found, at = np.unique(values[near], return_inverse=True)
        whole[near] = np.array([float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP).scaleb(3)) for x in found.tolist()])[at]
    whole = whole.astype(np.int64)
    sign = pc.if_else(pa.array(whole < 0), "-", "")
    digits = pc.utf8_lpad(pa.array(np.abs(whole) % 1000).cast(pa.string()), 3, "0")
    return pc.binary_join_element_wise(sign, pa.array(np.abs(whole) // 1000).cast(pa.string()), pa.scalar("."), digits, "")


def window_names(shot: pa.ChunkedArray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """`window_id` of columns."""
    span = pc.binary_join_element_wise(_milli(start), _milli(end), "-")
    return pc.binary_join_element_wise(shot.cast(pa.string()), span, ":trim:")


def offered(slots: pa.Table, shots: pa.Table | None, limit: int, like: pa.Schema) -> Iterator[pa.Table]:
    """Every slot of a bucket (rank 0) before its candidates, project by project in order of index, with the columns of `like`."""
    if shots is None:
        shots = pa.table({c: pa.array([], pa.float64() if c.endswith("_sec") else pa.string()) for c in SHOT})
    for block, theirs, slot, shot, rank, combo, known in ranked(slots, shots, limit):
        project, index = codes(block["project_id"])[0], codes(block["slot_index"])[0]
        group = np.cumsum(np.append(True, (project[1:] != project[:-1]) | (index[1:] != index[:-1])))
        offers = windows(block, theirs, slot, shot, rank, combo, known, ("project_id", "slot_index", "rank", "shot_id", "asset_id", "in_sec", "out_sec", "score", "character", "series", "entry_dir", "exit_dir"))
        start, end = offers["in_sec"].to_numpy(), offers["out_sec"].to_numpy()
        made = {
            "window_id": window_names(offers["shot_id"], start, end), "anchor_sec": pa.array((start + end) / 2.0), "entry_motion": offers["entry_dir"], "exit_motion": offers["exit_dir"],
        }
        held = pa.table({f.name: (made[f.name] if f.name in made else offers[f.name] if f.name in offers.column_names else pa.nulls(offers.num_rows)).cast(f.type) for f in like})
        own = {"project_id": block["project_id"], "slot_index": block["slot_index"], "rank": pa.array(np.zeros(block.num_rows, np.int32)), "relation": block["entry_motion"]}
        asked = pa.table({f.name: own[f.name].cast(f.type) if f.name in own else pa.nulls(block.num_rows, f.type) for f in like})
        order = np.lexsort((np.append(np.zeros(block.num_rows, np.int64), rank), np.append(group, group[slot])))
        yield pa.concat_tables([asked, held]).take(pa.array(order))
