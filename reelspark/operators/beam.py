"""Beam search over the slots of many projects at once, in whole columns.

All projects of a chunk advance one slot at a time together. What a partial sequence chose lately is a
window of row numbers (one column per slot); choices that all partial sequences of a project share leave the window
for an index of intervals per asset, so a slot costs the same however many slots came before.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reelspark.functions import directions

MAX_SOURCE_OVERLAP = 0.5
MOTION_WEIGHT = 0.25
# Reward for the same character, and what another one, another series, a step in scale and a recent asset cost.
SAME, OTHER, SERIES, SCALE, RECENT = 0.05, -0.10, -0.20, -0.05, -0.15
# Slots after which shared choices leave the window, and offers that are searched together.
WINDOW = 16
CHUNK_ROWS = 100_000
# Most comparisons held at once.
BLOCK = 1 << 21

NONE = -1


def _motion_table() -> np.ndarray:
    """Reward by relation (reset, none, carry, any other), exit of the last choice and entry of the next."""
    names = list(directions.VECTORS)
    vectors = np.array([directions.VECTORS[n] for n in names])
    cosine = vectors[:, :1] * vectors[:, 0] + vectors[:, 1:] * vectors[:, 1]
    still = np.array([n == "none" for n in names])
    cosine[still, :] = cosine[:, still] = 0.0
    reset = np.broadcast_to(np.where(still, 0.0, -MOTION_WEIGHT * 0.4), cosine.shape)
    return np.stack([reset, np.zeros_like(cosine), cosine * MOTION_WEIGHT, -cosine * MOTION_WEIGHT])


RELATIONS = ("reset", "none", "carry")


def _overlapping(s1, e1, s2, e2) -> np.ndarray:
    """Whether two spans share more than the allowed part of the shorter one."""
    shared = np.maximum(0.0, np.minimum(e1, e2) - np.maximum(s1, s2))
    shortest = np.minimum(e1 - s1, e2 - s2)
    return (shortest > 0) & (shared > 0) & (shared / np.where(shortest > 0, shortest, 1.0) > MAX_SOURCE_OVERLAP)


class Taken:
    """Windows that are chosen for good: their names, and their spans by asset.

    Two spans share more than half of the shorter one only if the middle of the shorter lies inside the longer. So
    spans are kept by their middle, one sorted list per power of two of their length, and a lookup reads those whose
    middles are near enough.
    """

    def __init__(self):
        self.names: set[str] = set()
        self.spans: dict[str, dict[int, list[tuple[float, float, float]]]] = {}

    def add(self, asset: str, name: str, start: float, stop: float) -> None:
        self.names.add(name)
        if stop > start:
            lists = self.spans.setdefault(asset, {})
            bisect.insort(lists.setdefault(math.frexp(stop - start)[1], []), ((start + stop) / 2, start, stop))

    def repeats(self, asset: str, name: str, start: float, stop: float) -> bool:
        if name in self.names:
            return True
        length, middle = stop - start, (start + stop) / 2
        if length <= 0:
            return False
        for power, spans in self.spans.get(asset, {}).items():
            reach = max(length, 2.0**power) / 2 * (1 + 1e-9)
            for _, s, e in spans[bisect.bisect_left(spans, (middle - reach,)) : bisect.bisect_right(spans, (middle + reach, math.inf, math.inf))]:
                if max(0.0, min(stop, e) - max(start, s)) / min(length, e - s) > MAX_SOURCE_OVERLAP:
                    return True
        return False


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Numbers of a column's distinct values (NONE for null), and the values."""
    encoded = column.combine_chunks().dictionary_encode()
    return encoded.indices.fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int32), encoded.dictionary.to_pylist()


def _choices(table: pa.Table, slot: np.ndarray, row: np.ndarray, gain: np.ndarray) -> pa.Table:
    """What was chosen for the slots in rows `slot`: the offers in rows `row`, if any."""
    picked = pa.array(row, mask=row == NONE)
    out = {c: table[c].take(pa.array(slot)) for c in ("project_id", "slot_index")}
    for c in ("window_id", "shot_id", "asset_id", "entry_motion", "exit_motion", "in_sec", "out_sec", "anchor_sec"):
        out[c] = pc.fill_null(table[c].take(picked), 0.0 if c.endswith("_sec") else "none" if c.endswith("motion") else "")
    return pa.table(out | {"score": pa.array(gain)})


@dataclass
class Walk:
    """A project whose slots go on in the next chunk: the state of its partial sequences as rows of `held`."""

    held: pa.Table
    state: dict[str, np.ndarray]
    slots: np.ndarray
    taken: Taken | None
    walked: int
    decided: list[pa.Table] = field(default_factory=list)

    def told(self) -> pa.Table:
        """Choices, if no slot follows."""
        at = np.flatnonzero(self.slots != NONE)
        out = pa.concat_tables([*self.decided, _choices(self.held, self.slots[at], self.state["rows"][0, at], self.state["gains"][0, at])])
        return out.append_column("total", pa.array(np.full(out.num_rows, self.state["total"][0])))


class Chunk:
    """Rows in order of project, slot and rank; a slot's own row (rank 0) stands before its offers."""

    def __init__(self, table: pa.Table, width: int, walk: Walk | None = None):
        self.width, self.walk = width, walk
        held = walk.held.num_rows if walk else 0
        self.table = table = (pa.concat_tables([walk.held, table]) if walk else table).combine_chunks()
        self.asset, self.assets = _codes(table["asset_id"])
        self.character, self.series = _codes(table["character"])[0], _codes(table["series"])[0]
        self.name = pc.rank(table["window_id"].combine_chunks(), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        names = {n: i for i, n in enumerate(directions.VECTORS)}

        def directions_of(column: str) -> np.ndarray:
            codes, values = _codes(table[column])
            return np.array([names.get(v, names["none"]) for v in values] + [names["none"]], np.int64)[codes]

        self.entry, self.exit = directions_of("entry_motion"), directions_of("exit_motion")
        codes, values = _codes(table["relation"])
        self.relation = np.array([RELATIONS.index(v) if v in RELATIONS else len(RELATIONS) for v in values] + [len(RELATIONS)], np.int64)[codes]
        self.start, self.stop, self.score, self.scale = (
            table[c].combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("in_sec", "out_sec", "score", "scale")
        )
        self.motion = _motion_table()

        rank = table["rank"].to_numpy()[held:]
        slots = np.flatnonzero(rank == 0)
        ends = np.append(slots[1:], len(rank))
        project, slot = _codes(table["project_id"])[0][held:], _codes(table["slot_index"])[0][held:]
        # Offers after another slot's row have no slot of their own.
        own = np.repeat(slots, ends - slots) if len(slots) else slots
        first = slots[0] if len(slots) else len(rank)
        mine = (project[first:] == project[own]) & (slot[first:] == slot[own]) & (rank[first:] > 0)
        self.offers = first + held + np.flatnonzero(mine)
        self.counts = np.bincount(np.searchsorted(slots, own[mine]), minlength=len(slots)).astype(np.int64)
        self.offsets = np.cumsum(self.counts) - self.counts
        self.slots = slots + held
        heads = np.flatnonzero(np.append(True, project[slots][1:] != project[slots][:-1])) if len(slots) else slots
        self.first = heads
        self.lengths = np.diff(np.append(heads, len(slots)))
        goes_on = walk is not None
        if goes_on and (not len(slots) or table["project_id"][int(self.slots[0])] != walk.held["project_id"][0]):
            raise ValueError("a project that goes on must come first")
        n = len(heads)
        shape = (n, width)
        self.state = {
            "total": np.zeros(shape), "alive": np.zeros(shape, bool), "order": np.zeros(shape, np.int64), "recent": np.full((*shape, 3), NONE, np.int64),
            **{c: np.full(shape, NONE, np.int64) for c in ("who", "work", "last")},
            "rows": np.full((*shape, 0), NONE, np.int64), "gains": np.zeros((*shape, 0)),
        }
        self.state["alive"][:, 0] = True
        self.window_slots = np.full((n, 0), NONE, np.int64)
        self.walked = np.zeros(n, np.int64)
        self.taken: list[Taken | None] = [None] * n
        self.open = np.ones(n, bool)
        if goes_on:
            columns = walk.state["rows"].shape[-1]
            self._widen(columns)
            for c, v in walk.state.items():
                self.state[c][0] = v
            self.window_slots[0] = walk.slots
            self.walked[0], self.taken[0] = walk.walked, walk.taken
        self.decided: list[tuple[np.ndarray, ...]] = []  # project, row of the slot, row of the choice, gain

    def _widen(self, columns: int) -> None:
        s, n = self.state, len(self.first)
        s["rows"] = np.concatenate([s["rows"], np.full((n, self.width, columns), NONE, np.int64)], axis=2)
        s["gains"] = np.concatenate([s["gains"], np.zeros((n, self.width, columns))], axis=2)
        self.window_slots = np.concatenate([self.window_slots, np.full((n, columns), NONE, np.int64)], axis=1)

    def _repeats(self, at: np.ndarray, offers: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Whether an offer repeats or mostly overlaps a choice: projects x partial sequences x offers."""
        out = np.zeros((len(at), self.width, offers.shape[1]), bool)
        rows = self.state["rows"][at]
        used = np.flatnonzero((rows != NONE).any(axis=(0, 1)))
        step = max(1, BLOCK // max(1, out.size))
        for i in range(0, len(used), step):
            chosen = rows[:, :, used[i : i + step]]
            named = self.name[chosen][:, :, None, :] == self.name[offers][:, None, :, None]
            same = named | (self.asset[chosen][:, :, None, :] == self.asset[offers][:, None, :, None])
            p, w, k, t = np.nonzero(same & (chosen != NONE)[:, :, None, :] & valid[:, None, :, None])
            mine, theirs = offers[p, k], chosen[p, w, t]
            clash = named[p, w, k, t] | _overlapping(self.start[mine], self.stop[mine], self.start[theirs], self.stop[theirs])
            out[p[clash], w[clash], k[clash]] = True
        for i, p in enumerate(at):
            if self.taken[p] is not None:
                for k in np.flatnonzero(valid[i]):
                    row = offers[i, k]
                    if self.taken[p].repeats(self.assets[self.asset[row]], self.table["window_id"][int(row)].as_py(), float(self.start[row]), float(self.stop[row])):
                        out[i, :, k] = True
        return out

    def _gain(self, p: np.ndarray, w: np.ndarray, row: np.ndarray, relation: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of an offer plus its bonus against the choices before it."""
        s = self.state
        who, work, last = s["who"][p, w], s["work"][p, w], s["last"][p, w]
        told = (who != NONE) & (self.character[row] != NONE)
        same = np.where(told, np.where(self.character[row] == self.character[who], SAME, OTHER), 0.0)
        told = (work != NONE) & (self.series[row] != NONE)
        other = np.where(told & (self.series[row] != self.series[work]), SERIES, 0.0)
        size = np.abs(self.scale[row] - np.where(last != NONE, self.scale[last], np.nan)) * SCALE
        motion = self.motion[relation, np.where(last != NONE, self.exit[last], 0), self.entry[row]]
        recent = s["recent"][p, w]
        repeat = np.where(((self.asset[recent] == self.asset[row][:, None]) & (recent != NONE)).any(axis=1), RECENT, 0.0)
        bonus = same + other + np.where(np.isnan(size), 0.0, size) + motion + repeat
        return self.score[row] + np.where(first, 0.0, bonus)

    def _advance(self, at: np.ndarray, slot: np.ndarray) -> None:
        """One slot with offers of each project `at`: the best `width` continuations stay."""
        s, width = self.state, self.width
        counts = self.counts[slot]
        column = np.arange(counts.max())
        valid = column < counts[:, None]
        offers = self.offers[np.where(valid, self.offsets[slot][:, None] + column, 0)]
        usable = valid[:, None, :] & ~self._repeats(at, offers, valid)
        usable |= valid[:, None, :] & ~usable.any(axis=2, keepdims=True)  # all repeat: any may be taken
        usable &= s["alive"][at][:, :, None]
        i, w, k = np.nonzero(usable & (np.cumsum(usable, axis=2) <= width))
        row, p = offers[i, k], at[i]
        gain = self._gain(p, w, row, self.relation[self.slots[slot]][i], self.walked[p] == 0)
        total = s["total"][p, w] + gain
        # Equal totals go by the sequence of window names; those before are ranked already.
        best = np.lexsort((self.name[row], s["order"][p, w], -total, i))
        place = np.arange(len(best)) - np.searchsorted(i[best], i[best], "left")
        best, place = best[place < width], place[place < width]
        i, w, row, gain, total, p = i[best], w[best], row[best], gain[best], total[best], p[best]
        before, name = s["order"][p, w], self.name[row]
        by = np.lexsort((name, before, i))
        new = np.ones(len(by), bool)
        new[1:] = (i[by][1:] != i[by][:-1]) | (before[by][1:] != before[by][:-1]) | (name[by][1:] != name[by][:-1])
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(new)
        parent = {c: s[c][p, w] for c in ("who", "work", "recent", "rows", "gains")}
        s["alive"][at] = False
        s["alive"][p, place] = True
        s["total"][p, place], s["order"][p, place], s["last"][p, place] = total, order, row
        s["who"][p, place] = np.where(self.character[row] != NONE, row, parent["who"])
        s["work"][p, place] = np.where(self.series[row] != NONE, row, parent["work"])
        s["recent"][p, place] = np.concatenate([parent["recent"][:, 1:], row[:, None]], axis=1)
        # The last column belongs to this slot.
        s["rows"][p, place], s["gains"][p, place] = parent["rows"], parent["gains"]
        s["rows"][p, place, -1], s["gains"][p, place, -1] = row, gain

    def _settle(self, at: np.ndarray) -> None:
        """Move choices that all partial sequences share out of the window, and drop columns nobody needs."""
        rows, alive = self.state["rows"][at], self.state["alive"][at]
        shared = np.logical_and.accumulate(((rows == rows[:, :1]) | ~alive[:, :, None]).all(axis=1), axis=1)
        for i, p in enumerate(at):
            done = np.flatnonzero(shared[i] & (self.window_slots[p] != NONE))
            if not len(done):
                continue
            self.taken[p] = self.taken[p] or Taken()
            chosen = rows[i, 0, done]
            for row in chosen[chosen != NONE].tolist():
                self.taken[p].add(self.assets[self.asset[row]], self.table["window_id"][row].as_py(), float(self.start[row]), float(self.stop[row]))
            self.decided.append((np.full(len(done), p), self.window_slots[p, done], chosen, self.state["gains"][p, 0, done]))
            self.window_slots[p, done] = NONE
            self.state["rows"][p, :, done] = NONE
        kept = np.flatnonzero((self.window_slots[self.open] != NONE).any(axis=0))
        first = kept[0] if len(kept) else self.window_slots.shape[1]
        self.window_slots = self.window_slots[:, first:]
        self.state["rows"], self.state["gains"] = self.state["rows"][:, :, first:], self.state["gains"][:, :, first:]

    def _finish(self, at: np.ndarray) -> None:
        i, t = np.nonzero(self.window_slots[at] != NONE)
        self.decided.append((at[i], self.window_slots[at[i], t], self.state["rows"][at[i], 0, t], self.state["gains"][at[i], 0, t]))

    def run(self, ended: bool) -> tuple[pa.Table, Walk | None]:
        """Choices of every project that ends here, and the last project's state if it may go on."""
        n = len(self.first)
        stays = n - 1 if n and not ended else None
        for k in range(int(self.lengths.max(initial=0))):
            at = np.flatnonzero(self.lengths > k)
            slot = self.first[at] + k
            self._widen(1)
            self.window_slots[at, -1] = self.slots[slot]
            offered = self.counts[slot] > 0
            if offered.any():
                self._advance(at[offered], slot[offered])
            self.walked[at] += 1
            over = at[(self.lengths[at] == k + 1) & (at != (NONE if stays is None else stays))]
            if len(over):
                self._finish(over)
                self.open[over] = False
            at = at[self.open[at]]
            if not len(at):
                break
            if self.window_slots.shape[1] >= 2 * WINDOW:
                self._settle(at)
        if stays is not None:
            self._settle(np.array([stays]))
        return self._told(stays), None if stays is None else self._leave(stays)

    def _told(self, stays: int | None) -> pa.Table:
        p, slot, row, gain = (np.concatenate(v) for v in zip(*self.decided)) if self.decided else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        if stays is not None:
            mine = p == stays
            self.left = _choices(self.table, slot[mine], row[mine], gain[mine])
            p, slot, row, gain = p[~mine], slot[~mine], row[~mine], gain[~mine]
        out = _choices(self.table, slot, row, gain)
        total = self.state["total"][p, 0]
        if self.walk and stays != 0:
            earlier = pa.concat_tables(self.walk.decided) if self.walk.decided else out.slice(0, 0)
            out = pa.concat_tables([out, earlier])
            total = np.append(total, np.full(earlier.num_rows, self.state["total"][0, 0]))
        return out.append_column("total", pa.array(total))

    def _leave(self, p: int) -> Walk:
        state = {c: v[p] for c, v in self.state.items()}
        keys = ("who", "work", "last", "recent", "rows")
        slots = self.window_slots[p]
        # The first held row names the project.
        used = np.unique(np.concatenate([[self.slots[self.first[p]]], slots[slots != NONE], *(state[c][state[c] != NONE].ravel() for c in keys)]))
        for c in keys:
            state[c] = np.where(state[c] == NONE, NONE, np.searchsorted(used, state[c]))
        slots = np.where(slots == NONE, NONE, np.searchsorted(used, slots))
        decided = [*(self.walk.decided if self.walk and p == 0 else []), self.left]
        return Walk(self.table.take(pa.array(used)), state, slots, self.taken[p], int(self.walked[p]), decided)


def search(batches: Iterator[pa.RecordBatch], width: int, chunk_rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Choices of all projects of a task, read in chunks of whole slots; a long project goes on from chunk to chunk."""
    held: list[pa.Table] = []
    walk, rows = None, 0

    def ended(first) -> Iterator[pa.Table]:
        nonlocal walk
        if walk is not None and first != walk.held["project_id"][0]:
            yield walk.told()
            walk = None

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < chunk_rows:
            continue
        table = pa.concat_tables(held)
        slots = np.flatnonzero(table["rank"].to_numpy() == 0)
        if len(slots) > 1:  # the last slot's offers may go on
            yield from ended(table["project_id"][int(slots[0])])
            out, walk = Chunk(table.slice(0, int(slots[-1])), width, walk).run(False)
            yield out
            table = table.slice(int(slots[-1]))
        held, rows = [table], table.num_rows
    if rows:
        table = pa.concat_tables(held)
        slots = np.flatnonzero(table["rank"].to_numpy() == 0)
        if len(slots):
            yield from ended(table["project_id"][int(slots[0])])
            yield Chunk(table, width, walk).run(True)[0]
            walk = None
    yield from ended(None)
