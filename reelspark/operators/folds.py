"""Order-dependent folds over a key's rows that stay parallel when one key holds most of them.

Rows are range-sorted and cut into pieces of consecutive rows. Each piece is first reduced to what it does to whatever
comes before it; a key's few reductions are walked in order, which tells every piece where it starts; the pieces
are then folded side by side.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from reelspark.session import materialise

PIECE_ROWS = 1 << 16

# What a row does to the kept row before it.
DROPPED, REPLACES, FOLLOWS = 0, 1, 2
Rule = Callable[[tuple, tuple], int]


def pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows sorted by keys and order, written with the number of their piece in `_piece`.

    Pieces hold up to `piece_rows` consecutive rows, of many keys or a part of one, and are numbered in order.
    """
    by = [*keys, *order]
    names = df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            piece = first + (seen + np.arange(batch.num_rows)) // piece_rows
            seen += batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(piece)], [*names, "_piece"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return materialise(rows.mapInArrow(number, T.StructType([*df.schema.fields, T.StructField("_piece", T.LongType())])), "pieces")


def _by_key(table: pa.Table, keys: Sequence[str]) -> list[tuple[int, int]]:
    """Row ranges of the keys of a sorted table."""
    n = table.num_rows
    cut = np.zeros(max(0, n - 1), bool)
    for c in keys:
        codes = table[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        cut |= codes[1:] != codes[:-1]
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    return list(zip(edges[:-1], edges[1:])) if n else []


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys of a task's sorted rows."""
    held: list[pa.Table] = []
    now = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for a, b in _by_key(table, keys):
            key = tuple(table[c][a].as_py() for c in keys)
            if held and key != now:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            now = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _sorted(table: pa.Table, keys: Sequence[str], order: Sequence[str]) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in (*keys, *order)]).combine_chunks()


def _edges(table: pa.Table, keys: Sequence[str]) -> list[tuple[int, int]]:
    """Ranges of the first and the last key, which may go on in other pieces."""
    ranges = _by_key(table, keys)
    return ranges[:1] + (ranges[-1:] if len(ranges) > 1 else [])


def _walk(rows: list[tuple], rule: Rule) -> Iterator[tuple[int, int]]:
    """Kept rows in order, each with what the next one does to it (FOLLOWS for the last)."""
    kept = 0
    for j in range(1, len(rows)):
        does = rule(rows[kept], rows[j])
        if does != DROPPED:
            yield kept, does
            kept = j
    if rows:
        yield kept, FOLLOWS


def _heads(table: pa.Table, keys: Sequence[str], order: str, values: Sequence[str], rule: Rule) -> Iterator[dict]:
    """What a piece does to a kept row before it: the rows that can be the next kept one, and where each leads.

    A row that follows the piece's first row also follows any row before the piece, so candidates end there. Of rows at
    one instant only those that none before them drops can be next.
    """
    for a, b in _edges(table, keys):
        rows = list(zip(*(table[c].slice(a, b - a).to_pylist() for c in values)))
        at = table[order].slice(a, b - a).to_pylist()
        heads, same = [], []
        for j, row in enumerate(rows):
            same = [i for i in same if at[i] == at[j]]
            if any(rule(rows[i], row) == DROPPED for i in same):
                continue
            heads.append(j)
            same.append(j)
            if rule(rows[0], row) == FOLLOWS:
                break
        # Paths from all heads side by side; two that reach one row go on as one.
        start, leads = set(heads), {}
        active: dict[int, list[int]] = {}
        for j, row in enumerate(rows):
            moved = [i for i in active if rule(rows[i], row) != DROPPED]
            joined = [h for i in moved for h in active.pop(i)]
            if j in start:
                joined.append(j)
            if joined:
                active[j] = joined
        for end, some in active.items():
            leads.update(dict.fromkeys(some, end))
        key = {c: table[c][a].as_py() for c in keys}
        for h in heads:
            yield key | {"_piece": table["_piece"][a].as_py(), "_head": h, **{f"_h_{c}": v for c, v in zip(values, rows[h])}, **{f"_x_{c}": v for c, v in zip(values, rows[leads[h]])}}


def _seeds(records: Iterator[dict], keys: Sequence[str], values: Sequence[str], rule: Rule) -> Iterator[dict]:
    """Where each piece's kept rows begin (-1: nowhere), and whether its last kept row stays, from the heads in order."""
    now, piece, kept, holder, found = None, None, None, None, False

    def seed(of, entry, stays):
        return dict(zip(keys, of[0])) | {"_piece": of[1], "_entry": entry, "_stays": stays}

    for r in records:
        key = tuple(r[c] for c in keys)
        if key != now:
            if piece is not None and not found:
                yield seed((now, piece), -1, True)
            if holder:
                yield seed(holder[0], holder[1], True)
            now, piece, kept, holder, found = key, None, None, None, False
        if r["_piece"] != piece:
            if piece is not None and not found:
                yield seed((now, piece), -1, True)
            piece, found = r["_piece"], False
        if found:
            continue
        does = FOLLOWS if kept is None else rule(kept, tuple(r[f"_h_{c}"] for c in values))
        if does != DROPPED:
            if holder:
                yield seed(holder[0], holder[1], does == FOLLOWS)
            holder, kept, found = ((now, piece), r["_head"]), tuple(r[f"_x_{c}"] for c in values), True
    if piece is not None and not found:
        yield seed((now, piece), -1, True)
    if holder:
        yield seed(holder[0], holder[1], True)


def _kept(table: pa.Table, seeds: dict[tuple, tuple[int, bool]], keys: Sequence[str], values: Sequence[str], rule: Rule) -> np.ndarray:
    out: list[int] = []
    columns = [table[c].to_pylist() for c in values]
    named = [table[c].to_pylist() for c in keys]
    for a, b in _by_key(table, keys):
        entry, stays = seeds.get(tuple(c[a] for c in named), (0, True))
        if entry < 0:
            continue
        rows = list(zip(*(c[a + entry : b] for c in columns)))
        path = list(_walk(rows, rule))
        final = [a + entry + i for i, does in path[:-1] if does == FOLLOWS]
        out += final + ([a + entry + path[-1][0]] if stays else [])
    return np.array(out, np.int64)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def keep_by_rule(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], rule: Rule, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows that stay when a key's rows are read in order against the row kept last.

    `rule(kept, row)` sees the `values` of both and says whether the row is DROPPED, REPLACES the kept one (which then
    goes), or FOLLOWS it. It must let a row that follows some row also follow every row before that one. `order` is
    one column without nulls. A key of any size is spread over its pieces: between two tasks pass only the rows that can come
    next, a few unless very many lie close together, and the rows they lead to.
    """
    keys, values = list(keys), list(values)
    rows = pieces(df, keys, [order, *[c for c in values if c != order]], piece_rows)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key_types = ", ".join(f"{c} {fields[c]}" for c in keys)
    head_types = ", ".join([key_types, "_piece long", "_head int", *(f"_{s}_{c} {fields[c]}" for s in "hx" for c in values)])
    seed_types = f"{key_types}, _piece long, _entry int, _stays boolean"
    by = [order, *[c for c in values if c != order]]

    def told(records: Iterator[dict], like: pa.Schema) -> pa.Table:
        return pa.Table.from_pylist(list(records), schema=like)

    def heads(table: pa.Table) -> pa.Table:
        table = _sorted(table, keys, by)
        kinds = {c: table.schema.field(c).type for c in {*keys, *values}}
        like = [(c, kinds[c]) for c in keys] + [("_piece", pa.int64()), ("_head", pa.int32())] + [(f"_{s}_{c}", kinds[c]) for s in "hx" for c in values]
        return told(_heads(table, keys, order, values, rule), pa.schema(like))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        like = pa.schema([(c, first.schema.field(c).type) for c in keys] + [("_piece", pa.int64()), ("_entry", pa.int32()), ("_stays", pa.bool_())])

        def all_batches():
            yield first
            yield from batches

        found: list[dict] = []
        for seed in _seeds(_records(all_batches()), keys, values, rule):
            found.append(seed)
            if len(found) == 4096:
                yield pa.RecordBatch.from_pylist(found, schema=like)
                found = []
        yield pa.RecordBatch.from_pylist(found, schema=like)

    def replay(table: pa.Table, begins: pa.Table) -> pa.Table:
        table = _sorted(table, keys, by)
        told = {tuple(r[c] for c in keys): (r["_entry"], r["_stays"]) for r in begins.to_pylist()}
        return table.take(pa.array(_kept(table, told, keys, values, rule))).drop_columns(["_piece"])

    reduced = rows.select(*keys, "_piece", *[c for c in by if c not in keys]).groupBy("_piece").applyInArrow(heads, head_types)
    begins = reduced.repartition(*keys).sortWithinPartitions(*keys, "_piece", "_head").mapInArrow(seeds, seed_types)
    return rows.groupBy("_piece").cogroup(begins.groupBy("_piece")).applyInArrow(replay, df.schema)


def spaced(wait: int) -> Rule:
    """Keep a row, valued by its index, that lies more than `wait` past the last kept one."""
    return functools.partial(_spaced, wait)


def _spaced(wait: int, kept: tuple, row: tuple) -> int:
    return FOLLOWS if row[0] - kept[0] > wait else DROPPED


def strongest(kept: tuple, row: tuple) -> int:
    """Merge rows (sec, gap, rank, strength) closer than `gap`, one number per key, to the kept one: the higher (rank, strength) stays."""
    if row[0] - kept[0] >= row[1]:
        return FOLLOWS
    return REPLACES if row[2:] > kept[2:] else DROPPED


def running_top(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limit: int, name: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add the `limit`-th largest `value` among a key's earlier rows (zero while there are fewer) as a double column."""
    keys, order = list(keys), list(order)
    rows = pieces(df, keys, order, piece_rows)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key_types = ", ".join(f"{c} {fields[c]}" for c in keys)

    def tops(table: pa.Table) -> pa.Table:
        table = _sorted(table, keys, order)
        out = []
        for a, b in _edges(table, keys):
            best = heapq.nlargest(limit, table[value].slice(a, b - a).to_pylist())
            out.append({c: table[c][a].as_py() for c in keys} | {"_piece": table["_piece"][a].as_py(), "_top": best})
        like = [(c, table.schema.field(c).type) for c in keys] + [("_piece", pa.int64()), ("_top", pa.list_(pa.float64()))]
        return pa.Table.from_pylist(out, schema=pa.schema(like))

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = tuple(r[c] for c in keys)
                if key != now:
                    now, best = key, []
                out.append(r | {"_top": best})
                best = heapq.nlargest(limit, [*best, *r["_top"]])
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    def replay(table: pa.Table, seeds: pa.Table) -> pa.Table:
        table = _sorted(table, keys, order)
        told = {tuple(r[c] for c in keys): r["_top"] for r in seeds.to_pylist()}
        named = [table[c].to_pylist() for c in keys]
        numbers, out = table[value].to_pylist(), []
        for a, b in _by_key(table, keys):
            heap = sorted(told.get(tuple(c[a] for c in named), []))
            for x in numbers[a:b]:
                out.append(heap[0] if len(heap) == limit else 0.0)
                if len(heap) < limit:
                    heapq.heappush(heap, x)
                elif x > heap[0]:
                    heapq.heapreplace(heap, x)
        return table.drop_columns(["_piece"]).append_column(name, pa.array(out, pa.float64()))

    reduced = rows.select(*keys, "_piece", *[c for c in (*order, value) if c not in keys]).groupBy("_piece").applyInArrow(tops, f"{key_types}, _piece long, _top array<double>")
    seeds = reduced.repartition(*keys).sortWithinPartitions(*keys, "_piece").mapInArrow(before, f"{key_types}, _piece long, _top array<double>")
    out = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return rows.groupBy("_piece").cogroup(seeds.groupBy("_piece")).applyInArrow(replay, out)
