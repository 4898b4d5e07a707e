"""Prefix tree of project histories: which projects went through the same first steps, and what that saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from reelspark.operators import ordered
from reelspark.session import materialise

# Steps that one row of a matrix holds, rows of a shard, and project ids in one packed text.
SEGMENT = 32
SHARD_ROWS = 1 << 14
PACKED = 1024
STEP_BYTES = 16

_BEFORE = ["p0", "p1", "p2", "p3"]
_PLACE = ["seg", *_BEFORE]
_ROW = "shard long, project_id long, seg long, p0 long, p1 long, p2 long, p3 long, ids binary, length long"
_EDGE = "shard long, col int, last boolean, seg long, p0 long, p1 long, p2 long, p3 long, path binary, n long, owner long, longest long"
_COUNTED = _ROW + ", owner array<long>, n array<long>, child array<long>, leaves array<long>, saved array<long>"
_NODE = "project_id long, depth long, parent_project_id long, n_projects long, n_children long, n_leaves long, saved_bytes long"


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _placed(log: DataFrame) -> DataFrame:
    """Rows with their zero-based place in the project's history, null texts empty."""
    rows = log.where(F.col("project_id").isNotNull()).select(
        F.col("project_id").cast("long").alias("project_id"), F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("action").cast("string"), F.lit("")).alias("action"), F.coalesce(F.col("target").cast("string"), F.lit("")).alias("target"),
    )
    return ordered.annotate(rows, ["project_id"], ["seq", "action", "target"], {"place": ordered.position()}).drop("seq")


def _forks(forks: DataFrame) -> DataFrame:
    """One row per project: its base and how many of the base's steps it starts with."""
    told = F.struct(F.col("base_id").cast("long").alias("base_id"), F.coalesce(F.col("shared").cast("long"), F.lit(0).cast("long")).alias("shared"))
    rows = forks.where("project_id is not null").groupBy(F.col("project_id").cast("long").alias("project_id")).agg(F.min(told).alias("f"))
    return rows.select("project_id", "f.base_id", F.greatest("f.shared", F.lit(0).cast("long")).alias("shared"))


def _forked(placed: DataFrame, forks: DataFrame) -> DataFrame:
    """Steps of every project after its fork, places dense again."""
    lengths = placed.groupBy(F.col("project_id").alias("base_id")).agg(F.count(F.lit(1)).alias("_length"))
    asked = forks.join(lengths, "base_id", "left").withColumn("had", F.least("shared", F.coalesce("_length", F.lit(0).cast("long"))))
    asked = asked.select("project_id", "base_id", "shared", "had")
    body = [c for c in placed.columns if c not in ("project_id", "place")]
    own = placed.join(asked, "project_id", "left").where("shared is null or place >= shared")
    own = own.select("project_id", F.coalesce(F.col("place") - F.col("shared") + F.col("had"), F.col("place")).alias("place"), *body)
    # A base hands on only its first steps, whatever its length.
    most = asked.where("had > 0").groupBy(F.col("base_id").alias("project_id")).agg(F.max("had").alias("_most"))
    heads = placed.join(most, "project_id").where("place < _most").select(F.col("project_id").alias("base_id"), "place", *body)
    taken = asked.where("had > 0").select("project_id", "base_id", "had").join(heads, "base_id").where("place < had")
    return own.unionByName(taken.select("project_id", "place", *body))


def forked_logs(log: DataFrame, forks: DataFrame) -> DataFrame:
    """Logs as they read after forking: the first steps of the base, then a project's own steps after as many.

    log(project_id, seq, action, target): ordered by seq, nulls first, ties by action and target; null texts read as
    empty, rows without a project are dropped, other columns ignored. forks(project_id, base_id, shared): a project
    takes the first `shared` steps of the base's original log (all if there are fewer, none if there is no such log) in
    place of its own first `shared`. The smallest of several forks of a project counts; a project without one stays.
    Returns project_id, seq (dense, from zero), action, target.
    """
    return _forked(_placed(log), _forks(forks)).select("project_id", F.col("place").alias("seq"), "action", "target")


def _segments(steps: DataFrame, segment: int) -> DataFrame:
    """Rows of at most `segment` steps: their ids in one binary, and sums that identify all steps before the row."""
    seg = F.floor(F.col("place") / segment).cast("long")
    one = F.struct("place", "step", "size")
    rows = steps.groupBy("project_id", seg.alias("seg")).agg(F.array_sort(F.collect_list(one)).alias("s"))
    ids = F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["step"])), ""))
    rows = materialise(rows.select("project_id", "seg", ids.alias("ids"), F.transform("s", lambda x: x["size"]).alias("sizes"), F.size("s").cast("long").alias("steps")), "segments")
    zero = F.lit(0).cast("long")
    ended = (F.col("seg") == 0) & (F.col("steps") < segment)
    alone = rows.where(ended).withColumns({c: zero for c in _BEFORE} | {"length": F.col("steps")})
    # What comes before a segment is told by sums over hashes of (number, content) of the segments before it.
    digest = F.sha2(F.concat(F.encode(F.concat_ws(":", F.col("seg").cast("string"), F.lit("")), "utf-8"), F.col("ids")), 256)
    number = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
    asks = {c: ordered.sum_before(number(i)) for i, c in enumerate(_BEFORE)} | {"length": ordered.key_total(F.col("steps"))}
    longer = ordered.annotate(rows.where(~ended), ["project_id"], ["seg"], asks)
    names = ["project_id", *_PLACE, "ids", "sizes", "length"]
    return alone.select(*names).unionByName(longer.select(*names))


def _sharded(segments: DataFrame, shard_rows: int) -> DataFrame:
    """Rows in order of their path, cut into shards of consecutive rows."""
    keys = [*_PLACE, "ids", "project_id"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            shard = first + (seen + np.arange(batch.num_rows)) // shard_rows
            seen += batch.num_rows
            yield pa.record_batch([pa.array(shard), *batch.columns], ["shard", *batch.schema.names])

    rows = segments.repartitionByRange(_parts(segments), *keys).sortWithinPartitions(*keys)
    return materialise(rows.select("project_id", *_PLACE, "ids", "length", "sizes").mapInArrow(number, _ROW + ", sizes array<long>"), "shards")


class Paths:
    """The rows of one shard as a padded matrix of step numbers, sorted, with the starts of its nodes.

    Column j holds step j of each row, zero where the row is shorter. A node at depth j + 1 is a run of rows that
    agree in everything up to column j; `starts[:, j]` marks where such runs begin.
    """

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        ids = table["ids"].cast(pa.large_binary()).combine_chunks()
        offsets = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1 + ids.offset)[ids.offset :]
        flat = np.frombuffer(ids.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(">u8").reshape(-1, 2)
        lengths = np.diff(offsets) // STEP_BYTES
        # Step ids as small numbers in the order of their bytes.
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        numbers = np.empty(len(flat), np.int32)
        numbers[order] = 1 + np.concatenate([[0], np.cumsum((flat[order][1:] != flat[order][:-1]).any(axis=1))])
        width = int(lengths.max())
        held = np.arange(width) < lengths[:, None]
        matrix = np.zeros(held.shape, np.int32)
        matrix[held] = numbers
        before = np.stack([table[c].to_numpy() for c in _PLACE], axis=1)
        projects = table["project_id"].to_numpy()
        order = np.lexsort([projects, *matrix.T[::-1], *before.T[::-1]])
        matrix, before = matrix[order], before[order]
        self.table, self.held, self.projects = table.take(pa.array(order)), held[order], projects[order]
        changed = np.ones(matrix.shape, bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        changed[1:, 0] |= (before[1:] != before[:-1]).any(axis=1)
        self.starts = np.logical_or.accumulate(changed, axis=1)
        self.width, self.offsets = width, np.concatenate([[0], np.cumsum(lengths[order])])

    def lists(self, column: str) -> np.ndarray:
        """A list column as a padded matrix."""
        out = np.zeros(self.held.shape, np.int64)
        out[self.held] = self.table[column].combine_chunks().flatten().to_numpy()
        return out

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()

    def listed(self, matrix: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), pa.array(matrix[self.held].astype(np.int64)))

    def runs(self, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First row of every run of column j, which of them are nodes (not padding), and which run each row is in."""
        at = np.flatnonzero(self.starts[:, j])
        return at, self.held[at, j], np.cumsum(self.starts[:, j]) - 1


def _edges(table: pa.Table) -> pa.Table:
    """Nodes that may go on in the shard before or after: those of the first and of the last row."""
    paths = Paths(table)
    length, shard, ids = paths.column("length"), paths.table["shard"][0].as_py(), paths.table["ids"]
    where = {c: paths.column(c) for c in _PLACE}
    out = []
    for j in range(paths.width):
        at, node, _ = paths.runs(j)
        n = np.diff([*at, len(length)])
        owner, longest = np.minimum.reduceat(paths.projects, at), np.maximum.reduceat(length, at)
        for last, i in ((False, 0), (True, len(at) - 1)):
            if node[i] and not (last and i == 0):
                place = {c: int(v[at[i]]) for c, v in where.items()}
                path = ids[int(at[i])].as_py()[: STEP_BYTES * (j + 1)]
                out.append({"shard": shard, "col": j, "last": last, **place, "path": path, "n": int(n[i]), "owner": int(owner[i]), "longest": int(longest[i])})
    kinds = {"col": pa.int32(), "last": pa.bool_(), "path": pa.binary()}
    names = [c.strip().split()[0] for c in _EDGE.split(",")]
    return pa.table({c: pa.array([o[c] for o in out], kinds.get(c, pa.int64())) for c in names})


def _counted(segment: int):
    def counted(rows: pa.Table, patches: pa.Table) -> pa.Table:
        """Members and owner of every node on a row's path, and what the row adds to them as an owner.

        A node's owner is its smallest project. Adding each node's own numbers to its owner's row alone lets sums over
        a node's members, from its column on, be sums over its subtree.
        """
        paths = Paths(rows)
        length, depth0 = paths.column("length"), paths.column("seg") * segment
        told = {(c, last): (n, owner, longest) for c, last, n, owner, longest in zip(*(patches[c].to_pylist() for c in ("col", "last", "n", "owner", "longest")))}
        n, owner, longest = (np.zeros(paths.held.shape, np.int64) for _ in range(3))
        for j in range(paths.width):
            at, _, run = paths.runs(j)
            values = [np.diff([*at, len(length)]), np.minimum.reduceat(paths.projects, at), np.maximum.reduceat(length, at)]
            for last, i in ((False, 0), (True, len(at) - 1)):
                if (j, last) in told:
                    for v, whole in zip(values, told[j, last]):
                        v[i] = whole
            n[:, j], owner[:, j], longest[:, j] = (v[run] for v in values)
        mine = (owner == paths.projects[:, None]) & paths.held
        depth = depth0[:, None] + np.arange(1, paths.width + 1)
        leaf = mine & (longest == depth)
        saved = mine * (n - 1) * paths.lists("sizes")
        onward = lambda x: np.cumsum(x[:, ::-1], axis=1, dtype=np.int64)[:, ::-1]
        child = np.zeros_like(n)
        child[:, :-1] = mine[:, 1:]
        kept = paths.table.select([c.strip().split()[0] for c in _ROW.split(",")])
        for name, matrix in (("owner", owner), ("n", n), ("child", child), ("leaves", onward(leaf)), ("saved", onward(saved))):
            kept = kept.append_column(name, paths.listed(matrix))
        return kept

    return counted


def _nodes(segment: int, root: int):
    def nodes(table: pa.Table) -> pa.Table:
        """One row per node of the shard, its sums over the shard's members."""
        paths = Paths(table)
        owner, n, child, leaves, saved = (paths.lists(c) for c in ("owner", "n", "child", "leaves", "saved"))
        child[np.arange(len(n)), paths.held.sum(axis=1) - 1] += paths.column("next_own")
        leaves += paths.column("later_leaves")[:, None]
        saved += paths.column("later_saved")[:, None]
        above = np.concatenate([paths.table["above"].combine_chunks().fill_null(root).to_numpy()[:, None], owner[:, :-1]], axis=1)
        out = []
        for j in range(paths.width):
            at, node, _ = paths.runs(j)
            sums = [np.add.reduceat(x[:, j], at)[node] for x in (child, leaves, saved)]
            first = at[node]
            out.append([owner[first, j], paths.column("seg")[first] * segment + j + 1, above[first, j], n[first, j], *sums])
        names = [c.strip().split()[0] for c in _NODE.split(",")]
        return pa.table({c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in zip(names, zip(*out))})

    return nodes


def _ends(ends: DataFrame, most: int) -> DataFrame:
    """SHA-256 over the ids of the projects that end at a node, ascending and joined by commas.

    The ids are packed into texts of up to `most` ids by tasks that share even a node where most projects end; the
    hash of a node then reads its texts in order, one batch at a time.
    """
    keys = ["owner", "depth"]

    def grouped(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple[tuple[int, int], list]]:
        for batch in batches:
            owner, depth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in keys)
            cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])) + 1
            values = batch.column(batch.schema.get_field_index(value)).to_pylist()
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
                if b > a:
                    yield (int(owner[a]), int(depth[a])), values[a:b]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*key, ids[i], ",".join(map(str, ids[i : i + most]))) for key, ids in grouped([batch], "project_id") for i in range(0, len(ids), most)]
            yield pa.record_batch([pa.array([o[i] for o in out], kind) for i, kind in enumerate([pa.int64()] * 3 + [pa.string()])], [*keys, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done):
            return pa.record_batch([pa.array([d[i] for d in done], kind) for i, kind in enumerate([pa.int64(), pa.int64(), pa.string()])], [*keys, "ends_sha256"])

        now, state = None, None
        for batch in batches:
            done = []
            for key, texts in grouped([batch], "ids"):
                if key == now:
                    state.update(b",")
                else:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(",".join(texts).encode())
            yield told(done)
        if now:
            yield told([(*now, state.hexdigest())])

    texts = ends.repartitionByRange(_parts(ends), *keys, "project_id").sortWithinPartitions(*keys, "project_id").mapInArrow(packed, "owner long, depth long, first long, ids string")
    return texts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashed, "owner long, depth long, ends_sha256 string")


def _step_id(action: Column, target: Column) -> Column:
    text = F.concat_ws(":", F.char_length(action).cast("string"), action, target)
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2 * STEP_BYTES))


def history_tree(
    log: DataFrame, forks: DataFrame | None = None, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS, packed: int = PACKED
) -> DataFrame:
    """Tree of the distinct beginnings of project histories.

    log(project_id, seq, action, target) as `forked_logs` reads it, and optionally forks(project_id, base_id, shared),
    whose projects count even without steps. The first d steps (action, target) of a history are a node at depth d, from
    the root without steps; projects whose history begins with them are its members.

    Histories are rows of step numbers, ordered by path and range-sharded; a third of all projects with one history
    spread over many shards. In a shard's padded matrix, a lexsort and the changes from row to row, OR-ed along the
    columns, mark where nodes start, and reduceat sums them at every depth. Nodes of a shard's first and last rows may
    go on in its neighbours and are added up between shards. A history of more than `segment` steps is several rows, each
    told apart by a digest of what came before, and passes its sums on by ordered sums over its rows.

    Returns one row per node, named by its smallest member and its depth: project_id, depth, parent_project_id (null
    for the root), n_projects, n_children, n_leaves (nodes without children in the subtree, which holds its top),
    saved_bytes (over the subtree, a node's further members times the UTF-8 bytes of its last target), ends_sha256 (of
    the decimal ids of the members that end there, ascending, joined by commas). Without projects there is no root.
    """
    steps = _placed(log).select(
        "project_id", "place", _step_id(F.col("action"), F.col("target")).alias("step"), F.octet_length("target").cast("long").alias("size")
    )
    steps = materialise(steps, "steps")
    projects = steps.where("place = 0").select("project_id")
    if forks is not None:
        forks = materialise(_forks(forks), "forks")
        projects = projects.unionByName(forks.select("project_id")).distinct()
        steps = _forked(steps, forks)
    projects = materialise(projects, "projects")
    shards = _sharded(_segments(steps, segment), shard_rows)

    edges = materialise(shards.groupBy("shard").applyInArrow(_edges, _EDGE), "edges")
    key = [*_PLACE, "path"]
    whole = edges.groupBy(*key).agg(F.sum("n").alias("n"), F.min("owner").alias("owner"), F.max("longest").alias("longest"))
    patches = edges.select("shard", "col", "last", *key).join(whole, key).select("shard", "col", "last", "n", "owner", "longest")
    counted = materialise(shards.groupBy("shard").cogroup(patches.groupBy("shard")).applyInArrow(_counted(segment), _COUNTED), "counted")

    zero = F.lit(0).cast("long")
    starts = (F.element_at("owner", 1) == F.col("project_id")).cast("long")
    top = projects.select("project_id", F.lit(1).cast("long").alias("n"), zero.alias("c"), zero.alias("l"), zero.alias("s")).unionByName(
        counted.select(F.lit(None).cast("long").alias("project_id"), zero.alias("n"), F.when(F.col("seg") == 0, starts).otherwise(zero).alias("c"), F.element_at("leaves", 1).alias("l"), F.element_at("saved", 1).alias("s"))
    )
    top = top.agg(F.min("project_id").alias("project_id"), F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("s").alias("s")).first()
    root = None if top["project_id"] is None else (top["project_id"], 0, None, top["n"], top["c"], max(top["l"], 1), top["s"])

    single = F.col("length") < segment
    carry = {"next_own": zero, "later_leaves": zero, "later_saved": zero, "above": F.lit(None).cast("long")}
    asks = {
        "_leaves": ordered.running_sum(F.element_at("leaves", 1)), "_saved": ordered.running_sum(F.element_at("saved", 1)),
        "_all_leaves": ordered.key_total(F.element_at("leaves", 1)), "_all_saved": ordered.key_total(F.element_at("saved", 1)),
        "next_own": ordered.lead(starts, zero), "above": ordered.lag(F.element_at("owner", -1)),
    }
    longer = ordered.annotate(counted.where(~single), ["project_id"], ["seg"], asks)
    longer = longer.withColumns({"later_leaves": F.col("_all_leaves") - F.col("_leaves"), "later_saved": F.col("_all_saved") - F.col("_saved")})
    rows = counted.where(single).withColumns(carry).unionByName(longer.select(*counted.columns, *carry))
    nodes = rows.groupBy("shard").applyInArrow(_nodes(segment, root[0] if root else 0), _NODE)
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_bytes")]
    nodes = nodes.groupBy("project_id", "depth").agg(F.min("parent_project_id").alias("parent_project_id"), F.max("n_projects").alias("n_projects"), *sums)
    nodes = nodes.unionByName(projects.sparkSession.createDataFrame([root] if root else [], _NODE))

    here = F.col("seg") == F.floor((F.col("length") - 1) / segment)
    ends = counted.where(here).select(F.element_at("owner", -1).alias("owner"), F.col("length").alias("depth"), "project_id")
    idle = projects.join(steps.select("project_id").distinct(), "project_id", "left_anti")
    ends = ends.unionByName(idle.select(F.lit(root[0] if root else 0).cast("long").alias("owner"), zero.alias("depth"), "project_id"))
    ended = _ends(ends, packed).withColumnRenamed("owner", "project_id")
    nothing = hashlib.sha256().hexdigest()
    return nodes.join(ended, ["project_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
