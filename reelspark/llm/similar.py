"""Exact n-gram Jaccard join of project documents by prefix filters under several token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from reelspark.llm import units
from reelspark.llm.graph import components
from reelspark.session import materialise

SHINGLE_WORDS = 4
PERCENT = 85
ORDERS = 3
# Shingles that a task holds before it deals them out, and of one bucket that is sorted together.
HELD_SHINGLES = 1 << 20
# Documents of a family compared at once; larger families are compared block by block.
BLOCK = 256
# Columns of the incidence matrix multiplied at once.
COLUMNS = 1 << 13

U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, text by text in ascending order, and their bounds.

    Words in A-Z are lower-cased. A text of fewer than k words is one shingle, a text without words none.
    """
    folded = units.LOWER[data]
    starts, stops, bounds = units.words(folded, offsets)
    hashes = units.word_hashes(folded, starts, stops)
    found, place = units.shingles(hashes, bounds, k, 1)
    owner = np.searchsorted(bounds, place, "right") - 1
    size = np.diff(bounds)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = units.Rolling(hashes, 1).of(bounds[short], bounds[short + 1])
        found, owner = np.concatenate((found, units.mix(whole, 5))), np.concatenate((owner, short))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[fresh], owner[fresh]
    return found, np.searchsorted(owner, np.arange(len(offsets)))


def set_signatures(documents: DataFrame, k: int) -> DataFrame:
    """Size and 128-bit signature of every document's shingle set."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in units.slices(batch, "document"):
                found, bounds = shingle_sets(data, offsets, k)
                sums = []
                for salt in (11, 12):
                    with np.errstate(over="ignore"):
                        total = np.concatenate((np.zeros(1, U), np.cumsum(units.mix(found, salt))))
                        sums.append(pa.array(units.signed(total[bounds[1:]] - total[bounds[:-1]])))
                yield pa.record_batch([part.column("project_id"), pa.array(np.diff(bounds)), *sums], ["project_id", "n", "mark_a", "mark_b"])

    return documents.mapInArrow(step, "project_id long, n long, mark_a long, mark_b long")


def _dealt(documents: DataFrame, k: int, buckets: int) -> DataFrame:
    """Shingles dealt to buckets by hash: one row per bucket for every million shingles of a task."""

    def pack(owners: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        owner, found = np.concatenate(owners), np.concatenate(hashes)
        bucket = (found >> U(33)) % U(buckets)
        order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint64), kind="stable")
        owner, found = owner[order], found[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = owner[cuts[b] : cuts[b + 1]]
            head = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            count = np.diff(np.append(head, len(mine))).astype(np.uint32)
            blobs = [mine[head].tobytes(), count.tobytes(), found[cuts[b] : cuts[b + 1]].tobytes()]
            yield pa.record_batch([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["bucket", "owners", "counts", "hashes"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part, data, offsets in units.slices(batch, "document"):
                found, bounds = shingle_sets(data, offsets, k)
                ids = part.column("project_id").to_numpy(zero_copy_only=False)
                owners.append(np.repeat(ids, np.diff(bounds)))
                hashes.append(found)
                held += len(found)
                if held >= HELD_SHINGLES:
                    yield from pack(owners, hashes)
                    owners, hashes, held = [], [], 0
        if held:
            yield from pack(owners, hashes)

    return documents.mapInArrow(step, "bucket int, owners binary, counts binary, hashes binary")


def _group(owner: np.ndarray, groups: int) -> np.ndarray:
    return (units.mix(owner.view(U), 30) % U(groups)).astype(np.int32)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and length of every stretch of equal values."""
    head = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(values)))


def repeated_shingles(documents: DataFrame, heads: DataFrame, k: int, total: int, percent: int) -> DataFrame:
    """Documents of `heads` that can link, with their shingles that occur in several documents.

    heads: project_id, n, copies. Shingles are dealt to buckets by hash. A bucket finds those of several
    documents and sends them back, dealt to groups of documents: one row per bucket and group, both ways. A
    group puts each document's shingles together and keeps the documents with enough of them: a link needs so
    many common shingles, and common ones occur in several documents. Returns project_id, n, copies, tokens
    and counts, each shingle's number of documents: the corpus statistic behind the rare-first order.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // HELD_SHINGLES))
    sent = ["group", "owners", "sizes", "tokens", "counts"]

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, bytes, bytes]] = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("owners", "counts", "hashes")))
        if not rows:
            return
        owner = np.concatenate([np.repeat(np.frombuffer(a, np.int64), np.frombuffer(c, np.uint32)) for a, c, _ in rows])
        found = np.concatenate([np.frombuffer(h, U) for *_, h in rows])
        rows.clear()
        order = np.argsort(found)
        found, owner = found[order], owner[order]
        _, count = _runs(found)
        many = np.repeat(count, count)
        keep = many > 1
        found, owner, many = found[keep], owner[keep], many[keep]
        group = _group(owner, buckets)
        order = np.lexsort((owner, group))
        found, owner, many, group = found[order], owner[order], many[order], group[order]
        for at, size in zip(*(x.tolist() for x in _runs(group))):
            mine = slice(at, at + size)
            head, length = _runs(owner[mine])
            blobs = [owner[mine][head].tobytes(), length.astype(np.uint32).tobytes(), found[mine].tobytes(), np.minimum(many[mine], (1 << 31) - 1).astype(np.int32).tobytes()]
            yield pa.record_batch([pa.array([int(group[at])], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], sent)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_group(batch.column(0).to_numpy(), buckets)), *batch.columns], ["group", "project_id", "n", "copies"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, tokens, counts, known = [], [], [], []
        for batch in batches:
            blob = batch.filter(pc.is_valid(batch.column("owners")))
            for a, c, t, m in zip(*(blob.column(x).to_pylist() for x in sent[1:])):
                owners.append(np.repeat(np.frombuffer(a, np.int64), np.frombuffer(c, np.uint32)))
                tokens.append(np.frombuffer(t, np.int64))
                counts.append(np.frombuffer(m, np.int32))
            head = batch.filter(pc.is_valid(batch.column("n")))
            known.append(np.stack([head.column(x).to_numpy() for x in ("project_id", "n", "copies")]))
        if not owners:
            return
        ids, n, copies = np.concatenate(known, axis=1)
        order = np.argsort(ids)
        ids, n, copies = ids[order], n[order], copies[order]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        owner, token, count = owner[order], np.concatenate(tokens)[order], np.concatenate(counts)[order]
        head, size = _runs(owner)
        at = np.minimum(np.searchsorted(ids, owner[head]), max(0, len(ids) - 1))
        chosen = (ids[at] == owner[head]) & (100 * size >= percent * n[at]) if len(ids) else np.zeros(len(head), bool)
        keep = np.repeat(chosen, size)
        at, size, token, count = at[chosen], size[chosen], token[keep], count[keep]
        ends = np.concatenate(([0], np.cumsum(size)))
        for first in range(0, len(at), 2000):
            last = min(first + 2000, len(at))
            offsets = pa.array((ends[first : last + 1] - ends[first]).astype(np.int32))
            part = slice(ends[first], ends[last])
            yield pa.record_batch(
                [
                    *(pa.array(x[at[first:last]]) for x in (ids, n, copies)), pa.ListArray.from_arrays(offsets, pa.array(token[part])),
                    pa.ListArray.from_arrays(offsets, pa.array(count[part])),
                ],
                ["project_id", "n", "copies", "tokens", "counts"],
            )

    # One partition per bucket and per group, so that all have the same share.
    dealt = _dealt(documents, k, buckets).repartitionById(buckets, F.col("bucket"))
    answers = dealt.mapInArrow(reply, "group int, owners binary, sizes binary, tokens binary, counts binary")
    asked = heads.select("project_id", "n", "copies").mapInArrow(place, "group int, project_id long, n long, copies long")
    both = answers.unionByName(asked, allowMissingColumns=True).repartitionById(buckets, F.col("group"))
    return both.mapInArrow(gather, "project_id long, n long, copies long, tokens array<long>, counts array<int>")


def prefix_tokens(members: DataFrame, order: int, percent: int) -> DataFrame:
    """Prefix of every member under one global order: (family, token, project_id).

    Every order begins with the shingles of one document alone, which `tokens` leaves out. Order 0 then
    goes by document count, rarest first; the others by a hash of their own.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("tokens")
            size = np.diff(listed.offsets.to_numpy())
            token = listed.flatten().to_numpy().view(U)
            n = batch.column("n").to_numpy()
            owner = np.repeat(np.arange(len(batch)), size)
            keys = [units.mix(token, 20 + order), owner] if order else [units.mix(token, 20), batch.column("counts").flatten().to_numpy(), owner]
            rank = np.lexsort(keys)
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            prefix = n - -(-percent * n // 100) + 1 - (n - size)
            chosen = rank[place < prefix[owner]]
            mine = pa.array(owner[chosen])
            yield pa.record_batch(
                [batch.column("family").take(mine), pa.array(units.signed(token[chosen])), batch.column("project_id").take(mine)], ["family", "token", "project_id"]
            )

    return members.select("family", "project_id", "n", "tokens", "counts").mapInArrow(step, "family long, token long, project_id long")


def narrowed(members: DataFrame, order: int, percent: int) -> DataFrame:
    """Members split into smaller families: those that share prefix tokens under this order too, directly or through others."""
    prefixes = materialise(prefix_tokens(members, order, percent), "prefixes")
    heads = prefixes.groupBy("family", "token").agg(F.min("project_id").alias("_head"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    edges = prefixes.join(materialise(heads, "heads"), ["family", "token"]).where("project_id > _head").select("project_id", "_head")
    found = components(edges, "project_id", "_head").select(F.col("node").alias("project_id"), F.col("component").alias("family"))
    return materialise(members.drop("family").join(found, "project_id"), "members")


def block_links(left: list[np.ndarray], left_n: np.ndarray, right: list[np.ndarray], right_n: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of exact links between two blocks of token sets."""
    sizes = np.array([len(t) for t in (*left, *right)])
    token = np.concatenate((*left, *right)) if len(sizes) else np.zeros(0, np.int64)
    _, column, count = np.unique(token, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = int(column[-1]) + 1 if len(column) else 0
    both = np.zeros((len(left), len(right)))
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        matrix = np.zeros((len(sizes), min(COLUMNS, width - at)), np.float32)
        matrix[owner[a:b], column[a:b] - at] = 1
        both += matrix[: len(left)] @ matrix[len(left) :].T
    return 100 * both >= percent * (left_n[:, None] + right_n[None, :] - both)


def family_links(members: DataFrame, percent: int) -> DataFrame:
    """Exact links inside families: (project_id, other, links).

    One row per document and pair of blocks: the smallest document that links join it to there, and the
    number of documents (copies included) it links with there.
    """
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("_size")).withColumn("_blocks", F.ceil(F.col("_size") / BLOCK).cast("int"))
    placed = members.join(materialise(sizes.where("_size > 1"), "family-sizes"), "family")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("project_id"), F.col("_blocks").cast("long")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = placed.select(
        "family", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "project_id", "n", "copies", "tokens"
    )

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids, n, copies, block = (table[c].to_numpy() for c in ("project_id", "n", "copies", "block"))
        listed = table["tokens"].combine_chunks()
        offsets, flat = listed.offsets.to_numpy(), listed.values.to_numpy()
        tokens = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
        low = table["low"][0].as_py()
        same = low == table["high"][0].as_py()
        a = np.flatnonzero(block == low)
        b = a if same else np.flatnonzero(block != low)
        links = block_links([tokens[i] for i in a], n[a], [tokens[i] for i in b], n[b], percent)
        if same:
            np.fill_diagonal(links, False)
        label_a, label_b = ids[a].copy(), ids[b].copy()
        top = np.iinfo(np.int64).max
        while True:
            best_a = np.minimum(label_a, np.where(links, label_b[None, :], top).min(axis=1, initial=top))
            best_b = np.minimum(label_b, np.where(links, best_a[:, None], top).min(axis=0, initial=top))
            if same:
                best_a = best_b = np.minimum(best_a, best_b)
            if (best_a == label_a).all() and (best_b == label_b).all():
                break
            label_a, label_b = best_a, best_b
        out = [(ids[a], label_a, links @ copies[b])]
        if not same:
            out.append((ids[b], label_b, links.T @ copies[a]))
        columns = [np.concatenate(x) for x in zip(*out)]
        keep = columns[2] > 0
        return pa.record_batch([pa.array(x[keep].astype(np.int64)) for x in columns], ["project_id", "other", "links"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("family", "low", "high")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            at = 0
            for edge in [*change.tolist(), len(batch)]:
                key = tuple(int(k[at]) for k in keys)
                if held and key != now:
                    yield solve(held)
                    held = []
                now = key
                held.append(batch.slice(at, edge - at))
                at = edge
        if held:
            yield solve(held)

    pairs = placed.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
    return pairs.mapInArrow(step, "project_id long, other long, links long")


def similar_projects(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """Documents joined with those that share at least `percent` of a hundred of their word shingles.

    documents: project_id (unique long), document (text). Other columns are ignored. Words are runs of
    anything but ASCII white space, A-Z lower-cased. A document's set holds its distinct shingles of
    `shingle_words` words; with fewer words the whole sequence is one shingle. Two documents link when
    100 * common >= percent * union.

    Documents with equal sets are one class. A document that can link shares its first tokens with the
    other under every global order of tokens, the first being rarest first. Families are what is connected
    by shared prefix tokens under all orders one after another; only within them are sets compared, block
    against block, so no pair is ever a row. Linking documents share all tokens that count, and tokens of
    one document alone are dropped at the start, once per corpus.

    Returns project_id, n_shingles, component_id (the smallest project_id reachable by links, itself
    included) and n_links (documents it links with). Null, empty and word-less documents have no shingles,
    link with nothing and are their own component. Null ids are dropped. Rows that share a project_id
    are taken for copies of one document. An empty table gives an empty result.
    """
    documents = documents.select(F.col("project_id").cast("long").alias("project_id"), "document").where("project_id is not null")
    marks = materialise(set_signatures(documents, shingle_words), "signatures")
    mark = ["n", "mark_a", "mark_b"]
    classes = marks.where("n > 0").groupBy(*mark).agg(F.min("project_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "classes")
    total = marks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    heads = classes.select(F.col("class_id").alias("project_id"), "n", "copies")
    found = repeated_shingles(documents, heads, shingle_words, total, percent)
    members = materialise(found.withColumn("family", F.lit(0).cast("long")), "members")
    for order in range(orders):
        members = narrowed(members, order, percent)
    links = materialise(family_links(members, percent), "class-links")

    joined = components(links, "project_id", "other").withColumnRenamed("node", "class_id")
    degree = links.groupBy(F.col("project_id").alias("class_id")).agg(F.sum("links").alias("_links"))
    of_class = classes.join(joined, "class_id", "left").join(degree, "class_id", "left").select(
        *mark, F.coalesce("component", "class_id").alias("component_id"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = marks.join(materialise(of_class, "class-components"), mark, "left")
    return out.select(
        "project_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "project_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
