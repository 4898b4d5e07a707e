"""Token counts of edited documents: a tree of counts per document, re-encoded only where an edit touches it."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

LEAF_BYTES = 256
# Fixed value: how byte-level BPE vocabularies of this kind split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Visible ASCII. A space between two of these always begins a new pre-token.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True

TREE_FIELDS = "leaf_ends array<int>, sums array<long>"
COUNT_SCHEMA = "project_id long, n_tokens long, n_tokens_edited long, n_edits int, n_leaves int, n_bytes long, n_bytes_encoded long, leaf_ends array<int>, sums array<long>"


def read_ranks(folder: str, name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """A vocabulary file's text; read on the driver and sent to the tasks (less than a megabyte)."""
    with open(f"{folder}/{name}", "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def encoder(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count(enc: tiktoken.Encoding, data: bytes) -> int:
    return len(enc.encode_ordinary(data.decode()))


def leaf_ends(data: bytes, size: int = LEAF_BYTES) -> np.ndarray:
    """Ends of the leaves: safe places, the first at or after every `size` bytes."""
    array = np.frombuffer(data, np.uint8)
    if len(array) <= size:
        return np.array([len(array)], np.int32) if len(array) else np.zeros(0, np.int32)
    seen = _VISIBLE[array]
    safe = np.flatnonzero((array[1:-1] == 0x20) & seen[:-2] & seen[2:]) + 1
    if len(safe):
        at = np.searchsorted(safe, np.arange(size, len(array), size))
        safe = np.unique(safe[at[at < len(safe)]])
    return np.append(safe, len(array)).astype(np.int32)


def tree_of(counts: np.ndarray) -> np.ndarray:
    """Complete binary tree of sums, root at 1, leaves in the last half (zero-padded)."""
    width = 1 << max(0, int(len(counts) - 1).bit_length()) if len(counts) else 1
    sums = np.zeros(2 * width, np.int64)
    sums[width : width + len(counts)] = counts
    level = width
    while level > 1:
        half = level // 2
        sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
        level = half
    return sums


def set_leaf(sums: np.ndarray, leaf: int, value: int) -> None:
    """Replace one leaf's count and correct the sums above it."""
    at = len(sums) // 2 + leaf
    change = value - int(sums[at])
    while at and change:
        sums[at] += change
        at //= 2


def edited_tree(enc: tiktoken.Encoding, data: bytes, ends: np.ndarray, sums: np.ndarray, edits: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Leaf ends and sums of the edited text, and the bytes encoded for them.

    An edit replaces bytes start to stop. Its region is the leaves within two bytes of it: the places
    where a region begins and ends keep their neighbours, so the rest of the text is split as before.
    Regions that share a leaf are one. A region's new text is dealt to its leaves; those left over are empty. The
    result takes further edits as a fresh tree does.
    """
    sums = sums.copy()
    edits = sorted(edits)
    if not len(ends):
        whole = b"".join(text for *_, text in edits)
        set_leaf(sums, 0, count(enc, whole))
        return np.array([len(whole)], np.int32) if whole else ends, sums, len(whole)
    regions: list[list] = []
    for edit in edits:
        last = min(int(np.searchsorted(ends, min(len(data), edit[1] + 2), "left")), len(ends) - 1)
        first = min(int(np.searchsorted(ends, max(0, edit[0] - 2), "right")), last)
        if regions and first <= regions[-1][1]:
            regions[-1][1] = max(last, regions[-1][1])
            regions[-1][2].append(edit)
        else:
            regions.append([first, last, [edit]])
    encoded, after, grown = 0, ends.copy(), 0
    done = 0
    for first, last, inside in regions:
        at, stop = int(ends[first - 1]) if first else 0, int(ends[last])
        after[done:first] += grown
        begin = at + grown
        pieces = []
        for start, end, text in inside:
            pieces += [data[at:start], text]
            at = max(at, end)
        pieces.append(data[at:stop])
        fresh = b"".join(pieces)
        encoded += len(fresh)
        leaves = last - first + 1
        parts = leaf_ends(fresh, max(LEAF_BYTES, -(-len(fresh) // leaves)))
        cuts = [0, *parts.tolist(), *[len(fresh)] * (leaves - len(parts))]
        for i in range(leaves):
            set_leaf(sums, first + i, count(enc, fresh[cuts[i] : cuts[i + 1]]) if cuts[i + 1] > cuts[i] else 0)
        after[first : last + 1] = [begin + c for c in cuts[1:]]
        grown, done = begin + len(fresh) - stop, last + 1
    after[done:] += grown
    return after, sums, encoded


def edited_counts(enc: tiktoken.Encoding, data: bytes, ends: np.ndarray, sums: np.ndarray, edits: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, int]:
    """Sums after the edits, and the bytes encoded for them. See `edited_tree`."""
    return edited_tree(enc, data, ends, sums, edits)[1:]


def apply_edits(data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    out, at = [], 0
    for start, stop, text in sorted(edits):
        out += [data[at:start], text]
        at = max(at, stop)
    return b"".join([*out, data[at:]])


def with_trees(documents: DataFrame, ranks: bytes) -> DataFrame:
    """Documents with the tree of their token counts; all columns stay but for earlier ones of the same names.

    Adds leaf_ends (byte ends of the leaves) and sums (complete binary tree, root at index 1).
    """
    told = documents.sparkSession.sparkContext.broadcast(ranks)
    documents = documents.drop("leaf_ends", "sums")
    names = [f.name for f in documents.schema.fields]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(told.value)
        for batch in batches:
            all_ends, all_sums = [], []
            for text in batch.column("document"):
                data = (text.as_py() or "").encode()
                ends = leaf_ends(data)
                counts = np.array([count(enc, data[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], np.int64)
                all_ends.append(ends)
                all_sums.append(tree_of(counts))
            listed = [_lists(all_ends, pa.int32()), _lists(all_sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *listed], [*names, "leaf_ends", "sums"])

    return documents.mapInArrow(step, f"{fields}, {TREE_FIELDS}")


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def edited_token_counts(trees: DataFrame, ranks: bytes, keep_text: bool = False) -> DataFrame:
    """Token counts of documents before and after their edits, from their trees.

    trees: project_id, document, leaf_ends and sums (`with_trees`), and edits, an array of (start, stop,
    text): bytes start to stop of the document are replaced by the text. Edits lie between characters and do not overlap; equal
    starts apply in order of stop. Only leaves near an edit are encoded again, and the sums above them
    corrected. The count equals that of the whole edited text.

    Returns project_id, n_tokens, n_tokens_edited, n_edits, n_leaves, n_bytes, n_bytes_encoded (for the
    edits) and the tree of the edited text (leaf_ends, sums); with keep_text also that text as document, ready for the
    next edits. Null documents are empty; null or empty edits change nothing; ends beyond the text are cut to it. Null ids and repeated
    rows are each counted. An empty table gives an empty result.
    """
    told = trees.sparkSession.sparkContext.broadcast(ranks)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(told.value)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            ends_of, sums_of, texts = [], [], []
            for i in range(len(batch)):
                data = (batch.column("document")[i].as_py() or "").encode()
                ends, sums = (np.asarray(batch.column(c)[i].values) for c in ("leaf_ends", "sums"))
                before = int(sums[1])
                edits = [(min(max(0, e["start"]), len(data)), min(max(0, e["stop"]), len(data)), (e["text"] or "").encode()) for e in batch.column("edits")[i].as_py() or []]
                encoded = 0
                if edits:
                    ends, sums, encoded = edited_tree(enc, data, ends, sums, edits)
                if keep_text:
                    texts.append(apply_edits(data, edits).decode())
                ends_of.append(ends)
                sums_of.append(sums)
                for name, value in zip(names, (batch.column("project_id")[i].as_py(), before, int(sums[1]), len(edits), len(ends), len(data), encoded)):
                    out[name].append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(out[c], k) for c, k in zip(names, kinds)]
            columns += [_lists(ends_of, pa.int32()), _lists(sums_of, pa.int64()), *([pa.array(texts, pa.string())] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = COUNT_SCHEMA + (", document string" if keep_text else "")
    names = [f.split()[0] for f in schema.split(", ")]
    return trees.select("project_id", "document", "leaf_ends", "sums", "edits").mapInArrow(step, schema)


# What is redacted, in this order, and what stands in its place.
REDACTIONS = (
    (rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<email>"),
    (rb"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
    (rb"\+?\d{1,2} ?\(\d{3}\) ?\d{3}-\d{4}", "<phone>"),
    (rb"\b\d{13,19}\b", "<number>"),
    (rb"\b(?:AKIA[0-9A-Z]{12,}|(?:sk|ghp)[-_][A-Za-z0-9_-]{16,})", "<key>"),
)


def with_redactions(documents: DataFrame) -> DataFrame:
    """Documents (project_id, document) with the edits that redact addresses, numbers and keys."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(b"|".join(b"(" + p + b")" for p, _ in REDACTIONS))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
        quick = re.compile(rb"[0-9@]|AKIA|sk[-_]|ghp[-_]")
        for batch in batches:
            found = []
            for text in batch.column("document"):
                data = (text.as_py() or "").encode()
                edits = []
                if quick.search(data):
                    edits = [{"start": m.start(), "stop": m.end(), "text": REDACTIONS[m.lastindex - 1][1]} for m in pattern.finditer(data)]
                found.append(edits)
            yield pa.record_batch([batch.column("project_id"), batch.column("document"), pa.array(found, kind)], ["project_id", "document", "edits"])

    rows = documents.select(F.col("project_id").cast("long").alias("project_id"), F.col("document").cast("string").alias("document"))
    return rows.mapInArrow(step, "project_id long, document string, edits array<struct<start:int,stop:int,text:string>>")


def redacted_token_counts(documents: DataFrame, tokenizer_folder: str) -> DataFrame:
    """Token counts of project documents before and after redaction. See `edited_token_counts`.

    documents: project_id, document. Other columns are ignored. tokenizer_folder holds the vocabulary.
    """
    ranks = read_ranks(tokenizer_folder)
    return edited_token_counts(with_trees(with_redactions(documents), ranks), ranks)
