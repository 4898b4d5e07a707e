"""Toxic texts by compression distance: windows that a dictionary of toxic text shortens more than one of ordinary text."""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from reelspark.llm import units

WINDOW_WORDS = 8
LEVEL = 3
ORDINARY_BYTES = 1 << 14
TOXIC_WORDS = 100
# Bytes of the dictionary trained on toxic text, and which of its words that is: in so many toxic rows, and log odds above this.
TRAINED_BYTES = 1 << 14
LEAST_ROWS, LEAST_ODDS = 3, 1.6
# A word is telling when its count times its log odds is at least this share of the most telling word's.
TELLING = 0.25
# Labelled rows that are fitted on, of each label: the bound of the sample. Their texts are whole.
SAMPLE_ROWS = 4000
# Windows that the dictionary of ordinary text is trained on.
SAMPLE_WINDOWS = 60_000

SCORE_SCHEMA = "project_id long, score double, n_windows long, best_gain long"

_FOLD = units.LOWER.copy()
_FOLD[:128][units.NOT_ALNUM[:128]] = 0x20
_FOLD_TABLE = _FOLD.tobytes()


def folded(text: str) -> bytes:
    """Lower case, ASCII punctuation as spaces, a space in front."""
    return b" " + text.lower().encode().translate(_FOLD_TABLE)


def window_segments(data: bytes, size: int = WINDOW_WORDS) -> np.ndarray:
    """(offset, length) of every `size` words of a folded text, with the space before; the last may be shorter."""
    array = np.frombuffer(data, np.uint8)
    starts, stops, _ = units.words(array, np.array([0, len(array)]))
    if not len(starts):
        return np.zeros((0, 2), np.uint64)
    first = np.arange(0, len(starts), size)
    last = np.minimum(first + size, len(starts)) - 1
    begin = starts[first] - 1
    return np.stack([begin, stops[last] - begin + (stops[last] < len(array))], axis=1).astype(np.uint64)


def _lengths(compressor: zstandard.ZstdCompressor, data: bytes, segments: np.ndarray) -> np.ndarray:
    found = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()), threads=1)
    return np.fromiter((len(x) for x in found), np.int64, len(found))


@dataclass
class Model:
    """Dictionaries of ordinary and of toxic text, and the calibration of their window gains.

    All begin with the same dictionary trained on ordinary text. They end in more ordinary text, in the
    most telling toxic text, or in all text that marks toxic rows. A window's gain, its length with the
    ordinary dictionary minus that with a toxic one, then comes from the last part alone. The last pair ends
    in a second dictionary trained on ordinary text, and in one trained on toxic text.
    """

    shared: bytes
    ordinary: bytes
    toxic: bytes
    marked: bytes
    trained_ordinary: bytes
    trained_toxic: bytes
    weights: list[float] = field(default_factory=list)

    def compressors(self) -> tuple[zstandard.ZstdCompressor, ...]:
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
        made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.shared + part for part in (self.ordinary, self.toxic, self.marked, self.trained_ordinary, self.trained_toxic))]
        return tuple(zstandard.ZstdCompressor(dict_data=d, compression_params=settings) for d in made)

    def score(self, features: np.ndarray) -> np.ndarray:
        """Calibrated probability of toxic text."""
        return 1.0 / (1.0 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))


N_FEATURES = 11


def features_of(gains: np.ndarray) -> np.ndarray:
    """What is calibrated: the best telling gains, how many windows there were to find them in, the share of marked windows, and best and average trained gains."""
    if not len(gains):
        return np.array([1.0] + [0.0] * (N_FEATURES - 1))
    telling, marked = gains[:, 0], np.maximum(gains[:, 1], 0)
    top = np.sort(telling)[::-1][:3]
    rest = float(np.sum(np.maximum(top[1:], 0)))
    best = float(max(top[0], 0))
    crowd = math.log1p(len(gains))
    enough = min(1.0, len(gains) / 4.0)
    trained = np.maximum(np.sort(gains[:, 2])[::-1], 0)
    of_trained = [float(trained[0]), float(trained[:3].mean()), float(trained.mean()), float((trained >= 3).mean()) * enough]
    return np.array([1.0, best, rest, crowd, best * crowd / 5.0, float(marked.mean()), float((marked >= 5).mean()) * enough, *of_trained])


def gains_of(compressors, data: bytes, segments: np.ndarray) -> np.ndarray:
    """Gains of the telling, the marked and the trained dictionary, one row per window."""
    if not len(segments):
        return np.zeros((0, 3), np.int64)
    plain, telling, marked, ordinary, toxic = (_lengths(c, data, segments) for c in compressors)
    return np.stack([plain - telling, plain - marked, ordinary - toxic], axis=1)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; the samples themselves where they are too few to train on."""
    if not samples:
        return b" "
    total = sum(map(len, samples))
    size = min(size, max(256, total // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit on a sample of labelled texts. Without both labels the model scores every text at the share of label 1."""
    distinct: dict[str, int] = {}
    for text, label in zip(texts, labels):
        distinct.setdefault(text, label)
    rng = random.Random(seed)
    folds = [(folded(t), y) for t, y in sorted(distinct.items())]
    rng.shuffle(folds)
    n_toxic = sum(y for _, y in folds)
    if not n_toxic or n_toxic == len(folds):
        share = (sum(labels) + 0.5) / (len(labels) + 1.0)
        return Model(*[b" "] * 6, [math.log(share / (1 - share))] + [0.0] * (N_FEATURES - 1))

    def fit_dictionaries(rows: list[tuple[bytes, int]]) -> Model:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        sizes = [0, 0]
        for data, y in rows:
            counts[y].update(set(data.split()))
            sizes[y] += 1

        def contrast(w: bytes) -> float:
            return math.log((counts[1][w] + 0.5) / (sizes[1] + 1) / ((counts[0][w] + 0.5) / (sizes[0] + 1)))

        # Toxic samples: the words that many toxic texts have and ordinary ones lack, the most telling last.
        least = max(3, sizes[1] // 80)
        marks = [(n * contrast(w), w) for w, n in counts[1].items() if n >= least and len(w) > 3 and contrast(w) > 3.0]
        marks = sorted(marks)[-TOXIC_WORDS:]
        toxic = b"".join(b" " + w for n, w in marks if n >= TELLING * marks[-1][0]) + b" "
        marked = b"".join(b" " + w for _, w in marks) + b" "
        # What the second dictionary is trained on: the text of toxic windows that ordinary rows have far less of, in any language.
        own = {w for w, n in counts[1].items() if n >= LEAST_ROWS and contrast(w) > LEAST_ODDS}
        windows: list[bytes] = []
        excess: list[bytes] = []
        for data, y in rows:
            if y:
                excess += [b"".join(b" " + w for w in data[a : a + n].split() if w in own) for a, n in window_segments(data).tolist()]
            elif len(windows) < SAMPLE_WINDOWS:
                windows += [data[a : a + n] for a, n in window_segments(data).tolist()]
        return Model(
            _dictionary(windows, ORDINARY_BYTES), b"".join(windows[-500:])[-len(toxic) :], toxic, marked,
            _dictionary(windows[::-1], TRAINED_BYTES), _dictionary([w for w in excess if w], TRAINED_BYTES),
        )

    # Calibrate on texts that the dictionaries have not seen, then train them on all.
    half = len(folds) // 2
    rows, marks = [], []
    for seen, unseen in ((folds[:half], folds[half:]), (folds[half:], folds[:half])):
        compressors = fit_dictionaries(seen).compressors()
        for data, y in unseen:
            rows.append(features_of(gains_of(compressors, data, window_segments(data))))
            marks.append(y)
    model = fit_dictionaries(folds)
    model.weights = _logistic(np.array(rows), np.array(marks, float)).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """At most `rows` texts of each label, whole, by a hash of their id: the bounded sample that the model is fitted on."""
    known = labels.where("flagged in (0, 1) and project_id is not null").groupBy("project_id").agg(F.max("flagged").alias("flagged"))
    order = F.xxhash64("project_id")
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("flagged") == label).orderBy(order, "project_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.where("document is not null").select("project_id", "document")
    found = texts.join(F.broadcast(chosen), "project_id").dropDuplicates(["project_id"]).orderBy("project_id").toArrow()
    return found["document"].to_pylist(), [int(v) for v in found["flagged"].to_pylist()]


def score_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """Toxicity of every project document.

    documents: project_id (long), document (text). Other columns are ignored and never part of a score.
    The project flags no texts itself; labels come from outside (`labelled_sample`: project_id, flagged
    0 or 1). The folded text is cut into windows of eight words. Each is compressed with the dictionaries
    of ordinary and of toxic text; the differences, calibrated on labelled texts, give the score.

    Returns project_id, score (0 to 1, toxic from 0.5), n_windows and best_gain (bytes). A null, empty or
    word-less document has no window and gets the calibrated score of no gain. Null ids and repeated rows
    are each scored. The whole text counts, however long. An empty table gives an empty result.
    """
    told = documents.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = told.value.compressors()
        for batch in batches:
            gains = _gains(compressors, batch.column("document"))
            best = np.array([int(g[:, 0].max()) if len(g) else 0 for g in gains], np.int64)
            counts = np.array([len(g) for g in gains], np.int64)
            columns = [batch.column("project_id").cast(pa.int64()), pa.array(_scores(told.value, gains)), pa.array(counts), pa.array(best)]
            yield pa.record_batch(columns, ["project_id", "score", "n_windows", "best_gain"])

    return documents.select("project_id", "document").mapInArrow(step, SCORE_SCHEMA)


def without_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of `documents` that score below the threshold, all columns unchanged. See `score_toxicity`.

    documents: document (text) and any other columns. Rows are dropped where they are read, without a shuffle.
    """
    told = documents.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = told.value.compressors()
        for batch in batches:
            scores = _scores(told.value, _gains(compressors, batch.column("document")))
            yield batch.filter(pa.array(scores < threshold))

    return documents.mapInArrow(step, fields)


def _scores(model: Model, gains: list[np.ndarray]) -> np.ndarray:
    return model.score(np.array([features_of(g) for g in gains])) if gains else np.zeros(0)


def _gains(compressors, texts: pa.Array) -> list[np.ndarray]:
    """Gains of the windows of every text, some half megabyte of text at a time."""
    out: list[np.ndarray] = []
    pending: list[bytes] = []
    size = 0
    for i in range(len(texts)):
        data = folded(texts[i].as_py() or "")
        pending.append(data)
        size += len(data)
        if size >= units.SLICE_BYTES or i == len(texts) - 1:
            out += _slice_gains(compressors, pending)
            pending, size = [], 0
    return out


def _slice_gains(compressors, texts: list[bytes]) -> list[np.ndarray]:
    """Gains of several texts with one call per dictionary."""
    each = [window_segments(t) for t in texts]
    base = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
    moved = [s + np.array([b, 0], np.uint64) for s, b in zip(each, base.astype(np.uint64))]
    gains = gains_of(compressors, b"".join(texts), np.concatenate(moved)) if moved else np.zeros((0, 3), np.int64)
    cuts = np.cumsum([len(s) for s in each])
    return np.split(gains, cuts[:-1])
