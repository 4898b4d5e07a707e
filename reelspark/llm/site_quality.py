"""Quality of media notes: document evidence combined with what the folder and its root are known for."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reelspark.llm import units
from reelspark.session import materialise

# Labelled rows of each verdict that the classifier is fitted on: the bound of the sample.
SAMPLE_ROWS = 4000
FEATURES = ("bias", "upper", "digits", "signs", "word_chars", "distinct", "repeats", "mixed", "pieces", "long_line", "log_words")
# Strengths of the priors, in documents, are kept within these bounds.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
# A document's own evidence counts up to these log odds.
MOST_EVIDENCE = 12.0

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#$%&*+/<=>@[]\\^_`{|}~!"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers that describe each text of a slice, one row per text; all zero but the bias for a text without words."""
    starts, stops, bounds = units.words(data, offsets)
    n = np.diff(bounds)
    size = np.diff(offsets)
    have = n > 0
    words, chars = np.maximum(n, 1), np.maximum(size, 1)

    def total(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return (sums[cuts[1:]] - sums[cuts[:-1]]).astype(float)

    owner = np.repeat(np.arange(len(n)), n)
    hashes = units.word_hashes(data, starts, stops)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=len(n))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    last = data[stops - 1] if len(stops) else np.zeros(0, np.uint8)
    length = stops - starts
    lines = total(_NEWLINE[data], offsets) + 1
    upper, lower = total(_UPPER[data], offsets), total(_LOWER[data], offsets)
    out = np.zeros((len(n), len(FEATURES)))
    out[:, 0] = 1
    out[:, 1] = upper / np.maximum(upper + lower, 1)
    out[:, 2] = total(_DIGIT[data], offsets) / chars
    out[:, 3] = 4 * total(_SIGN[data], offsets) / chars
    out[:, 4] = np.minimum(total(length, bounds) / words, 30) / 10
    out[:, 5] = distinct / words / np.maximum(0.2, 1 - np.log1p(words) / 12)
    out[:, 6] = total(again, bounds) / words
    out[:, 7] = total(_SIGN[last], bounds) / words
    out[:, 8] = total((length == 1) & _SIGN[data[starts]] if len(starts) else length, bounds) / words
    out[:, 9] = np.log1p(n / lines) / 5
    out[:, 10] = np.log1p(n) / 10
    out[~have, 1:] = 0
    return out


def feature_rows(assets: DataFrame) -> DataFrame:
    """Assets with their features: (asset_id, root, folder, features)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in units.slices(batch, "note"):
                found = text_features(data, offsets)
                places = pa.array(np.arange(0, found.size + 1, len(FEATURES)).astype(np.int32))
                kept = [part.column(c) for c in ("asset_id", "root", "folder")]
                yield pa.record_batch([*kept, pa.ListArray.from_arrays(places, pa.array(found.ravel()))], ["asset_id", "root", "folder", "features"])

    return assets.select("asset_id", "root", "folder", "note").mapInArrow(step, "asset_id long, root string, folder string, features array<double>")


@dataclass
class Classifier:
    """Logistic regression on text features; `base` are the log odds of its training rows."""

    weights: list[float]
    base: float

    def log_odds(self, features: Column) -> Column:
        """Log odds of good quality that the text alone speaks for, the training rows' own share taken out."""
        terms = F.zip_with(features, F.array(*[F.lit(w) for w in self.weights]), lambda x, w: x * w)
        total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) - F.lit(self.base)
        return F.greatest(F.lit(-MOST_EVIDENCE), F.least(F.lit(MOST_EVIDENCE), total))


def fit_classifier(features: DataFrame, verdicts: DataFrame, rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on at most `rows` labelled assets of each verdict, by a hash of their id."""
    known = verdicts.where("passed in (0, 1) and asset_id is not null").groupBy("asset_id").agg(F.min("passed").alias("passed"))
    chosen = None
    for verdict in (0, 1):
        part = known.where(F.col("passed") == verdict).orderBy(F.xxhash64("asset_id"), "asset_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = features.join(F.broadcast(chosen), "asset_id").dropDuplicates(["asset_id"]).orderBy("asset_id").select("features", "passed").toArrow()
    y = found["passed"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Classifier([0.0] * len(FEATURES), 0.0)
    x = found["features"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    w = np.zeros(x.shape[1])
    penalty = 0.05 * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return Classifier(w.tolist(), base)


def _logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def _inside(p: Column) -> Column:
    return F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))


def _strength(share: Column, n: Column, mean: Column) -> Column:
    """Method-of-moments strength of a Beta prior over groups with these shares of good documents.

    The groups' spread around the mean, less what their sizes alone explain, is the prior's variance.
    """
    spread = F.sum(n * (share - mean) * (share - mean)) / F.sum(n)
    chance = F.max(mean * (1 - mean)) * F.count(F.lit(1)) / F.sum(n)
    between = F.greatest(spread - chance, F.lit(1e-9))
    return F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), F.max(mean * (1 - mean)) / between - 1))


def asset_quality(assets: DataFrame, verdicts: DataFrame, classifier: Classifier | None = None, sample: int = SAMPLE_ROWS) -> DataFrame:
    """Posterior quality of media notes, shrunk along root and folder.

    assets: asset_id (unique long), root and folder (the media path's first part and the part below it),
    note (text). verdicts: asset_id, passed (0 or 1). Other columns are ignored. A classifier turns each
    note into log odds. Roots have a Beta prior around the global share of good notes, folders one around
    their root's posterior; both strengths come from the spread between groups (method of moments). A
    group counts its verdicts where known and the classifier's probabilities elsewhere, the asset's own
    left out. So a root or folder with few notes stays near the level above. The posterior adds the note's
    own log odds to those of its folder.

    Returns asset_id, root, folder, evidence (log odds of the note), root_share, folder_share (posterior
    means without the asset itself), quality (0 to 1) and keep (from 0.5). Null roots and folders are
    groups of their own. Null and empty notes have the evidence of an empty text. Repeated rows and null
    ids are each returned. Several verdicts on one asset count as the lowest. Without verdicts of both
    kinds notes give no evidence. An empty table gives an empty result.
    """
    assets = assets.select(F.col("asset_id").cast("long").alias("asset_id"), F.col("root").cast("string").alias("root"), F.col("folder").cast("string").alias("folder"), "note")
    features = materialise(feature_rows(assets), "features")
    verdicts = verdicts.select(F.col("asset_id").cast("long").alias("asset_id"), "passed")
    classifier = classifier or fit_classifier(features, verdicts, sample)
    known = verdicts.where("passed in (0, 1) and asset_id is not null").groupBy("asset_id").agg(F.min("passed").cast("double").alias("_known"))
    rows = features.select("asset_id", F.struct("root").alias("_root"), F.struct("root", "folder").alias("_folder"), classifier.log_odds(F.col("features")).alias("evidence"))
    rows = rows.join(known, "asset_id", "left")
    labelled = known.agg((F.coalesce(F.sum("_known"), F.lit(0.0)) + 1).alias("_good"), (F.count(F.lit(1)) + 2).alias("_all")).first()
    start = float(np.log(labelled[0] / (labelled[1] - labelled[0])))
    soft = F.lit(1.0) / (1 + F.exp(-(F.col("evidence") + F.lit(start))))
    rows = materialise(rows.withColumn("_good", F.coalesce("_known", soft)).drop("_known"), "evidence")

    folders = materialise(rows.groupBy("_root", "_folder").agg(F.count(F.lit(1)).alias("_n"), F.sum("_good").alias("_g")), "folders")
    roots = folders.groupBy("_root").agg(F.sum("_n").alias("_root_n"), F.sum("_g").alias("_root_g"))
    # Three numbers describe all groups: the global share and the two strengths.
    mean = float(roots.agg(_inside(F.sum("_root_g") / F.sum("_root_n"))).first()[0] or 0.5)
    root_k = roots.agg(_strength(F.col("_root_g") / F.col("_root_n"), F.col("_root_n"), F.lit(mean))).first()[0] or LEAST_STRENGTH
    levels = materialise(folders.join(roots, "_root"), "levels")
    folder_k = levels.agg(_strength(F.col("_g") / F.col("_n"), F.col("_n"), F.col("_root_g") / F.col("_root_n"))).first()[0] or LEAST_STRENGTH

    joined = rows.join(levels.drop("_root"), "_folder")
    root_share = (F.lit(root_k * mean) + F.col("_root_g") - F.col("_good")) / (F.lit(root_k) + F.col("_root_n") - 1)
    joined = joined.withColumn("root_share", _inside(root_share))
    folder_share = (F.lit(folder_k) * F.col("root_share") + F.col("_g") - F.col("_good")) / (F.lit(folder_k) + F.col("_n") - 1)
    joined = joined.withColumn("folder_share", _inside(folder_share))
    quality = F.lit(1.0) / (1 + F.exp(-(F.col("evidence") + _logit(F.col("folder_share")))))
    return joined.select(
        "asset_id", F.col("_folder.root").alias("root"), F.col("_folder.folder").alias("folder"), "evidence", "root_share", "folder_share",
        quality.alias("quality"), (quality >= 0.5).alias("keep"),
    )
