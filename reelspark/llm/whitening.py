"""Whitening of frame histograms: leading components of their covariance, scaled to unit variance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelspark.session import materialise

STEPS = 256
COMPONENTS = 4
# Part of the trace at and below which an eigenvalue counts as zero, and the drop after which what remains is measured again.
ZERO = 1e-24
NEXT_ROUND = 1e-6
# Eigenvalues of a tridiagonal matrix closer than this part of its norm are one cluster.
CLUSTER = 1e-3
NOTHING = 1e-150
MOST_STEP = float(1 << 53)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reduction of a symmetric matrix: diagonal, off-diagonal, and the unit reflectors in order."""
    a = np.array(matrix, float)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        if np.abs(x).max() < NOTHING:  # its square would underflow
            x[:] = 0.0
        length = np.linalg.norm(x)
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        if length > 0:
            v /= np.linalg.norm(v)
        reflectors.append(v)
        inner = a[k + 1 :, k + 1 :]
        p = inner @ v
        w = p - (v @ p) * v
        inner -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, x[0])
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each of the points."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count = np.zeros(len(at), int)
    q = np.ones(len(at))
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of the Sturm count."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    rank = n - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        over = below(diagonal, off, middle) > rank
        high, low = np.where(open_ & over, middle, high), np.where(open_ & ~over, middle, low)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solution of (T - shift) y = right by elimination with row exchanges; vanishing pivots become tiny."""
    n = len(diagonal)
    least = max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0, 1e-300) * np.finfo(float).eps
    d, up, up2, y = diagonal - shift, off.copy(), np.zeros(max(0, n - 2)), right.copy()
    for i in range(n - 1):
        if abs(off[i]) > abs(d[i]):
            factor = d[i] / off[i]
            d[i], next_up = off[i], d[i + 1]
            d[i + 1] = up[i] - factor * next_up
            up[i] = next_up
            if i < n - 2:
                up2[i] = up[i + 1]
                up[i + 1] = -factor * up[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            if abs(d[i]) < least:
                d[i] = least
            factor = off[i] / d[i]
            d[i + 1] -= factor * up[i]
            y[i + 1] -= factor * y[i]
    if abs(d[-1]) < least:
        d[-1] = least
    for i in range(n - 1, -1, -1):
        y[i] -= (up[i] * y[i + 1] if i < n - 1 else 0.0) + (up2[i] * y[i + 2] if i < n - 2 else 0.0)
        y[i] /= d[i]
    return y


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the values as columns: inverse iteration, made orthogonal again within a cluster."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max() + (2 * np.abs(off).max() if len(off) else 0.0), 1e-300)
    rng = np.random.default_rng(0)
    out = np.zeros((n, len(values)))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        y = rng.normal(size=n)
        for _ in range(5):
            # Equal values are told apart by tiny shifts, so that their solutions differ.
            y = _solve(diagonal, off, value - (j - first) * 4 * np.finfo(float).eps * norm, y / np.linalg.norm(y))
            for _ in range(3):
                y /= np.linalg.norm(y)
                y -= out[:, first:j] @ (out[:, first:j].T @ y)
        out[:, j] = y / np.linalg.norm(y)
    return out


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    k = min(k, len(matrix))
    scale = np.abs(matrix).max() if matrix.size else 0.0
    if not scale or not k:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        part = vectors[at + 1 :]
        part -= 2 * np.outer(reflectors[at], reflectors[at] @ part)
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


@dataclass
class Whitening:
    """What is fitted: rows and sums of the fit list, eigenvalues, eigenvectors (columns), trace and identity error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """rows - sums / n, the integer part of the mean taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (rows - whole) - rest

    def of(self, rows: np.ndarray) -> np.ndarray:
        return (self.centred(rows) @ self.vectors) / np.sqrt(self.values)

    def deviation(self, rows: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - sum)**2, exact; null beyond 38 digits."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(rows).max(initial=0))
        if most * most * max(1, len(self.sums)) < 1 << 62:
            apart = rows * self.n - np.array(self.sums, np.int64)
            return pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
        told = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums)) for row in rows.tolist()]
        return pa.array([Decimal(t) if t < 10**38 else None for t in told], pa.decimal128(38, 0))


def steps_of(histograms: DataFrame) -> DataFrame:
    """Rows whose histogram is whole: shot_id, and its entries as integers, floor(STEPS * entry)."""
    value = F.col("hist").cast("array<double>")
    usable = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * STEPS) < MOST_STEP))
    rows = histograms.select("shot_id", value.alias("_v")).where(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.coalesce(usable, F.lit(False)))
    rows = rows.select("shot_id", F.transform("_v", lambda x: F.floor(x * STEPS).cast("long")).alias("steps"))
    return rows


def _commonest_width(rows: DataFrame) -> int:
    """Most frequent length, the larger of equally frequent ones; zero without rows."""
    best = rows.groupBy(F.size("steps").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return best["w"] if best else 0


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(batch.schema.get_field_index("steps")).flatten().to_numpy().reshape(-1, width)


def _summed(fit: DataFrame, rows: int, columns: int, part_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the fit list of a small matrix per block of rows: one per task, added up by Spark."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for _, block in _blocks(batches, width):
            total += part_of(block)
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    out = np.zeros(rows * columns)
    # One number per entry of the matrix, whatever the rows.
    told = fit.select("steps").mapInArrow(step, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out[told["at"].to_numpy()] = told["value"].to_numpy()
    return out.reshape(rows, columns)


def fit_whitening(histograms: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening fitted on the distinct vectors of `steps_of(histograms)`; none for an empty table."""
    rows = steps_of(histograms).select("steps")
    width = _commonest_width(rows)
    return _fit(rows, width, components) if width else None


def _fit(rows: DataFrame, width: int, components: int) -> Whitening:
    fit = materialise(rows.where(F.size("steps") == width).distinct(), "fit-list")
    # Exact sums: many entries of 53 bits overflow a long, so each goes in two parts.
    parts = fit.select(F.posexplode("steps").alias("at", "x")).groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("x", 20)).alias("high"), F.sum(F.col("x").bitwiseAND((1 << 20) - 1)).alias("low")
    )
    told = sorted(parts.collect(), key=lambda r: r["at"])  # one row per dimension
    sums = [(r["high"] << 20) + r["low"] for r in told]
    model = Whitening(told[0]["n"], sums, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0)
    wanted, values = min(components, width), []
    while len(values) < wanted:
        found = model.vectors

        def spread(block: np.ndarray) -> np.ndarray:
            apart = model.centred(block)
            apart -= (apart @ found) @ found.T
            return apart.T @ apart

        covariance = _summed(fit, width, width, spread, width) / model.n
        if not values:
            model.trace = float(np.trace(covariance))
        some, vectors = leading_pairs((covariance + covariance.T) / 2, wanted - len(values))
        # Values far below the leading one are lost in its rounding: they are measured again without it.
        sound = (some > model.trace * ZERO) & (some >= some[0] * NEXT_ROUND)
        if not sound.any():
            break
        vectors = vectors[:, sound] - found @ (found.T @ vectors[:, sound])
        values += some[sound].tolist()
        model.vectors = np.concatenate([found, vectors / np.linalg.norm(vectors, axis=0)], axis=1)
    model.values = np.array(values)
    k = len(values)
    if k:

        def products(block: np.ndarray) -> np.ndarray:
            white = model.of(block)
            return white.T @ white

        model.identity_error = float(np.abs(_summed(fit, k, k, products, width) / model.n - np.eye(k)).max())
    return model


def whiten_histograms(histograms: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Leading whitened components of every frame histogram.

    histograms: shot_id (any type), hist (array of numbers); other columns are ignored. Entries become integers,
    floor(256 * entry). Null vectors, empty ones, and those with null, non-finite or huge entries (2**45 and more) take
    no part, nor do those of another length than the commonest one (the longer of two equally common). Each distinct
    vector counts once in the fit, however many shots share it; every row is whitened, repeated and null ids included.

    The centred covariance is summed in the tasks that hold the vectors; only matrices as wide as a vector reach the
    driver, which reduces them to tridiagonal form, brackets the leading eigenvalues by Sturm counts and finds their vectors
    by inverse iteration. Values below a millionth of the largest are measured again in a pass that leaves the found
    directions out, so that their precision does not hang on the largest.

    Returns shot_id, component (from 1, falling variance), n (vectors of the fit), deviation (decimal, exact sum over
    dimensions of (n * x - sum)**2, null beyond 38 digits), whitened, explained (part of the total variance) and
    identity_error (largest entry of the whitened fit's covariance minus the identity). A direction without variance
    has no component: one vector, or only equal ones, give no rows, as does an empty table.
    """
    schema = f"shot_id {histograms.schema['shot_id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = steps_of(histograms)
    width = _commonest_width(rows.select("steps"))
    model = _fit(rows.select("steps"), width, components) if width else None
    if model is None or not len(model.values):
        return histograms.sparkSession.createDataFrame([], schema)
    told = histograms.sparkSession.sparkContext.broadcast(model)  # as wide as a vector

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = told.value
        k = len(fitted.values)
        for batch, block in _blocks(batches, width):
            m = len(block)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch(
                [
                    batch.column(batch.schema.get_field_index("shot_id")).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fitted.n)), fitted.deviation(block).take(each), pa.array(fitted.of(block).ravel()),
                    pa.array(np.tile(fitted.values / fitted.trace, m)), pa.array(np.full(m * k, fitted.identity_error)),
                ],
                ["shot_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("steps") == width).mapInArrow(step, schema)
