"""Whitening of embeddings: eigenvectors of their covariance, refined from float32 to double precision.

Entries become whole numbers, so sums, deviations and the covariance are exact: tasks add up products of what is left after the
rounded mean is taken away, in doubles while these hold every whole number, and the driver, which gets one number per pair of
dimensions, corrects for the rounding. Eigenvectors in float32 are a first guess. Each step of the refinement (Ogita and Aishima) takes four matrix
products in higher precision and doubles the digits; eigenvectors whose eigenvalues lie too close together for it are turned
within their own subspace by an eigenproblem of their own, shifted so that their differences keep their digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCALE, SHIFT = 64, 1_000_000
FAR = float(1 << 50)  # entries beyond it, once scaled, count as it
EXACT = 1 << 53


@dataclass(frozen=True)
class Whitening:
    """What the fit found for vectors of one length: number and sums of vectors, unit eigenvectors (columns), eigenvalues, the
    trace, and how far the covariance of the whitened vectors is from the identity (null before it is measured)."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    def live(self) -> np.ndarray:
        """Components whose eigenvalue is not zero to double precision."""
        return self.values > (self.values.max(initial=0) * len(self.values) * np.finfo(float).eps)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the difference is taken in whole numbers around the rounded mean."""
        mean = [round_div(s, self.n) for s in self.sums]
        left = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, mean, strict=True)])
        return (x - np.array(mean, np.int64)).astype(np.float64) - left

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scaled = self.directions[:, self.live()] / np.sqrt(self.values[self.live()])
        return self.centred(x) @ scaled


def round_div(a: int, b: int) -> int:
    """a / b to the nearest whole number, halves upwards."""
    return (2 * a + b) // (2 * b)


def whole_numbers(batch: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, whole numbers as int64 matrix) of the vectors of a batch that are not null and hold finite entries only."""
    sizes = pc.fill_null(pc.list_value_length(batch), -1).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        entries = batch.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        good = np.isfinite(entries).all(axis=1)
        with np.errstate(over="ignore"):
            yield size, rows[good], np.clip(np.floor(SCALE * entries[good]), -FAR, FAR).astype(np.int64) + SHIFT


def products(y: np.ndarray) -> list[list[int]]:
    """y'y in whole numbers: by doubles over as many rows as keep every sum below 2 ** 53, else number by number."""
    size = y.shape[1]
    most = int(np.abs(y).max(initial=0))
    rows = EXACT // most**2 if most else len(y)
    if rows < 1:
        big = y.astype(object)
        return (big.T @ big).tolist()
    total = np.zeros((size, size), object)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total.tolist()


def exact_ratio(num: int, den: int) -> tuple[float, float]:
    """The nearest double of num / den and what it lacks."""
    high = num / den
    p, q = high.as_integer_ratio()
    return high, (num * q - p * den) / (den * q)


def refined(matrix: np.ndarray, rounds: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix in long double (or as precise as the machine has it)."""
    size = len(matrix)
    scale = np.abs(matrix).max(initial=0)
    if not scale:
        return np.zeros(size), np.eye(size)
    a = matrix / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    before, kind = np.inf, np.float64
    eye = np.eye(size)
    for _ in range(rounds):
        x, b = x.astype(kind), a.astype(kind)
        r = eye - x.T @ x
        s = x.T @ b @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        near = 2 * (np.linalg.norm(off.astype(np.float64), 2) + np.linalg.norm(r.astype(np.float64), 2))
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > near
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ step
        for group in clusters(values, near):
            x[:, group] = turned(b, x[:, group], values[group].mean())
        size_of_step = float(np.abs(step).max())
        if size_of_step < 4 * np.finfo(kind).eps or size_of_step >= before / 2:
            if kind is np.longdouble:
                break
            kind, size_of_step = np.longdouble, np.inf
        before = size_of_step
    for _ in range(2):
        x = x + x @ (eye - x.T @ x) / 2
    values = ((x * (a.astype(x.dtype) @ x)).sum(axis=0) * scale).astype(np.float64)
    order = np.argsort(-values, kind="stable")
    x = x[:, order].astype(np.float64)
    return values[order], x * np.where(x[np.abs(x).argmax(axis=0), np.arange(size)] < 0, -1, 1)


def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Groups of two or more eigenvalues that a chain of gaps of at most `near` joins."""
    order = np.argsort(values, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(values[order]) > near) + 1)
    return [p for p in parts if len(p) > 1]


def turned(a: np.ndarray, x: np.ndarray, centre: float) -> np.ndarray:
    """x, which spans the subspace of a cluster, turned to its eigenvectors: those of x'(a - centre)x, which is small, so that doubles
    tell its eigenvalues apart."""
    inner = x.T @ (a @ x - centre * x)
    # x need not be orthonormal to the last digit: solve for the pair (inner, x'x), reduced by the inverse square root of x'x
    r = np.eye(x.shape[1]) - x.T @ x
    inner = inner + (r @ inner + inner @ r) / 2
    size = np.abs(inner).max()
    if not size:
        return x
    turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float64))[1].astype(x.dtype)
    return x @ turn


def fit(vectors: DataFrame, embedding: str = "embedding", components: int = 32) -> dict[int, Whitening]:
    """For each length of vectors, the whitening fitted on all of them. Three passes: sums, covariance, and the covariance of what is whitened.

    Vectors that are null or hold null or non-finite entries play no part, nor do empty ones; vectors of other lengths are fitted by
    themselves. The driver gets one number per pair of dimensions and length. Other columns play no part; an empty table gives no whitening.
    """
    rows = vectors.select(F.col(embedding).cast("array<double>").alias("v"))

    def sums(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for size, _, x in whole_numbers(batch.column(0)):
                held = total.setdefault(size, [0, np.zeros(size, object)])
                held[0] += len(x)
                fits = len(x) * int(np.abs(x).max(initial=0)) < 1 << 63
                held[1] = held[1] + (x if fits else x.astype(object)).sum(axis=0)
        for size, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict({"size": pa.array([size] * size, pa.int32()), "i": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "s": pa.array([int(v) for v in s], pa.decimal128(38))})

    found: dict[int, list] = {}
    for r in rows.mapInArrow(sums, "size int, i int, n long, s decimal(38,0)").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        n, s = found.setdefault(r.size, [0, [0] * r.size])
        s[r.i] = int(r.s)
        found[r.size][0] = r.n
    means = {size: np.array([round_div(v, n) for v in s], np.int64) for size, (n, s) in found.items() if n}

    def squares(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in whole_numbers(batch.column(0)):
                if len(x):
                    total[size] = total.get(size, 0) + np.array(products(x - means[size]), object)
        for size, g in total.items():
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_pydict({"size": pa.array([size] * len(i), pa.int32()), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "g": pa.array(g[i, j].tolist(), pa.decimal128(38))})

    def gathered(task, kind: str) -> dict[int, dict]:
        out: dict[int, dict] = {}
        for r in rows.mapInArrow(task, f"size int, i int, j int, g {kind}").groupBy("size", "i", "j").agg(F.sum("g").alias("g")).toLocalIterator():
            out.setdefault(r.size, {})[r.i, r.j] = r.g
        return out

    fitted = {}
    for size, entries in gathered(squares, "decimal(38,0)").items():
        n, s = found[size]
        left = [v - n * int(m) for v, m in zip(s, means[size], strict=True)]
        v = np.zeros((size, size), np.longdouble)
        trace = 0
        for (i, j), g in entries.items():
            num = n * int(g) - left[i] * left[j]
            high, low = exact_ratio(num, n * n)
            v[i, j] = v[j, i] = np.longdouble(high) + np.longdouble(low)
            trace += num if i == j else 0
        values, directions = refined(v)
        fitted[size] = Whitening(n, tuple(s), directions[:, :components], np.maximum(values[:components], 0), trace / (n * n))

    def checked(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in whole_numbers(batch.column(0)):
                z = fitted[size].whitened(x) if len(x) else np.zeros((0, 0))
                if z.size:
                    total[size] = total.get(size, 0) + z.T @ z
        for size, g in total.items():
            i, j = np.triu_indices(len(g))
            # in units of 2 ** -60, so that the sum does not hang on the order of tasks
            g = g[i, j] * (1 << 60)
            yield pa.RecordBatch.from_pydict({"size": pa.array([size] * len(i), pa.int32()), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "g": pa.array([int(v) for v in g], pa.decimal128(38))})

    for size, entries in gathered(checked, "decimal(38,0)").items():
        w = fitted[size]
        error = max(abs(int(g) / (w.n << 60) - (i == j)) for (i, j), g in entries.items())
        fitted[size] = Whitening(w.n, w.sums, w.directions, w.values, w.trace, error)
    return fitted


def whiten(vectors: DataFrame, fitted: dict[int, Whitening], embedding: str = "embedding") -> DataFrame:
    """The rows whose vectors are not null or empty and hold finite entries only, all their columns and (replaced where they exist) whitened array<double>
    (one entry per component, null where its eigenvalue is zero to double precision), n long, deviation decimal(38,0) (sum over dimensions of the
    squares of n * x - sum, exact; null if it has more digits), shares array<double> (eigenvalues over the trace; null where that is zero) and
    identity_error double (null where no component has an eigenvalue).

    x is floor(64 * entry) + 1000000; entries beyond 2 ** 44 count as that. Repeated rows stay; vectors of a length that the fit didn't see go.
    """
    added = ("whitened", "n", "deviation", "shares", "identity_error")
    own = [c for c in vectors.columns if c not in added]
    rows = vectors.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    limit = 10**38

    def apply(batches):
        for batch in batches:
            for size, at, x in whole_numbers(batch.column(1)):
                if not len(at) or size not in fitted:
                    continue
                w = fitted[size]
                live = w.live()
                z = np.full((len(x), len(live)), np.nan)
                z[:, live] = w.whitened(x)
                mean = [round_div(s, w.n) for s in w.sums]
                rest = [s - w.n * m for s, m in zip(w.sums, mean, strict=True)]
                y = x - np.array(mean, np.int64)
                if size * (w.n * (int(np.abs(y).max()) + 1)) ** 2 < 1 << 63:
                    deviation = ((w.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [sum((w.n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in y.tolist()]
                flat = pa.array(z.ravel(), from_pandas=True)
                parts = len(live)
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, parts * len(x) + 1, parts, dtype=np.int32)), flat)
                shares = [float(v) / w.trace if w.trace else None for v in w.values]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), whitened, pa.array([w.n] * len(x), pa.int64()), pa.array([d if d < limit else None for d in deviation], pa.decimal128(38)),
                     pa.array([shares] * len(x), pa.list_(pa.float64())), pa.array([w.identity_error] * len(x), pa.float64())], ["own", *added])

    schema = StructType([rows.schema["own"], *StructType.fromDDL("whitened array<double>, n long, deviation decimal(38,0), shares array<double>, identity_error double").fields])
    done = rows.mapInArrow(apply, schema)
    return done.select(*(F.col(f"own.`{c}`").alias(c) for c in own), *added)
