"""Whitening of embeddings by QDWH spectral divide and conquer (operator 11).

Every entry c of a vector becomes the integer x = floor(64 c) + 1,000,000. The covariance V of x over all remaining vectors
is exact up to one rounding: tasks centre x at the integer part of its mean, add up integer products, and the rest of the
centring is done with whole numbers on the totals. Its eigenvectors come from polar decompositions: the polar factor U of
V - shift (QR-based dynamically weighted Halley iteration) gives the projector (U + I) / 2 on the eigenvectors above the
shift; its range and complement split V into two smaller problems, until nothing is left off the diagonal. Only totals of
d * (d + 1) / 2 numbers and the d-by-32 whitening matrix are ever on the driver or broadcast, whatever the number of vectors.

Left out: null vectors, vectors with a null or non-finite entry, or with one of 2^40 or more (whose products have no exact
place here), and vectors whose length is not the most frequent one (the greater of equally frequent ones), empty ones too.
A null vec_id stays null; repeated rows each get theirs and count as often in the fit. Directions without variance have no
component: equal vectors, a single vector or an empty table give no rows. deviation is null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
_SLICE = 1000
_LIMIT = 2.0**40
_LONG = 2**63 - 1


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part, vec as doubles."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(_LIMIT)))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), fine.alias("fine"), F.size(vec).alias("width"))
    kept = kept.filter(F.col("vec").isNotNull() & F.col("fine") & (F.col("width") > 0))
    widths = kept.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    return kept.filter(F.col("width") == (widths[0]["width"] if widths else 0)).select("vec_id", "vec")


def whole_numbers(column: pa.Array) -> np.ndarray:
    """x of a batch of vectors, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat.reshape(len(column), -1))).astype(np.int64) + OFFSET


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, _SLICE):
            yield batch.slice(i, _SLICE)


def _numbered(values: dict) -> pa.RecordBatch:
    """(i, j, v) of a dict of matrices or rows of totals."""
    keys = list(values)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([Decimal(values[k]) for k in keys], pa.decimal128(38, 0))], ["i", "j", "v"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for part in _slices(batches):
        s = whole_numbers(part.column("vec")).sum(axis=0).astype(object)
        n, total = n + part.num_rows, s if total is None else total + s
    if n:
        yield _numbered({(-1, -1): n} | {(i, -1): v for i, v in enumerate(total)})


def _exact_products(x: np.ndarray) -> np.ndarray:
    """x' x of a matrix of whole numbers, without rounding."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < 2**53:
        f = x.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    if most * most * len(x) < 2**63:
        return (x.T @ x).astype(object)
    return x.astype(object).T @ x.astype(object)


def _products(centre: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in _slices(batches):
        c = _exact_products(whole_numbers(part.column("vec")) - centre)
        total = c if total is None else total + c
    if total is not None:
        yield _numbered({(i, j): total[i, j] for i in range(len(total)) for j in range(i, len(total))})


def _totals(parts: DataFrame) -> dict:
    """Totals over all tasks: one row per pair of dimensions, so bounded by the width of the vectors."""
    return {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}


def polar(a: np.ndarray, steps: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley iteration."""
    d = len(a)
    x = a / max(np.linalg.norm(a, 2), np.finfo(float).tiny)
    low = max(np.linalg.norm(x, -2), 1e-17)
    eye = np.eye(d)
    for _ in range(steps):
        low2 = low * low
        root = np.cbrt(4 * (1 - low2) / (low2 * low2))
        h = np.sqrt(1 + root) + 0.5 * np.sqrt(max(0.0, 8 - 4 * root + 8 * (2 - low2) / (low2 * np.sqrt(1 + root))))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = (b / c) * x + (h - b / c) / np.sqrt(c) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (h + b * low2) / (1 + c * low2))
        if moved < 1e-15 * d ** 0.5 or (moved < 1e-8 and 1 - low < 1e-15):
            break
    return x


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """An orthonormal basis whose first k columns span the eigenvectors above a shift, and k."""
    d = len(a)
    diagonal = np.sort(np.diag(a))
    # The middle of the spread first; then shifts that part the diagonal at its widest gaps.
    gaps = np.argsort(-np.diff(diagonal))
    for shift in [np.median(diagonal), np.trace(a) / d, *((diagonal[g] + diagonal[g + 1]) / 2 for g in gaps[:4])]:
        p = (polar(a - shift * np.eye(d)) + np.eye(d)) / 2
        k = int(np.rint(np.trace(p)))
        if 0 < k < d:
            basis, _ = np.linalg.qr(p @ rng.standard_normal((d, k)))
            basis, _ = np.linalg.qr(p @ basis)
            whole, _ = np.linalg.qr(np.hstack([basis, (np.eye(d) - p) @ rng.standard_normal((d, d - k))]))
            return whole, k
    raise ArithmeticError("no shift splits the matrix")


def eigen(v: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, of a symmetric matrix by spectral divide and conquer."""
    rng, size = np.random.default_rng(seed), max(np.linalg.norm(v), np.finfo(float).tiny)
    values, vectors = [], []

    def divide(basis: np.ndarray) -> None:
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        off = a - np.diag(np.diag(a))
        if len(a) == 1 or np.linalg.norm(off) <= 4 * np.finfo(float).eps * size:
            values.extend(np.diag(a))
            vectors.extend(basis.T)
            return
        if len(a) == 2:
            # The smallest split has a closed form: one plane rotation.
            t = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
            q, k = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]), 1
        else:
            q, k = _split(a, rng)
        divide(basis @ q[:, :k])
        divide(basis @ q[:, k:])

    divide(np.eye(len(v)))
    order = np.argsort(-np.array(values), kind="stable")
    q = np.array(vectors).T[:, order]
    return np.array(values)[order], q / np.linalg.norm(q, axis=0)


class Fit:
    """What tasks need to whiten a vector: integer centre, remainder of the mean, sums, matrix."""

    def __init__(self, n: int, sums: list[int], products: dict, most: int):
        d = len(sums)
        self.n, self.sums = n, sums
        self.centre = np.array([s // n for s in sums], np.int64)
        rest = [s - n * int(c) for s, c in zip(sums, self.centre, strict=True)]
        self.rest = np.array([r / n for r in rest])
        v = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                v[i, j] = v[j, i] = float(Fraction(n * products[i, j] - rest[i] * rest[j], n * n))
        values, q = eigen(v) if v.any() else (np.zeros(d), np.eye(d))
        # What is smaller than the rounding of the largest is no variance.
        k = min(most, int((values > 1e-12 * max(values.max(initial=0), 0)).sum()))
        self.covariance, self.values, self.vectors = v, values[:k], q[:, :k]
        self.matrix = self.vectors / np.sqrt(self.values)
        self.explained = self.values / np.trace(v) if k else self.values

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of every row, exactly."""
        n, s = self.n, np.array(self.sums, object)
        most = n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if most < 2**62:
            z = n * x - s.astype(np.int64)
            most = int(np.abs(z).max(initial=0))
            if most * most * x.shape[1] < 2**63:
                return (z * z).sum(axis=1).tolist()
        z = n * x.astype(object) - s
        return [int(v) if v <= _LONG else None for v in (z * z).sum(axis=1)]


def fit(rows: DataFrame, most: int = 32) -> Fit | None:
    """The fit over all rows of usable(), None without rows."""
    sums = _totals(rows.select("vec").mapInArrow(_sums, "i int, j int, v decimal(38,0)"))
    n = sums.pop((-1, -1), 0)
    if not n:
        return None
    s = [sums[i, -1] for i in range(len(sums))]
    centre = np.array([v // n for v in s], np.int64)
    products = _totals(rows.select("vec").mapInArrow(partial(_products, centre), "i int, j int, v decimal(38,0)"))
    return Fit(n, s, products, most)


def _moments(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, sums and centred products of a task's whitened vectors, merged slice by slice."""
    f, n, mean, m = shared.value, 0, 0.0, 0.0
    for part in _slices(batches):
        w = f.whiten(whole_numbers(part.column("vec")))
        here = w.mean(axis=0)
        delta, both = here - mean, n + len(w)
        m = m + (w - here).T @ (w - here) + np.outer(delta, delta) * (n * len(w) / both)
        mean, n = mean + delta * (len(w) / both), both
    if n:
        k = len(mean)
        rows = [(-1, -1, float(n), 0.0)] + [(i, -1, n * mean[i], mean[i]) for i in range(k)]
        # Tasks meet by plain sums: about the common origin, which is the mean up to rounding.
        rows += [(i, j, m[i, j] + n * mean[i] * mean[j], 0.0) for i in range(k) for j in range(i, k)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[r[:3] for r in rows], strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["i", "j", "v"])


def identity_error(rows: DataFrame, shared) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, as measured, minus the identity."""
    parts = rows.select("vec").mapInArrow(partial(_moments, shared), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = {(r["i"], r["j"]): r["v"] for r in parts}
    n = total[-1, -1]
    return max(abs(v / n - total[i, -1] / n * total[j, -1] / n - (i == j)) for (i, j), v in total.items() if j >= 0)


def _whitened(shared, error: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = shared.value
    k = len(f.values)
    for part in _slices(batches):
        x = whole_numbers(part.column("vec"))
        m = len(x)
        repeated = np.repeat(np.arange(m), k)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("vec_id").take(pa.array(repeated)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, f.n, np.int64)),
                pa.array(f.deviations(x), pa.int64()).take(pa.array(repeated)),
                pa.array(f.whiten(x).reshape(-1)),
                pa.array(np.tile(f.explained, m)),
                pa.array(np.full(m * k, error)),
            ],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, most: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per remaining vector and component up to `most`: see the module for what is left out."""
    spark = rows.sparkSession
    kept = usable(rows, id_col, vec_col)
    f = fit(kept, most)
    if f is None or not len(f.values):
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(f)
    return kept.mapInArrow(partial(_whitened, shared, identity_error(kept, shared)), SCHEMA)


def whitened_vectors(rows: DataFrame, most: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, whitened array<double>): one row per remaining vector, components in order."""
    spark = rows.sparkSession
    kept = usable(rows, id_col, vec_col)
    f = fit(kept, most)
    if f is None or not len(f.values):
        return spark.createDataFrame([], "vec_id long, whitened array<double>")
    shared = spark.sparkContext.broadcast(f)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            w = shared.value.whiten(whole_numbers(part.column("vec")))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "whitened"])

    return kept.mapInArrow(project, "vec_id long, whitened array<double>")
