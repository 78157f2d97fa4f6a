"""Whitening of embeddings by contour integration (FEAST).

Vectors become integers, floor(256 * x) per component, and the fit list holds each of them once. Sums are exact; the covariance is
that of the centred vectors, summed per task and again in ``SUMS`` groups, so only that many matrices of the vectors' width reach the
driver, never rows. There the leading components are taken out of that one matrix:

1. The matrix is brought to tridiagonal form; the signs of the pivots of its shifted factorisation (inertia) count the eigenvalues
   above any shift. Bisection with these counts cuts the leading part of the spectrum, in its widest gaps, into intervals that are known
   to hold so many eigenvalues each.
2. Per interval a circle through its ends is integrated by Gauss quadrature: at each node the complex shifted matrix is solved against a
   block of vectors, and the weighted sum of the solutions projects them onto the interval's eigenvectors.
3. Rayleigh-Ritz in that subspace gives the eigenpairs; the step is repeated until their residuals are at rounding level and as many lie
   within the interval as the inertia counts tell. If some are missed the block is widened.

Rows are whitened in one narrow pass: deviation from the mean, projected on each component, over the root of its eigenvalue.

Edge cases. A vector that is null, or holds a null or non-finite component, takes no part; missing components of shorter vectors count
as 0. A component that leaves 64 bits counts as the nearest value within. A row without vec_id is returned with null; rows that share one are
rows of their own, and count once in the fit list if their vectors are equal. Components whose eigenvalue is rounding noise against the
trace are left out, as they cannot be whitened: vectors that are all equal, one vector, or an empty table give an empty result. A
deviation beyond 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.shared import stored

SCALE = 256
#: Partial sums that reach the driver, quadrature nodes on a half circle, and eigenvalues of one interval at most where gaps allow.
SUMS, NODES, PER_INTERVAL = 32, 8, 8
#: Repetitions of projection and Rayleigh-Ritz before a block is widened.
ROUNDS = 30


def _scaled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = np.array([np.nan if v is None else v for v in vector.as_py()], np.float64) if vector.is_valid and vector.values.null_count else None
            if vector.is_valid and values is None:
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if values is None or not np.isfinite(values).all():
                continue
            with np.errstate(over="ignore"):
                whole = np.floor(SCALE * values)
            top = np.abs(whole) >= 2.0**63
            fit = np.where(top, 0, whole).astype(np.int64)
            fit[top] = np.where(whole[top] > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
            ids.append(vec_id)
            out.append(fit)
        offsets = np.concatenate(([0], np.cumsum([len(v) for v in out]))).astype(np.int32)
        flat = np.concatenate(out) if out else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))], ["vec_id", "x"])


def scaled(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vec_id and the integer vector x of every row that takes part, all of one width, stored."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = stored(rows.mapInArrow(_scaled, "vec_id long, x array<long>"), "scaled")
    low, width = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low == width:
        return rows
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width as the rows of a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sum_up(rows: DataFrame, part, start) -> list:
    """Numbers summed over all rows: ``part`` gives a batch's share as a list of Python integers or floats, added per task, then in
    ``SUMS`` groups, then here."""

    def add(a: list | None, b: list) -> list:
        return b if a is None else [x + y for x, y in zip(a, b, strict=True)]

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = add(total, part(batch))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[repr(v) for v in total]], pa.list_(pa.string()))], ["total"])

    def together(table: pa.Table) -> pa.Table:
        total = None
        for values in table.column("total").to_pylist():
            total = add(total, [type(start)(v) for v in values])
        return pa.table([pa.array([[repr(v) for v in total]], pa.list_(pa.string()))], ["total"])

    sums = rows.mapInArrow(partial, "total array<string>")
    sums = sums.withColumn("share", F.pmod(F.monotonically_increasing_id() / F.lit(1 << 33), F.lit(SUMS)).cast("int"))
    out = sums.groupBy("share").applyInArrow(together, "total array<string>").collect()
    total = None
    for row in out:
        total = add(total, [type(start)(v) for v in row["total"]])
    return total or []


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of ``fit`` (x) and the exact sum per dimension."""

    def part(batch: pa.RecordBatch) -> list[int]:
        x = _matrix(batch.column(0))
        if x.size and max(abs(int(x.min())), abs(int(x.max()))) >= 2**62 // len(x):
            return [len(x), *(sum(int(v) for v in column) for column in x.T)]
        return [len(x), *x.sum(axis=0).tolist()]

    total = _sum_up(fit.select("x"), part, 0)
    return (total[0], total[1:]) if total else (0, [])


def covariance(fit: DataFrame, column: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance of ``column`` (lists of one width), centred before multiplying, divided by n."""

    def part(batch: pa.RecordBatch) -> list[float]:
        centred = _matrix(batch.column(0)) - mean
        return (centred.T @ centred).ravel().tolist()

    return np.array(_sum_up(fit.select(column), part, 0.0)).reshape(len(mean), len(mean)) / n


def _tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder reflections)."""
    a = matrix.copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size > 0:
            v /= size
            a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def _above(diagonal: np.ndarray, beside: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: positive pivots of the factorised tridiagonal matrix less the shift (inertia)."""
    tiny = np.finfo(float).tiny * 4 / np.finfo(float).eps
    count, pivot = 0, 1.0
    for i, d in enumerate(diagonal.tolist()):
        pivot = d - shift - (beside[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def _cuts(diagonal: np.ndarray, beside: np.ndarray, k: int, top: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues within), from the top, that hold the ``k`` largest eigenvalues; cut in the widest gaps."""

    def nth(i: int) -> float:
        """The i-th largest eigenvalue, by bisection."""
        low, high = -top, top
        while high - low > 1e-9 * top:
            middle = (low + high) / 2
            low, high = (middle, high) if _above(diagonal, beside, middle) >= i else (low, middle)
        return (low + high) / 2

    n = len(diagonal)
    values: list[float] = []

    def gap(c: int) -> float:
        """How far the c-th eigenvalue lies above the next one."""
        values.extend(nth(i) for i in range(len(values) + 1, c + 2))
        return values[c - 1] - values[c]

    out, first = [], 0
    while first < k:
        # The cut follows the wanted values, or some unwanted ones after them, or as many as one interval takes; further on if they are all alike.
        least, reach = k if first + PER_INTERVAL >= k else first + 1, first + PER_INTERVAL
        while True:
            best = max(range(least, min(reach, n - 1) + 1), key=gap, default=n)
            if best == n or gap(best) > 1e-7 * top or reach >= n:
                break
            reach *= 2
        whole = best == n or gap(best) <= 1e-7 * top
        low = -0.01 * top if whole else (values[best - 1] + values[best]) / 2
        high = out[-1][0] if out else nth(1) + (0.01 * top if whole else gap(best))
        out.append((low, high, _above(diagonal, beside, low) - first))
        first += out[-1][2]
    return out


def _feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high``, falling, and their unit eigenvectors as columns."""
    n = len(matrix)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (nodes + 1)
    centre, radius = (low + high) / 2, (high - low) / 2
    width = min(n, 2 * count + 2)
    draw = np.random.default_rng(13)
    scale = np.abs(matrix).max()
    while True:
        block = draw.standard_normal((n, width))
        best = None
        for _ in range(ROUNDS):
            projected = np.zeros((n, width))
            for angle, weight in zip(angles, weights, strict=True):  # the lower half circle is the conjugate of the upper one
                turn = radius * np.exp(1j * angle)
                projected += weight / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(n) - matrix, block.astype(complex))).real
            basis = np.linalg.qr(projected)[0]
            reduced = basis.T @ matrix @ basis
            values, vectors = np.linalg.eigh((reduced + reduced.T) / 2)
            block = basis @ vectors
            inside = np.flatnonzero((values > low) & (values < high))[::-1]
            if len(inside) == count:
                pairs = values[inside], block[:, inside]
                residual = np.abs(matrix @ pairs[1] - pairs[1] * pairs[0]).max()
                if best is not None and (residual < 4 * n * np.finfo(float).eps * scale or residual > best / 2) and best < 1e-9 * scale:
                    return pairs
                best = residual
        if width == n and best is not None:
            return pairs
        width = min(n, 2 * width)


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns; fewer if the rest is rounding noise."""
    trace = float(np.trace(matrix)) if len(matrix) else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    unit = matrix / trace
    diagonal, beside = _tridiagonal(unit)
    noise = len(unit) * np.finfo(float).eps * 16
    k = min(k, _above(diagonal, beside, noise))
    parts = [_feast(unit, *cut) for cut in _cuts(diagonal, beside, k, 1.0)]
    values, vectors = np.concatenate([p[0] for p in parts]), np.hstack([p[1] for p in parts])
    return values[:k] * trace, vectors[:, :k]


def whitened(vectors: DataFrame, k: int = 4) -> DataFrame:
    """Per row of ``vectors`` that takes part and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = scaled(vectors)
    fit = stored(rows.select("x").distinct(), "fit")
    n, sums = moments(fit)
    mean = np.array([s / n for s in sums])
    matrix = covariance(fit, "x", mean, n) if n else np.zeros((0, 0))
    values, axes = components(matrix, k)
    k = len(values)
    turned = axes / np.sqrt(values)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = (_matrix(batch.column(0)) - mean) @ turned
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, k, dtype=np.int32)), pa.array(y.ravel()))], ["y"])

    spread = fit.mapInArrow(project, "y array<double>")
    totals = _sum_up(spread, lambda b: _matrix(b.column(0)).sum(axis=0).tolist(), 0.0)
    error = float(np.abs(covariance(spread, "y", np.array(totals) / n, n) - np.eye(k)).max())
    share = values / np.trace(matrix)
    largest = max((abs(s) for s in sums), default=0)

    def deviations(x: np.ndarray) -> list[int | None]:
        top = n * max(abs(int(x.min())), abs(int(x.max()))) + largest
        if top**2 * x.shape[1] < 2**63:
            return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            y = (x - mean) @ turned
            times = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.repeat(n, len(times)),
                pa.array(deviations(x), pa.int64()).take(pa.array(times)), pa.array(y.ravel()), pa.array(np.tile(share, len(x))), pa.repeat(error, len(times)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their four leading whitened components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 4)
