"""Embedding whitening by spectrum slicing.

Entries become whole numbers, so sums, means and deviations are exact. The
covariance is summed in tasks from centred rows; the driver sees that matrix, whose
size depends on the width of the vectors only, and slices its spectrum: the inertia
of an LDL^T factorisation of the shifted covariance counts the eigenvalues above
the shift, bisection on those counts isolates each leading eigenvalue, Rayleigh
quotient iteration converges to it cubically, and the counts on both sides of the
result certify its number. Eigenvalues that no shift in double precision tells
apart are taken together as one invariant subspace.

Vectors are read once for each of: widths, sums, covariance, the check of the
whitened covariance, and the result. No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
# Below this share of the largest eigenvalue a direction counts as without variance.
RANK = 1e-12
# Eigenvalues closer than this share of the norm are one cluster.
CLUSTER = 1e-10
_EPS = np.finfo(float).eps


# --- the spectrum of one symmetric matrix ---


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above the shift, by the inertia of an LDL^T factorisation.

    Symmetric pivoting after Bunch and Kaufman: a pivot is one entry or a two by two
    block, which has one eigenvalue of each sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    size, at, above = len(a), 0, 0
    growth = (1 + 17**0.5) / 8
    while at < size:
        below = np.abs(a[at + 1 :, at])
        largest = below.max(initial=0.0)
        own = abs(a[at, at])
        block = False
        if largest == 0 or own >= growth * largest:
            swap = at
        else:
            swap = at + 1 + int(below.argmax())
            row = np.abs(a[swap, at:])
            row[swap - at] = 0
            across = row.max()
            if own * across >= growth * largest**2:
                swap = at
            elif abs(a[swap, swap]) < growth * across:
                block = True
        target = at + 1 if block else at
        if swap != target:
            a[[target, swap]] = a[[swap, target]]
            a[:, [target, swap]] = a[:, [swap, target]]
        after = at + 2 if block else at + 1
        columns = a[after:, at:after]
        if block:
            above += 1
            a[after:, after:] -= columns @ np.linalg.solve(a[at:after, at:after], columns.T)
        elif a[at, at] != 0:
            above += int(a[at, at] > 0)
            a[after:, after:] -= np.outer(columns[:, 0], columns[:, 0] / a[at, at])
        at = after
    return above


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray, norm: float) -> np.ndarray:
    """(matrix - shift)^-1 right, of length 1; a shift on an eigenvalue is moved a little."""
    for _ in range(8):
        try:
            found = np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            found = np.array(np.inf)
        if np.isfinite(found).all():
            return found / np.linalg.norm(found, axis=0)
        shift += 4 * _EPS * norm
    raise ArithmeticError("no shift near the eigenvalue can be solved")


def _rayleigh(matrix: np.ndarray, low: float, high: float, norm: float) -> np.ndarray | None:
    """The eigenvector whose eigenvalue is in (low, high]; None if another one was found."""
    start = np.random.default_rng(len(matrix)).standard_normal(len(matrix))
    vector = _solved(matrix, (low + high) / 2, start, norm)
    best, least = vector, np.inf
    for _ in range(12):
        value = vector @ matrix @ vector
        residual = np.linalg.norm(matrix @ vector - value * vector)
        if residual >= least and residual < 1e-12 * norm:
            break
        if residual < least:
            best, least = vector, residual
        if residual <= _EPS * norm:
            break
        vector = _solved(matrix, value, vector, norm)
    value = best @ matrix @ best
    return best if low < value <= high and least < 1e-11 * norm else None


def _subspace(matrix: np.ndarray, shift: float, width: int, norm: float) -> np.ndarray:
    """Orthonormal eigenvectors of the `width` eigenvalues nearest to the shift."""
    found = np.random.default_rng(width).standard_normal((len(matrix), width))
    for _ in range(6):
        found, _ = np.linalg.qr(_solved(matrix, shift, found, norm))
    _, turn = np.linalg.eigh(found.T @ matrix @ found)
    return found @ turn[:, ::-1]


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns.

    Fewer than `count` where the matrix is smaller or has less rank. The largest
    entry of each vector is positive.
    """
    norm = np.abs(matrix).sum(axis=1).max(initial=0.0)
    if norm == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = eigenvalues_above(matrix, shift)
        return counts[shift]

    floor, top = RANK * norm, norm * (1 + 4 * _EPS)
    wanted = min(count, above(floor))
    vectors: list[np.ndarray] = []
    waiting = [(floor, top)]
    while waiting:
        low, high = waiting.pop()
        first, last = above(high) + 1, above(low)
        if last < first or first > wanted:
            continue
        if last == first and high - low < 0.1 * high:
            vector = _rayleigh(matrix, low, high, norm)
            if vector is not None:
                vectors.append(vector)
                continue
        if high - low <= CLUSTER * norm:
            vectors.extend(_subspace(matrix, (low + high) / 2, last - first + 1, norm).T)
            continue
        middle = (low + high) / 2
        # The upper half is taken first, so vectors come in falling order.
        waiting += [(low, middle), (middle, high)]
    basis = np.linalg.qr(np.array(vectors).T)[0][:, :wanted]
    values = np.einsum("ij,ij->j", basis, matrix @ basis)
    room = 16 * len(matrix) * _EPS * norm + CLUSTER * norm
    for number, value in enumerate(values, start=1):
        if above(value + room) >= number or above(value - room) < number:
            raise ArithmeticError(f"eigenvalue {number} is not certified")
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(wanted)])
    return values, basis * signs


# --- the vectors ---


@dataclass
class Fit:
    """What whitening needs to know of all vectors."""

    width: int
    n: int
    sums: np.ndarray  # whole numbers, as Python integers
    largest: int  # largest entry of any x, without sign
    trace: float = 0.0
    values: np.ndarray | None = None
    axes: np.ndarray | None = None


def complete(vector: Column) -> Column:
    """Is an array of finite numbers."""
    return F.coalesce(
        F.forall(
            vector,
            lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)),
        ),
        F.lit(False),
    )


def _whole(column: pa.ListArray, width: int) -> np.ndarray:
    """Entries as whole numbers; Python integers where 64 bits don't hold them."""
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    floors = np.floor(SCALE * entries)
    if np.abs(floors).max(initial=0.0) < 2.0**62:
        return floors.astype(np.int64) + OFFSET
    # A product that leaves the doubles is taken exactly.
    exact = [(int(c * SCALE) if np.isfinite(c * SCALE) else int(c) * SCALE) for c in floors.ravel() / SCALE]
    return np.array(exact, object).reshape(-1, width) + OFFSET


def _differences(whole: np.ndarray, fit: Fit) -> np.ndarray:
    """n * x - S, exact."""
    if fit.largest * fit.n < 2**61 and whole.dtype != object:
        return fit.n * whole - fit.sums.astype(np.int64)
    return fit.n * whole.astype(object) - fit.sums


def _centred(whole: np.ndarray, fit: Fit) -> np.ndarray:
    return (_differences(whole, fit) / fit.n).astype(float)


def _deviation(whole: np.ndarray, fit: Fit) -> pa.Array:
    """Sums of squared differences; NULL beyond 38 digits."""
    differences = _differences(whole, fit)
    if differences.dtype != object:
        most = int(np.abs(differences).max(initial=0))
        if fit.width * most**2 < 2**63:
            return pa.array((differences**2).sum(axis=1)).cast(pa.decimal128(38, 0))
    sums = (differences.astype(object) ** 2).sum(axis=1)
    return pa.array([Decimal(int(s)) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def _sums(rows: DataFrame, vector: str) -> Fit | None:
    """Width, number and exact sums of the vectors of the most frequent width (of equals the larger)."""
    widths = rows.groupBy(F.size(vector).alias("width")).count()
    first = widths.filter("width > 0").orderBy(F.desc("count"), F.desc("width")).head()
    if first is None:
        return None
    width = first["width"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, largest = np.zeros(width, object), np.zeros(width, object)
        for batch in batches:
            if batch.num_rows:
                whole = _whole(batch.column(0), width)
                # A batch of 64-bit numbers below 2^62 may leave 64 bits when summed.
                small = whole.dtype != object and int(np.abs(whole).max()) * len(whole) < 2**62
                sums = sums + (whole if small else whole.astype(object)).sum(axis=0).astype(object)
                largest = np.maximum(largest, np.abs(whole).max(axis=0).astype(object))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(width)),
                pa.array([str(s) for s in sums], pa.string()),
                pa.array([str(s) for s in largest], pa.string()),
            ],
            names=["at", "total", "largest"],
        )

    same = rows.filter(F.size(vector) == width).select(vector)
    parts = same.mapInArrow(partial, "at long, total string, largest string")
    if_small = [F.expr(f"try_cast({c} AS DECIMAL(38, 0))").alias(c) for c in ("total", "largest")]
    found = (
        parts.select("at", *if_small)
        .groupBy("at")
        .agg(F.sum("total").alias("total"), F.max("largest").alias("largest"))
        .collect()
    )
    sums = np.zeros(width, object)
    for row in found:
        sums[row["at"]] = int(row["total"])
    return Fit(width, first["count"], sums, max(int(row["largest"]) for row in found))


def _covariance(same: DataFrame, fit: Fit) -> np.ndarray:
    """Covariance with divisor n; rows of the matrix are summed by key, not on the driver."""
    width = fit.width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                rows = _centred(_whole(batch.column(0), width), fit)
                total += rows.T @ rows
        yield _matrix_rows(np.arange(width), total / fit.n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for at, row in zip(batch.column(0).to_pylist(), rows):
                found[at] = found[at] + row if at in found else row
        if found:
            yield _matrix_rows(np.array(list(found)), np.array(list(found.values())))

    schema = "at long, row array<double>"
    merged = same.mapInArrow(partial, schema).repartition("at").mapInArrow(merge, schema)
    matrix = np.zeros((width, width))
    for row in merged.collect():
        matrix[row["at"]] = row["row"]
    return (matrix + matrix.T) / 2


def _matrix_rows(at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))],
        names=["at", "row"],
    )


def _moments_joined(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred products of two sets of rows together."""
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    mean = a[1] + apart * (b[0] / n)
    return n, mean, a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _identity_error(same: DataFrame, fit: Fit) -> float:
    """Largest entry of the whitened covariance minus the identity, without sign."""
    k = len(fit.values)
    schema = "n long, mean array<double>, products array<double>"

    def packed(found: tuple) -> pa.RecordBatch:
        n, mean, products = found
        lists = [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (mean, products)]
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *lists], names=["n", "mean", "products"])

    def unpacked(rows) -> Iterator[tuple]:
        for n, mean, products in rows:
            yield n, np.array(mean), np.array(products).reshape(k, k)

    def joined(parts: Iterator[tuple]) -> tuple:
        total = (0, np.zeros(k), np.zeros((k, k)))
        for part in parts:
            total = _moments_joined(total, part)
        return total

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                if batch.num_rows:
                    rows = _whitened(_whole(batch.column(0), fit.width), fit)
                    mean = rows.mean(axis=0)
                    yield len(rows), mean, (rows - mean).T @ (rows - mean)

        yield packed(joined(parts()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield packed(joined(unpacked(rows)))

    parts = same.mapInArrow(partial, schema).repartition(32).mapInArrow(merge, schema)
    n, _, products = joined(unpacked(parts.collect()))
    return float(np.abs(products / n - np.eye(k)).max())


def _whitened(whole: np.ndarray, fit: Fit) -> np.ndarray:
    return _centred(whole, fit) @ fit.axes / np.sqrt(fit.values)


RESULT = (
    "component int, n long, deviation decimal(38,0), whitened double, "
    "explained double, identity_error double"
)


def whiten(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Each vector on the leading principal axes, scaled to unit variance.

    One row per vector and component: the id, component (from 1 by falling
    variance), n, deviation (exact sum of squares of n*x - S; NULL beyond 38 digits),
    whitened, explained, identity_error.

    Vectors that are NULL or hold NULL, NaN or infinite entries are left out, as are
    empty ones and those of another width than the most frequent (of equally frequent
    ones the larger). There are no more components than the covariance has rank:
    one vector, or equal vectors only, give no rows, as an empty table does. Repeated
    rows and ids, and NULL ids, are vectors of their own. Other columns are not
    carried. Runs the fit when called.
    """
    entries = F.col(f"`{vector}`")
    rows = vectors.filter(complete(entries)).select(
        F.col(f"`{id}`").alias("__id"), entries.cast("array<double>").alias("__vector")
    )
    id_type = rows.schema["__id"].dataType.simpleString()
    schema = f"`{id}` {id_type}, {RESULT}"
    spark = vectors.sparkSession
    fit = _sums(rows, "__vector")
    if fit is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("__vector") == fit.width)
    same = rows.select("__vector")
    covariance = _covariance(same, fit)
    fit.trace = float(np.trace(covariance))
    fit.values, fit.axes = leading_eigenpairs(covariance, components)
    found = len(fit.values)
    if not found:
        return spark.createDataFrame([], schema)
    error = _identity_error(same, fit)
    explained = fit.values / fit.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Eight rows come of one: small steps keep the results small.
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                whole = _whole(part.column(1), fit.width)
                n = len(whole)
                each = pa.array(np.repeat(np.arange(n), found))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each),
                        pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * found, fit.n)),
                        _deviation(whole, fit).take(each),
                        pa.array(_whitened(whole, fit).ravel()),
                        pa.array(np.tile(explained, n)),
                        pa.array(np.full(n * found, error)),
                    ],
                    names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, schema)
