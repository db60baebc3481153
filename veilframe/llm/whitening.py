"""Whitening of embeddings by their leading principal components, without a covariance matrix of all dimensions.

Each pass over the stored vectors multiplies the covariance with a narrow block of directions, as sums of X^T (X Q) over
centred rows; only such blocks, dimensions by a few columns, reach the driver. There the directions are orthonormalised
(QR) and the best combinations of all directions tried so far are found (Rayleigh-Ritz). The residuals of the k leading
pairs are the next block, until they are as small as rounding, which certifies the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binaries, kept, own_names

#: Directions a pass multiplies, the most that the driver keeps before it restarts from the best, and passes at most.
BLOCK, MOST, MAX_PASSES = 32, 512, 500
#: Residual of a certified pair and least eigenvalue of a component, as shares of the largest eigenvalue.
TOLERANCE, FLAT = 1e-12, 1e-11
LIMITS = np.iinfo(np.int64)


def encode(column: pa.Array, scale: int) -> tuple[np.ndarray, list[bytes], list[int]]:
    """Rows of an array<double> column without null or non-finite entries: their places, floor(scale * entry), lengths.

    A vector is a byte for the width of its entries and the entries without the zeros at their end, so equal vectors
    have equal bytes. Entries beyond 64 bits become the nearest 64-bit number.
    """
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = column.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(size, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    rows = np.flatnonzero((size >= 0) & (bad[ends] == bad[ends - np.maximum(size, 0)]))
    with np.errstate(over="ignore", invalid="ignore"):
        floors = np.floor(scale * values)
        whole = np.where(floors >= 2.0**63, LIMITS.max, np.where(floors < -(2.0**63), LIMITS.min, np.where(np.abs(floors) < 2.0**63, floors, 0).astype(np.int64)))
    out = []
    for a, b in zip((ends - size)[rows].tolist(), ends[rows].tolist(), strict=True):
        x = whole[a:b]
        narrow = not len(x) or (x.min() >= -(1 << 15) and x.max() < 1 << 15)
        out.append((b"\2" if narrow else b"\10") + x.astype("<i2" if narrow else "<i8").tobytes().rstrip(b"\0"))
    return rows, out, size[rows].tolist()


def decode(vectors: list[bytes], dims: int) -> np.ndarray:
    """(rows, dims) of what encode gave."""
    out = np.zeros((len(vectors), dims), np.int64)
    for kind in (2, 8):
        own = [i for i, v in enumerate(vectors) if v[0] == kind]
        data = b"".join(vectors[i][1:].ljust(dims * kind, b"\0") for i in own)
        out[own] = np.frombuffer(data, f"<i{kind}").reshape(len(own), dims)
    return out


class Centre:
    """The exact mean of n vectors with the sums S, and rows less the mean; the whole part goes before rounding."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        if len(x) and max(-int(x.min()), int(x.max()), int(np.abs(self.whole.astype(float)).max(initial=0))) >= 1 << 61:
            return (x.astype(object) - self.whole.astype(object)).astype(float) - self.rest
        return (x - self.whole).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None beyond 38 digits."""
        far = self.n * max([abs(int(x.min(initial=0))), int(x.max(initial=0))]) + max(map(abs, self.sums), default=0)
        if far * far * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        found = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [v if v < 10**38 else None for v in map(int, found)]


def _summed(fit: DataFrame, dims: int, parts: Callable[[np.ndarray], np.ndarray], cells: int) -> np.ndarray:
    """Sum over all vectors of parts(rows), `cells` numbers: each task adds up its own, Spark adds up the tasks'."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            total += parts(decode(batch.column(0).to_pylist(), dims))
        yield pa.record_batch([pa.array(np.arange(cells), pa.int32()), pa.array(total)], ["cell", "v"])

    out = np.zeros(cells)
    for cell, v in fit.select("x").mapInArrow(add, "cell int, v double").groupBy("cell").agg(F.sum("v")).toLocalIterator():
        out[cell] = v
    return out


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """Exact sums of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x = decode(batch.column(0).to_pylist(), dims)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low, strict=True)]
        yield pa.record_batch([pa.array(range(dims), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["dim", "s"])

    rows = fit.select("x").mapInArrow(add, "dim int, s decimal(38, 0)").groupBy("dim").agg(F.sum("s"))
    return [int(s) for _, s in sorted(rows.collect())]


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The block's directions outside the basis, orthonormal; those that rounding alone leaves are dropped."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        block, scales = np.linalg.qr(block)
        block = block[:, np.abs(np.diag(scales)) > 1e-10]
    return block


def leading_components(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, block: int = BLOCK, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the k largest, at most dims, of a matrix given as block -> matrix @ block.

    Block subspace iteration: the Ritz step works on all blocks since the last restart, so each product counts, and
    close eigenvalues need no more products than dimensions. Raises where MAX_PASSES certify no k pairs.
    """
    k = min(k, dims)
    rng = np.random.default_rng(7)
    basis, image, new = np.zeros((dims, 0)), np.zeros((dims, 0)), _orthonormal(rng.standard_normal((dims, min(dims, max(block, k)))), np.zeros((dims, 0)))
    for _ in range(MAX_PASSES):
        basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])
        inner = basis.T @ image
        values, mix = np.linalg.eigh((inner + inner.T) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        found, moved = basis @ mix, image @ mix
        residual = moved - found * values
        top = max(values[0], 0.0)
        if np.linalg.norm(residual[:, :k], axis=0).max() <= TOLERANCE * top or basis.shape[1] == dims or not top:
            return values[:k], found[:, :k] / np.linalg.norm(found[:, :k], axis=0)
        wide = min(block, dims - basis.shape[1])
        if basis.shape[1] + block > max(most, 3 * block):
            basis, image = found[:, : 2 * block], moved[:, : 2 * block]
        new = _orthonormal(residual[:, :wide], basis)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((dims, wide)), basis)
    raise RuntimeError(f"{MAX_PASSES} passes don't certify {k} components")


@own_names
def whiten(vectors: DataFrame, k: int = 4, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row per kept row and component.

    Rows whose `embedding` is null or holds a null or non-finite entry are left out. Entries become x = floor(scale *
    entry); shorter vectors count as having zeros at their end. Components are fitted to the distinct vectors, n of them,
    each once: eigenvectors of their covariance (divisor n) by falling eigenvalue, their largest entry positive. Fewer
    than k come where the covariance has fewer directions above rounding: none for one distinct vector or an empty table,
    which give no rows. deviation is the sum of (n x - S)^2, decimal(38, 0), null beyond that. A null or repeated vec_id
    is a row like any other, other columns are ignored.

    The distinct vectors are found in one shuffle, after each task has left out its own repeats, and stored; each pass
    reads them without a shuffle of rows. The result is a map over the vectors as they came.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found, sizes = encode(batch.column(0), scale)
            yield pa.record_batch([binaries(found), pa.array(sizes, pa.int32())], ["x", "dims"])

    fit = kept(rows.select("embedding").mapInArrow(whole, "x binary, dims int").groupBy("x").agg(F.max("dims").alias("dims")))
    n, dims = fit.agg(F.count(F.lit(1)), F.max("dims")).first()
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double"
    if not n or not dims:
        return spark.createDataFrame([], schema)
    centre = Centre(n, _sums(fit, dims))

    def times(block: np.ndarray) -> np.ndarray:
        def parts(x: np.ndarray) -> np.ndarray:
            z = centre.rows(x)
            return (z.T @ (z @ block)).ravel()

        return _summed(fit, dims, parts, block.size).reshape(block.shape) / n

    trace = _summed(fit, dims, lambda x: (centre.rows(x) ** 2).sum(axis=0), dims).sum() / n
    values, directions = leading_components(times, dims, k, block) if trace > 0 else (np.zeros(0), np.zeros((dims, 0)))
    real = values > FLAT * values.max(initial=0.0)
    values, directions = values[real], directions[:, real]
    k = len(values)
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0) if k else directions
    onto = directions / np.sqrt(values)

    def covariance(x: np.ndarray) -> np.ndarray:
        w = centre.rows(x) @ onto
        return (w.T @ w).ravel()

    error = float(np.abs(_summed(fit, dims, covariance, k * k).reshape(k, k) / n - np.eye(k)).max(initial=0.0))
    explained = values / trace if trace > 0 else values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found, _ = encode(batch.column(1), scale)
            x = decode(found, dims)
            each = np.repeat(np.arange(len(own)), k)
            ids, far = batch.column(0).take(pa.array(own)), pa.array(centre.deviations(x), pa.decimal128(38, 0))
            m = len(each)
            yield pa.record_batch(
                [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), len(own)), pa.int32()),
                    pa.array(np.full(m, n), pa.int64()),
                    far.take(pa.array(each)),
                    pa.array((centre.rows(x) @ onto).ravel()),
                    pa.array(np.tile(explained, len(own))),
                    pa.array(np.full(m, error)),
                ],
                [f.split()[0] for f in schema.replace("decimal(38, 0)", "decimal").split(", ")],
            )

    return rows.mapInArrow(project, schema)
