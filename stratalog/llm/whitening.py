"""Embedding whitening by a bit-sliced scatter.

Entries become integers x = floor(1024 c) + 100000. Their cross-products are counted by bits: the rows of a batch are shifted per
dimension by the batch' least value, and bit b of dimension d of all rows is packed into 64-bit words, the plane (d, b). The number of rows
in which two planes both have their bit is a popcount of their AND; weighted by the powers of both planes these counts add up to the exact cross-products
of the batch, and the shifts are put back by its exact sums. Batches add up in Spark as decimals; only n, S and the products of
dimension pairs, whose number depends on the dimension alone, reach the driver. There n * products - S S' centres the
scatter as integers before it becomes floating point and eigh sees it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.columns import require

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows in a slice of the scatter: planes of so many bits stay in a core's cache. Words of planes counted at a time.
SLICE, BLOCK = 1 << 13, 1 << 18
#: Entries beyond this cannot become a long with the shift.
LARGEST = 2.0**51


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are numbers of a size that becomes a long."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)), F.lit(False)))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def integers(column: pa.Array, dimension: int) -> np.ndarray:
    """The rows of x."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, dimension)


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the columns of a non-negative matrix, rows packed into words: (words, dimension, bit) of each plane, empty ones left out."""
    rows, dims = y.shape
    bits = int(y.max(initial=0)).bit_length()
    padded = np.zeros((-(-rows // 64) * 64, dims), np.int64)
    padded[:rows] = y
    words, of, bit = [], [], []
    for b in range(bits):
        packed = np.packbits(np.ascontiguousarray((padded >> b & 1).astype(np.uint8).T), axis=1, bitorder="little").view(np.uint64)
        full = np.flatnonzero(packed.any(axis=1))
        words.append(packed[full])
        of.append(full)
        bit.append(np.full(len(full), b))
    if not words:
        return np.zeros((0, len(padded) // 64), np.uint64), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(words), np.concatenate(of), np.concatenate(bit)


def cross_products(x: np.ndarray) -> list[list[int]]:
    """Exact sums of x_i * x_j over the rows, by AND-popcounts of shifted bit planes."""
    rows, dims = x.shape
    low = x.min(axis=0)
    words, of, bit = planes(x - low)
    total = np.zeros((dims, dims), object)
    step = max(1, BLOCK // max(1, words.size))
    for k in range(0, len(words), step):
        both = np.bitwise_count(words[k : k + step, None, :] & words[None, :, :]).sum(axis=2, dtype=np.int64)
        for line, i, b in zip(both, of[k : k + step], bit[k : k + step]):
            for c in range(int(bit.max()) + 1):
                at = bit == c
                total[i, of[at]] += line[at].astype(object) << int(b + c)
    sums = [int(s) for s in (x - low).sum(axis=0)]
    shift = [int(v) for v in low]
    return [[int(total[i, j]) + shift[i] * sums[j] + shift[j] * sums[i] + rows * shift[i] * shift[j] for j in range(dims)] for i in range(dims)]


@dataclass(frozen=True)
class Whitening:
    """What is fitted: n, exact sums, and per component its eigenvalue, share and direction (columns)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    shares: np.ndarray
    directions: np.ndarray

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections of centred rows over the roots of the eigenvalues; 0 along a component without variance."""
        mean = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        root = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.inf)
        return ((x - mean) - rest) @ self.directions / root

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the sum over dimensions of (n x - S)^2, exact."""
        widest = max((abs(self.n * int(v) - s) for col, s in zip(x.T, self.sums) for v in (col.min(initial=0), col.max(initial=0))), default=0)
        if len(x) == 0:
            return []
        if widest**2 * self.dimension < 2**63 and self.n * int(np.abs(x).max(initial=0)) < 2**62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(v) for v in (exact**2).sum(axis=1)]


def usual_dimension(vectors: DataFrame) -> int:
    """The commonest length of the vectors, the greater of equally common ones; 0 without vectors."""
    counts = vectors.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    best = counts.agg(F.max(F.struct("rows", "size")).alias("best")).first()["best"]
    return best["size"] if best else 0


def scatter(vectors: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and the cross-products of all vectors, exact. Reduced per task, then by Spark; the driver gets one number per pair of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, [0] * dimension, Counter()
        for batch in batches:
            x = integers(batch.column(0), dimension)
            for k in range(0, len(x), SLICE):
                part = x[k : k + SLICE]
                n += len(part)
                sums = [a + int(b) for a, b in zip(sums, part.sum(axis=0))]
                for i, line in enumerate(cross_products(part)):
                    for j in range(i + 1):
                        total[i, j] += line[j]
        if n:
            # i = -1: the number of rows; j = -1: sums.
            rows = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums)), *((i, j, v) for (i, j), v in total.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([str(r[2]) for r in rows], pa.string())], ["i", "j", "v"])

    parts = vectors.select("vector").mapInArrow(run, "i int, j int, v string")
    added = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    found = {(r["i"], r["j"]): int(r["v"]) for r in added}
    products = [[found.get((max(i, j), min(i, j)), 0) for j in range(dimension)] for i in range(dimension)]
    return found.get((-1, -1), 0), [found.get((i, -1), 0) for i in range(dimension)], products


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a column ``vector`` of usable vectors of one length (`prepared`); None without rows."""
    first = vectors.select(F.size("vector").alias("size")).first()
    if first is None:
        return None
    n, sums, products = scatter(vectors, first["size"])
    # Exact integers n * products - S S', then correctly rounded quotients.
    v = np.array([[(n * p - a * b) / (n * n) for p, b in zip(line, sums)] for line, a in zip(products, sums)], np.float64)
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    trace = sum(v[i, i] for i in range(len(v)))
    # An eigenvalue within rounding of zero is one without variance.
    values = np.where(values > len(v) * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    keep = slice(0, min(components, len(values)))
    shares = values[keep] / trace if trace > 0 else np.zeros(len(values[keep]))
    return Whitening(n, tuple(sums), values[keep], shares, directions[:, keep])


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity, measured over all rows."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, n = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            w = model.whiten(integers(batch.column(0), model.dimension))
            total, squares, n = total + w.sum(axis=0), squares + w.T @ w, n + len(w)
        if n:
            numbers = np.concatenate([total, squares.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers)), pa.int32()), pa.array(numbers)], ["at", "v"])

    parts = vectors.select("vector").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    added = np.zeros(k + k * k)
    for r in parts.collect():
        added[r["at"]] = r["v"]
    mean, squares = added[:k] / model.n, added[k:].reshape(k, k) / model.n
    # The means are within rounding of 0, so taking them off now is centring.
    return float(np.abs(squares - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def prepared(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that remain."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    return rows


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: vec_id, component (from 1), n, deviation (decimal(38,0)), whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null, non-finite or (beyond 2^51) unshiftable entries are dropped. Where lengths differ, the commonest
    length counts (the greater of equally common ones) and the others are dropped. A component without variance (equal vectors, or
    fewer vectors than components) gives 0 for whitened and explained. Null and repeated vec_id pass through, other columns are not read; an
    empty table gives no rows.
    """
    require(df, vec_id, vector)
    rows = prepared(df, vec_id, vector)
    rows = rows.where(F.size("vector") == usual_dimension(rows))
    schema = (f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    model = fit(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                x = integers(part.column(1), model.dimension)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                deviation = pa.array([Decimal(d) for d in model.deviations(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n)),
                     deviation.take(each), pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.shares, len(x))), pa.array(np.full(len(x) * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
